"""Language identification by compression.

Each language has a raw-content zstandard dictionary: text of that language. A
document is compressed once under each dictionary and takes the language whose
output is smallest. It is cut into pieces of ``PIECE`` bytes, each compressed by itself, so
that the dictionary counts to the end of a long text. Where the runner-up is within ``MARGIN`` of it, ``rejected``
is true (the prediction stays, the caller may drop it).

A longer dictionary would win by its size alone, so only dictionaries of one size are compared: a language's
dictionary has the largest of ``SIZES`` that its training text fills. Languages of the largest size are compared
first; the best of them then meets those of each lesser size with its own dictionary cut to that size. A rare language
thus takes nothing from the others.

Training reads a bounded sample: per language at most ``SAMPLE`` distinct texts, those
with the smallest hash of their own content, so the choice depends on text alone and copies count once. Whole texts
follow each other in that order until the dictionary is full. The driver holds one dictionary for each language.
Null texts and texts without a letter give ``und`` with score 0. With nothing to
learn from, every document is ``und``. Ties go to the language first in order of
name. Equal rows get equal results, each row by its own text where a doc_id repeats; an empty table gives no rows. Only doc_id, text
and lang are read, so other columns of any name don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, smallest, stored

#: Bounds of the training sample: texts per language, and bytes of a dictionary, largest first.
SAMPLE = 256
SIZES = tuple((110 << 10) >> k for k in range(11))
MARGIN = 0.01
LEVEL = 3
PIECE = 2048
LETTER = regex.compile(r"\p{L}")


def train(docs: DataFrame, sizes: tuple[int, ...] = SIZES) -> dict[str, bytes]:
    """Dictionaries by language from rows with text and lang."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    # Hashes alone are ranked; the texts of the chosen ones are fetched then.
    # Written first, so that the join knows how little it is.
    chosen = stored(smallest(rows.select("lang", "h").distinct(), "lang", SAMPLE, "h"), "language-sample")
    texts = rows.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    # Every letter has a byte at least: texts after so many letters cannot be in the dictionary.
    letters = F.length(F.regexp_replace("text", r"\P{L}+", "")).cast("long")
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    needed = texts.withColumn("n", letters).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < sizes[0])
    held: dict[str, bytes] = {}
    for r in needed.select("lang", "h", "text").orderBy("lang", "h").toLocalIterator():
        if len(held.get(r["lang"], b"")) < sizes[0]:
            held[r["lang"]] = held.get(r["lang"], b"") + prepare(r["text"]) + b" "
    return {lang: x[: next((n for n in sizes if n <= len(x)), sizes[-1])] for lang, x in held.items()}


def prepare(text: str) -> bytes:
    """Letters decide: lower case, every run of other characters one space."""
    return " ".join(WORDS.findall(text.lower())).encode()


WORDS = regex.compile(r"[\p{L}\p{M}]+")


def coder(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, dict_size=len(dictionary), strategy=zstandard.STRATEGY_BTOPT, min_match=3, search_log=3, write_content_size=False, write_dict_id=False
    )
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries, self.langs = dictionaries, sorted(dictionaries)
        self.coders: dict[tuple[str, int], zstandard.ZstdCompressor] = {}
        #: Size -> languages with a dictionary of that size, largest first.
        self.levels: dict[int, list[str]] = {}
        for lang in sorted(self.langs, key=lambda x: (-len(dictionaries[x]), x)):
            self.levels.setdefault(len(dictionaries[lang]), []).append(lang)

    def output(self, lang: str, size: int, pieces: list[bytes]) -> int:
        """Bytes of the pieces under a language's dictionary, cut to ``size``."""
        if (lang, size) not in self.coders:
            self.coders[lang, size] = coder(self.dictionaries[lang][:size])
        compress = self.coders[lang, size].compress
        return sum(len(compress(p)) for p in pieces)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1 and whether the margin is narrow."""
        if text is None or not self.langs or not LETTER.search(text):
            return "und", 0.0, True
        data = prepare(text)
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        best, margin = None, None
        for size, langs in self.levels.items():
            found = sorted((self.output(x, size, pieces), x) for x in {*langs, *([best] if best else [])})
            if len(found) > 1:
                # The winner's bytes against the runner-up's, at one size; the narrowest of the rounds that the last winner was in counts.
                own = (found[1][0] - found[0][0]) / max(found[1][0], 1)
                margin = own if margin is None or found[0][1] != best else min(margin, own)
            best = found[0][1]
        if margin is None:
            return best, 1.0, False
        # Bits saved against the runner-up, as odds; ties score 1/2.
        return best, 0.5 + 0.5 * min(1.0, margin / 0.2), margin < MARGIN


def predict(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of whole texts."""
    source = id_and_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(shipped.value)
        for batch in batches:
            got = [c.predict(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "lang_pred": pa.array([x[0] for x in got], pa.string()),
                    "score": pa.array([x[1] for x in got], pa.float64()),
                    "rejected": pa.array([x[2] for x in got], pa.bool_()),
                }
            )

    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def held_out(modulus: int, remainder: int, id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder


def predictions(docs: DataFrame) -> DataFrame:
    rest = docs.where(~F.coalesce(held_out(4, 2), F.lit(False)))
    out = predict(docs, train(rest))
    return out.select("doc_id", F.coalesce(held_out(4, 2), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
