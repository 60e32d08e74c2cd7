"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of common words are compared
with its language's references by the Jensen-Shannon distance (base 2, so 0 to 1). The
references are counted over all documents: class totals, and the ``COMMON`` most
frequent words of each language that came twice at least; a document's bins are those and the whole corpus's, which its language may lack.
A document is rejected where a distance exceeds its limit; the guards leave out documents too short for a histogram to
mean anything. A long one without any common word is as far from them as can be, at distance 1. The base rules (fewer than 50 words, over half of the words in repeated
three-word windows) reject regardless.

Null text counts as no words and fails the base rules. Every language has a reference of its own, however many there are;
null and empty languages have the whole corpus's. Repeated rows get equal verdicts, and rows that share a doc_id are judged each by its own text; ties among common words
go to the smaller word. Texts of any length are judged whole. An empty table gives no rows. Only doc_id, lang and text are read, so other columns
of any name don't matter (``kept_documents`` carries them in one struct).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

COMMON = 40
#: Limits of the two distances, and the least characters and words for them to be judged.
CHAR_LIMIT, WORD_LIMIT = 0.33, 0.80
LEAST_CHARS, LEAST_WORDS = 200, 100
#: Classes of characters; what is in none of them is counted as the rest.
CLASSES = {"lower": "[a-z]+", "upper": "[A-Z]+", "digit": "[0-9]+", "space": r"[\x20\x09-\x0D]+", "sign": r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"}
SYMBOLS = "[#*$%&|<>]+"
#: Repeated windows of a document up to which they are looked for one by one.
FEW = 24
#: Lists that the bins' words are dealt into by their hash, to look a word up in a short one.
DEALT = 128
ANY = ""  # the name of the whole corpus among the languages


def without(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that match ``pattern``."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def measured(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, words and the base measures, one row for each of ``docs``; ``carry`` names columns to keep as they are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(WORD))
    df = docs.select(*carry, "doc_id", "lang", text.alias("text"))
    df = df.select(*carry, "doc_id", "lang", "text", words(F.col("text")).alias("w"), lines.alias("lines"))
    # A window is its three words' hash; the values that come twice are neighbours once sorted.
    windows = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    df = stripped(df, *carry, "doc_id", "lang", "w", "lines")
    df = df.select(
        *carry,
        "doc_id",
        "lang",
        "text",
        "w",
        F.size("w").cast("long").alias("n_words"),
        (F.length("text") - class_counts()["space"]).cast("long").alias("word_chars"),
        without(F.col("rest"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
        F.array(*(class_counts()[k] for k in CLASSES)).alias("classes"),
    )
    df = df.withColumn("sorted", F.sort_array("windows"))
    df = df.withColumn("twice", F.array_distinct(F.filter("sorted", lambda x, j: x == F.get("sorted", j - 1)))).drop("sorted")
    # Few repeated values are looked for one by one; many are found by sorting the windows with their places.
    few = F.filter(F.transform("windows", lambda x, i: F.when(F.array_contains("twice", x), i)), lambda i: i.isNotNull())
    df = df.withColumn("placed", F.when(F.size("twice") > FEW, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    many = F.transform("placed", lambda x, j: F.when((x["h"] == F.get("placed", j - 1)["h"]) | (x["h"] == F.get("placed", j + 1)["h"]), x["i"]))
    starts = F.when(F.size("twice") == 0, F.array().cast("array<int>")).when(F.size("twice") <= FEW, few).otherwise(F.sort_array(F.filter(many, lambda i: i.isNotNull())))
    df = df.withColumn("starts", starts).drop("windows", "placed", "twice")
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n")),
    )["n"]
    return df.withColumn("n_repeat_words", covered).drop("starts")


def stripped(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` with text, "bare" (text without lower-case letters) and "rest" (that without white space): what
    is left gets shorter with each class, and so does the work of counting the next."""
    df = df.select(*columns, "text", F.regexp_replace("text", CLASSES["lower"], "").alias("bare"))
    return df.select(*columns, "text", "bare", F.regexp_replace("bare", CLASSES["space"], "").alias("rest"))


def class_counts() -> dict[str, Column]:
    """Characters of each class, from the columns of ``stripped``."""
    own = {"lower": F.length("text") - F.length("bare"), "space": F.length("bare") - F.length("rest")}
    own |= {k: without(F.col("rest"), CLASSES[k]) for k in ("upper", "digit", "sign")}
    return {k: c.cast("long") for k, c in own.items()} | {"total": F.length("text").cast("long")}


def common_words(docs: DataFrame) -> DataFrame:
    """lang, word, n of the most frequent words, by language and (as ANY) over all documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select(F.coalesce("lang", F.lit(ANY)).alias("lang"), F.explode(words(text)).alias("word"))
    counts = each.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    both = counts.select(F.explode(F.array_distinct(F.array(F.col("lang"), F.lit(ANY)))).alias("lang"), "word", "n")
    # A word that came once is common nowhere.
    both = both.groupBy("lang", "word").agg(F.sum("n").alias("n")).where("n > 1")
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return both.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= COMMON).drop("r")


def dealt(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(DEALT)).cast("int")


def references(docs: DataFrame) -> DataFrame:
    """A row for each language: ref_lang, ref_classes (probabilities), ref_words (word -> probability, 0 for words common in the corpus only)
    and ref_lists (the same words in ``DEALT`` lists)."""
    counts = class_counts()
    text = docs.select(F.coalesce("lang", F.lit(ANY)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    per = stripped(text, "lang").groupBy("lang").agg(*(F.sum(c).alias(k) for k, c in counts.items()))
    per = stored(per, "language-classes")
    # The whole corpus is the sum of all languages, and stands for those without a name.
    whole = per.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in counts)).select(F.lit(ANY).alias("lang"), *counts)
    per = per.where(F.col("lang") != ANY).unionByName(whole)
    own = F.array(*CLASSES, F.col("total") - sum((F.col(k) for k in CLASSES), F.lit(0)))
    classes = per.select(F.col("lang").alias("ref_lang"), F.transform(own, lambda x: x / F.greatest("total", F.lit(1))).alias("ref_classes"))
    top = stored(common_words(docs), "language-words")
    share = (F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).alias("q")
    lists = top.select("lang", "word", share).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("word", "q"))).alias("own"))
    # One row of ``COMMON`` words.
    common = lists.where(F.col("lang") == ANY).select(F.col("own.word").alias("common"))
    lists = lists.join(F.broadcast(common)).select(F.col("lang").alias("ref_lang"), "own", F.array_except("common", "own.word").alias("rest"))
    entries = F.concat("own", F.transform("rest", lambda w: F.struct(w.alias("word"), F.lit(0.0).alias("q"))))
    lists = lists.select("ref_lang", F.map_from_entries(entries).alias("ref_words"))
    refs = classes.join(lists, "ref_lang", "left").select("ref_lang", "ref_classes", F.coalesce("ref_words", F.create_map().cast("map<string,double>")).alias("ref_words"))
    lists = F.transform(F.sequence(F.lit(0), F.lit(DEALT - 1)), lambda i: F.filter(F.map_keys("ref_words"), lambda x: dealt(x) == i))
    # Written, so that the join with the documents knows its size.
    return stored(refs.withColumn("ref_lists", lists), "references")


def term(p: Column, q: Column) -> Column:
    """What a bin adds to twice the divergence."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return part(p) + part(q)


def distance(twice_divergence: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), twice_divergence / 2)))


def judged(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Base measures, ``char_distance`` and ``word_distance`` (null under the guards), base_failed and kept."""
    refs = references(docs)
    df = measured(docs.select(*carry, "doc_id", "lang", "text"), carry)
    df = df.withColumn("ref_lang", F.coalesce("lang", F.lit(ANY))).join(refs, "ref_lang", "left")
    # Common words of the document, sorted: a run of equal words is a bin.
    own = F.sort_array(F.filter("w", lambda x: F.array_contains(F.get("ref_lists", dealt(x)), x)))
    df = df.select("*", F.length("text").alias("n_chars"), own.alias("own")).drop("w", "text")
    other = F.col("n_chars") - F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    shares = F.transform(F.concat("classes", F.array(other.cast("long"))), lambda x: x / F.col("n_chars"))
    chars = F.aggregate(F.zip_with(shares, "ref_classes", term), F.lit(0.0), lambda a, x: a + x)
    starts = F.filter(F.transform("own", lambda x, j: F.when((j == 0) | (x != F.get("own", j - 1)), j)), lambda x: x.isNotNull())
    df = df.withColumn("starts", starts)
    bins = F.transform(
        "starts",
        lambda s, j: F.struct(
            ((F.coalesce(F.get("starts", j + 1), F.size("own")) - s) / F.size("own")).alias("p"),
            F.coalesce(F.element_at("ref_words", F.get("own", s)), F.lit(0.0)).alias("q"),
        ),
    )
    df = df.withColumn("bins", bins)
    # A reference word that the document lacks adds its whole share.
    words_twice = F.aggregate("bins", F.lit(1.0), lambda a, b: a - b["q"] + term(b["p"], b["q"]))
    df = df.withColumn("char_distance", F.when(F.col("n_chars") >= LEAST_CHARS, distance(chars)))
    words_far = F.when(F.size("own") > 0, distance(words_twice)).otherwise(1.0)
    df = df.withColumn("word_distance", F.when((F.col("n_words") >= LEAST_WORDS) & (F.size("ref_words") > 0), words_far))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = (F.coalesce("char_distance", F.lit(0.0)) > CHAR_LIMIT) | (F.coalesce("word_distance", F.lit(0.0)) > WORD_LIMIT)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return df.select(*carry, *columns, failed.alias("base_failed"), (~failed & ~far).alias("kept"), "char_distance", "word_distance")


def rules(docs: DataFrame) -> DataFrame:
    return judged(docs).drop("char_distance", "word_distance")


def kept_documents(docs: DataFrame) -> DataFrame:
    """``docs``, with all columns, without the rejected rows."""
    rows = docs.select("doc_id", "lang", "text", F.struct(*docs.columns).alias("__row"))
    # A predicate would be pushed below the measures and copy them into itself; no predicate passes a column that counts rows.
    whole = judged(rows, ("__row",)).withColumn("__n", F.monotonically_increasing_id())
    return whole.where("kept AND __n >= 0").select("__row.*")
