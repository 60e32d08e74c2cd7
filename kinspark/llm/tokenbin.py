"""Token ids in binary files, and back.

``write`` sorts documents by doc_id into range partitions, encodes each text as
the tokenizers library does (see ``pieces``), appends an end id, and packs runs of documents into
segments: a document index and the ids in range-coded blocks (see ``rangecoder``).
A file is a sequence of segments, written through Spark's own writer, so any
store that Spark writes to will do and a lost executor's half-written file is never
committed. File names carry the partition, so reading in name order is reading in doc_id
order.

Segment, little-endian: b"KSG1", bytes of the index (u32), bytes of the blocks (u32), checksum of
the index (u32); the index, deflated: number of documents (u32), a byte for each that is
1 where its doc_id is null, doc_ids (i64), numbers of ids (u32); the blocks; a line feed.

Null and empty texts have the end id only. Rows that repeat a doc_id are kept, next to
each other; a null doc_id sorts first. A text longer than a segment makes a segment of
its own, with as many blocks as it takes. An empty table writes no segment and reads back empty. Only doc_id
and text are read, so other columns of any name don't matter. Vocabularies of over 65,536 ids raise ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rangecoder
from .bpe import slices
from .common import id_and_text, new_path, stored
from .pieces import PieceEncoder, load

#: Ids of a segment at most, unless a slice of texts has more; segments of a file; bytes of text encoded at once.
SEGMENT_IDS = rangecoder.GROUP * rangecoder.BLOCK
SEGMENTS_A_FILE, SLICE = 8, 1 << 20
HEAD = struct.Struct("<4sIII")


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, alphabet: int) -> bytes:
    """A segment of documents with ``counts`` ids each."""
    index = zlib.compress(
        struct.pack("<I", len(doc_ids))
        + bytes(i is None for i in doc_ids)
        + np.array([i or 0 for i in doc_ids], "<i8").tobytes()
        + counts.astype("<u4").tobytes(),
        1,
    )
    blocks = rangecoder.encode(ids, alphabet)
    return HEAD.pack(b"KSG1", len(index), len(blocks), zlib.crc32(index)) + index + blocks


def unpack(data: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """doc_ids, numbers of ids and all ids of each segment of a file."""
    at = 0
    while at < len(data):
        magic, n_index, n_blocks, crc = HEAD.unpack_from(data, at)
        at += HEAD.size
        raw = data[at : at + n_index]
        if magic != b"KSG1" or zlib.crc32(raw) != crc:
            raise rangecoder.DamagedBlock("index")
        index = zlib.decompress(raw)
        (n,) = struct.unpack_from("<I", index)
        null = index[4 : 4 + n]
        ids = np.frombuffer(index, "<i8", n, 4 + n).tolist()
        counts = np.frombuffer(index, "<u4", n, 4 + 9 * n).astype(np.int64)
        yield [None if z else i for i, z in zip(ids, null)], counts, rangecoder.decode(data[at + n_index : at + n_index + n_blocks])
        at += n_index + n_blocks + 1


def runs(batches: Iterable[pa.RecordBatch], encoder: PieceEncoder, end: int) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """doc_ids, numbers of ids and ids of documents, in runs of at most ``SEGMENT_IDS`` where a slice of texts allows."""
    held: list[tuple[list[int | None], np.ndarray, np.ndarray]] = []
    size = 0

    def taken() -> tuple[list[int | None], np.ndarray, np.ndarray]:
        return [i for own, _, _ in held for i in own], np.concatenate([c for _, c, _ in held]), np.concatenate([x for _, _, x in held])

    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            ids, counts = encoder.encode(batch.column("text"))
            ids = np.insert(ids, np.cumsum(counts), end)
            if held and size + len(ids) > SEGMENT_IDS:
                yield taken()
                held, size = [], 0
            held.append((batch.column("doc_id").to_pylist(), counts + 1, ids))
            size += len(ids)
    if held:
        yield taken()


def write(docs: DataFrame, path: str, vocabulary: str, end: int) -> None:
    """Files of all documents under ``path``, in ascending doc_id order by file name."""
    source = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(vocabulary)
        if encoder.size > 1 << 16:
            raise ValueError(f"ids must be below 65,536; the vocabulary has {encoder.size}")
        for some in runs(batches, encoder, end):
            yield pa.RecordBatch.from_pydict({"segment": pa.array([pack(*some, encoder.size)], pa.binary())})

    # The text writer puts a line feed after each value and leaves its bytes alone.
    segments = ordered.mapInArrow(run, "segment binary").select(F.col("segment").cast("string").alias("value"))
    segments.write.option("maxRecordsPerFile", SEGMENTS_A_FILE).text(path)


def files(spark: SparkSession, path: str) -> DataFrame:
    """file (its order as struct of numbers) and content."""
    name = F.col("path")
    order = F.struct(F.regexp_extract(name, r"part-(\d+)-", 1).cast("long").alias("part"), F.regexp_extract(name, r"\.?c(\d+)\.", 1).cast("long").alias("n"))
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(order.alias("file"), "content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, place (in the file), doc_id, before (ids of the file's earlier documents) and ids (binary, little-endian uint32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                place = before = 0
                for docs, counts, ids in unpack(content):
                    ends = np.cumsum(counts)
                    places = pa.py_buffer(np.append(0, 4 * ends).astype(np.int64))
                    wide = pa.Array.from_buffers(pa.large_binary(), len(docs), [None, places, pa.py_buffer(ids.astype("<u4"))])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array([file["part"]] * len(docs), pa.int64()),
                            "n": pa.array([file["n"]] * len(docs), pa.int64()),
                            "place": pa.array(np.arange(place, place + len(docs))),
                            "doc_id": pa.array(docs, pa.int64()),
                            "before": pa.array(before + ends - counts),
                            "ids": wide.cast(pa.binary()),
                        }
                    )
                    place, before = place + len(docs), before + int(counts.sum())

    return files(spark, path).mapInArrow(run, "part long, n long, place long, doc_id long, before long, ids binary")


def digests(docs: DataFrame, vocabulary: str, end: int = 2) -> DataFrame:
    """Writes files to the shared folder, reads them back, and tells each document's place, number and checksum of ids."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, path, vocabulary, end)
    back = read(spark, path)
    rows = back.select("part", "n", "doc_id", "before", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    rows = stored(rows, "token-rows")
    # Ids before each file: within its partition first, so that one task sees a row for each partition only.
    sums = rows.groupBy("part", "n").agg(F.sum("n_tokens").alias("total"))
    own = F.sum("total").over(W.partitionBy("part").orderBy("n")) - F.col("total")
    parts = sums.groupBy("part").agg(F.sum("total").alias("whole"))
    parts = parts.select("part", (F.sum("whole").over(W.orderBy("part")) - F.col("whole")).alias("ahead"))
    sums = sums.select("part", "n", own.alias("own")).join(parts, "part").select("part", "n", (F.col("own") + F.col("ahead")).alias("earlier"))
    out = rows.join(sums, ["part", "n"])
    return out.select("doc_id", (F.col("earlier") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
