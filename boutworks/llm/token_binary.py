"""Token ids in files: frequency-ranked ids, byte-aligned lengths in separate control bytes.

Files, and blocks within a file, are in ascending doc_id order, rows without a doc_id first. A file row is a block of
documents: `start` (ids of all documents before it), the documents' doc_ids and lengths, `control` (two bits a value, four values a byte: its bytes less one) and `data` (the little-endian bytes
of each value's frequency rank). A block is decoded with one table lookup a control byte. `vocabulary` maps ranks to ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import materialize, release, scratch_path, shuffle_partitions, slices, small_batches
from .tokenize import tokenizer

BLOCK_BYTES = 4 << 20
#: Bytes of the four values of each control byte.
LENGTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], axis=1).astype(np.uint8)


def encode_block(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of non-negative numbers below 2**32."""
    values = np.ascontiguousarray(values, "<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.tobytes(), data.tobytes()


def decode_block(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)))
    at = np.cumsum(size, dtype=np.int64) - size
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


_RAW = "part int, base long, doc_ids array<long>, sizes binary, ids binary"
_FILE = "start long, doc_ids array<long>, sizes binary, control binary, data binary"


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Tokenize whole texts and write `path`/blocks and `path`/vocabulary, both Parquet, by Spark's own writers.

    Null texts count as empty, so a document has its end id at least. Rows without a doc_id come first and keep null.
    Rows with equal doc_id, or none, stay apart; a hash of the text orders them. An empty table gives files without rows.
    Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(Path(tokenizer_path).read_text())
    partitions = shuffle_partitions(spark)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(partitions, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, base = tokenizer(content.value), TaskContext.get().partitionId(), 0
        for piece in slices(batches, "text", BLOCK_BYTES):
            ids, off = tok.encode(piece.column("text"))
            sizes = np.diff(off) + 1
            ids = np.insert(ids, off[1:], end_id)
            doc_ids = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([base], pa.int64()), doc_ids, *(pa.array([x.tobytes()], pa.binary()) for x in (sizes.astype("<u4"), ids.astype(tok.dtype)))], names=["part", "base", "doc_ids", "sizes", "ids"])
            base += len(ids)

    raw = materialize(small_batches(ordered).mapInArrow(tokens, _RAW), "token-ids")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(content.value)
        seen = np.zeros(max(tok.size, end_id + 1), np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                got = np.bincount(np.frombuffer(x.as_py(), tok.dtype))
                seen[: len(got)] += got
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(seen[used], pa.int64())], names=["id", "n"])

    # At most one row an entry of the vocabulary.
    ranked = raw.select("ids").mapInArrow(counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    by_rank = np.array([r.id for r in sorted(ranked, key=lambda r: (-r.n, r.id))], np.int64)
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    ranks = spark.sparkContext.broadcast(rank)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(by_rank)], "rank int, id int").coalesce(1).write.parquet(f"{path}/vocabulary")

    # One number for each partition of the range exchange.
    width = tokenizer(content.value).dtype.itemsize
    sizes = raw.groupBy("part").agg(F.sum(F.length("ids")).alias("n")).collect()
    before, at = {}, 0
    for r in sorted(sizes, key=lambda r: r.part):
        before[r.part] = at
        at += r.n // width

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(content.value)
        for batch in batches:
            for i in range(batch.num_rows):
                part, base, ids = (batch.column(c)[i].as_py() for c in ("part", "base", "ids"))
                control, data = encode_block(ranks.value[np.frombuffer(ids, tok.dtype)])
                yield pa.RecordBatch.from_arrays([pa.array([base + before[part]], pa.int64()), *(batch.column(c).slice(i, 1) for c in ("doc_ids", "sizes")), *(pa.array([x], pa.binary()) for x in (control, data))], names=["start", "doc_ids", "sizes", "control", "data"])

    # Tables are read in any order, so that blocks are put in theirs once more, as bytes.
    blocks = raw.repartitionByRange(partitions, "part", "base").sortWithinPartitions("part", "base")
    blocks.mapInArrow(encoded, _FILE).write.parquet(f"{path}/blocks")
    release(raw)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files."""
    vocabulary = spark.sparkContext.broadcast(np.array([r.id for r in spark.read.parquet(f"{path}/vocabulary").orderBy("rank").collect()], "<u4"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, own, control, data = (batch.column(c)[i].as_py() for c in ("start", "sizes", "control", "data"))
                sizes = np.frombuffer(own, "<u4").astype(np.int64)
                ids = vocabulary.value[decode_block(control, data, int(sizes.sum()))]
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[b - n : b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids").slice(i, 1).flatten(), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.read.parquet(f"{path}/blocks").mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the files, below the scratch folder unless a path is given, and read them back."""
    path = path or scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id)
    return read_token_files(docs.sparkSession, path)
