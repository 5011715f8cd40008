"""Packing by shortest-pack-first over the length histogram.

Documents are cut into pieces of at most `size` tokens. Only the histogram of piece lengths reaches the driver (`size`
numbers): lengths are placed longest first, each into the shortest open packs, by updating counts of packing patterns.
Patterns are joined back to pieces by each piece's rank among those of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialize, slices, small_batches
from .tokenize import tokenizer

BLOCK_BYTES = 2 << 20
_PIECES = "part int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of packing patterns that hold each length as often as the histogram says."""
    open_: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(size + 1)]  # by room left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = size
        while left and room >= length:
            if not open_[room]:
                room -= 1
                continue
            count, pattern = open_[room].pop()
            used = min(count, left)
            if used < count:
                open_[room].append((count - used, pattern))
            open_[room - length].append((used, (*pattern, length)))
            left -= used
        each = size // length  # a new pack is the only one that fits, so the next pieces of this length join it
        for count, pieces_ in ((left // each, each), (1, left % each)):
            if count and pieces_:
                open_[size - length * pieces_].append((count, (length,) * pieces_))
    return [x for packs in open_ for x in packs]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """For ranges of ranks of each length: the first sequence and the offset there, sorted by (length, rank)."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            rank = taken.get(length, 0)
            taken[length] = rank + count
            rows.append((length << 44 | rank, base - rank, offset))
            offset += length
        base += count
    rows.sort()
    got = np.array(rows, np.int64).reshape(-1, 3)
    return {"key": got[:, 0], "sequence": got[:, 1], "offset": got[:, 2]}


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, size: int) -> DataFrame:
    """Pieces of the ids of each whole text with its end id: at most `size` each, in turn."""
    content = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = tokenizer(content.value), TaskContext.get().partitionId()
        for piece in slices(batches, "text", BLOCK_BYTES):
            ids, off = tok.encode(piece.column("text"))
            ids = np.insert(ids, off[1:], end_id).astype("<u4")
            off = off + np.arange(len(off))
            rows = []
            for doc_id, a, b in zip(piece.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                rows += [(part, doc_id, s - a, min(size, b - s), zlib.crc32(ids[s : min(s + size, b)]), b - a) for s in range(a, b, size)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.int64()] * 5), strict=True)], names=["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, _PIECES)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, pad.

    Null and empty texts are one piece of the end id. Repeated rows are packed as often as they occur; ties in length
    are ranked by part, doc_id and start. An empty table gives an empty one. Other columns are ignored.
    `pad` is what the sequence lacks to `size` (0 where its length is a power of two), on its first piece, else 0.
    """
    spark = docs.sparkSession
    found = materialize(pieces(docs, tokenizer_path, end_id, size), "pack-pieces")
    per_part = materialize(found.groupBy("length", "part").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    patterns = pack_histogram(histogram, size)
    table = slots(patterns)
    fill = np.array([sum(p) for _, p in patterns], np.int64)
    first = np.cumsum([0] + [c for c, _ in patterns])
    told = spark.sparkContext.broadcast((table, fill, first))
    before = per_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start")) - 1)
    ranked = ranked.join(before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before")), ["length", "part"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, fill, first = told.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(table["key"], length << 44 | rank, "right") - 1
            sequence, offset = table["sequence"][at] + rank, table["offset"][at]
            full = fill[np.searchsorted(first, sequence, "right") - 1] if len(sequence) else sequence
            pad = np.where((offset == 0) & (full & (full - 1) != 0), size - full, 0)
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(pad, pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "pad"])

    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).cast("long").alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, pad long")
