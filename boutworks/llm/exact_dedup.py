"""Exact dedup by content-defined chunk recipes.

A text's white-space runs become one space; it is then cut where a rolling hash of the last 16 bytes has its low bits
clear. Chunks are deduplicated into a table of identifiers: 64-bit fingerprints, each verified to stand for one size and
one independent 64-bit check over the whole table. Were a fingerprint to stand for two contents, identifiers widen to
fingerprint, check and size. A text is the ordered list of its chunks' identifiers, and equal lists are equal texts; the
texts themselves are read once and never move, and their digest is for the result alone.

Groups are counted by list and salt, and told back by list and salt, so copies of one text are dealt to many tasks.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import first_of_groups, materialize, slices, small_batches
from ._text import SPACED, U, buffer, mix

WINDOW = 16
MEAN_BITS = 11
LEAST, MOST = 512, 16384
#: Each text's copies are dealt to at least so many parts, and to one more for each ROWS_A_SALT rows of the table.
SALTS, ROWS_A_SALT = 64, 100_000
_P = U(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)


def normalized(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column with each run of white space as one space; null is empty."""
    raw, off = buffer(column)
    space = ~SPACED[raw]
    again = space.copy()
    again[1:] &= space[:-1]
    if len(again):
        again[0] = False
    cuts = off[1:-1]
    again[cuts[cuts < len(raw)]] = False
    out = np.where(space, np.uint8(32), raw)[~again]
    kept = np.concatenate(([0], np.cumsum(~again)))
    return out, kept[off]


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling hash's multiplier and of its inverse."""
    up, down = np.full(n, _P), np.full(n, U(pow(int(_P), -1, 2**64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def cut_points(raw: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end, by the 16 bytes before them."""
    if len(raw) < WINDOW:
        return np.zeros(0, np.int64)
    up, down = _powers((len(raw) >> 18) + 1 << 18)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up[: len(raw)], out=sums[1:])
    rolled = (sums[WINDOW:] - sums[:-WINDOW]) * down[: len(raw) - WINDOW + 1]
    return np.flatnonzero(mix(rolled) >> U(64 - MEAN_BITS) == 0) + WINDOW


def chunk_ends(points: np.ndarray, a: int, b: int) -> list[int]:
    """Ends of the chunks of bytes a to b: the next cut point after LEAST bytes, MOST at the latest."""
    ends, at = [], a
    points = points[np.searchsorted(points, a + WINDOW) : np.searchsorted(points, b)]
    while b - at > LEAST:
        k = np.searchsorted(points, at + LEAST)
        end = int(min(points[k] if k < len(points) else b, at + MOST, b))
        ends.append(end)
        at = end
    return ends + [b] if at < b else ends


def recipes(docs: DataFrame, fingerprint_bits: int = 64) -> DataFrame:
    """(row, doc_id, text_sha256, chunks: array of (fp, check, size)) for each row; row is a number of its own."""
    shift = 64 - fingerprint_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for piece in slices(batches, "text"):
            raw, off = normalized(piece.column("text"))
            points, data = cut_points(raw), memoryview(raw)
            sha, fps, checks, sizes, ends = [], [], [], [], [0]
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                sha.append(hashlib.sha256(data[a:b]).hexdigest())
                for end in chunk_ends(points, a, b):
                    digest = hashlib.blake2b(data[a:end], digest_size=16).digest()
                    fps.append(int.from_bytes(digest[:8], "little", signed=True) >> shift)
                    checks.append(int.from_bytes(digest[8:], "little", signed=True))
                    sizes.append(end - a)
                    a = end
                ends.append(len(fps))
            chunks = pa.StructArray.from_arrays([pa.array(fps, pa.int64()), pa.array(checks, pa.int64()), pa.array(sizes, pa.int32())], names=["fp", "check", "size"])
            rows = pa.array(np.arange(row, row + piece.num_rows))
            row += piece.num_rows
            yield pa.RecordBatch.from_arrays([rows, piece.column("doc_id"), pa.array(sha, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chunks)], names=["row", "doc_id", "text_sha256", "chunks"])

    docs = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return docs.mapInArrow(run, "row long, doc_id long, text_sha256 string, chunks array<struct<fp: long, check: long, size: int>>")


def chunk_table(found: DataFrame) -> DataFrame:
    """(fp, check, size, n): the distinct chunks of some recipes, and how often each stands in them."""
    return found.select(F.explode("chunks").alias("c")).groupBy("c.fp", "c.check", "c.size").agg(F.count("*").alias("n"))


def identified(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """The recipes with `recipe`, the ordered identifiers of their chunks."""
    clash = not chunks.groupBy("fp").count().where("count > 1").isEmpty()
    recipe = F.flatten(F.transform("chunks", lambda c: F.array(c["fp"], c["check"], c["size"].cast("long")))) if clash else F.transform("chunks", lambda c: c["fp"])
    return found.select("row", "doc_id", "text_sha256", recipe.alias("recipe"))


def exact_groups(docs: DataFrame, fingerprint_bits: int = 64) -> DataFrame:
    """One row per row of docs: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after white-space runs become one space; a null is empty. The row with the smallest
    doc_id of equal texts stays: kept is true for one row of a group, also where rows repeat a doc_id and text. Rows
    without a doc_id count in their group and have a null kept, as in the SQL; keep_id is null if no row of a group has
    one. An empty table gives an empty one; other columns are ignored.
    """
    found = materialize(recipes(docs, fingerprint_bits), "dedup-recipes")
    chunks = materialize(chunk_table(found), "dedup-chunks")
    salts = max(SALTS, found.count() // ROWS_A_SALT)
    rows = identified(found, chunks).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    part = rows.groupBy("recipe", "salt").agg(F.min("doc_id").alias("lo"), F.min_by("row", "doc_id").alias("lo_row"), F.min("row").alias("first_row"), F.count("*").alias("n"))
    # Written once, so that all of a group's rows are told of the same one.
    part = materialize(part, "dedup-parts")
    whole = part.groupBy("recipe").agg(F.min("lo").alias("keep_id"), F.coalesce(F.min_by("lo_row", "lo"), F.min("first_row")).alias("keep_row"), F.sum("n").alias("group_size"))
    group = part.select("recipe", "salt").join(whole.where("group_size > 1"), "recipe")
    own = F.col("group_size").isNull()
    return rows.join(group, ["recipe", "salt"], "left").select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("doc_id").isNotNull(), own | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts: that of the smallest doc_id, rows without one coming last.

    Null and empty texts are equal to each other. Columns are as before; an empty table gives an empty one.
    """
    return first_of_groups(docs, lambda rows: exact_groups(rows).select("doc_id", F.col("keep_id").alias("label")), "dedup")
