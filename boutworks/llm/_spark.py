"""Session helpers: shared scratch tables, bounded Arrow slices."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and one machine runs all."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _LOCAL.setdefault("root", tempfile.mkdtemp(prefix="scratch-"))
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path  # type: ignore[attr-defined]
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables written by materialize() which nothing needs any more."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            spark = df.sparkSession
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            with contextlib.suppress(Exception):
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def column_of(batch: pa.RecordBatch, path: str) -> pa.Array:
    """A column, or `row.name`: a field of the struct column `row`."""
    head, _, field = path.partition(".")
    column = batch.column(head)
    return column.field(field) if field else column


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a piece holds at most `limit` bytes of `column`, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.cumulative_sum(pc.fill_null(pc.binary_length(column_of(batch, column)), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
        start, base = 0, 0
        while start < n:
            stop = max(start + 1, int(size.searchsorted(base + limit, "right")))
            yield batch.slice(start, stop - start)
            base, start = int(size[stop - 1]), stop
    trim()


def trim() -> None:
    """Give freed memory of a Python worker back to the machine: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_KEPT: dict = {}


def forget() -> None:
    if _KEPT:
        _KEPT.clear()
        trim()


def kept(key, make: Callable):
    """What a Python worker keeps from task to task, one thing at a time: another operator's goes."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def small_batches(df: DataFrame) -> DataFrame:
    """df with bounded batches of the Parquet reader, and of bytes between the JVM and Python, for long texts.

    By default they count thousands of rows however long. These are options of a session, so the frame goes to a copy of
    its own: the caller's keeps what it has. A smaller setting stays.
    """
    spark = df.sparkSession
    small = {}
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", 4 * SLICE_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", 512)):
        if int(str(spark.conf.get(key, str(most + 1))).rstrip("bB")) > most:
            small[key] = str(most)
    if not small:
        return df
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for key, value in small.items():
        own.conf.set(key, value)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().logical()), own)


def map_slices(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for piece in slices(batches, column):
            yield fn(piece)

    return small_batches(df).mapInArrow(run, schema)


BROADCAST_ROWS = 400_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id is in `ids` (a written table); ids go to all executors only if they are few."""
    gone = ids.select(F.col("doc_id").alias("gone_id"))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def keep_rows(docs: DataFrame, stays: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """docs with the rows for whose texts `stays` is true, row by row: ids play no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            yield piece.filter(pa.array(stays(piece.column("text")), pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)


def first_of_groups(docs: DataFrame, labels: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """docs with one row of each group that `labels` finds: the smallest doc_id, rows without one after all others.

    labels: rows (doc_id, text) to (doc_id, label), where label is the smallest doc_id of a row's group. Where
    each row has a doc_id of its own, the others are dropped by it. Else the rows are numbered in a written copy, the
    numbers stand for ids, and one row of each group stays all the same.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("doc_id is null or n > 1").isEmpty():
        told = labels(docs.select("doc_id", "text"))
        return without(docs, materialize(told.where("doc_id <> label").select("doc_id"), f"{name}-gone"))
    numbered = materialize(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("doc_id")), f"{name}-numbered")
    told = labels(numbered.select("doc_id", F.col("row.text").alias("text")))
    own = numbered.select("doc_id", F.col("row.doc_id").cast("long").alias("own"))
    order = F.struct(F.col("own").isNull(), "own", "doc_id")
    kept_ = told.join(own, "doc_id").groupBy("label").agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias("kept_id"))
    kept_ = materialize(kept_, f"{name}-kept")
    return numbered.join(kept_, numbered["doc_id"] == kept_["kept_id"], "left_semi").select("row.*")
