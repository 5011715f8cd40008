"""File sources and sinks: schema gates, capped reads, sorted and partitioned writes, publishing."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema_fingerprint(schema: T.StructType) -> str:
    """A digest of names, types, nullability and order."""
    told = [[f.name, f.dataType.simpleString(), f.nullable] for f in schema.fields]
    return hashlib.sha256(json.dumps(told, separators=(",", ":")).encode()).hexdigest()


def require_schema(df: DataFrame, want: T.StructType) -> DataFrame:
    """Names, types and order must equal the contract."""
    have = [(f.name, f.dataType) for f in df.schema.fields]
    if have != [(f.name, f.dataType) for f in want.fields]:
        raise ValueError(f"schema differs from the contract: {df.schema.simpleString()}")
    return df


def read_parquet(spark: SparkSession, paths: list[str], schema: T.StructType | None = None) -> DataFrame:
    """Files or folders, searched through; partition folders are not read as columns."""
    reader = spark.read.option("recursiveFileLookup", "true")
    return (reader.schema(schema) if schema else reader).parquet(*paths)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object a line, by a fixed schema; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def capped(df: DataFrame, cap: int) -> DataFrame:
    """df, or an error if it has more than cap rows; never a truncated read."""
    if df.limit(cap + 1).count() > cap:
        raise ValueError(f"more than {cap} rows")
    return df


def read_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Distinct values, one a line; a line that does not match is an error."""
    rows = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
    if not rows.where(~F.col("value").rlike(pattern)).isEmpty():
        raise ValueError("malformed line")
    return rows.distinct()


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls), as footer statistics would have them."""
    one = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])).alias("s")).select("s.*")


def write_sorted(df: DataFrame, path: str, keys: list[str], rows_a_file: int = 0) -> None:
    """Range-partitioned and sorted, zstandard; files are in key order and one task never holds all rows."""
    out = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("compression", "zstd").mode("errorifexists")
    (out.option("maxRecordsPerFile", rows_a_file) if rows_a_file else out).parquet(path)


def write_members(df: DataFrame, path: str, member: str, order: str) -> None:
    """One ordered folder for each member."""
    df.repartition(member).sortWithinPartitions(member, order).write.partitionBy(member).option("compression", "zstd").mode("errorifexists").parquet(path)


def write_not_empty(df: DataFrame, path: str) -> None:
    """An empty part is an error."""
    if df.isEmpty():
        raise ValueError("an empty part")
    df.write.mode("errorifexists").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def publish(spark: SparkSession, workspace: str, destination: str) -> None:
    """Rename within one file system; an existing destination is never overwritten."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(workspace), jvm.org.apache.hadoop.fs.Path(destination)
    fs = src.getFileSystem(conf)
    if fs.exists(dst):
        raise FileExistsError(destination)
    if not fs.rename(src, dst):
        raise OSError(f"could not publish {destination}")


def write_manifest(payload: dict, path: str) -> str:
    """Canonical JSON through a temporary file; returns its digest."""
    data = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()
    part = Path(f"{path}.{uuid.uuid4().hex}")
    part.write_bytes(data)
    os.replace(part, path)
    return hashlib.sha256(data).hexdigest()


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of each file, read by the executors."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def archive_members(path: str, suffix: str = ".parquet", extra: tuple[str, ...] = ()) -> list[str]:
    """Member names of a flat archive: unique, without folders, of one kind but for `extra`."""
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
    if len(set(names)) != len(names) or any("/" in n or "\\" in n for n in names):
        raise ValueError("archive members must be unique and flat")
    if odd := [n for n in names if not n.endswith(suffix) and n not in extra]:
        raise ValueError(f"unexpected members: {odd}")
    return sorted(n for n in names if n.endswith(suffix))


@contextlib.contextmanager
def extracted(path: str, member: str, folder: str, chunk: int = 8 << 20) -> Iterator[tuple[str, str]]:
    """(file, sha256) of a member extracted in chunks; the file goes afterwards."""
    out, digest = Path(folder) / member, hashlib.sha256()
    try:
        with zipfile.ZipFile(path) as z, z.open(member) as src, out.open("wb") as dst:
            while data := src.read(chunk):
                digest.update(data)
                dst.write(data)
        yield str(out), digest.hexdigest()
    finally:
        out.unlink(missing_ok=True)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as bags of rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
