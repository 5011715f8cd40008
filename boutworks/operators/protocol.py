"""Roles over time: contiguous slices, allowed reads, populations that are used once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLES = ("fit", "watch", "calibration", "reporting")
#: What each operation may read.
ALLOWED = {"train": {"fit", "watch"}, "calibrate": {"calibration"}, "report": {"reporting"}}


def stages(start: str, watch: str, calibration: str, reporting: str, end: str) -> list[tuple[str, str, str]]:
    """(role, from, to) of half-open slices that follow each other."""
    cuts = [start, watch, calibration, reporting, end]
    if cuts != sorted(set(cuts)):
        raise ValueError("slices must be ordered and not empty")
    return list(zip(ROLES, cuts[:-1], cuts[1:], strict=True))


def between(ts, low: str, high: str):
    return (F.col(ts) >= F.lit(low).cast("timestamp")) & (F.col(ts) < F.lit(high).cast("timestamp"))


def any_window(rows: DataFrame, windows: list[tuple[str, str]], ts: str = "ts") -> DataFrame:
    """Rows in any of some half-open windows."""
    return rows.where(reduce(lambda a, b: a | b, [between(ts, *w) for w in windows], F.lit(False)))


def resolve(rows: DataFrame, slices: list[tuple[str, str, str]], ts: str = "ts") -> DataFrame:
    """(role, n, first_ts, last_ts); a slice without rows is an error, rows in no slice are left out."""
    role = F.lit(None).cast("string")
    for name, low, high in slices:
        role = F.when(between(ts, low, high), name).otherwise(role)
    got = rows.withColumn("role", role).where("role is not null").groupBy("role").agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    if lost := {s[0] for s in slices} - {r.role for r in got.select("role").collect()}:
        raise ValueError(f"empty slices: {sorted(lost)}")
    return got


def read(rows: DataFrame, role: str, operation: str) -> DataFrame:
    """Rows of a role for an operation that may have them."""
    if role not in ALLOWED.get(operation, set()):
        raise PermissionError(f"{operation} may not read {role}")
    return rows.where(F.col("role") == role)


def unconsumed(rows: DataFrame, consumed: DataFrame, key: str = "event_key") -> DataFrame:
    """Events not used yet; those of failed uses stay used."""
    return rows.join(consumed.select(key), key, "left_anti")


def reserve(rows: DataFrame, path: str, key: str = "event_key") -> None:
    """Append a population to the table of used events; one that was used is an error."""
    spark = rows.sparkSession
    try:
        used = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        used = rows.select(key).limit(0)
    if not rows.join(used.select(key), key, "left_semi").isEmpty():
        raise ValueError("events were used before")
    rows.select(key).write.mode("append").parquet(path)


def disjoint(a: DataFrame, b: DataFrame, key: str = "event_key") -> bool:
    return a.select(key).intersect(b.select(key)).isEmpty()


def synthetic_population(spark: SparkSession, n: int) -> DataFrame:
    """A deterministic population of 4 contexts and 8 players; n is a multiple of 32, 64 at least."""
    if n < 64 or n % 32:
        raise ValueError("a multiple of 32 of at least 64 rows")
    i = F.col("id")
    return spark.range(n).select(i.alias("row_no"), (i % 4).cast("int").alias("context"), F.concat(F.lit("p"), (i % 8).cast("string")).alias("player_a"), F.concat(F.lit("p"), ((i + 1 + F.floor(i / 8) % 7) % 8).cast("string")).alias("player_b"), F.when((i * 7 + F.floor(i / 4)) % 3 == 0, 1).otherwise(0).alias("label"))
