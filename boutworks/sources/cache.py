"""Feature and token tables that are pinned to the identity of what they were made from."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def identity_digest(identity: dict) -> str:
    return hashlib.sha256(json.dumps(identity, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_cache(df: DataFrame, path: str, identity: dict) -> None:
    """Rows in Parquet, and the identity beside them, written last."""
    df.write.mode("errorifexists").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(identity_digest(identity), json.dumps(identity, sort_keys=True))], "digest string, identity string").coalesce(1).write.json(f"{path}/identity")


def load_cache(spark: SparkSession, path: str, identity: dict) -> DataFrame:
    """The rows, or an error if they were made from something else."""
    found = spark.read.schema("digest string, identity string").json(f"{path}/identity").first()
    if found is None or found.digest != identity_digest(identity):
        raise ValueError("the cache belongs to another identity")
    return spark.read.parquet(f"{path}/rows")


def by_role(tokens: DataFrame, role: str, ordered: bool = True) -> DataFrame:
    """A role's rows with their ordinals, in order where that matters."""
    rows = tokens.where(F.col("role") == role)
    return rows.orderBy("row_ordinal") if ordered else rows


def aligned(tokens: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Positional join by ordinal; an ordinal on one side only is an error."""
    both = tokens.join(sidecars, "row_ordinal", "full")
    key = [c for c in sidecars.columns if c != "row_ordinal"][0]
    own = [c for c in tokens.columns if c != "row_ordinal"][0]
    if not both.where(F.col(key).isNull() | F.col(own).isNull()).isEmpty():
        raise ValueError("ordinals differ")
    return both
