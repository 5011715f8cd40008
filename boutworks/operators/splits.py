"""Half-open temporal splits, player-disjoint splits by hash, and the checks that keep them apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_fraction

PARTITIONS = ("train", "validation", "test")
KEY = ("ts", "fingerprint", "member", "row_no")


def temporal(ts: Column, train_end: str, validation_end: str) -> Column:
    """`< train_end` train, `< validation_end` validation, else test."""
    if train_end >= validation_end:
        raise ValueError("cutovers must be ordered")
    return F.when(ts < F.lit(train_end).cast("timestamp"), "train").when(ts < F.lit(validation_end).cast("timestamp"), "validation").otherwise("test")


def by_fraction(x: Column, train: float = 0.70, validation: float = 0.85) -> Column:
    return F.when(x < train, "train").when(x < validation, "validation").otherwise("test")


def player_disjoint(rows: DataFrame, seed: int) -> DataFrame:
    """Rows with the split of each player, computed in place: no join with a table of players."""
    out = rows
    for side in ("a", "b"):
        out = out.withColumn(f"part_{side}", by_fraction(hash_fraction(seed, F.col(f"player_{side}"))))
    return out.withColumn("partition", F.when(F.col("part_a") == F.col("part_b"), F.col("part_a")).otherwise("bridge"))


def split_summary(rows: DataFrame, partition: str = "partition") -> DataFrame:
    return rows.groupBy(F.col(partition).alias("partition")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def require_each(summary: DataFrame) -> DataFrame:
    """A temporal split without rows is an error."""
    have = {r.partition for r in summary.select("partition").collect()}
    if lost := set(PARTITIONS) - have:
        raise ValueError(f"empty splits: {sorted(lost)}")
    return summary


def players(rows: DataFrame) -> DataFrame:
    """UNION of both sides' players."""
    return rows.select(F.explode(F.array("player_a", "player_b")).alias("player")).distinct()


def leaking_players(rows: DataFrame) -> DataFrame:
    """Players that stand in more than one split of the retained rows."""
    sides = rows.where("partition <> 'bridge'").select("partition", F.explode(F.array("player_a", "player_b")).alias("player"))
    return sides.groupBy("player").agg(F.count_distinct("partition").alias("partitions")).where("partitions > 1")


def checks(ledger: DataFrame, canonical: DataFrame, split: DataFrame, disjoint: DataFrame, train_end: str, validation_end: str) -> DataFrame:
    """(check_id, violations): seven checks, each one aggregate."""
    key = list(KEY)
    valid = ledger.where("state = 'valid'").select("member", "row_no")
    joined = split.join(canonical.select(*key), key)
    label = temporal(F.col("ts"), train_end, validation_end)

    def one(name: str, df: DataFrame, n: Column = F.count("*")) -> DataFrame:
        return df.agg(n.cast("long").alias("violations")).select(F.lit(name).alias("check_id"), "violations")

    nulls = F.lit(False)
    for c in canonical.columns:
        nulls = nulls | F.col(c).isNull()
    parts = [
        one("identity_unique", canonical.groupBy(*key).count().where("count > 1")),
        one("no_nulls", canonical.where(nulls)),
        one("valid_rows_are_canonical", canonical.join(valid, ["member", "row_no"], "left_anti").select("member").unionByName(valid.join(canonical, ["member", "row_no"], "left_anti").select("member"))),
        one("retained_and_bridges", disjoint.join(canonical.select(*key), key, "left_anti")),
        one("players_disjoint", leaking_players(disjoint)),
        one("temporal_coverage", canonical.select(*key).exceptAll(split.select(*key)).unionByName(split.select(*key).exceptAll(canonical.select(*key)))),
        one("temporal_boundaries", joined.where(F.col("partition") != label)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
