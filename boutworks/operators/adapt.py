"""Raw winner-first rows to typed bouts, with issues in the order in which they are found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import player_id, strict_timestamp

SLOTS = 8
TOP_LEVEL = 16
#: 2 players, time, mode, then cards and levels of both sides.
RAW_SCHEMA = ", ".join(
    ["winner_id string", "loser_id string", "time string", "game_mode string"]
    + [f"{side}_card_{i} smallint" for side in ("winner", "loser") for i in range(SLOTS)]
    + [f"{side}_card_{i}_level smallint" for side in ("winner", "loser") for i in range(SLOTS)]
)


def _slot(side: str, i: int, known_ids: tuple[int, ...]) -> list[Column]:
    """What a slot can fail on, in turn: card missing, unknown, repeated; level missing; level out of range is malformed."""
    card, level = F.col(f"{side}_card_{i}"), F.col(f"{side}_card_{i}_level")
    before = F.lit(False)
    for j in range(i):
        before = before | (F.col(f"{side}_card_{j}") == card)
    return [
        F.when(card.isNull(), "incomplete_deck"),
        F.when(~card.isin(*known_ids), "unknown_card"),
        F.when(before, "repeated_card"),
        F.when(level.isNull(), "incomplete_deck"),
    ]


def _side(side: str, known_ids: tuple[int, ...]) -> Column:
    name = F.trim(F.col(f"{side}_id"))
    text = F.when(name.isNull() | (name == ""), "malformed_row")
    slots = [c for i in range(SLOTS) for c in _slot(side, i, known_ids)]
    bounds = F.lit(False)
    for i in range(SLOTS):
        level = F.col(f"{side}_card_{i}_level")
        bounds = bounds | (level < 1) | (level > TOP_LEVEL)
    pattern = ~player_id(F.col(f"{side}_id")).rlike("^[#A-Za-z0-9_-]+$")
    return F.coalesce(text, F.when(pattern, "malformed_row"), *slots, F.when(bounds, "malformed_row"))


def first_error(known_ids: tuple[int, ...]) -> Column:
    """The first failure of a row, or null: time, winner side, loser side, equal players, mode."""
    same = F.when(player_id(F.col("winner_id")) == player_id(F.col("loser_id")), "identical_players")
    mode = F.trim(F.col("game_mode"))
    return F.coalesce(
        F.when(strict_timestamp(F.col("time")).isNull(), "malformed_timestamp"),
        _side("winner", known_ids), _side("loser", known_ids), same,
        F.when(mode.isNull() | (mode == ""), "malformed_row"),
    )


def era_of(rows: DataFrame, eras: DataFrame, ts: str = "ts") -> DataFrame:
    """Left interval join with a registry of half-open, non-overlapping eras (era, valid_from, valid_to or null).

    The registry is a fixed dimension of a few rows, so a broadcast nested loop is the plan.
    """
    inside = (F.col(ts) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(ts) < F.col("valid_to")))
    return rows.join(F.broadcast(eras), inside, "left").drop("valid_from", "valid_to")


def adapt(raw: DataFrame, known_ids: tuple[int, ...], eras: DataFrame, mode: str) -> DataFrame:
    """raw + ts, era, state and issues.

    A first error makes a row invalid (malformed row or time) or quarantined; without one it is unsupported with all of
    mode, level and era issues, or valid.
    """
    told = era_of(raw.withColumn("ts", strict_timestamp(F.col("time"))).withColumn("error", first_error(known_ids)), eras)
    low = F.lit(False)
    for side in ("winner", "loser"):
        for i in range(SLOTS):
            low = low | (F.col(f"{side}_card_{i}_level") != TOP_LEVEL)
    population = F.array_compact(F.array(F.when(F.trim("game_mode") != mode, "unsupported_mode"), F.when(low, "non_max_card_level"), F.when(F.col("era").isNull(), "stale_balance_era")))
    issues = F.when(F.col("error").isNotNull(), F.array("error")).otherwise(population)
    state = F.when(F.col("error").isin("malformed_row", "malformed_timestamp"), "invalid").when(F.col("error").isNotNull(), "quarantined").when(F.size(population) > 0, "unsupported").otherwise("valid")
    return told.withColumn("state", state).withColumn("issues", issues).drop("error")


def profile(rows: DataFrame, mode: str, ts: str, items: list[str]) -> DataFrame:
    """Per mode, null first: rows, first and last time, least and greatest item; nulls are skipped."""
    return rows.groupBy(mode).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.min(F.least(*items)).alias("least_item"), F.max(F.greatest(*items)).alias("greatest_item")).withColumn(mode, F.coalesce(mode, F.lit("<null>")))
