"""One final verdict for each source row: event groups, dispositions, counts, and checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states of a record, and the issues that ingestion can find.
STATES = ("insufficient_data", "invalid", "quarantined", "unsupported", "valid")
ISSUES = (
    "conflicting_battle", "draw_outcome", "duplicate_battle", "identical_players", "incomplete_deck", "incompatible_source_schema", "malformed_row",
    "malformed_timestamp", "non_max_card_level", "repeated_card", "stale_balance_era", "unsupported_mode", "unknown_card",
)


def event_groups(rows: DataFrame) -> DataFrame:
    """Of each event: distinct fingerprints, rows, and the first row in (member, row_no) order."""
    return rows.groupBy("event_key").agg(
        F.count_distinct("fingerprint").alias("fingerprints"),
        F.count("*").alias("rows"),
        F.min(F.struct("member", "row_no")).alias("first"),
    )


def dispositions(rows: DataFrame, population_issues: Column) -> DataFrame:
    """conflict > duplicate > population issue > valid; one shuffle by event.

    population_issues: an array of issue codes of the row by itself. Conflicting events quarantine all their rows;
    otherwise the first row represents the event and the others are duplicates. Issues are distinct and sorted.
    """
    event = Window.partitionBy("event_key")
    first = F.min(F.struct("member", "row_no")).over(event)
    conflict = ~F.min("fingerprint").over(event).eqNullSafe(F.max("fingerprint").over(event))
    again = ~F.struct("member", "row_no").eqNullSafe(first)
    issue = F.when(conflict, F.array(F.lit("conflicting_battle"))).when(again, F.array(F.lit("duplicate_battle"))).otherwise(F.array().cast("array<string>"))
    state = F.when(conflict | again, "quarantined").when(F.size(population_issues) > 0, "unsupported").otherwise("valid")
    return rows.select(
        "member", "row_no", "event_key", "fingerprint", "ts", "outcome", "player_a", "player_b",
        state.alias("state"),
        F.array_sort(F.array_distinct(F.concat(issue, population_issues))).alias("issues"),
        first["member"].alias("representative_member"), first["row_no"].alias("representative_row"),
    )


def with_unadaptable(ledger: DataFrame, unadaptable: DataFrame) -> DataFrame:
    """UNION ALL with rows that never became events; their identity is null."""
    typed = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in unadaptable.columns else F.col(f.name) for f in ledger.schema.fields]
    return ledger.unionByName(unadaptable.select(*typed))


def zero_filled(counts: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """Counts by key with a row for each name."""
    names_df = counts.sparkSession.createDataFrame([(n,) for n in names], f"{key} string")
    return names_df.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def state_counts(ledger: DataFrame) -> DataFrame:
    return zero_filled(ledger.groupBy("state").agg(F.count("*").alias("n")), "state", STATES)


def issue_counts(ledger: DataFrame) -> DataFrame:
    return zero_filled(ledger.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n")), "issue", ISSUES)


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once: empty for a sound ledger or table."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_sightings(rows: DataFrame) -> DataFrame:
    """The streaming index's verdict: the first row of an event stays accepted, later ones are duplicates or conflicts."""
    event = Window.partitionBy("event_key").orderBy("member", "row_no")
    first = F.first("fingerprint").over(event.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    verdict = F.when(F.row_number().over(event) == 1, "accepted").when(F.col("fingerprint").eqNullSafe(first), "duplicate").otherwise("conflict")
    return rows.select("member", "row_no", "event_key", verdict.alias("verdict"))


def conserved(source: int, staged: int, unadaptable: int) -> None:
    """Staged and unadaptable rows make up the source."""
    if staged + unadaptable != source:
        raise ValueError(f"{source} source rows, but {staged} staged and {unadaptable} unadaptable")
