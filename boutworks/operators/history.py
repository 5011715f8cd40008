"""Per-player histories: rolling strength of schedule, past-only skill, diagnostics, ordered windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import log_odds
from ..sources.shared import written
from .ranks import numbered

KEY = ("ts", "fingerprint", "member", "row_no")


def sides(rows: DataFrame, *extra: str) -> DataFrame:
    """Two rows a bout, one per player: player, opponent, win (null for a draw), p from the player's side, side."""
    win_a = F.when(F.col("outcome") == "side_a_win", 1).when(F.col("outcome") == "side_b_win", 0)
    a = F.struct(F.lit("a").alias("side"), F.col("player_a").alias("player"), F.col("player_b").alias("opponent"), win_a.alias("win"), F.col("p").alias("chance"))
    b = F.struct(F.lit("b").alias("side"), F.col("player_b").alias("player"), F.col("player_a").alias("opponent"), (1 - win_a).alias("win"), (1 - F.col("p")).alias("chance"))
    return rows.select(*KEY, *extra, F.explode(F.array(a, b)).alias("s")).select(*KEY, *extra, "s.*")


def exclusion_issues(available: Column, era_matches: Column) -> Column:
    """All of mode and draw; only without those, missing or stale predictions."""
    first = F.array_compact(F.array(F.when(F.col("mode") != "F", "unsupported_mode"), F.when(F.col("outcome") == "draw", "draw_outcome")))
    second = F.when(~available, F.array(F.lit("unavailable_model_coverage"))).when(~era_matches, F.array(F.lit("stale_balance_era"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(first) > 0, first).otherwise(second)


def rolling(observations: DataFrame, n: int) -> DataFrame:
    """Of each player the last n eligible rows by (ts, fingerprint): difficulty, expected and actual wins.

    Fewer than n rows are insufficient; their sums are null.
    """
    if n <= 0:
        raise ValueError("the window must be positive")
    w = Window.partitionBy("player").orderBy(F.col("ts").desc(), F.col("fingerprint").desc(), F.col("member").desc(), F.col("row_no").desc())
    # The rank's limit is applied before the exchange too; all rows of a player are only counted.
    recent = observations.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    sums = recent.groupBy("player").agg(F.sum(1 - F.col("chance")).alias("sd"), F.sum("chance").alias("sp"), F.sum("win").alias("sw"))
    got = observations.groupBy("player").agg(F.count("*").alias("eligible")).join(sums, "player")
    enough = F.col("eligible") >= n
    return got.select(
        "player", "eligible", F.when(enough, "available").otherwise("insufficient_data").alias("status"),
        F.when(enough, F.col("sd") / n).alias("sos"), F.when(enough, F.col("sp")).alias("expected_wins"),
        F.when(enough, F.col("sw").cast("long")).alias("actual_wins"), F.when(enough, F.col("sw") - F.col("sp")).alias("above_expectation"),
    )


def window_shifts(observations: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Each player and window size under two models (chance, other): both difficulties and their shifts."""
    w = Window.partitionBy("player").orderBy(F.col("ts").desc(), F.col("fingerprint").desc(), F.col("member").desc(), F.col("row_no").desc())
    ranked = observations.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(sizes))
    long = ranked.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).where("rn <= size")
    got = long.groupBy("player", "size").agg(F.count("*").alias("rows"), F.sum("chance").alias("expected"), F.sum("other").alias("other_expected"), F.sum("win").cast("long").alias("wins"))
    full = F.col("rows") == F.col("size")
    return got.select("player", "size", "rows", full.alias("complete"), F.when(full, F.col("wins")).alias("wins"), F.when(full, F.col("expected")).alias("expected"), F.when(full, F.col("other_expected")).alias("other_expected"), F.when(full, F.col("expected") - F.col("other_expected")).alias("shift"), F.when(full, (F.col("other_expected") - F.col("expected")) / F.col("size")).alias("difficulty_shift"))


def summarize_shifts(shifts: DataFrame) -> DataFrame:
    size = F.abs("shift")
    return shifts.groupBy("size").agg(F.count("*").alias("players"), F.sum(F.col("complete").cast("long")).alias("complete"), F.avg("shift").alias("mean_shift"), F.avg(size).alias("mean_abs"), F.percentile(size, F.lit(0.5)).alias("p50"), F.percentile(size, F.lit(0.9)).alias("p90"))


def prior_skill(rows: DataFrame, ties_apart: bool) -> DataFrame:
    """KEY + gap: A's rating before the row less B's, from past rows alone.

    ties_apart: rows with one time count in key order; otherwise only strictly earlier times count.
    """
    both = sides(rows)
    if ties_apart:
        past = Window.partitionBy("player").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)
    else:
        both = both.withColumn("micros", F.unix_micros("ts"))
        past = Window.partitionBy("player").orderBy("micros").rangeBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    rated = both.withColumn("rating", log_odds(zero(F.sum("win").over(past)), F.count("win").over(past)))
    signed = F.when(F.col("side") == "a", F.col("rating")).otherwise(-F.col("rating"))
    return rated.groupBy(*KEY).agg(F.sum(signed).alias("gap"))


def frozen_history(rows: DataFrame, cutoff: str | None = None) -> DataFrame:
    """(player, wins, games, rating) of rows up to the cutoff."""
    both = sides(rows if cutoff is None else rows.where(F.col("ts") <= F.lit(cutoff).cast("timestamp")))
    got = both.groupBy("player").agg(F.sum("win").cast("long").alias("wins"), F.count("win").alias("games"))
    return got.withColumn("rating", log_odds(F.col("wins"), F.col("games")))


def history_gaps(rows: DataFrame, history: DataFrame) -> DataFrame:
    """KEY + gap of frozen ratings; a player never seen has rating 0."""
    a = history.select(F.col("player").alias("player_a"), F.col("rating").alias("ra"))
    b = history.select(F.col("player").alias("player_b"), F.col("rating").alias("rb"))
    return rows.join(a, "player_a", "left").join(b, "player_b", "left").select(*KEY, (F.coalesce("ra", F.lit(0.0)) - F.coalesce("rb", F.lit(0.0))).alias("gap"))


def rows_by_time(rows: DataFrame) -> DataFrame:
    """(ts, n, before): rows of each time and of all earlier ones.

    Times are summed within days first, then days are numbered, so no task holds all rows.
    """
    per = rows.groupBy("ts").agg(F.count("*").alias("n")).withColumn("day", F.to_date("ts"))
    days = per.groupBy("day").agg(F.sum("n").alias("day_n"))
    past_days = days.select("day", F.coalesce(F.sum("day_n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("day_before"))
    inside = Window.partitionBy("day").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("in_day", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(past_days, "day").select("ts", "n", (F.col("day_before") + F.col("in_day")).alias("before"))


def watch_boundary(rows: DataFrame, share: float) -> DataFrame:
    """The time that cuts off about `share` of the rows as the later part; nearest, and of two the later cut."""
    times = rows_by_time(rows)
    total = rows.count()
    target = total - int(total * share)
    return times.where("before > 0").select("ts", F.col("before").alias("fit_rows"), F.lit(total).cast("long").alias("rows")).orderBy(F.abs(F.col("fit_rows") - target), F.col("fit_rows").desc()).limit(1)


#: Characters of a fingerprint that split rows of one time.
PREFIX = 3


def trailing(rows: DataFrame, share: float) -> DataFrame:
    """KEY + ordinal + watch: whether a row is among the last int(n share), at least one and at most n - 1.

    Numbers come from rows_by_time and a rank within equal times by prefixes of the fingerprint, never from one sort of
    all rows or of all rows of a time.
    """
    n = rows.count()
    k = min(max(int(n * share), 1), n - 1)
    ranked = numbered(rows.select(*KEY), ("ts",), F.substring("fingerprint", 1, PREFIX), KEY[1:], "in_ts").join(rows_by_time(rows), "ts")
    ordinal = (F.col("before") + F.col("in_ts")).cast("long")
    return ranked.select(*KEY, ordinal.alias("ordinal"), (ordinal >= n - k).alias("watch"))


def unordered_keys(rows: DataFrame) -> DataFrame:
    """Rows that repeat the key before them: none in a table with strictly ascending keys."""
    return rows.groupBy(*KEY).count().where("count > 1")


def slice_offsets(numbered: DataFrame) -> DataFrame:
    """First and last ordinal of each month, and whether its ordinals are contiguous."""
    got = numbered.groupBy(F.date_trunc("month", "ts").alias("month")).agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"), F.count("*").alias("n"))
    return got.withColumn("contiguous", F.col("last") - F.col("first") + 1 == F.col("n"))


def player_support(rows: DataFrame) -> DataFrame:
    """Per player: games, distinct decks, share of the commonest, switches between strictly later games, first day."""
    deck = F.when(F.col("side") == "a", F.col("deck_a")).otherwise(F.col("deck_b"))
    both = sides(rows, "deck_a", "deck_b").withColumn("deck", deck)
    w = Window.partitionBy("player").orderBy(*KEY)
    moved = both.withColumn("old_deck", F.lag("deck").over(w)).withColumn("old_ts", F.lag("ts").over(w))
    base = moved.groupBy("player").agg(F.count("*").alias("games"), F.count_distinct("deck").alias("decks"), F.sum(((F.col("old_ts") < F.col("ts")) & (F.col("old_deck") != F.col("deck"))).cast("long")).alias("switches"), F.min(F.to_date("ts")).alias("first_day"))
    top = both.groupBy("player", "deck").count().groupBy("player").agg(F.max("count").alias("top"))
    return base.join(top, "player").select("player", "games", "decks", F.coalesce("switches", F.lit(0)).alias("switches"), (F.col("top") / F.col("games")).alias("dominant_share"), "first_day")


def opponent_components(rows: DataFrame) -> DataFrame:
    """(player, component): the smallest player reachable over opponents, by min-label rounds on written tables."""
    edges = rows.select(F.col("player_a").alias("x"), F.col("player_b").alias("y")).distinct()
    edges = written(edges.union(edges.select("y", "x")).distinct(), "opponents")
    labels = written(edges.groupBy(F.col("x").alias("player")).agg(F.least(F.first("x"), F.min("y")).alias("component")), "opponents")
    while True:
        near = edges.join(labels, edges.y == labels.player).groupBy(F.col("x").alias("player")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "player").select("player", F.least("component", "near").alias("component"))
        up = labels.select(F.col("player").alias("component"), F.col("component").alias("above"))
        moved = written(moved.join(up, "component").select("player", F.least("component", "above").alias("component")), "opponents")
        if moved.join(labels, ["player", "component"], "left_anti").isEmpty():
            return moved
        labels = moved


def supports(train: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with how often the training rows have their decks, unordered deck pair and players; unseen is 0."""
    decks = train.select(F.explode(F.array("deck_a", "deck_b")).alias("deck")).groupBy("deck").agg(F.count("*").alias("n"))
    lo, hi = F.least("deck_a", "deck_b"), F.greatest("deck_a", "deck_b")
    pairs = train.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.count("*").alias("pair_n"))
    players = train.select(F.explode(F.array("player_a", "player_b")).alias("player")).groupBy("player").agg(F.count("*").alias("n"))
    out = rows.withColumns({"lo": lo, "hi": hi}).join(pairs, ["lo", "hi"], "left").drop("lo", "hi")
    for s in ("a", "b"):
        out = out.join(decks.select(F.col("deck").alias(f"deck_{s}"), F.col("n").alias(f"deck_{s}_n")), f"deck_{s}", "left")
        out = out.join(players.select(F.col("player").alias(f"player_{s}"), F.col("n").alias(f"player_{s}_n")), f"player_{s}", "left")
    return out.na.fill(0, ["pair_n", "deck_a_n", "deck_b_n", "player_a_n", "player_b_n"])


def support_bins(rows: DataFrame, value: str, edges: tuple[int, ...]) -> DataFrame:
    """(lower edge, n): rows by the largest edge that does not exceed the value."""
    lower = F.array_max(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(value)))
    return rows.groupBy(lower.alias("edge")).agg(F.count("*").alias("n"))


def residuals(rows: DataFrame) -> DataFrame:
    """Per player the mean of outcome less chance from their side."""
    return sides(rows).groupBy("player").agg(F.avg(F.col("win") - F.col("chance")).alias("residual"), F.count("*").alias("n"))


def stability(rows: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return rows.agg(F.avg(F.abs(d)).alias("mean_abs"), F.sqrt(F.avg(d * d)).alias("rms"), F.max(F.abs(d)).alias("max_abs"))


def shrinkage(effects: DataFrame, column: str = "effect") -> DataFrame:
    """Mean square and largest size of fitted effects."""
    e = F.col(column)
    return effects.agg(F.avg(e * e).alias("mean_square"), F.max(F.abs(e)).alias("max_abs"))


def faced_most(rows: DataFrame, limit: int = 5) -> DataFrame:
    """The opposing items met most, their mean chance; ties by name in binary order."""
    met = rows.select(F.explode("items_b").alias("item"), "p").groupBy("item").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"))
    return met.orderBy(F.desc("n"), "item").limit(limit)
