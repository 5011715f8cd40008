"""Scores of probabilities: losses, calibration, slices, paired differences and their inference."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import equal_width_bin, probability_band, row_log_loss, seen_class, support_band

Z95 = 1.959963984540054
#: The least history of each band.
HISTORY_BOUNDS = (0, 1, 10)


def mean_scores(label: str = "label", p: str = "p") -> list[Column]:
    y, x = F.col(label), F.col(p)
    tie = F.when(x == 0.5, 0.5).otherwise(((x > 0.5) == (y == 1)).cast("double"))
    return [F.count("*").alias("n"), F.avg(row_log_loss(y, x)).alias("log_loss"), F.avg((x - y) * (x - y)).alias("brier"), F.avg(tie).alias("accuracy"), F.sum((x == 0.5).cast("long")).alias("ties")]


def reliability(rows: DataFrame, bins: int = 10, label: str = "label", p: str = "p") -> DataFrame:
    """(bin, n, mean_p, mean_y) over equal-width bins."""
    return rows.groupBy(equal_width_bin(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("mean_y"))


def summary(rows: DataFrame, bins: int = 10, label: str = "label", p: str = "p") -> DataFrame:
    """One row of log loss, Brier score, accuracy (ties half), ties and expected calibration error, in one pass.

    Rows are pre-aggregated by bin, so the second level sees `bins` rows.
    """
    y, x = F.col(label).cast("double"), F.col(p)
    tie = F.when(x == 0.5, 0.5).otherwise(((x > 0.5) == (y == 1)).cast("double"))
    by = rows.groupBy(equal_width_bin(x, bins).alias("bin")).agg(F.count("*").alias("n"), F.sum(row_log_loss(y, x)).alias("ll"), F.sum((x - y) * (x - y)).alias("br"), F.sum(tie).alias("ac"), F.sum((x == 0.5).cast("long")).alias("ties"), F.sum(x).alias("sp"), F.sum(y).alias("sy"))
    n = F.sum("n")
    return by.agg(n.alias("n"), (F.sum("ll") / n).alias("log_loss"), (F.sum("br") / n).alias("brier"), (F.sum("ac") / n).alias("accuracy"), F.sum("ties").alias("ties"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / n).alias("ece"))


def grouped(rows: DataFrame, families: dict[str, Column], label: str = "label", p: str = "p") -> DataFrame:
    """Scores overall and for each value of each family, with grouping sets: one shuffle for all of them."""
    named = rows.select(label, p, *[c.alias(n) for n, c in families.items()])
    sets = [[]] + [[n] for n in families]
    out = named.groupingSets(sets, *families).agg(*mean_scores(label, p), F.grouping_id().alias("gid"))
    slice_name = F.coalesce(*[F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}:"), F.col(n).cast("string"))) for n in families], F.lit("overall"))
    return out.select(slice_name.alias("slice"), "n", "log_loss", "brier", "accuracy", "ties")


def families() -> dict[str, Column]:
    """Disjoint slices of rows with supports deck_a_n, deck_b_n, pair_n and a probability."""
    return {
        "deck": seen_class(F.col("deck_a_n"), F.col("deck_b_n")),
        "pair": F.when(F.col("pair_n") > 0, "seen_pair").otherwise("unseen_pair"),
        "support": F.concat(F.lit("support_"), support_band(F.least("deck_a_n", "deck_b_n"))),
        "probability": F.concat(F.lit("band_"), probability_band(F.col("p")).cast("string")),
    }


def slice_names(with_players: bool = True) -> list[tuple[str, Column]]:
    """The fixed slices, each with its condition; empty ones are reported too."""
    deck, low = seen_class(F.col("deck_a_n"), F.col("deck_b_n")), F.least("deck_a_n", "deck_b_n")
    out: list[tuple[str, Column]] = [("overall", F.lit(True))]
    out += [(f"deck:{v}", deck == v) for v in ("both_unseen", "one_unseen", "both_seen")]
    out += [("pair:unseen_pair", F.col("pair_n") == 0), ("pair:seen_pair", F.col("pair_n") > 0)]
    out += [(f"support:{v}", support_band(low) == v) for v in ("0", "1_3", "4_19", "20_plus")]
    if with_players:
        player = seen_class(F.col("player_a_n"), F.col("player_b_n"))
        out += [(f"player:{v}", player == v) for v in ("both_unseen", "one_unseen", "both_seen")]
        history = F.least("player_a_n", "player_b_n")
        for i, lower in enumerate(HISTORY_BOUNDS):
            upper = HISTORY_BOUNDS[i + 1] if i + 1 < len(HISTORY_BOUNDS) else None
            out.append((f"history:band_{i}", (history >= lower) & (history < upper if upper is not None else F.lit(True))))
    out += [(f"probability:band_{k}", probability_band(F.col("p")) == k) for k in range(5)]
    return out


def sliced(rows: DataFrame, aggregates: list[Column], slices: list[tuple[str, Column]]) -> DataFrame:
    """Aggregates for each named slice, empty ones included."""
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in slices]))
    got = rows.withColumn("slice", F.explode(named)).groupBy("slice").agg(*aggregates)
    every = rows.sparkSession.createDataFrame([(n,) for n, _ in slices], "slice string")
    return every.join(got, "slice", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def dyadic(rows: DataFrame, value: str, a: str = "player_a", b: str = "player_b") -> DataFrame:
    """Mean difference with a sandwich variance for rows that share players: one row.

    variance = (sum over players of (sum of residuals)^2 - the same over unordered pairs) / n^2.
    """
    d = F.col(value)
    total = rows.agg(F.avg(d).alias("mean"), F.count("*").alias("n"))
    res = rows.join(F.broadcast(total), F.lit(True)).select(a, b, (d - F.col("mean")).alias("r"))
    per_player = res.select(F.explode(F.array(a, b)).alias("player"), "r").groupBy("player").agg(F.sum("r").alias("s"), F.count("*").alias("c"))
    per_pair = res.groupBy(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).agg(F.sum("r").alias("s"))
    p = per_player.agg(F.sum(F.col("s") * F.col("s")).alias("ps"), F.count("*").alias("players"), F.max("c").alias("most"))
    q = per_pair.agg(F.sum(F.col("s") * F.col("s")).alias("qs"), F.count("*").alias("pairs"))
    one = total.join(p, F.lit(True)).join(q, F.lit(True))
    variance = (F.col("ps") - F.col("qs")) / (F.col("n") * F.col("n"))
    se = F.when(variance >= 0, F.sqrt(variance))
    status = F.when(variance < 0, "negative_variance_estimate").when(variance == 0, "zero_variance_estimate").otherwise("ok")
    return one.select("mean", variance.alias("variance"), "n", "players", "pairs", (F.col("most") / F.col("n")).alias("max_incidence"), (F.col("players") < 30).alias("few_players"), status.alias("status"), se.alias("se"), (F.col("mean") - Z95 * se).alias("lower"), (F.col("mean") + Z95 * se).alias("upper"))


def paired(candidate: DataFrame, comparator: DataFrame, key: tuple[str, ...], attributes: tuple[str, ...]) -> DataFrame:
    """A one-to-one join with full coverage; unequal keys or attributes are an error."""
    for side in (candidate, comparator):
        if not side.groupBy(*key).count().where("count > 1").isEmpty():
            raise ValueError("prediction keys repeat")
    x = candidate.select(*key, *[F.col(c).alias(f"x_{c}") for c in attributes], F.col("p").alias("p"), F.lit(1).alias("in_x"))
    y = comparator.select(*key, *attributes, F.col("p").alias("q"), F.lit(1).alias("in_y"))
    both = x.join(y, list(key), "full")
    unlike = F.lit(False)
    for c in attributes:
        unlike = unlike | ~F.col(c).eqNullSafe(F.col(f"x_{c}"))
    if not both.where(F.col("in_x").isNull() | F.col("in_y").isNull() | unlike).isEmpty():
        raise ValueError("predictions do not cover the same rows")
    return both.select(*key, *attributes, "p", "q")


def differences(rows: DataFrame, label: str = "label", p: str = "p", q: str = "q") -> DataFrame:
    y = F.col(label)
    return rows.withColumn("d_log_loss", row_log_loss(y, F.col(p)) - row_log_loss(y, F.col(q))).withColumn("d_brier", F.pow(F.col(p) - y, F.lit(2)) - F.pow(F.col(q) - y, F.lit(2)))


def holm(tests: DataFrame) -> DataFrame:
    """Step-down adjusted p-values of (name, p); a null counts as 1 in the family and stays null.

    The family is a handful of registered tests, so one ordered window is fine.
    """
    numeric = F.coalesce("p", F.lit(1.0))
    order = Window.orderBy(numeric, "name")
    m = F.count("*").over(Window.partitionBy())
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * numeric)
    ran = tests.withColumn("step", step)
    running = F.max("step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ran.select("name", "p", F.when(F.col("p").isNotNull(), running).alias("adjusted"))


def normal_p_values(z: float) -> tuple[float, float]:
    """(one-sided lower, two-sided) of a standard normal."""
    lower = 0.5 * math.erfc(-z / math.sqrt(2))
    return lower, math.erfc(abs(z) / math.sqrt(2))
