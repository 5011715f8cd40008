"""Oriented rows, item and pair counts, and the predictors that are sums over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import laplace, log_odds, logit, mirrored, sigmoid

PAIR_SCALE = 8.0


def oriented(rows: DataFrame, seed: int, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """Swap both sides of the rows that the seeded digest picks; the label turns with them."""
    out = rows.withColumn("mirrored", mirrored(seed, F.col("fingerprint")))
    for a, b in pairs:
        x, y = F.col(a), F.col(b)
        out = out.withColumns({a: F.when(F.col("mirrored"), y).otherwise(x), b: F.when(F.col("mirrored"), x).otherwise(y)})
    return out.withColumn("label", F.when(F.col("mirrored"), 1 - F.col("label")).otherwise(F.col("label")))


def swapped(rows: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """Both sides exchanged in every row."""
    turn = {a: F.col(b) for a, b in pairs} | {b: F.col(a) for a, b in pairs}
    return rows.withColumns(turn | {"label": 1 - F.col("label")})


def opened(c: str, name: str) -> Column:
    """A row an item. The outer form, since for the plain one the optimizer adds a check of the array's size to the scan,
    where it makes decks and their orientation once more for each row."""
    return F.explode_outer(c).alias(name)


def item_counts(rows: DataFrame, items_a: str = "items_a", items_b: str = "items_b") -> DataFrame:
    """(item, wins, trials) over both sides; side B is credited with 1 - label."""
    side = lambda c, won: F.struct(F.col(c).alias("items"), won.cast("long").alias("won"))
    long = rows.select(F.explode(F.array(side(items_a, F.col("label")), side(items_b, 1 - F.col("label")))).alias("s"))
    return long.select(opened("s.items", "item"), "s.won").where("item is not null").groupBy("item").agg(F.sum("won").alias("wins"), F.count("*").alias("trials"))


def matchup_counts(rows: DataFrame, a: str = "deck_a", b: str = "deck_b") -> DataFrame:
    return rows.groupBy(F.col(a).alias("deck_a"), F.col(b).alias("deck_b")).agg(F.sum(F.col("label").cast("long")).alias("wins"), F.count("*").alias("trials"))


def pair_counts(rows: DataFrame, items_a: str = "items_a", items_b: str = "items_b") -> DataFrame:
    """(item, against, wins, trials) for each directed pair of opposing items; equal decks are summed before they are opened."""
    decks = rows.groupBy(items_a, items_b).agg(F.sum(F.col("label").cast("long")).alias("won"), F.count("*").alias("n"))
    one = decks.select(opened(items_a, "item"), F.col(items_b).alias("others"), "won", "n")
    both = one.select("item", opened("others", "against"), "won", "n").where("item is not null and against is not null")
    return both.groupBy("item", "against").agg(F.sum("won").alias("wins"), F.sum("n").alias("trials"))


def pair_weights(counts: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(item, against, weight): half the difference of both directions' logits; a missing direction counts as even."""
    back = counts.select(F.col("item").alias("against"), F.col("against").alias("item"), F.col("wins").alias("back_wins"), F.col("trials").alias("back_trials"))
    both = counts.join(back, ["item", "against"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    there = logit(laplace(zero("wins"), zero("trials"), alpha))
    return both.select("item", "against", (0.5 * (there - logit(laplace(zero("back_wins"), zero("back_trials"), alpha)))).alias("weight"))


def item_effects(counts: DataFrame, alpha: float = 1.0) -> DataFrame:
    return counts.select("item", log_odds(F.col("wins"), F.col("trials"), alpha).alias("effect"))


#: Largest catalog that goes out as a literal map; beyond it tables are joined.
MAP_ITEMS = 2_000


def _literal(table: dict, kind: str) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map().cast(f"map<{kind}>")


def _plus(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda x, y: x + y)


def item_scores(rows: DataFrame, effects: DataFrame, items_a: str = "items_a", items_b: str = "items_b") -> DataFrame:
    """Adds score = sum of A's effects - sum of B's (unknown items count nothing) and probability."""
    few = effects.select("item", "effect").limit(MAP_ITEMS + 1).collect()
    if len(few) <= MAP_ITEMS:
        known = _literal({r.item: r.effect for r in few}, "int,double")
        total = lambda c: _plus(F.transform(F.col(c), lambda i: F.coalesce(F.try_element_at(known, i), F.lit(0.0))))
        out = rows.withColumn("score", total(items_a) - total(items_b))
    else:
        out = rows
        for side in (items_a, items_b):
            long = rows.select(F.col(side).alias("_deck")).distinct().select("_deck", F.explode("_deck").alias("item"))
            told = long.join(effects, "item", "left").groupBy("_deck").agg(F.sum(F.coalesce("effect", F.lit(0.0))).alias(f"_{side}"))
            out = out.join(told, F.col(side) == F.col("_deck"), "left").drop("_deck")
        out = out.withColumn("score", F.coalesce(f"_{items_a}", F.lit(0.0)) - F.coalesce(f"_{items_b}", F.lit(0.0))).drop(f"_{items_a}", f"_{items_b}")
    return out.withColumn("probability", sigmoid(F.col("score")))


def pair_scores(rows: DataFrame, effects: DataFrame, weights: DataFrame, keys: tuple[str, ...], items_a: str = "items_a", items_b: str = "items_b", scale: float = PAIR_SCALE) -> DataFrame:
    """keys + pair_score, pair_probability: item scores plus the mean weight of opposing pairs over `scale`.

    Weights are summed once for each distinct pair of decks, and the sums joined back.
    """
    single = item_scores(rows, effects, items_a=items_a, items_b=items_b)
    decks = rows.select(F.col(items_a).alias("_a"), F.col(items_b).alias("_b")).distinct()
    one = decks.select("_a", "_b", opened("_a", "item"))
    both = one.select("_a", "_b", "item", opened("_b", "against")).join(weights, ["item", "against"], "left")
    summed = both.groupBy("_a", "_b").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("w"))
    out = single.join(summed, (F.col(items_a) == F.col("_a")) & (F.col(items_b) == F.col("_b")), "left")
    out = out.withColumn("pair_score", F.col("score") + F.coalesce("w", F.lit(0.0)) / scale)
    return out.select(*keys, "pair_score", sigmoid(F.col("pair_score")).alias("pair_probability"))


def exact_matchups(rows: DataFrame, counts: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Adds the smoothed rate of the very matchup; one never seen is even."""
    told = counts.select("deck_a", "deck_b", laplace(F.col("wins"), F.col("trials"), alpha).alias("exact"))
    return rows.join(told, ["deck_a", "deck_b"], "left").withColumn("exact", F.coalesce("exact", F.lit(0.5)))


def _at(weights: Column):
    return lambda i: F.element_at(weights, i + 1)


def nearest(items: str, centroids: list[list[float]]):
    """Index of the nearest centroid of a set of items: |c|^2 + n - 2 sum c; the lowest on ties."""
    best = []
    for k, c in enumerate(centroids):
        weights = F.array(*[F.lit(float(x)) for x in c])
        inner = F.aggregate(F.transform(F.col(items), _at(weights)), F.lit(0.0), lambda x, y: x + y)
        best.append(F.struct((F.lit(float(sum(x * x for x in c))) + F.size(items) - 2 * inner).alias("d"), F.lit(k).alias("k")))
    return F.array_min(F.array(*best))["k"] if best else F.lit(None).cast("int")


def cluster_wins(rows: DataFrame, a: str = "cluster_a", b: str = "cluster_b") -> DataFrame:
    """Directed wins and trials of clusters, both sides counted; log-odds of the smoothed rate."""
    side = lambda x, y, won: F.struct(F.col(x).alias("cluster"), F.col(y).alias("against"), won.cast("long").alias("won"))
    long = rows.select(F.explode(F.array(side(a, b, F.col("label")), side(b, a, 1 - F.col("label")))).alias("s")).select("s.*")
    out = long.groupBy("cluster", "against").agg(F.sum("won").alias("wins"), F.count("*").alias("trials"))
    return out.withColumn("log_odds", log_odds(F.col("wins"), F.col("trials")))
