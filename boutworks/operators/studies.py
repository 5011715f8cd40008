"""Comparisons of model variants, frozen confirmations, and scoring by the kind of a saved model."""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import combinations
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import logit, row_log_loss, sigmoid
from . import counts, metrics, models


def variants(rows: DataFrame, probabilities: dict[str, Column], keep: tuple[str, ...]) -> DataFrame:
    """Long form: keep + variant, p."""
    each = [F.struct(F.lit(n).alias("variant"), c.alias("p")) for n, c in probabilities.items()]
    return rows.select(*keep, F.explode(F.array(*each)).alias("v")).select(*keep, "v.*")


def compared(rows: DataFrame, probabilities: dict[str, Column], label: str = "label") -> DataFrame:
    """(first, second, n, d_log_loss, d_brier) for every pair of variants, in one pass over the rows."""
    y = F.col(label)
    pairs = []
    for a, b in combinations(sorted(probabilities), 2):
        p, q = probabilities[a], probabilities[b]
        pairs.append(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), (row_log_loss(y, p) - row_log_loss(y, q)).alias("dl"), ((p - y) * (p - y) - (q - y) * (q - y)).alias("db")))
    long = rows.select(F.explode(F.array(*pairs)).alias("s")).select("s.*")
    return long.groupBy("first", "second").agg(F.count("*").alias("n"), F.avg("dl").alias("d_log_loss"), F.avg("db").alias("d_brier"))


def report(rows: DataFrame, probabilities: dict[str, Column], slices: list[tuple[str, Column]], label: str = "label") -> DataFrame:
    """(variant, slice, n, log_loss, brier, accuracy, ties) of every variant on every slice, empty ones included."""
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in slices]))
    long = variants(rows.withColumn("names", named), probabilities, (label, "names")).withColumn("slice", F.explode("names"))
    got = long.groupBy("variant", "slice").agg(*metrics.mean_scores(label))
    every = rows.sparkSession.createDataFrame([(v, n) for v in probabilities for n, _ in slices], "variant string, slice string")
    return every.join(got, ["variant", "slice"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def confirm(rows: DataFrame, candidates: dict[str, Column], comparator: Column, label: str = "label") -> DataFrame:
    """(name, mean, se, p, adjusted): one-sided tests that a candidate's log loss is lower, adjusted over the family.

    The family is a handful of frozen candidates, so each is a driver-side step.
    """
    y, told = F.col(label), []
    for name, p in candidates.items():
        d = metrics.dyadic(rows.withColumn("d", row_log_loss(y, p) - row_log_loss(y, comparator)), "d").first()
        z = d.mean / d.se if d.se else None
        told.append((name, d.mean, d.se, metrics.normal_p_values(z)[0] if z is not None else None))
    tests = rows.sparkSession.createDataFrame(told, "name string, mean double, se double, p double")
    return tests.join(metrics.holm(tests.select("name", "p")).select("name", "adjusted"), "name")


def scored_fit(calibration: DataFrame, development: DataFrame, score: str) -> tuple[float, DataFrame]:
    """The temperature of the calibration rows, and the development rows scored with and without it."""
    t = models.fit_temperature(calibration, score)
    return t, models.calibrated(development, score, t)


def ensemble(rows: DataFrame, columns: tuple[str, ...]) -> Column:
    """The logit of the seeds' mean probability."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(c)
    return logit(total / len(columns))


def select_once(path: str, choose: Callable[[], dict]) -> dict:
    """A recorded choice: made once; a later run must choose the same."""
    made = choose()
    p = Path(path)
    if p.exists():
        if json.loads(p.read_text()) != made:
            raise ValueError("the selection differs from the recorded one")
    else:
        p.write_text(json.dumps(made, sort_keys=True))
    return made


#: What scores rows for a saved model of each kind: (rows, model) -> rows with probability.
SCORERS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "item-effects": lambda rows, model: counts.item_scores(rows, model["effects"]),
    "exact-matchups": lambda rows, model: counts.exact_matchups(rows, model["counts"]).withColumnRenamed("exact", "probability"),
    "temperature": lambda rows, model: rows.withColumn("probability", sigmoid(F.col("logit") / model["temperature"])),
}


def predict(rows: DataFrame, model: dict, vocabulary: list[int] | None = None) -> DataFrame:
    """rows + probability and availability; a deck with an item out of the vocabulary has none."""
    if model["kind"] not in SCORERS:
        raise ValueError(f"unknown model kind {model['kind']}")
    out = SCORERS[model["kind"]](rows, model)
    if vocabulary is None:
        return out.withColumn("available", F.lit(True))
    known = F.array(*[F.lit(i) for i in vocabulary])
    ok = (F.size(F.array_except("items_a", known)) == 0) & (F.size(F.array_except("items_b", known)) == 0)
    return out.withColumn("available", ok).withColumn("probability", F.when(ok, F.col("probability")))


def bound(catalog: DataFrame, vocabulary: DataFrame, key: str = "identity") -> DataFrame:
    """A dimension keyed by position in the vocabulary; an identity without an entry is an error."""
    out = vocabulary.join(catalog, key, "left")
    lost = [c for c in catalog.columns if c != key][0]
    if not out.where(F.col(lost).isNull()).isEmpty():
        raise ValueError("the vocabulary has identities that the catalog lacks")
    return out
