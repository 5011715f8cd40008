"""Streaming and model queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import counts, history, models
from ..streaming import collector
from .bouts import BOUTS_SQL, bouts, decided, table
from .registry import query, rounded
from .scoring import SIDES, oriented


def _workspace(spark, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _lineitem_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "lineitem").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    key = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return rows.select(key.alias("event_key"), F.col("l_returnflag").alias("variant"), F.when(F.col("l_orderkey") % 4 == 0, "unsupported_mode").alias("reason"), F.to_timestamp(F.lit("1996-01-01")).alias("ts"))


@query("t5_stream_match_states", BOUTS_SQL + "SELECT event_key, CASE WHEN count(DISTINCT outcome) > 1 THEN 'conflicted' WHEN split_part(event_key, ':', 1)::BIGINT % 4 = 0 THEN 'ineligible' ELSE 'eligible' END AS state, least(2, count(DISTINCT outcome))::INT AS variants, count(*) AS seen FROM bouts GROUP BY 1")
def stream_states(spark, sf_dir):
    path = _workspace(spark, "match-states")
    collector.run_once(collector.match_states(_lineitem_stream(spark, sf_dir)), path)
    return collector.latest(spark, path, "event_key").select("event_key", "state", "variants", "seen")


@query("t8_stream_counters", "SELECT CASE WHEN l_orderkey % 4 = 0 THEN 'unsupported_mode' ELSE 'eligible' END AS name, count(*) AS n FROM lineitem GROUP BY 1")
def stream_counters(spark, sf_dir):
    path = _workspace(spark, "counters")
    collector.run_once(collector.counters(_lineitem_stream(spark, sf_dir)), path)
    return collector.latest(spark, path, "name")


@query("t9_stream_windows", "SELECT to_timestamp(floor(epoch_us(ts) / 21600000000) * 21600)::TIMESTAMP AS start, count(*) AS n FROM events GROUP BY 1")
def stream_windows(spark, sf_dir):
    path = _workspace(spark, "windows")
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select(F.col("ts").cast("timestamp").alias("ts"))
    collector.run_once(collector.windowed_counts(rows, "ts", "6 hours"), path)
    return collector.latest(spark, path, "start").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("t6_poll_gaps", "WITH k AS (SELECT user_id, ts::DATE AS day, list(DISTINCT event_type) AS keys FROM events GROUP BY 1, 2), p AS (SELECT *, lag(keys) OVER (PARTITION BY user_id ORDER BY day) AS old FROM k) SELECT 'u' || user_id::VARCHAR AS tag, day FROM p WHERE old IS NOT NULL AND NOT list_has_any(old, keys)")
def poll_gaps(spark, sf_dir):
    """Each day's log of a user against that user's log before it, over all events."""
    polls = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("keys"))
    polls = polls.withColumn("old", F.lag("keys").over(Window.partitionBy("user_id").orderBy("day")))
    tag = F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("tag"), "day").alias("tag")
    return collector.gaps(polls.where("old IS NOT NULL").select(tag, F.col("old").alias("keys")), polls.select(tag, "keys")).select("tag.tag", "tag.day")


@query("m5_serial_updates")
def serial(spark, sf_dir):
    return rounded(models.serial_updates(oriented(spark, sf_dir), ("ts", "fingerprint", "member", "row_no"), 0.05))


@query("m8_deck_clusters")
def clusters(spark, sf_dir):
    rows = oriented(spark, sf_dir)
    sides = F.explode(F.array(F.array_sort("items_a"), F.array_sort("items_b"))).alias("items")
    decks = rows.select(sides).where(F.size("items") > 0).distinct().orderBy("items")
    centroids = models.deck_clusters(decks, "items", 104, 64)
    told = rows.withColumn("cluster_a", counts.nearest("items_a", centroids)).withColumn("cluster_b", counts.nearest("items_b", centroids))
    return rounded(counts.cluster_wins(told))


def _equal(rows):
    return models.signed_presence("items_a", "items_b", 104), models.signed_presence("items_b", "items_a", 104)


@query("m14_explicit_interactions")
def explicit(spark, sf_dir):
    rows = oriented(spark, sf_dir)
    there, back = _equal(rows)
    return rounded(models.both_orientations(models.explicit_interactions(rows, there), rows, there, back, ("member", "row_no")), 4)


@query("m11_boosted_trees")
def boosted(spark, sf_dir):
    rows = oriented(spark, sf_dir).join(history.trailing(decided(spark, sf_dir), 0.1).select("member", "row_no", "watch"), ["member", "row_no"])
    there, back = models.presence("items_a", "items_b", 104), models.presence("items_b", "items_a", 104)
    model = models.boosted(rows, there, F.col("watch"), rounds=5, depth=3)
    return rounded(models.both_orientations(model, rows, there, back, ("member", "row_no")), 4)


@query("m18_fitted_temperature", None)
def fitted(spark, sf_dir):
    rows = decided(spark, sf_dir).withColumn("logit", S.logit(0.3 + 0.4 * F.when(F.col("row_no") % 4 == 0, 1 - F.col("label")).otherwise(F.col("label"))))
    t = models.fit_temperature(rows, "logit")
    return rounded(spark.createDataFrame([(t,)], "temperature double"), 4)


@query("v19_swap_error", "SELECT 0.0::DOUBLE AS swap_error")
def swap_error(spark, sf_dir):
    rows = oriented(spark, sf_dir)
    effects = counts.item_effects(counts.item_counts(rows))
    there = counts.item_scores(rows, effects).select("member", "row_no", F.col("score").alias("there"))
    back = counts.item_scores(counts.swapped(rows, (*SIDES, ("items_a", "items_b"))), effects).select("member", "row_no", F.col("score").alias("back"))
    return rounded(models.swap_error(there.join(back, ["member", "row_no"]), "there", "back"))


@query("s21_block_sample", BOUTS_SQL + "SELECT member, count(*) AS n FROM bouts WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1996-07-01' OR ts >= TIMESTAMP '1998-01-01' AND ts < TIMESTAMP '1998-02-01' GROUP BY 1")
def windows_union(spark, sf_dir):
    from ..operators.protocol import any_window

    rows = any_window(bouts(spark, sf_dir), [("1996-01-01", "1996-07-01"), ("1998-01-01", "1998-02-01")])
    return rows.groupBy("member").agg(F.count("*").alias("n"))


@query("v22_compared_variants", BOUTS_SQL + """, d AS (SELECT label, unnest([{'a': 'even', 'b': 'p', 'x': 0.5::DOUBLE, 'y': p}, {'a': 'even', 'b': 'q', 'x': 0.5::DOUBLE, 'y': q}, {'a': 'p', 'b': 'q', 'x': p, 'y': q}]) AS u FROM decided),
l AS (SELECT u.a AS first, u.b AS second, -(label * ln(u.x) + (1 - label) * ln(1 - u.x)) + (label * ln(u.y) + (1 - label) * ln(1 - u.y)) AS dl, (u.x - label) ** 2 - (u.y - label) ** 2 AS db FROM d)
SELECT first, second, count(*) AS n, round(avg(dl), 6) + 0.0 AS d_log_loss, round(avg(db), 6) + 0.0 AS d_brier FROM l GROUP BY 1, 2""")
def compared(spark, sf_dir):
    from ..operators import studies

    return rounded(studies.compared(decided(spark, sf_dir), {"p": F.col("p"), "q": F.col("q"), "even": F.lit(0.5)}))


@query("v22_variant_report")
def variant_report(spark, sf_dir):
    from ..operators import metrics, studies
    from .scoring import held_out

    return rounded(studies.report(held_out(spark, sf_dir), {"p": F.col("p"), "q": F.col("q")}, metrics.slice_names()))


@query("v23_confirm")
def confirmed(spark, sf_dir):
    from ..operators import studies

    return rounded(studies.confirm(decided(spark, sf_dir), {"p": F.col("p"), "even": F.lit(0.5)}, F.col("q")))


@query("m27_predict", BOUTS_SQL + "SELECT member, row_no, list_max(list_transform(range(0, 8), lambda i: (deck_a + 13 * i) % 104)) < 100 AND list_max(list_transform(range(0, 8), lambda i: (deck_b + 13 * i) % 104)) < 100 AS available FROM decided")
def predicted(spark, sf_dir):
    from ..operators import studies

    rows = oriented(spark, sf_dir)
    model = {"kind": "item-effects", "effects": counts.item_effects(counts.item_counts(rows))}
    got = studies.predict(rows, model, list(range(100)))
    return got.select("member", "row_no", "available")


@query("a45_shrinkage", "SELECT round(avg(l_tax * l_tax), 6) + 0.0 AS mean_square, round(max(abs(l_tax)), 6) + 0.0 AS max_abs FROM lineitem")
def shrinkage(spark, sf_dir):
    return rounded(history.shrinkage(table(spark, sf_dir, "lineitem"), "l_tax"))


@query("v16_lineup_hashes", BOUTS_SQL + "SELECT member, row_no, sha256(deck_a::VARCHAR || '|' || player_a || '|16') AS lineup FROM decided")
def lineups(spark, sf_dir):
    return decided(spark, sf_dir).select("member", "row_no", S.lineup_hash(F.col("deck_a").cast("string"), F.col("player_a"), F.lit(16)).alias("lineup"))
