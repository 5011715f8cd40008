"""Counting, matchup and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import counts, history, metrics
from .bouts import BOUTS_SQL, TRAIN_END, bouts, decided, deck
from .registry import query, rounded

SEED = 17
SIDES = (("player_a", "player_b"), ("deck_a", "deck_b"))
_MIRROR = f"(('0x' || substr(sha256('{SEED}:' || fingerprint), 1, 2))::INT % 2 = 1)"
ORIENTED_SQL = BOUTS_SQL + f""", o AS (SELECT *, {_MIRROR} AS mirrored FROM decided),
oriented AS (SELECT ts, fingerprint, member, row_no, p, q, mirrored, CASE WHEN mirrored THEN player_b ELSE player_a END AS player_a, CASE WHEN mirrored THEN player_a ELSE player_b END AS player_b,
  CASE WHEN mirrored THEN deck_b ELSE deck_a END AS deck_a, CASE WHEN mirrored THEN deck_a ELSE deck_b END AS deck_b, CASE WHEN mirrored THEN 1 - label ELSE label END AS label FROM o)
, items AS (SELECT *, list_transform(range(0, 8), lambda i: ((deck_a + 13 * i) % 104)::INT) AS items_a, list_transform(range(0, 8), lambda i: ((deck_b + 13 * i) % 104)::INT) AS items_b FROM oriented)
"""


def oriented(spark, sf_dir):
    rows = counts.oriented(decided(spark, sf_dir), SEED, SIDES)
    return rows.withColumn("items_a", deck(F.col("deck_a"))).withColumn("items_b", deck(F.col("deck_b")))


@query("p17_oriented", ORIENTED_SQL + "SELECT member, row_no, mirrored, player_a, player_b, deck_a, deck_b, label FROM oriented")
def oriented_rows(spark, sf_dir):
    return oriented(spark, sf_dir).select("member", "row_no", "mirrored", "player_a", "player_b", "deck_a", "deck_b", "label")


_ITEM_COUNTS = """, ic AS (SELECT item, sum(won)::BIGINT AS wins, count(*) AS trials FROM (SELECT unnest(items_a) AS item, label AS won FROM items UNION ALL SELECT unnest(items_b), 1 - label FROM items) GROUP BY item)
"""


@query("a17_item_counts", ORIENTED_SQL + _ITEM_COUNTS + "SELECT * FROM ic")
def item_counts(spark, sf_dir):
    return counts.item_counts(oriented(spark, sf_dir))


@query("a18_matchup_counts", ORIENTED_SQL + "SELECT deck_a, deck_b, sum(label)::BIGINT AS wins, count(*) AS trials FROM oriented GROUP BY 1, 2")
def matchup_counts(spark, sf_dir):
    return counts.matchup_counts(oriented(spark, sf_dir))


_PAIR_COUNTS = """, pc AS (SELECT item, against, sum(label)::BIGINT AS wins, count(*) AS trials FROM (SELECT item, unnest(items_b) AS against, label FROM (SELECT unnest(items_a) AS item, items_b, label FROM items)) GROUP BY 1, 2)
"""


@query("a19_pair_counts", ORIENTED_SQL + _PAIR_COUNTS + "SELECT * FROM pc")
def pair_counts(spark, sf_dir):
    return counts.pair_counts(oriented(spark, sf_dir))


@query("a22_log_odds", ORIENTED_SQL + _ITEM_COUNTS + "SELECT item, round((wins + 1.0::DOUBLE) / (trials + 2), 6) + 0.0 AS smoothed, round(ln((wins + 1.0::DOUBLE) / (trials - wins + 1)), 6) + 0.0 AS effect FROM ic")
def log_odds(spark, sf_dir):
    c = counts.item_counts(oriented(spark, sf_dir))
    return rounded(c.select("item", S.laplace(F.col("wins"), F.col("trials")).alias("smoothed"), S.log_odds(F.col("wins"), F.col("trials")).alias("effect")))


_SCORES = _ITEM_COUNTS + """, fx AS (SELECT item, ln((wins + 1.0::DOUBLE) / (trials - wins + 1)) AS e FROM ic),
sa AS (SELECT member, row_no, sum(e) AS s FROM (SELECT member, row_no, unnest(items_a) AS item FROM items) JOIN fx USING (item) GROUP BY 1, 2),
sb AS (SELECT member, row_no, sum(e) AS s FROM (SELECT member, row_no, unnest(items_b) AS item FROM items) JOIN fx USING (item) GROUP BY 1, 2),
sc AS (SELECT i.*, sa.s - sb.s AS score, 1 / (1 + exp(-(sa.s - sb.s))) AS probability FROM items i JOIN sa USING (member, row_no) JOIN sb USING (member, row_no))
"""


@query("m1_baseline_scores", ORIENTED_SQL + _SCORES + "SELECT member, row_no, round(score, 6) + 0.0 AS score, round(probability, 6) + 0.0 AS probability FROM sc")
def baseline(spark, sf_dir):
    rows = oriented(spark, sf_dir)
    return rounded(counts.item_scores(rows, counts.item_effects(counts.item_counts(rows))).select("member", "row_no", "score", "probability"))


_LL = "-(label * ln(greatest({p}, 1e-15::DOUBLE)) + (1 - label) * ln(greatest(1 - {p}, 1e-15::DOUBLE)))"


@query("m2_score_partition", ORIENTED_SQL + _SCORES + """, ex AS (SELECT deck_a, deck_b, (sum(label) + 1.0::DOUBLE) / (count(*) + 2) AS exact FROM oriented GROUP BY 1, 2),
f AS (SELECT sc.label, probability, exact, 0.5::DOUBLE AS prior FROM sc JOIN ex USING (deck_a, deck_b)),
l AS (SELECT label, unnest([{'m': 'prior', 'x': prior}, {'m': 'exact', 'x': exact}, {'m': 'items', 'x': probability}]) AS u FROM f)
SELECT u.m AS model, count(*) AS n, round(avg(""" + _LL.format(p="u.x") + """), 6) + 0.0 AS log_loss, round(avg((u.x - label) * (u.x - label)), 6) + 0.0 AS brier FROM l GROUP BY 1""")
def score_partition(spark, sf_dir):
    rows = oriented(spark, sf_dir)
    scored = counts.item_scores(rows, counts.item_effects(counts.item_counts(rows)))
    scored = counts.exact_matchups(scored, counts.matchup_counts(rows))
    model = lambda n, c: F.struct(F.lit(n).alias("model"), c.alias("p"))
    long = scored.select("label", F.explode(F.array(model("prior", F.lit(0.5)), model("exact", F.col("exact")), model("items", F.col("probability")))).alias("m")).select("label", "m.*")
    return rounded(long.groupBy("model").agg(*metrics.mean_scores()).select("model", "n", "log_loss", "brier"))


_WEIGHTS = _PAIR_COUNTS + """, pw AS (SELECT item, against, 0.5 * (ln((coalesce(a.wins, 0) + 1.0::DOUBLE) / (coalesce(a.trials, 0) - coalesce(a.wins, 0) + 1)) - ln((coalesce(b.wins, 0) + 1.0::DOUBLE) / (coalesce(b.trials, 0) - coalesce(b.wins, 0) + 1))) AS weight
  FROM pc a FULL JOIN (SELECT against AS item, item AS against, wins, trials FROM pc) b USING (item, against))
"""


@query("m3_pair_weights", ORIENTED_SQL + _WEIGHTS + "SELECT item, against, round(weight, 6) + 0.0 AS weight FROM pw")
def pair_weights(spark, sf_dir):
    return rounded(counts.pair_weights(counts.pair_counts(oriented(spark, sf_dir))))


@query("m4_pair_scores", ORIENTED_SQL + _SCORES + _WEIGHTS + """, lw AS (SELECT member, row_no, sum(weight) AS w FROM (SELECT member, row_no, item, unnest(items_b) AS against FROM (SELECT member, row_no, unnest(items_a) AS item, items_b FROM items)) JOIN pw USING (item, against) GROUP BY 1, 2)
SELECT member, row_no, round(score + w / 8, 6) + 0.0 AS pair_score, round(1 / (1 + exp(-(score + w / 8))), 6) + 0.0 AS pair_probability FROM sc JOIN lw USING (member, row_no)""")
def pair_scores(spark, sf_dir):
    rows = oriented(spark, sf_dir)
    effects, weights = counts.item_effects(counts.item_counts(rows)), counts.pair_weights(counts.pair_counts(rows))
    return rounded(counts.pair_scores(rows, effects, weights, ("member", "row_no")))


#: Frozen centroids. A deck's items are alike modulo 13, so each deck has its centroid.
CENTROIDS = [[0.2 if lo <= i % 13 < hi else 0.0 for i in range(104)] for lo, hi in ((0, 5), (5, 9), (9, 13))]


def _cluster_sql(c: str) -> str:
    return f"CASE WHEN {c}[1] % 13 < 5 THEN 0 WHEN {c}[1] % 13 < 9 THEN 1 ELSE 2 END"


@query("a20_cluster_wins", ORIENTED_SQL + f""", c AS (SELECT label, {_cluster_sql('items_a')} AS ca, {_cluster_sql('items_b')} AS cb FROM items),
l AS (SELECT ca AS cluster, cb AS against, label AS won FROM c UNION ALL SELECT cb, ca, 1 - label FROM c)
SELECT cluster, against, sum(won)::BIGINT AS wins, count(*) AS trials, round(ln((sum(won) + 1.0::DOUBLE) / (count(*) - sum(won) + 1)), 6) + 0.0 AS log_odds FROM l GROUP BY 1, 2""")
def cluster_wins(spark, sf_dir):
    rows = oriented(spark, sf_dir)
    rows = rows.withColumn("cluster_a", counts.nearest("items_a", CENTROIDS)).withColumn("cluster_b", counts.nearest("items_b", CENTROIDS))
    return rounded(counts.cluster_wins(rows))


_SUMMARY = "count(*) AS n, round(avg(" + _LL.format(p="p") + "), 6) + 0.0 AS log_loss, round(avg((p - label) * (p - label)), 6) + 0.0 AS brier, round(avg(CASE WHEN p = 0.5 THEN 0.5 WHEN (p > 0.5) = (label = 1) THEN 1 ELSE 0 END::DOUBLE), 6) + 0.0 AS accuracy, sum((p = 0.5)::BIGINT)::BIGINT AS ties"


@query("a26_metrics", BOUTS_SQL + f""", b AS (SELECT least(9, floor(p * 10)::INT) AS bin, count(*) AS c, abs(sum(p) - sum(label)) AS gap FROM decided GROUP BY 1)
SELECT {_SUMMARY}, (SELECT round(sum(gap) / sum(c), 6) + 0.0 FROM b) AS ece FROM decided""")
def summary(spark, sf_dir):
    return rounded(metrics.summary(decided(spark, sf_dir)))


@query("a27_reliability", BOUTS_SQL + "SELECT least(9, floor(p * 10)::INT) AS bin, count(*) AS n, round(avg(p), 6) + 0.0 AS mean_p, round(avg(label::DOUBLE), 6) + 0.0 AS mean_y FROM decided GROUP BY 1")
def reliability(spark, sf_dir):
    return rounded(metrics.reliability(decided(spark, sf_dir)))


SUPPORT_SQL = BOUTS_SQL + f""", tr AS (SELECT * FROM decided WHERE ts < TIMESTAMP '{TRAIN_END}'), ho AS (SELECT * FROM decided WHERE ts >= TIMESTAMP '{TRAIN_END}'),
dk AS (SELECT d, count(*) AS n FROM (SELECT unnest([deck_a, deck_b]) AS d FROM tr) GROUP BY 1),
pl AS (SELECT d, count(*) AS n FROM (SELECT unnest([player_a, player_b]) AS d FROM tr) GROUP BY 1),
pr AS (SELECT least(deck_a, deck_b) AS lo, greatest(deck_a, deck_b) AS hi, count(*) AS n FROM tr GROUP BY 1, 2),
sup AS (SELECT ho.*, coalesce(d1.n, 0) AS deck_a_n, coalesce(d2.n, 0) AS deck_b_n, coalesce(p1.n, 0) AS player_a_n, coalesce(p2.n, 0) AS player_b_n, coalesce(pr.n, 0) AS pair_n
  FROM ho LEFT JOIN dk d1 ON d1.d = deck_a LEFT JOIN dk d2 ON d2.d = deck_b LEFT JOIN pl p1 ON p1.d = player_a LEFT JOIN pl p2 ON p2.d = player_b
  LEFT JOIN pr ON pr.lo = least(deck_a, deck_b) AND pr.hi = greatest(deck_a, deck_b)),
sl AS (SELECT *, CASE (deck_a_n > 0)::INT + (deck_b_n > 0)::INT WHEN 0 THEN 'both_unseen' WHEN 1 THEN 'one_unseen' ELSE 'both_seen' END AS f_deck,
  CASE WHEN pair_n > 0 THEN 'seen_pair' ELSE 'unseen_pair' END AS f_pair,
  CASE WHEN least(deck_a_n, deck_b_n) = 0 THEN '0' WHEN least(deck_a_n, deck_b_n) < 4 THEN '1_3' WHEN least(deck_a_n, deck_b_n) < 20 THEN '4_19' ELSE '20_plus' END AS f_support,
  CASE (player_a_n > 0)::INT + (player_b_n > 0)::INT WHEN 0 THEN 'both_unseen' WHEN 1 THEN 'one_unseen' ELSE 'both_seen' END AS f_player,
  CASE WHEN least(player_a_n, player_b_n) < 1 THEN 0 WHEN least(player_a_n, player_b_n) < 10 THEN 1 ELSE 2 END AS f_history,
  CASE WHEN p < 0.2 THEN 0 WHEN p < 0.4 THEN 1 WHEN p < 0.6 THEN 2 WHEN p < 0.8 THEN 3 ELSE 4 END AS f_band FROM sup)
"""


def held_out(spark, sf_dir):
    rows = decided(spark, sf_dir)
    cut = F.lit(TRAIN_END).cast("timestamp")
    return history.supports(rows.where(F.col("ts") < cut), rows.where(F.col("ts") >= cut))


@query("a53_support_lookup", SUPPORT_SQL + "SELECT member, row_no, deck_a_n, deck_b_n, pair_n, player_a_n, player_b_n FROM sup")
def support_lookup(spark, sf_dir):
    return held_out(spark, sf_dir).select("member", "row_no", "deck_a_n", "deck_b_n", "pair_n", "player_a_n", "player_b_n")


@query("a28_grouping_sets", SUPPORT_SQL + f"""SELECT slice, n, log_loss, brier, accuracy, ties FROM (
  SELECT coalesce('deck:' || f_deck, 'pair:' || f_pair, 'support:support_' || f_support, 'probability:band_' || f_band::VARCHAR, 'overall') AS slice, {_SUMMARY}
  FROM sl GROUP BY GROUPING SETS ((), (f_deck), (f_pair), (f_support), (f_band)))""")
def grouping_sets(spark, sf_dir):
    return rounded(metrics.grouped(held_out(spark, sf_dir), metrics.families()))


_SLICES = """, ex AS (SELECT *, unnest(['overall', 'deck:' || f_deck, 'pair:' || f_pair, 'support:' || f_support, 'player:' || f_player, 'history:band_' || f_history::VARCHAR, 'probability:band_' || f_band::VARCHAR]) AS slice FROM sl)
"""
_NAMES = "(VALUES " + ", ".join(f"('{n}')" for n, _ in [("overall", 0), *[(f"deck:{v}", 0) for v in ("both_unseen", "one_unseen", "both_seen")], ("pair:unseen_pair", 0), ("pair:seen_pair", 0), *[(f"support:{v}", 0) for v in ("0", "1_3", "4_19", "20_plus")], *[(f"player:{v}", 0) for v in ("both_unseen", "one_unseen", "both_seen")], *[(f"history:band_{i}", 0) for i in range(3)], *[(f"probability:band_{k}", 0) for k in range(5)]]) + ") s(slice)"


@query("a29_slices", SUPPORT_SQL + _SLICES + f"SELECT s.slice, coalesce(n, 0)::BIGINT AS n, log_loss, brier, accuracy, ties FROM {_NAMES} LEFT JOIN (SELECT slice, {_SUMMARY} FROM ex GROUP BY slice) USING (slice)")
def slices(spark, sf_dir):
    return rounded(metrics.sliced(held_out(spark, sf_dir), metrics.mean_scores(), metrics.slice_names()))


_DIFF = "(" + _LL.format(p="p") + " - " + _LL.format(p="q") + ")"


@query("a30_paired_slices", SUPPORT_SQL + _SLICES + f"SELECT s.slice, coalesce(n, 0)::BIGINT AS n, d_log_loss, d_brier FROM {_NAMES} LEFT JOIN (SELECT slice, count(*) AS n, round(avg({_DIFF}), 6) + 0.0 AS d_log_loss, round(avg((p - label) ** 2 - (q - label) ** 2), 6) + 0.0 AS d_brier FROM ex GROUP BY slice) USING (slice)")
def paired_slices(spark, sf_dir):
    rows = metrics.differences(held_out(spark, sf_dir))
    return rounded(metrics.sliced(rows, [F.count("*").alias("n"), F.avg("d_log_loss").alias("d_log_loss"), F.avg("d_brier").alias("d_brier")], metrics.slice_names()))


@query("a31_dyadic", BOUTS_SQL + f""", d AS (SELECT player_a AS a, player_b AS b, {_DIFF} AS v FROM decided), t AS (SELECT avg(v) AS mean, count(*) AS n FROM d),
r AS (SELECT a, b, v - mean AS r FROM d, t), pp AS (SELECT x, sum(r) AS s, count(*) AS c FROM (SELECT unnest([a, b]) AS x, r FROM r) GROUP BY 1), qq AS (SELECT sum(r) AS s FROM r GROUP BY least(a, b), greatest(a, b)),
z AS (SELECT mean, n, (SELECT count(*) FROM pp) AS players, (SELECT count(*) FROM qq) AS pairs, (SELECT max(c) FROM pp) AS most, ((SELECT sum(s * s) FROM pp) - (SELECT sum(s * s) FROM qq)) / (n * n) AS variance FROM t)
SELECT round(mean, 6) + 0.0 AS mean, round(variance, 6) + 0.0 AS variance, n, players, pairs, round(most / n, 6) + 0.0 AS max_incidence, players < 30 AS few_players,
  CASE WHEN variance < 0 THEN 'negative_variance_estimate' WHEN variance = 0 THEN 'zero_variance_estimate' ELSE 'ok' END AS status,
  round(sqrt(greatest(variance, 0)), 6) + 0.0 AS se, round(mean - 1.959963984540054::DOUBLE * sqrt(greatest(variance, 0)), 6) + 0.0 AS lower, round(mean + 1.959963984540054::DOUBLE * sqrt(greatest(variance, 0)), 6) + 0.0 AS upper FROM z""")
def dyadic(spark, sf_dir):
    return rounded(metrics.dyadic(metrics.differences(decided(spark, sf_dir)), "d_log_loss"))


@query("j16_paired_predictions", BOUTS_SQL + "SELECT member, row_no, label, player_a, player_b, round(p, 6) + 0.0 AS p, round(q, 6) + 0.0 AS q FROM decided")
def paired_predictions(spark, sf_dir):
    rows = decided(spark, sf_dir)
    return rounded(metrics.paired(rows, rows.withColumn("p", F.col("q")), ("member", "row_no"), ("label", "player_a", "player_b")))


@query("a33_holm", "SELECT * FROM (VALUES ('a', 0.01::DOUBLE, 0.03::DOUBLE), ('b', 0.04, 0.06), ('c', 0.03, 0.06), ('d', NULL, NULL)) t(name, p, adjusted) WHERE false UNION ALL SELECT * FROM (VALUES ('a', 0.01::DOUBLE, 0.04::DOUBLE), ('b', 0.04, 0.09), ('c', 0.03, 0.09), ('d', NULL, NULL)) t(name, p, adjusted)")
def holm(spark, sf_dir):
    return rounded(metrics.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "name string, p double")))


@query("m18_temperature_grid", BOUTS_SQL + f"""SELECT t AS temperature, round(avg(greatest(s, 0) + ln(1 + exp(-abs(s)))), 6) + 0.0 AS loss, round(avg(s), 6) + 0.0 AS signed_mean FROM (
  SELECT t, CASE WHEN label = 1 THEN -ln(p / (1 - p)) / t ELSE ln(p / (1 - p)) / t END AS s FROM decided, (SELECT unnest([0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0])::DOUBLE AS t)) GROUP BY 1""")
def temperature_grid(spark, sf_dir):
    from ..operators.models import temperature_curve

    rows = decided(spark, sf_dir).withColumn("logit", S.logit(F.col("p")))
    return rounded(temperature_curve(rows, "logit", (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)))


@query("m19_ensemble", BOUTS_SQL + "SELECT member, row_no, round((p + q) / 2, 6) + 0.0 AS mean_p, round(ln(((p + q) / 2) / (1 - (p + q) / 2)), 6) + 0.0 AS logit, round(0.5 * (p + 1 - q), 6) + 0.0 AS symmetrized FROM decided")
def ensemble(spark, sf_dir):
    mean = (F.col("p") + F.col("q")) / 2
    return rounded(decided(spark, sf_dir).select("member", "row_no", mean.alias("mean_p"), S.logit(mean).alias("logit"), S.symmetrized(F.col("p"), F.col("q")).alias("symmetrized")))


@query("a52_rms_scales", "SELECT round(sqrt(avg(l_quantity * l_quantity)), 6) + 0.0 AS quantity, round(CASE WHEN sqrt(avg(l_discount * l_discount)) = 0 THEN 1 ELSE sqrt(avg(l_discount * l_discount)) END, 6) + 0.0 AS discount FROM lineitem")
def rms_scales(spark, sf_dir):
    from ..operators.models import rms_scales as scales
    from .bouts import table

    return rounded(scales(table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))))


@query("a51_eligibility", "SELECT u.f AS feature, CASE WHEN count(DISTINCT u.v) <= 1 THEN 'constant_column' WHEN sum((u.v <> 0)::BIGINT) < 1000 THEN 'insufficient_support' ELSE 'eligible' END AS status, sum((u.v <> 0)::BIGINT)::BIGINT AS support FROM (SELECT unnest([{'f': 'one', 'v': 1.0::DOUBLE}, {'f': 'rare', 'v': (l_orderkey % 997 = 0)::INT::DOUBLE}, {'f': 'discount', 'v': l_discount}]) AS u FROM lineitem) GROUP BY 1")
def eligibility(spark, sf_dir):
    from ..operators.models import eligibility as eligible
    from .bouts import table

    rows = table(spark, sf_dir, "lineitem").select(F.lit(1.0).alias("one"), (F.col("l_orderkey") % 997 == 0).cast("double").alias("rare"), F.col("l_discount").alias("discount"))
    return eligible(rows, 1000)
