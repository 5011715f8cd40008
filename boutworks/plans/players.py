"""Player queries: rolling windows, past-only skill, diagnostics, time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import history, models
from .bouts import BOUTS_SQL, bouts, decided, deck, table
from .registry import query, rounded
from .scoring import SUPPORT_SQL, held_out

SIDES_SQL = BOUTS_SQL + """, sides AS (
  SELECT ts, fingerprint, member, row_no, deck_a AS deck, player_a AS player, label AS win, p AS chance, q AS other, 'a' AS side FROM decided
  UNION ALL SELECT ts, fingerprint, member, row_no, deck_b, player_b, 1 - label, 1 - p, 1 - q, 'b' FROM decided)
"""
_RECENT = ", rc AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY ts DESC, fingerprint DESC, member DESC, row_no DESC) AS rn FROM sides)\n"


@query("a35_rolling_sos", SIDES_SQL + _RECENT + """, g AS (SELECT player, count(*) AS eligible, sum(1 - chance) FILTER (rn <= 25) AS sd, sum(chance) FILTER (rn <= 25) AS sp, sum(win) FILTER (rn <= 25) AS sw FROM rc GROUP BY 1)
SELECT player, eligible, CASE WHEN eligible >= 25 THEN 'available' ELSE 'insufficient_data' END AS status, CASE WHEN eligible >= 25 THEN round(sd / 25, 6) + 0.0 END AS sos, CASE WHEN eligible >= 25 THEN round(sp, 6) + 0.0 END AS expected_wins,
  CASE WHEN eligible >= 25 THEN sw::BIGINT END AS actual_wins, CASE WHEN eligible >= 25 THEN round(sw - sp, 6) + 0.0 END AS above_expectation FROM g""")
def rolling(spark, sf_dir):
    return rounded(history.rolling(history.sides(decided(spark, sf_dir)), 25))


@query("a36_exclusions", BOUTS_SQL + """, x AS (SELECT unnest(CASE WHEN mode <> 'F' OR outcome = 'draw' THEN list_filter([CASE WHEN mode <> 'F' THEN 'unsupported_mode' END, CASE WHEN outcome = 'draw' THEN 'draw_outcome' END], lambda v: v IS NOT NULL)
  WHEN p <= 0.3 THEN ['unavailable_model_coverage'] WHEN ts < TIMESTAMP '1993-01-01' THEN ['stale_balance_era'] ELSE []::VARCHAR[] END) AS issue FROM bouts) SELECT issue, count(*) AS n FROM x GROUP BY 1""")
def exclusions(spark, sf_dir):
    rows = bouts(spark, sf_dir)
    issues = history.exclusion_issues(F.col("p") > 0.3, F.col("ts") >= F.lit("1993-01-01").cast("timestamp"))
    return rows.select(F.explode(issues).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


_SHIFTS = _RECENT + """, w AS (SELECT player, size, count(*) AS rows, sum(chance) AS e, sum(other) AS o, sum(win)::BIGINT AS wins FROM rc, (SELECT unnest([10, 25]) AS size) WHERE rn <= size GROUP BY 1, 2),
sh AS (SELECT player, size, rows, rows = size AS complete, CASE WHEN rows = size THEN wins END AS wins, CASE WHEN rows = size THEN e END AS expected, CASE WHEN rows = size THEN o END AS other_expected, CASE WHEN rows = size THEN e - o END AS shift, CASE WHEN rows = size THEN (o - e) / size END AS difficulty_shift FROM w)
"""


def _observations(spark, sf_dir):
    both = history.sides(decided(spark, sf_dir), "q")
    return both.withColumn("other", F.when(F.col("side") == "a", F.col("q")).otherwise(1 - F.col("q")))


@query("a37_window_shifts", SIDES_SQL + _SHIFTS + "SELECT player, size, rows, complete, wins, round(expected, 6) + 0.0 AS expected, round(other_expected, 6) + 0.0 AS other_expected, round(shift, 6) + 0.0 AS shift, round(difficulty_shift, 6) + 0.0 AS difficulty_shift FROM sh")
def window_shifts(spark, sf_dir):
    return rounded(history.window_shifts(_observations(spark, sf_dir), (10, 25)))


@query("a38_shift_summary", SIDES_SQL + _SHIFTS + "SELECT size, count(*) AS players, sum(complete::BIGINT)::BIGINT AS complete, round(avg(shift), 6) + 0.0 AS mean_shift, round(avg(abs(shift)), 6) + 0.0 AS mean_abs, round(quantile_cont(abs(shift), 0.5), 6) + 0.0 AS p50, round(quantile_cont(abs(shift), 0.9), 6) + 0.0 AS p90 FROM sh GROUP BY size")
def shift_summary(spark, sf_dir):
    return rounded(history.summarize_shifts(history.window_shifts(_observations(spark, sf_dir), (10, 25))))


@query("a40_seed_variability", "SELECT l_suppkey AS player, round(stddev_pop(l_discount), 6) + 0.0 AS spread, round(max(l_discount) - min(l_discount), 6) + 0.0 AS span FROM lineitem GROUP BY 1")
def seed_variability(spark, sf_dir):
    return rounded(table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("player")).agg(F.stddev_pop("l_discount").alias("spread"), (F.max("l_discount") - F.min("l_discount")).alias("span")))


def _gap_sql(frame: str, order: str) -> str:
    return SIDES_SQL + f""", s AS (SELECT *, coalesce(sum(win) OVER w, 0) AS pw, count(*) OVER w AS pn FROM sides WINDOW w AS (PARTITION BY player ORDER BY {order} {frame})),
r AS (SELECT *, ln((pw + 1.0::DOUBLE) / (pn - pw + 1)) AS rating FROM s)
SELECT member, row_no, round(sum(CASE WHEN side = 'a' THEN rating ELSE -rating END), 6) + 0.0 AS gap FROM r GROUP BY 1, 2"""


@query("w2_prior_skill_rows", _gap_sql("ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "ts, fingerprint, member, row_no"))
def prior_rows(spark, sf_dir):
    return rounded(history.prior_skill(decided(spark, sf_dir), ties_apart=True).select("member", "row_no", "gap"))


@query("w3_prior_skill_ties", _gap_sql("RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "epoch_us(ts)"))
def prior_ties(spark, sf_dir):
    return rounded(history.prior_skill(decided(spark, sf_dir), ties_apart=False).select("member", "row_no", "gap"))


@query("j23_frozen_gaps", SIDES_SQL + """, h AS (SELECT player, ln((sum(win) + 1.0::DOUBLE) / (count(*) - sum(win) + 1)) AS r FROM sides WHERE ts <= TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT member, row_no, round(coalesce(a.r, 0) - coalesce(b.r, 0), 6) + 0.0 AS gap FROM decided LEFT JOIN h a ON a.player = player_a LEFT JOIN h b ON b.player = player_b""")
def frozen_gaps(spark, sf_dir):
    rows = decided(spark, sf_dir)
    return rounded(history.history_gaps(rows, history.frozen_history(rows, "1996-01-01")).select("member", "row_no", "gap"))


@query("w4_rows_by_time", BOUTS_SQL + "SELECT ts, n, (sum(n) OVER (ORDER BY ts) - n)::BIGINT AS before FROM (SELECT ts, count(*) AS n FROM decided GROUP BY ts)")
def rows_by_time(spark, sf_dir):
    return history.rows_by_time(decided(spark, sf_dir)).select(F.col("ts").cast("timestamp_ntz").alias("ts"), "n", F.col("before").cast("long").alias("before"))


@query("a62_watch_boundary", BOUTS_SQL + """, t AS (SELECT ts, (sum(n) OVER (ORDER BY ts) - n)::BIGINT AS fit_rows, (sum(n) OVER ())::BIGINT AS rows FROM (SELECT ts, count(*) AS n FROM decided GROUP BY ts))
SELECT ts, fit_rows, rows FROM t WHERE fit_rows > 0 ORDER BY abs(fit_rows - (rows - floor(rows * 0.1)::BIGINT)), fit_rows DESC LIMIT 1""")
def watch_boundary(spark, sf_dir):
    return history.watch_boundary(decided(spark, sf_dir), 0.1).select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("fit_rows").cast("long").alias("fit_rows"), "rows")


@query("w6_w8_trailing_watch", BOUTS_SQL + """, o AS (SELECT member, row_no, row_number() OVER (ORDER BY ts, fingerprint, member, row_no) - 1 AS ordinal, count(*) OVER () AS n FROM decided)
SELECT member, row_no, ordinal, ordinal >= n - floor(n * 0.1) AS watch FROM o""")
def trailing_watch(spark, sf_dir):
    return history.trailing(decided(spark, sf_dir), 0.1).select("member", "row_no", "ordinal", "watch")


@query("w7_ascending_keys", "SELECT 0::BIGINT AS violations")
def ascending_keys(spark, sf_dir):
    return history.unordered_keys(decided(spark, sf_dir)).agg(F.count("*").alias("violations"))


@query("w13_slice_offsets", BOUTS_SQL + ", o AS (SELECT ts, row_number() OVER (ORDER BY ts, fingerprint, member, row_no) - 1 AS ordinal FROM decided) SELECT date_trunc('month', ts)::TIMESTAMP AS month, min(ordinal) AS first, max(ordinal) AS last, count(*) AS n, max(ordinal) - min(ordinal) + 1 = count(*) AS contiguous FROM o GROUP BY 1")
def slice_offsets(spark, sf_dir):
    got = history.slice_offsets(history.trailing(decided(spark, sf_dir), 0.1))
    return got.withColumn("month", F.col("month").cast("timestamp_ntz"))


@query("w10_tumbling_six_hours", "SELECT to_timestamp(floor(epoch_us(ts) / 21600000000) * 21600)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling(spark, sf_dir):
    got = table(spark, sf_dir, "events").groupBy(S.six_hour_start(F.col("ts")).alias("start"), "event_type").agg(F.count("*").alias("n"))
    return got.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("a41_player_support", SIDES_SQL + """, mv AS (SELECT *, lag(deck) OVER w AS od, lag(ts) OVER w AS ot FROM sides WINDOW w AS (PARTITION BY player ORDER BY ts, fingerprint, member, row_no)),
b AS (SELECT player, count(*) AS games, count(DISTINCT deck) AS decks, coalesce(sum((ot < ts AND od <> deck)::BIGINT), 0)::BIGINT AS switches, min(ts::DATE) AS first_day FROM mv GROUP BY 1),
t AS (SELECT player, max(c) AS top FROM (SELECT player, deck, count(*) AS c FROM sides GROUP BY 1, 2) GROUP BY 1)
SELECT player, games, decks, switches, round(top / games, 6) + 0.0 AS dominant_share, first_day FROM b JOIN t USING (player)""")
def player_support(spark, sf_dir):
    return rounded(history.player_support(decided(spark, sf_dir)))


@query("a46_opponent_components", BOUTS_SQL + """, e AS (SELECT DISTINCT player_a AS x, player_b AS y FROM decided), d AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (WITH RECURSIVE reach(x, y) AS (SELECT x, x FROM d UNION SELECT reach.x, d.y FROM reach JOIN d ON reach.y = d.x) SELECT x AS player, min(y) AS component FROM reach GROUP BY 1) SELECT * FROM r""")
def opponent_components(spark, sf_dir):
    return history.opponent_components(decided(spark, sf_dir))


@query("a42_support_bins", SUPPORT_SQL + "SELECT CASE WHEN pair_n >= 20 THEN 20 WHEN pair_n >= 4 THEN 4 WHEN pair_n >= 1 THEN 1 ELSE 0 END::INT AS edge, count(*) AS n FROM sup GROUP BY 1")
def support_bins(spark, sf_dir):
    return history.support_bins(held_out(spark, sf_dir), "pair_n", (0, 1, 4, 20))


@query("a43_residuals", SIDES_SQL + "SELECT player, round(avg(win - chance), 6) + 0.0 AS residual, count(*) AS n FROM sides GROUP BY 1")
def residuals(spark, sf_dir):
    return rounded(history.residuals(decided(spark, sf_dir)))


@query("a44_stability", BOUTS_SQL + "SELECT round(avg(abs(p - q)), 6) + 0.0 AS mean_abs, round(sqrt(avg((p - q) * (p - q))), 6) + 0.0 AS rms, round(max(abs(p - q)), 6) + 0.0 AS max_abs FROM decided")
def stability(spark, sf_dir):
    return rounded(history.stability(decided(spark, sf_dir), "p", "q"))


@query("a55_faced_most", BOUTS_SQL + ", i AS (SELECT unnest(list_transform(range(0, 8), lambda i: ((deck_b + 13 * i) % 104)::INT)) AS item, p FROM decided) SELECT item, count(*) AS n, round(avg(p), 6) + 0.0 AS mean_p FROM i GROUP BY 1 ORDER BY n DESC, item LIMIT 5")
def faced_most(spark, sf_dir):
    return rounded(history.faced_most(decided(spark, sf_dir).withColumn("items_b", deck(F.col("deck_b")))))


@query("a56_win_spread", SIDES_SQL + "SELECT player, round(sqrt(sum(chance * (1 - chance))), 6) + 0.0 AS spread FROM sides GROUP BY 1")
def win_spread(spark, sf_dir):
    c = F.col("chance")
    return rounded(history.sides(decided(spark, sf_dir)).groupBy("player").agg(F.sqrt(F.sum(c * (1 - c))).alias("spread")))


@query("p30_arranged_bouts", SIDES_SQL + "SELECT player, row_no, CASE WHEN win = 1 AND chance < 0.4 THEN 'upset_win' WHEN win = 0 AND chance > 0.6 THEN 'upset_loss' END AS upset FROM sides WHERE (win = 1 AND chance < 0.4) OR (win = 0 AND chance > 0.6)")
def arranged(spark, sf_dir):
    told = S.upset(F.col("win") == 1, F.col("chance"))
    return history.sides(decided(spark, sf_dir)).withColumn("upset", told).where("upset is not null").select("player", "row_no", "upset")


@query("p33_latest_ranked", SIDES_SQL + "SELECT player, arg_max(deck, (ts, fingerprint, row_no)) AS deck FROM sides GROUP BY 1")
def latest_deck(spark, sf_dir):
    both = history.sides(decided(spark, sf_dir), "deck_a", "deck_b").withColumn("deck", F.when(F.col("side") == "a", F.col("deck_a")).otherwise(F.col("deck_b")))
    return both.groupBy("player").agg(F.max_by("deck", F.struct("ts", "fingerprint", "row_no")).alias("deck"))


@query("a47_readiness", SIDES_SQL + """SELECT (SELECT count(*) FROM decided) AS rows, count(DISTINCT player) AS players, count(DISTINCT deck) AS decks, count(DISTINCT ts::DATE) AS days,
  (SELECT count(*) FROM (SELECT player FROM sides GROUP BY 1 HAVING count(*) >= 10)) AS windows_10, (SELECT count(*) FROM (SELECT player FROM sides GROUP BY 1 HAVING count(*) >= 25)) AS windows_25,
  (SELECT count(*) FROM (SELECT DISTINCT least(deck_a, deck_b), greatest(deck_a, deck_b) FROM decided)) AS deck_pairs FROM sides""")
def readiness(spark, sf_dir):
    rows = decided(spark, sf_dir)
    both = history.sides(rows, "deck_a", "deck_b").withColumn("deck", F.when(F.col("side") == "a", F.col("deck_a")).otherwise(F.col("deck_b")))
    per = both.groupBy("player").agg(F.count("*").alias("n")).agg(F.count("*").alias("players"), F.sum((F.col("n") >= 10).cast("long")).alias("windows_10"), F.sum((F.col("n") >= 25).cast("long")).alias("windows_25"))
    one = both.agg(F.count_distinct("deck").alias("decks"), F.count_distinct(F.to_date("ts")).alias("days"), (F.count("*") / 2).cast("long").alias("rows"))
    pairs = rows.select(F.least("deck_a", "deck_b").alias("lo"), F.greatest("deck_a", "deck_b").alias("hi")).distinct().agg(F.count("*").alias("deck_pairs"))
    return one.join(per, F.lit(True)).join(pairs, F.lit(True)).select("rows", "players", "decks", "days", "windows_10", "windows_25", "deck_pairs")


@query("a65_arg_min", "SELECT l_suppkey AS ordinal, round(sum(l_tax), 6) + 0.0 AS loss FROM lineitem GROUP BY 1 ORDER BY loss, ordinal LIMIT 1")
def arg_min(spark, sf_dir):
    rows = rounded(table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ordinal")).agg(F.sum("l_tax").alias("loss")))
    return models.arg_min(rows, "loss", "ordinal")


@query("a64_grouped_diagnostics", SUPPORT_SQL + ", x AS (SELECT label, p, unnest(['day:' || strftime(ts, '%Y-%m-%d'), CASE WHEN player_a_n > 0 AND player_b_n > 0 THEN 'seen_players' END, CASE WHEN least(player_a_n, player_b_n) >= 10 THEN 'history_10' END]) AS grp FROM sup) SELECT grp, count(*) AS n, round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) + 0.0 AS log_loss FROM x WHERE grp IS NOT NULL GROUP BY 1")
def grouped_diagnostics(spark, sf_dir):
    rows = held_out(spark, sf_dir)
    groups = F.array_compact(F.array(F.concat(F.lit("day:"), F.date_format("ts", "yyyy-MM-dd")), F.when((F.col("player_a_n") > 0) & (F.col("player_b_n") > 0), "seen_players"), F.when(F.least("player_a_n", "player_b_n") >= 10, "history_10")))
    return rounded(rows.withColumn("grp", F.explode(groups)).groupBy("grp").agg(F.count("*").alias("n"), F.avg(S.row_log_loss(F.col("label"), F.col("p"))).alias("log_loss")))
