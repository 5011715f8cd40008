"""Dataset queries: ledger, profiles, eras, splits, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import adapt, ledger, splits
from .bouts import BOUTS_SQL, ERAS, TRAIN_END, VALIDATION_END, bouts, decided, deck, table
from .registry import query

SEED = 17


def population(rows: DataFrame):
    return F.when(F.col("mode") != "F", F.array(F.lit("unsupported_mode"))).otherwise(F.array().cast("array<string>"))


def full_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bouts(spark, sf_dir)
    return ledger.dispositions(rows, population(rows))


def eras(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(ERAS), "era string, f string, t string")
    return rows.select("era", F.col("f").cast("timestamp").alias("valid_from"), F.col("t").cast("timestamp").alias("valid_to"))


ERA_SQL = "CASE " + " ".join(f"WHEN ts >= TIMESTAMP '{f}'" + (f" AND ts < TIMESTAMP '{t}'" if t else "") + f" THEN '{e}'" for e, f, t in ERAS) + " END"
LEDGER_SQL = BOUTS_SQL + """
, g AS (SELECT event_key, count(DISTINCT fingerprint) AS fps, arg_min(row_no, row_no) AS first_row FROM bouts GROUP BY event_key),
ledger AS (
  SELECT b.*, g.first_row, fps > 1 AS conflict, b.row_no <> g.first_row AS again,
    CASE WHEN fps > 1 OR b.row_no <> g.first_row THEN 'quarantined' WHEN mode <> 'F' THEN 'unsupported' ELSE 'valid' END AS state,
    list_sort(list_distinct(list_concat(
      CASE WHEN fps > 1 THEN ['conflicting_battle'] WHEN b.row_no <> g.first_row THEN ['duplicate_battle'] ELSE []::VARCHAR[] END,
      CASE WHEN mode <> 'F' THEN ['unsupported_mode'] ELSE []::VARCHAR[] END))) AS issues
  FROM bouts b JOIN g USING (event_key))
"""


@query("a2_disposition_ledger", LEDGER_SQL + "SELECT member, row_no, event_key, fingerprint, state, array_to_string(issues, ',') AS issues, first_row AS representative_row FROM ledger")
def disposition_ledger(spark, sf_dir):
    return full_ledger(spark, sf_dir).select("member", "row_no", "event_key", "fingerprint", "state", F.array_join("issues", ",").alias("issues"), "representative_row")


@query("a1_event_groups", BOUTS_SQL + "SELECT event_key, count(DISTINCT fingerprint) AS fingerprints, count(*) AS rows, arg_min(member, row_no) AS member, min(row_no) AS row_no FROM bouts GROUP BY event_key")
def event_groups(spark, sf_dir):
    return ledger.event_groups(bouts(spark, sf_dir)).select("event_key", "fingerprints", "rows", "first.member", "first.row_no")


_STATES = "(VALUES ('valid'), ('invalid'), ('quarantined'), ('unsupported'), ('insufficient_data'))"
_ISSUES = """(VALUES ('malformed_row'), ('malformed_timestamp'), ('incompatible_source_schema'), ('unknown_card'), ('repeated_card'), ('incomplete_deck'), ('identical_players'),
  ('duplicate_battle'), ('conflicting_battle'), ('unsupported_mode'), ('non_max_card_level'), ('draw_outcome'), ('stale_balance_era'))"""


@query("a6_state_counts", LEDGER_SQL + f"SELECT s.state, coalesce(n, 0)::BIGINT AS n FROM {_STATES} AS s(state) LEFT JOIN (SELECT state, count(*) AS n FROM ledger GROUP BY state) USING (state)")
def state_counts(spark, sf_dir):
    return ledger.state_counts(full_ledger(spark, sf_dir))


@query("a7_issue_counts", LEDGER_SQL + f"SELECT s.issue, coalesce(n, 0)::BIGINT AS n FROM {_ISSUES} AS s(issue) LEFT JOIN (SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM ledger) GROUP BY issue) USING (issue)")
def issue_counts(spark, sf_dir):
    return ledger.issue_counts(full_ledger(spark, sf_dir))


@query("a4_unadaptable_union", LEDGER_SQL + "SELECT member, row_no, event_key, state, array_to_string(issues, ',') AS issues FROM ledger UNION ALL SELECT 'x' || (o_orderkey % 8)::VARCHAR, o_orderkey, NULL, 'invalid', 'malformed_row' FROM orders WHERE o_orderstatus = 'P'")
def unadaptable_union(spark, sf_dir):
    lost = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("x"), (F.col("o_orderkey") % 8).cast("string")).alias("member"), F.col("o_orderkey").alias("row_no"), F.lit("invalid").alias("state"), F.array(F.lit("malformed_row")).alias("issues"))
    return ledger.with_unadaptable(full_ledger(spark, sf_dir), lost).select("member", "row_no", "event_key", "state", F.array_join("issues", ",").alias("issues"))


@query("a5_repeated_ledger_keys", BOUTS_SQL + "SELECT event_key, count(*) AS n FROM bouts GROUP BY event_key HAVING count(*) > 1")
def repeated(spark, sf_dir):
    return ledger.repeated_keys(bouts(spark, sf_dir), "event_key")


@query("t13_first_sightings", BOUTS_SQL + "SELECT member, row_no, event_key, CASE WHEN row_number() OVER w = 1 THEN 'accepted' WHEN fingerprint = first_value(fingerprint) OVER w THEN 'duplicate' ELSE 'conflict' END AS verdict FROM bouts WINDOW w AS (PARTITION BY event_key ORDER BY member, row_no)")
def sightings(spark, sf_dir):
    return ledger.first_sightings(bouts(spark, sf_dir))


@query("a9_profile", "SELECT coalesce(nullif(l_linestatus, 'O'), '<null>') AS mode, count(*) AS n, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts, min(least(l_partkey, l_suppkey)) AS least_item, max(greatest(l_partkey, l_suppkey)) AS greatest_item FROM lineitem GROUP BY 1")
def profile(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("mode", F.nullif("l_linestatus", F.lit("O")))
    return adapt.profile(rows, "mode", "l_shipdate", ["l_partkey", "l_suppkey"])


@query("j11_era_counts", BOUTS_SQL + f"SELECT {ERA_SQL} AS era, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM bouts GROUP BY 1")
def era_counts(spark, sf_dir):
    told = adapt.era_of(bouts(spark, sf_dir), eras(spark))
    return told.groupBy("era").agg(F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("first_ts"), F.max("ts").cast("timestamp_ntz").alias("last_ts"))


_PART = f"CASE WHEN ts < TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN ts < TIMESTAMP '{VALIDATION_END}' THEN 'validation' ELSE 'test' END"


@query("p3_temporal_split", BOUTS_SQL + f"SELECT {_PART} AS partition, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM bouts GROUP BY 1")
def temporal_split(spark, sf_dir):
    rows = bouts(spark, sf_dir).withColumn("partition", splits.temporal(F.col("ts"), TRAIN_END, VALIDATION_END))
    return splits.require_each(splits.split_summary(rows)).select("partition", "n", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


def _fraction(col: str) -> str:
    return f"(('0x' || substr(sha256('{SEED}:' || {col}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE)"


def _by_fraction(col: str) -> str:
    return f"CASE WHEN {_fraction(col)} < 0.70 THEN 'train' WHEN {_fraction(col)} < 0.85 THEN 'validation' ELSE 'test' END"


DISJOINT_SQL = BOUTS_SQL + f", d AS (SELECT *, {_by_fraction('player_a')} AS part_a, {_by_fraction('player_b')} AS part_b FROM bouts), disjoint AS (SELECT *, CASE WHEN part_a = part_b THEN part_a ELSE 'bridge' END AS partition FROM d)\n"


@query("p5_player_split", DISJOINT_SQL + "SELECT member, row_no, partition FROM disjoint")
def player_split(spark, sf_dir):
    return splits.player_disjoint(bouts(spark, sf_dir), SEED).select("member", "row_no", "partition")


@query("a13_player_split_counts", DISJOINT_SQL + "SELECT s.partition, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('train'), ('validation'), ('test'), ('bridge')) s(partition) LEFT JOIN (SELECT partition, count(*) AS n FROM disjoint GROUP BY 1) USING (partition)")
def player_split_counts(spark, sf_dir):
    rows = splits.player_disjoint(bouts(spark, sf_dir), SEED)
    return ledger.zero_filled(rows.groupBy("partition").agg(F.count("*").alias("n")), "partition", (*splits.PARTITIONS, "bridge"))


@query("a14_leaking_players", DISJOINT_SQL + "SELECT player, count(DISTINCT partition) AS partitions FROM (SELECT partition, unnest([player_a, player_b]) AS player FROM disjoint WHERE partition <> 'bridge') GROUP BY 1 HAVING count(DISTINCT partition) > 1")
def leaks(spark, sf_dir):
    return splits.leaking_players(splits.player_disjoint(bouts(spark, sf_dir), SEED))


@query("u1_players", BOUTS_SQL + "SELECT player_a AS player FROM bouts UNION SELECT player_b FROM bouts")
def players(spark, sf_dir):
    return splits.players(bouts(spark, sf_dir))


@query("v_seven_checks", "SELECT * FROM (VALUES ('identity_unique', 0::BIGINT), ('no_nulls', 0), ('valid_rows_are_canonical', 0), ('retained_and_bridges', 0), ('players_disjoint', 0), ('temporal_coverage', 0), ('temporal_boundaries', 0)) t(check_id, violations)")
def seven_checks(spark, sf_dir):
    told = full_ledger(spark, sf_dir)
    canonical = told.where("state = 'valid'").drop("issues", "state")
    split = canonical.select(*splits.KEY, splits.temporal(F.col("ts"), TRAIN_END, VALIDATION_END).alias("partition"))
    return splits.checks(told, canonical, split, splits.player_disjoint(canonical, SEED), TRAIN_END, VALIDATION_END)


@query("j7_valid_anti_join", LEDGER_SQL + "SELECT b.member, b.row_no FROM bouts b ANTI JOIN (SELECT member, row_no FROM ledger WHERE state = 'valid') v USING (member, row_no)")
def not_valid(spark, sf_dir):
    valid = full_ledger(spark, sf_dir).where("state = 'valid'").select("member", "row_no")
    return bouts(spark, sf_dir).join(valid, ["member", "row_no"], "left_anti").select("member", "row_no")


@query("j2_canonical", LEDGER_SQL + "SELECT 'v1' AS dataset_version, ts, fingerprint, member, row_no, player_a, player_b FROM ledger WHERE state = 'valid'")
def canonical(spark, sf_dir):
    valid = full_ledger(spark, sf_dir).where("state = 'valid'").select("member", "row_no")
    rows = bouts(spark, sf_dir).join(valid, ["member", "row_no"], "left_semi")
    return rows.select(F.lit("v1").alias("dataset_version"), F.col("ts").cast("timestamp_ntz").alias("ts"), "fingerprint", "member", "row_no", "player_a", "player_b")


@query("p8_adapted_rows", """
WITH r AS (SELECT l_orderkey AS id, l_linenumber AS ln, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag, l_linestatus, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS rn, * FROM lineitem),
x AS (SELECT id, ln, rn,
  CASE WHEN l_orderkey % 41 = 0 THEN 'malformed_timestamp'
       WHEN l_partkey % 37 = 0 THEN 'incomplete_deck'
       WHEN l_partkey % 31 = 0 THEN 'unknown_card'
       WHEN l_partkey % 29 = 0 THEN 'repeated_card'
       WHEN l_suppkey % 23 = 0 THEN 'identical_players' END AS error,
  l_linestatus <> 'F' AS bad_mode, l_linenumber = 5 AS low, l_shipdate AS ts FROM r)
SELECT id, ln, rn,
  CASE WHEN error = 'malformed_timestamp' THEN 'invalid' WHEN error IS NOT NULL THEN 'quarantined'
       WHEN bad_mode OR low OR """ + ERA_SQL + """ IS NULL THEN 'unsupported' ELSE 'valid' END AS state,
  CASE WHEN error IS NOT NULL THEN error ELSE concat_ws(',', CASE WHEN bad_mode THEN 'unsupported_mode' END, CASE WHEN low THEN 'non_max_card_level' END, CASE WHEN """ + ERA_SQL + """ IS NULL THEN 'stale_balance_era' END) END AS issues
FROM x""")
def adapted(spark, sf_dir):
    """Raw rows of 36 columns made from lineitem with planted faults, adapted."""
    li = table(spark, sf_dir, "lineitem")
    order = ["l_returnflag", "l_linestatus", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    from pyspark.sql import Window

    li = li.withColumn("rn", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*order)))
    part, d = F.col("l_partkey"), deck(F.col("l_partkey"))
    cols = {
        "winner_id": F.concat(F.lit("P"), F.col("l_suppkey").cast("string")),
        "loser_id": F.when(F.col("l_suppkey") % 23 == 0, F.concat(F.lit("P"), F.col("l_suppkey").cast("string"))).otherwise(F.concat(F.lit("Q"), F.col("l_suppkey").cast("string"))),
        "time": F.when(F.col("l_orderkey") % 41 == 0, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        "game_mode": F.concat(F.lit(" "), F.col("l_linestatus")),
    }
    for side in ("winner", "loser"):
        for i in range(8):
            card = d[i]
            if side == "loser" and i == 3:
                card = F.when(part % 37 == 0, F.lit(None)).when(part % 31 == 0, 999).when(part % 29 == 0, d[2]).otherwise(card)
            cols[f"{side}_card_{i}"] = card.cast("smallint")
            cols[f"{side}_card_{i}_level"] = (F.when(F.col("l_linenumber") == 5, 15).otherwise(16) if i == 7 else F.lit(16)).cast("smallint")
    raw = li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), "rn", *[c.alias(n) for n, c in cols.items()])
    got = adapt.adapt(raw, tuple(range(104)), eras(spark), "F")
    return got.select("id", "ln", F.col("rn").cast("long").alias("rn"), "state", F.array_join("issues", ",").alias("issues"))


@query("o3_overflow_guard", BOUTS_SQL + "SELECT count(*) AS n FROM decided")
def overflow_guard(spark, sf_dir):
    """A capped read fails rather than truncate: cap + 1 rows are looked for before anything is read."""
    from ..sources.files import capped

    return capped(decided(spark, sf_dir), 10**9).agg(F.count("*").alias("n"))


@query("u4_except", BOUTS_SQL + "SELECT event_key FROM bouts EXCEPT SELECT event_key FROM decided")
def except_(spark, sf_dir):
    return bouts(spark, sf_dir).select("event_key").subtract(decided(spark, sf_dir).select("event_key"))


@query("u5_intersect", BOUTS_SQL + "SELECT event_key FROM bouts WHERE mode = 'F' INTERSECT SELECT event_key FROM bouts WHERE mode = 'O'")
def intersect(spark, sf_dir):
    rows = bouts(spark, sf_dir)
    return rows.where("mode = 'F'").select("event_key").intersect(rows.where("mode = 'O'").select("event_key"))


@query("u7_distinct_ordered", BOUTS_SQL + "SELECT DISTINCT member FROM bouts ORDER BY 1")
def distinct_members(spark, sf_dir):
    return bouts(spark, sf_dir).select("member").distinct().orderBy("member")
