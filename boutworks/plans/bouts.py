"""Contest views over the star-schema tables, the same in Spark and (as SQL text) elsewhere.

A bout is a lineitem row: suppliers are the players, the return flag is the outcome, the line status the mode, and a
part gives each side a deck of eight items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

ITEMS = 104
#: Half-open eras; the last day of 1996 is in none.
ERAS = (("era-1", "1992-01-01", "1996-12-31"), ("era-2", "1997-01-01", "1999-01-01"), ("era-3", "1999-01-01", None))
TRAIN_END, VALIDATION_END = "1997-01-01", "1998-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def deck(part: Column) -> Column:
    """Eight distinct items in order of choice."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: ((part % 97 + 13 * i) % ITEMS).cast("int"))


def bouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "supplier").count()
    order = ["l_returnflag", "l_linestatus", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    # Ranked by the event's own key, so that what follows by event needs no second exchange.
    rn = F.row_number().over(Window.partitionBy("event_key").orderBy(*order))
    b = (F.col("l_suppkey") + 1 + F.col("l_partkey") % (m - 1)) % m
    key = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    lines = table(spark, sf_dir, "lineitem").withColumn("event_key", key)
    return lines.select(
        F.concat(F.lit("m"), (F.col("l_orderkey") % 8).cast("string")).alias("member"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100 + rn).cast("long").alias("row_no"),
        "event_key",
        F.concat_ws(":", "event_key", F.col("l_returnflag")).alias("fingerprint"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_linestatus").alias("mode"),
        F.when(F.col("l_returnflag") == "A", "side_a_win").when(F.col("l_returnflag") == "R", "side_b_win").otherwise("draw").alias("outcome"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 0).alias("label"),
        F.concat(F.lit("p"), (F.col("l_suppkey") % m).cast("string")).alias("player_a"),
        F.concat(F.lit("p"), b.cast("string")).alias("player_b"),
        (F.col("l_partkey") % 97).cast("int").alias("deck_a"),
        ((F.col("l_partkey") + F.col("l_suppkey")) % 97).cast("int").alias("deck_b"),
        F.least(F.greatest(0.2 + 5 * F.col("l_discount") + 2 * F.col("l_tax"), F.lit(0.05)), F.lit(0.95)).alias("p"),
        F.least(F.greatest(0.75 - 4 * F.col("l_discount") + F.col("l_tax"), F.lit(0.05)), F.lit(0.95)).alias("q"),
    )


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bouts of the supported mode with a winner."""
    return bouts(spark, sf_dir).where("mode = 'F' and label is not null")


#: The same views as SQL text, to be followed by a select.
BOUTS_SQL = f"""
WITH m AS (SELECT count(*)::BIGINT AS n FROM supplier),
raw_bouts AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_returnflag, l_linestatus, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS rn
  FROM lineitem, m),
bouts AS (
  SELECT 'm' || (l_orderkey % 8)::VARCHAR AS member,
    ((l_orderkey * 8 + l_linenumber) * 100 + rn)::BIGINT AS row_no,
    l_orderkey::VARCHAR || ':' || l_linenumber::VARCHAR AS event_key,
    l_orderkey::VARCHAR || ':' || l_linenumber::VARCHAR || ':' || l_returnflag AS fingerprint,
    l_shipdate AS ts, l_linestatus AS mode,
    CASE l_returnflag WHEN 'A' THEN 'side_a_win' WHEN 'R' THEN 'side_b_win' ELSE 'draw' END AS outcome,
    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 0 END AS label,
    'p' || (l_suppkey % n)::VARCHAR AS player_a,
    'p' || ((l_suppkey + 1 + l_partkey % (n - 1)) % n)::VARCHAR AS player_b,
    (l_partkey % 97)::INT AS deck_a, ((l_partkey + l_suppkey) % 97)::INT AS deck_b,
    least(greatest(0.2::DOUBLE + 5 * l_discount + 2 * l_tax, 0.05::DOUBLE), 0.95::DOUBLE) AS p,
    least(greatest(0.75::DOUBLE - 4 * l_discount + l_tax, 0.05::DOUBLE), 0.95::DOUBLE) AS q
  FROM raw_bouts),
decided AS (SELECT * FROM bouts WHERE mode = 'F' AND label IS NOT NULL)
"""
