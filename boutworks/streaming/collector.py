"""The collector as a stream: observations become match states, with idempotent batches and additive counters.

Identity, not time, decides what repeats: observations may come late and in any order, so the exact path keeps the state
of each event for good. `bounded` trades that for a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds to wait after a refusal for too many requests, and after any other failure; rejected credentials end the run.
RATE_LIMIT_BACKOFF, FAILURE_BACKOFF = 300.0, 60.0
FATAL = "credentials_rejected"


def next_due(now: float, code: str | None, interval_minutes: float, rate_limit: float = RATE_LIMIT_BACKOFF, failure: float = FAILURE_BACKOFF) -> float:
    """When a tag is due again, in epoch seconds."""
    if code == FATAL:
        raise PermissionError(code)
    if code is None:
        return now + 60 * interval_minutes
    return now + (rate_limit if code == "rate_limited" else failure)


def due(state: DataFrame, now: str, limit: int) -> DataFrame:
    """Tags to poll: the longest overdue first; ties by tag."""
    return state.where(F.col("due_at") <= F.lit(now).cast("timestamp")).orderBy("due_at", "tag").limit(limit)


def poll(due_tags: Iterator[str], fetch: Callable[[str], list], clock: Callable[[], float], deadline: float, pause: Callable[[], None]) -> Iterator[tuple[str, list | None, str | None]]:
    """(tag, log, error code), one request in flight, until the deadline; a fatal code ends the pass."""
    for tag in due_tags:
        if clock() >= deadline:
            return
        try:
            yield tag, fetch(tag), None
        except PermissionError:
            raise
        except Exception as error:
            code = getattr(error, "code", None) or "upstream_unavailable"
            yield tag, None, code
            if code == FATAL:
                raise PermissionError(code) from error
        pause()


#: The state store keeps its rows on the executors' disks, in so many MB of an executor's memory; the default one keeps them all in the heap.
ROCKSDB, ROCKSDB_MB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", 256


def on_disk(stream: DataFrame) -> DataFrame:
    """stream with its state in RocksDB, where the caller has chosen no store. These are options of a session, so the frame goes to a copy of its own."""
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore."
    if not spark.conf.get(f"{key}providerClass").endswith(".HDFSBackedStateStoreProvider"):
        return stream
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for name, value in (("providerClass", ROCKSDB), ("rocksdb.boundedMemoryUsage", "true"), ("rocksdb.maxMemoryUsageMB", str(ROCKSDB_MB)), ("rocksdb.compression", "zstd"), ("rocksdb.trackTotalNumberOfRows", "false")):
        own.conf.set(f"{key}{name}", value)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, stream._jdf.queryExecution().logical()), own)


def match_states(observations: DataFrame) -> DataFrame:
    """(event_key, variant, reason or null, ts) -> the state of each event after each batch that touches it.

    New events are eligible or not, as their first batch says; a second variant conflicts for good; a second time is an
    error. All of it is aggregated without Python: kept of an event are its count, its smallest and largest variant and
    time, and when it was first seen with or without a reason. `verdicts` tells what each batch brought.
    """
    variant, at = F.coalesce(F.concat(F.lit("="), F.col("variant").cast("string")), F.lit("")), F.unix_micros(F.col("ts").cast("timestamp"))
    # The time of the batch, the same for its rows, and in the last bit whether there is a reason.
    first = F.unix_micros(F.current_timestamp()) * 2 + F.col("reason").isNotNull().cast("long")
    # A time that is not known differs from every other.
    early, late = F.coalesce(at, F.lit(-(2**63))), F.coalesce(at, F.lit(2**63 - 1))
    got = on_disk(observations).select("event_key", variant.alias("variant"), first.alias("first"), early.alias("early"), late.alias("late")).groupBy("event_key")
    got = got.agg(F.min("variant").alias("least"), F.max("variant").alias("most"), F.min("first").alias("first"), F.min("early").alias("early"), F.max("late").alias("late"), F.count("*").alias("seen"))
    conflicted = F.col("least") != F.col("most")
    state = F.when((F.col("seen") > 1) & (F.col("early") != F.col("late")), F.raise_error(F.concat(F.coalesce("event_key", F.lit("null")), F.lit(" has two times"))))
    state = state.when(conflicted, "conflicted").when(F.col("first") % 2 == 0, "eligible").otherwise("ineligible")
    return got.select("event_key", state.alias("state"), F.when(conflicted, 2).otherwise(1).alias("variants"), "seen")


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """(event_key, batch, verdict) of the match states written below path: what a batch was to an event, new, a duplicate or the conflict."""
    before = F.lag("variants").over(Window.partitionBy("event_key").orderBy("batch"))
    verdict = F.when((F.col("variants") > 1) & (F.coalesce(before, F.lit(1)) == 1), "conflict").when(before.isNull(), "new").otherwise("duplicate")
    return spark.read.parquet(f"{path}/out").select("event_key", "batch", verdict.alias("verdict"))


def bounded(observations: DataFrame, delay: str) -> DataFrame:
    """First sightings alone, with state kept no longer than the watermark: later conflicts are not seen."""
    return observations.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_key", "variant"])


def _last_n(n: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            held += [(int(pd.Timestamp(t).value), str(fp), float(c), int(w)) for t, fp, c, w in zip(f["ts"], f["fingerprint"], f["chance"], f["win"], strict=True)]
        held = sorted(held)[-n:]
        state.update(tuple(list(c) for c in zip(*held, strict=True)))
        full = len(held) == n
        yield pd.DataFrame({"player": [key[0]], "rows": [len(held)], "sos": [sum(1 - c for _, _, c, _ in held) / n if full else None], "wins": [sum(w for *_, w in held)]})

    return run


def rolling(observations: DataFrame, n: int) -> DataFrame:
    """The last n bouts of each player over a stream: a bounded buffer a player."""
    return observations.groupBy("player").applyInPandasWithState(_last_n(n), "player string, rows int, sos double, wins long", "t array<long>, fp array<string>, c array<double>, w array<long>", "update", GroupStateTimeout.NoTimeout)


def gaps(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Tags whose last log (not empty) has nothing in common with the new one: bouts were missed in between."""
    both = previous.select("tag", F.col("keys").alias("old")).join(current.select("tag", "keys"), "tag")
    return both.where((F.size("old") > 0) & ~F.arrays_overlap("old", "keys")).select("tag")


def counters(observations: DataFrame) -> DataFrame:
    """Additive counters by name."""
    return observations.groupBy(F.coalesce("reason", F.lit("eligible")).alias("name")).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, ts: str, size: str, delay: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts over event-time windows. A delay bounds the state, and drops rows that come later than that; none keeps all."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    events = events.withWatermark(ts, delay) if delay else events
    return events.groupBy(w).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def idempotent_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: each batch has a folder of its own, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_once(stream: DataFrame, path: str, mode: str = "update") -> None:
    """All that is there, then stop."""
    query = stream.writeStream.outputMode(mode).foreachBatch(idempotent_sink(f"{path}/out")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last row that the batches wrote for each key."""
    rows = spark.read.parquet(f"{path}/out")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (key, "batch")]), "batch").alias("r")).select(key, "r.*")
