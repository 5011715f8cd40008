"""Files, caches, the log source, and the collector as a stream."""

from __future__ import annotations

import datetime as dt
import http.server
import json
import threading
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutworks.sources import battle_log, cache, catalogs, files, snapshot
from boutworks.streaming import collector

UTC = dt.timezone.utc


def test_files(spark, tmp_path):
    df = spark.range(100).withColumn("member", F.concat(F.lit("m"), (F.col("id") % 3).cast("string")))
    files.write_sorted(df, str(tmp_path / "sorted"), ["id"], 10)
    assert files.read_parquet(spark, [str(tmp_path / "sorted")]).count() == 100
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        files.write_sorted(df, str(tmp_path / "sorted"), ["id"])
    files.write_members(df, str(tmp_path / "members"), "member", "id")
    assert spark.read.parquet(str(tmp_path / "members")).where("member = 'm1'").count() == 33
    with pytest.raises(ValueError):
        files.write_not_empty(df.limit(0), str(tmp_path / "x"))
    with pytest.raises(ValueError):
        files.capped(df, 99)
    assert files.capped(df, 100).count() == 100
    with pytest.raises(ValueError):
        files.require_schema(df, T.StructType([T.StructField("id", T.IntegerType())]))
    assert {r.column: r.nulls for r in files.null_counts(df.withColumn("n", F.when(F.col("id") > 9, 1))).collect()} == {"id": 0, "member": 0, "n": 10}
    assert files.same_rows(df, df.orderBy(F.desc("id")))
    assert files.schema_fingerprint(df.schema) != files.schema_fingerprint(df.drop("member").schema)
    files.publish(spark, str(tmp_path / "members"), str(tmp_path / "published"))
    with pytest.raises(FileExistsError):
        files.publish(spark, str(tmp_path / "sorted"), str(tmp_path / "published"))


def test_jsonl_lines_manifest(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n{"k": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k int").agg(F.sum("k")).first()[0] == 3
    (tmp_path / "bad.jsonl").write_text('{"k": 1}\n{"k": \n')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "k int").collect()
    (tmp_path / "tags").write_text("#AAA\n\n#BBB\n#AAA\n")
    assert files.read_lines(spark, str(tmp_path / "tags"), "^#[A-Z0-9]{3,15}$").count() == 2
    with pytest.raises(ValueError):
        files.read_lines(spark, str(tmp_path / "tags"), "^#A+$")
    digest = files.write_manifest({"b": 1, "a": "é"}, str(tmp_path / "m.json"))
    assert (tmp_path / "m.json").read_text() == '{"a":"\\u00e9","b":1}' and len(digest) == 64
    assert files.hash_files(spark, str(tmp_path / "m.json")).first().sha256 == digest


def test_catalogs(spark, tmp_path):
    body = {"catalog_version": "v", "entries": [[0, "Knight", "knight", "base"], [1, "Evo Knight", "knight", "evolution"], [2, "Mirror", "mirror", "base"], [3, "Queen", "queen", "champion"]]}
    (tmp_path / "c.json").write_text(json.dumps(body))
    digest = files.hash_files(spark, str(tmp_path / "c.json")).first().sha256
    assert catalogs.pinned(str(tmp_path / "c.json"), digest) == body
    with pytest.raises(ValueError):
        catalogs.pinned(str(tmp_path / "c.json"), "0" * 64)
    cards = catalogs.cards(spark, body)
    assert [r.identity for r in cards.orderBy("source_id").collect()] == ["knight:base", "knight:evolution", "mirror:base", "queen:champion"]
    first, *rest = body["entries"]
    bad = ([], [[1, *first[1:]]], [[True, *first[1:]]], [[0, " ", "knight", "base"]], [first, [1, "Knight", "mirror", "base"]], [first, [1, "x", "knight", "base"]], [[0, "x", "knight", "evolution"]], [[0, "x", "Knight", "base"]], [[0, "x", "knight", "odd"]])
    for entries in bad:
        with pytest.raises(ValueError):
            catalogs.cards(spark, body | {"entries": entries})
    with pytest.raises(ValueError):
        catalogs.cards(spark, body | {"catalog_version": " "})

    api = {"cards": {c: {"api_id": 26 + i, "max_api_level": 16} for i, c in enumerate(("knight", "mirror", "queen"))}}
    ids = catalogs.api_ids(spark, api, cards)
    entries = catalogs.card_entries(cards, ids)
    assert [(e.identity, e.api_id) for e in entries] == [("knight:base", 26), ("knight:evolution", 26), ("mirror:base", 27), ("queen:champion", 28)]
    for change in ({"queen": None}, {"queen": {"api_id": 26, "max_api_level": 16}}, {"queen": {"api_id": 28, "max_api_level": 17}}, {"extra": {"api_id": 30, "max_api_level": 16}}):
        with pytest.raises(ValueError):
            catalogs.api_ids(spark, {"cards": api["cards"] | change}, cards)
    with pytest.raises(ValueError):
        catalogs.api_ids(spark, {"cards": {"knight": api["cards"]["knight"]}}, cards)

    tower = {"tower_id": "princess", "name": "Princess", "api_id": 159, "max_api_level": 16}
    assert [e.identity for e in catalogs.tower_entries(catalogs.towers(spark, {"catalog_version": "v", "entries": [tower]}))] == ["princess:tower"]
    for other in (tower, tower | {"max_api_level": 15}, tower | {"tower_id": "other", "api_id": 160, "name": " PRINCESS "}, tower | {"api_id": 0}):
        with pytest.raises(ValueError):
            catalogs.towers(spark, {"catalog_version": "v", "entries": [tower, other]})

    told = {"attribute_version": "v", "summary_columns": catalogs.SUMMARY, "cards": {"knight": {"elixir": 3, "roles": ["cycle"]}, "queen": {"elixir": 5, "roles": ["air_defense", "bait"]}, "mirror": {"elixir": None, "roles": ["spell"]}}}
    table = catalogs.attributes(spark, told)
    for change in ({"mirror": {"elixir": 1, "roles": []}}, {"knight": {"elixir": None, "roles": []}}, {"knight": {"elixir": 10, "roles": []}}, {"knight": {"elixir": 3, "roles": ["odd"]}}, {"knight": {"elixir": 3, "roles": ["bait", "bait"]}}):
        with pytest.raises(ValueError):
            catalogs.attributes(spark, told | {"cards": told["cards"] | change})
    decks = spark.createDataFrame([(1, ["knight:evolution", "queen:champion", "mirror:base"]), (2, ["mirror:base"]), (3, []), (4, None)], "id int, ids array<string>")
    got = {r.id: tuple(r)[1:] for r in catalogs.deck_summaries(decks, "id", "ids", table).collect()}
    assert got == {1: pytest.approx((13 / 3, 0, 0, 1, 1, 1, 1)), 2: (1, 0, 0, 1, 0, 0, 0), 3: (0,) * 7, 4: (0,) * 7}
    with pytest.raises(Exception, match="no attributes of odd:base"):
        catalogs.deck_summaries(spark.createDataFrame([(1, ["odd:base"])], decks.schema), "id", "ids", table).collect()


def test_snapshot_export(spark, small, tmp_path):
    from boutworks.plans.features import live_logs

    logs, path = live_logs(spark, small), str(tmp_path / "snapshot.jsonl")
    got = snapshot.export_matches(logs, path, "1992-01-01", "1999-01-01", "v1", "era")
    rows = spark.read.json(path)
    assert rows.count() == got["written"] > 0 and got["skipped_mode"] == 0
    assert sorted(r.row_number for r in rows.collect()) == list(range(got["written"]))
    assert {r.archive_member for r in rows.collect()} == {"snapshot.jsonl"} and set(rows.first().side_a_card_forms) == {"base"}
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        snapshot.export_matches(logs, path, "1992-01-01", "1999-01-01", "v1", "era")
    with pytest.raises(ValueError):
        snapshot.export_matches(logs, path + "2", "1980-01-01", "1981-01-01", "v1", "era")
    with pytest.raises(ValueError):
        snapshot.export_matches(logs, path + "2", "1992-01-01", "1999-01-01", " ", "era")


def test_archives(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("x.parquet", b"data")
        z.writestr("names.json", b"{}")
    assert files.archive_members(str(path), extra=("names.json",)) == ["x.parquet"]
    with pytest.raises(ValueError):
        files.archive_members(str(path))
    with files.extracted(str(path), "x.parquet", str(tmp_path), 2) as (out, digest):
        assert open(out, "rb").read() == b"data" and len(digest) == 64
    assert not (tmp_path / "x.parquet").exists()


def test_cache(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "row_ordinal").withColumn("tokens", F.array(F.lit(1)))
    cache.write_cache(df, str(tmp_path / "c"), {"v": 1})
    assert cache.load_cache(spark, str(tmp_path / "c"), {"v": 1}).count() == 5
    with pytest.raises(ValueError):
        cache.load_cache(spark, str(tmp_path / "c"), {"v": 2})
    side = df.select("row_ordinal", F.lit("x").alias("event"))
    assert cache.aligned(df, side).count() == 5
    with pytest.raises(ValueError):
        cache.aligned(df, side.where("row_ordinal > 0"))


def test_log_source(spark, tmp_path):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            code = 200 if "AAA" in self.path else 429
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(json.dumps([{"type": "x"}, {"type": "y"}]).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(battle_log.BattleLogSource)
    got = spark.read.format("battle_log").option("base", f"http://127.0.0.1:{server.server_port}").option("tags", "#AAA,#BBB").load().collect()
    server.shutdown()
    assert sorted((r.tag, r.error) for r in got) == [("#AAA", None), ("#AAA", None), ("#BBB", "rate_limited")] or sorted((r.tag, r.error or "") for r in got) == [("#AAA", ""), ("#AAA", ""), ("#BBB", "rate_limited")]
    assert battle_log.error_code(403) == "credentials_rejected"
    assert [battle_log.error_code(n) for n in (404, 429, 500)] == ["player_not_found", "rate_limited", "upstream_unavailable"]
    (tmp_path / "AAA.json").write_text(json.dumps([{"type": "x"}]))
    assert battle_log.from_folder(spark, str(tmp_path)).first().tag == "#AAA"


def stream_of(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def test_match_states_over_batches(spark, tmp_path):
    t = dt.datetime(2026, 5, 10, tzinfo=UTC)
    schema = "event_key string, variant string, reason string, ts timestamp"
    stream = stream_of(spark, tmp_path, [[("e1", "v1", None, t), ("e2", "w1", "draw", t)], [("e1", "v1", None, t), ("e3", "x1", None, t)], [("e1", "v2", None, t)], [("e1", "v1", None, t)]], schema)
    collector.run_once(collector.match_states(stream), str(tmp_path / "states"))
    got = {r.event_key: (r.state, r.variants, r.seen) for r in collector.latest(spark, str(tmp_path / "states"), "event_key").collect()}
    assert got == {"e1": ("conflicted", 2, 4), "e2": ("ineligible", 1, 1), "e3": ("eligible", 1, 1)}


def test_match_states_go_on_without_python(spark, tmp_path):
    t, schema = dt.datetime(2026, 5, 10, tzinfo=UTC), "event_key string, variant string, reason string, ts timestamp"
    rows = spark.range(20_000).selectExpr("concat('e', id) as event_key", "'v' as variant", "if(id % 4 = 0, 'draw', null) as reason", "timestamp'2026-05-10' as ts")
    rows.write.parquet(str(tmp_path / "in/0"))
    spark.createDataFrame([("e1", "w", None, t), ("e2", "v", "draw", t), ("new", None, None, t)], schema).write.parquet(str(tmp_path / "in/1"))
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for folders in ("in/0*", "in/*"):  # the second run goes on from the state of the first
        states = collector.match_states(spark.readStream.schema(schema).parquet(str(tmp_path / folders)))
        assert "Pandas" not in states._jdf.queryExecution().logical().toString()
        collector.run_once(states, str(tmp_path / "states"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == store
    got = collector.latest(spark, str(tmp_path / "states"), "event_key").groupBy("state", "variants", "seen").count().collect()
    assert {tuple(r) for r in got} == {("ineligible", 1, 1, 5000), ("eligible", 1, 1, 14_999), ("conflicted", 2, 2, 1), ("eligible", 1, 2, 1)}


def test_match_states_by_batch(spark, tmp_path):
    t = dt.datetime(2026, 5, 10, tzinfo=UTC)
    schema = "event_key string, variant string, reason string, ts timestamp"
    batches = [
        [("e1", "c", None, t), ("e2", None, "draw", t), ("e3", "a", None, t), ("e3", "b", None, t), ("e4", None, None, None)],
        [("e1", "d", "draw", t), ("e2", None, None, t), ("e3", "a", None, t)],
        [("e1", "a", None, t), ("e2", "", None, t), ("e1", "z", None, t)],
    ]
    collector.run_once(collector.match_states(stream_of(spark, tmp_path, batches, schema)), str(tmp_path / "states"))
    got = {r.event_key: (r.state, r.variants, r.seen) for r in collector.latest(spark, str(tmp_path / "states"), "event_key").collect()}
    assert got == {"e1": ("conflicted", 2, 4), "e2": ("conflicted", 2, 3), "e3": ("conflicted", 2, 3), "e4": ("eligible", 1, 1)}
    told = collector.verdicts(spark, str(tmp_path / "states")).orderBy("event_key", "batch").collect()
    assert [(r.event_key, r.verdict) for r in told] == [("e1", "new"), ("e1", "conflict"), ("e1", "duplicate"), ("e2", "new"), ("e2", "duplicate"), ("e2", "conflict"), ("e3", "conflict"), ("e3", "duplicate"), ("e4", "new")]
    late = [[("e1", "a", None, t)], [("e1", "a", None, t + dt.timedelta(minutes=1))]]
    with pytest.raises(Exception, match="e1 has two times"):
        collector.run_once(collector.match_states(stream_of(spark, tmp_path / "late", late, schema)), str(tmp_path / "late/states"))


def test_rolling_over_batches(spark, tmp_path):
    t = dt.datetime(2026, 5, 10, tzinfo=UTC)
    schema = "player string, ts timestamp, fingerprint string, chance double, win int"
    rows = [[("A", t + dt.timedelta(minutes=m), f"f{m}", p, w)] for m, p, w in ((3, 0.7, 1), (1, 0.1, 0), (4, 0.9, 1), (2, 0.3, 0))]
    collector.run_once(collector.rolling(stream_of(spark, tmp_path, rows, schema), 2), str(tmp_path / "rolling"))
    got = collector.latest(spark, str(tmp_path / "rolling"), "player").first()
    assert got.sos == pytest.approx(0.2) and got.wins == 2


def test_polling():
    now = [0.0]

    def fetch(tag):
        now[0] += 1
        if tag == "b":
            raise battle_log.FetchError("rate_limited")
        return [tag]

    got = list(collector.poll(iter("abcd"), fetch, lambda: now[0], 3, lambda: None))
    assert got == [("a", ["a"], None), ("b", None, "rate_limited"), ("c", ["c"], None)]
    assert collector.next_due(0, "rate_limited", 10) == 300
    assert collector.next_due(0, "invalid_response", 10) == collector.next_due(0, "player_not_found", 10) == 60
    assert collector.next_due(0, None, 10) == 600
    with pytest.raises(PermissionError):
        collector.next_due(0, "credentials_rejected", 10)

    def refused(tag):
        raise battle_log.FetchError("credentials_rejected")

    pass_ = collector.poll(iter("ab"), refused, lambda: 0, 3, lambda: None)
    assert next(pass_) == ("a", None, "credentials_rejected")
    with pytest.raises(PermissionError):
        next(pass_)


def test_due_and_gaps(spark):
    state = spark.sql("select * from values ('b', timestamp'2026-01-01'), ('a', timestamp'2026-01-01'), ('c', timestamp'2027-01-01') t(tag, due_at)")
    assert [r.tag for r in collector.due(state, "2026-06-01", 5).collect()] == ["a", "b"]
    old = spark.createDataFrame([("x", ["1", "2"]), ("y", ["1"]), ("z", [])], "tag string, keys array<string>")
    new = spark.createDataFrame([("x", ["2", "3"]), ("y", ["5"]), ("z", ["9"])], "tag string, keys array<string>")
    assert [r.tag for r in collector.gaps(old, new).collect()] == ["y"]


def test_deck_clusters_fit_on_every_deck(spark, small):
    import __spark_entry__ as entry
    from boutworks.plans.scoring import oriented

    decks = oriented(spark, small).selectExpr("explode(array(array_sort(items_a), array_sort(items_b))) as d").distinct().count()
    found = entry.queries()["m8_deck_clusters"](spark, small)
    assert found.select("cluster").distinct().count() == min(64, decks)


def test_poll_gaps_are_found_among_all_events(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(2000, 1, "2026-01-01", "a"), (2001, 1, "2026-01-02", "b"), (2002, 1, "2026-01-05", "b"), (2003, 2, "2026-01-01", "a"), (2004, 2, "2026-01-03", "a"), (5000, 2, "2026-01-04", "c")]
    spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string").selectExpr("event_id", "user_id", "ts::timestamp_ntz as ts", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    got = entry.queries()["t6_poll_gaps"](spark, str(tmp_path)).collect()
    assert sorted((r.tag, str(r.day)) for r in got) == [("u1", "2026-01-02"), ("u2", "2026-01-04")]
