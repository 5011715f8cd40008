"""Golden cases, invariances and fail-closed behaviour of the contest operators."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boutworks.functions import scalars as S
from boutworks.operators import adapt, channels, counts, digests, history, ledger, live, mechanics, metrics, models, protocol, splits

UTC = dt.timezone.utc
T0 = dt.datetime(2026, 5, 10, 12, 0, tzinfo=UTC)


# Identity ------------------------------------------------------------------


def python_identity(mode, source, ts, sides, winner):
    shown = []
    for player, cards in sides:
        pairs = sorted(cards)
        shown.append({"player_id": player, "cards": [list(p) for p in pairs]})
    shown.sort(key=lambda s: json.dumps(s, separators=(",", ":")))
    body = {"mode": mode, "sides": shown, "source_id": source, "timestamp": ts.isoformat()}
    dump = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return dump(body), dump(body | {"winner": winner or "draw"})


def test_event_key_and_fingerprint(spark):
    rng = random.Random(1)
    rows, want = [], []
    for i in range(200):
        cards = [[(f"c{rng.randrange(30)}-{j}:{rng.choice(['base', 'evolution'])}", rng.randrange(1, 17)) for j in range(8)] for _ in range(2)]
        players = (f"#P{rng.randrange(99)}", f"#Q{rng.randrange(99)}")
        ts = T0 + dt.timedelta(microseconds=rng.choice([0, 0, rng.randrange(10**12)]))
        winner = rng.choice([None, *players])
        rows.append((i, ts, players[0], [c for c, _ in cards[0]], [n for _, n in cards[0]], players[1], [c for c, _ in cards[1]], [n for _, n in cards[1]], winner))
        want.append(python_identity('ran"ked\\x\t', "src", ts, list(zip(players, cards, strict=True)), winner))
    df = spark.createDataFrame(rows, "i int, ts timestamp, pa string, ka array<string>, la array<int>, pb string, kb array<string>, lb array<int>, w string")
    body = S.event_body(F.lit('ran"ked\\x\t'), F.lit("src"), F.col("ts"), (F.col("pa"), F.col("ka"), F.col("la")), (F.col("pb"), F.col("kb"), F.col("lb")))
    got = df.select("i", S.event_key(body).alias("e"), S.fingerprint(body, F.col("w")).alias("f")).orderBy("i").collect()
    assert [(r.e, r.f) for r in got] == want


def test_seeded_hashes(spark):
    keys = [f"k{i}" for i in range(50)]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", S.mirrored(17, F.col("k")).alias("m"), S.hash_fraction(17, F.col("k")).alias("x")).collect()
    for r in rows:
        digest = hashlib.sha256(f"17:{r.k}".encode()).digest()
        assert r.m == (digest[0] % 2 == 1)
        assert r.x == int.from_bytes(digest[:8], "big") / 2**64


def test_deck_hash_ignores_order(spark):
    df = spark.createDataFrame([(["a", "b"], ["x", "y"], [1, 2]), (["b", "a"], ["y", "x"], [2, 1])], "i array<string>, f array<string>, l array<int>")
    got = df.select(S.deck_hash(F.col("i"), F.col("f")).alias("d"), S.deck_content_hash(F.col("i"), F.col("f"), F.col("l")).alias("c")).collect()
    assert got[0] == got[1]
    assert got[0].d == hashlib.sha256(b"a:x|b:y").hexdigest()
    assert got[0].c == hashlib.sha256(b"a:x:1|b:y:2").hexdigest()


def test_times(spark):
    df = spark.createDataFrame([("2026-05-10T12:00:00Z", "20260510T120000.000Z"), ("2026-05-10T12:00:00.5+02:00", "20260510T120000Z"), ("2026-05-10T12:00:00", "soon"), (None, None)], "a string, b string")
    rows = df.select(F.unix_micros(S.strict_timestamp(F.col("a"))).alias("a"), F.unix_micros(S.compact_timestamp(F.col("b"))).alias("b"), S.canonical_z(S.strict_timestamp(F.col("a"))).alias("z")).collect()
    noon = int(T0.timestamp() * 1e6)
    assert [r.a for r in rows] == [noon, noon - 7_200_000_000 + 500_000, None, None]
    assert [r.b for r in rows] == [noon, noon, None, None]
    assert [r.z for r in rows[:2]] == ["2026-05-10T12:00:00Z", "2026-05-10T10:00:00.5Z"]


# Ledger and splits -----------------------------------------------------------


def test_ledger_golden(spark):
    rows = spark.createDataFrame(
        [("a", 0, "e1", "f1", T0, "side_a_win", "p", "q", "F"), ("b", 4, "e1", "f1", T0, "side_a_win", "p", "q", "F"), ("c", 1, "e2", "f2", T0, "draw", "p", "q", "O"), ("a", 7, "e3", "f3", T0, "draw", "p", "q", "F"), ("b", 7, "e3", "f4", T0, "draw", "p", "q", "O")],
        "member string, row_no long, event_key string, fingerprint string, ts timestamp, outcome string, player_a string, player_b string, mode string",
    )
    issues = F.when(F.col("mode") != "F", F.array(F.lit("unsupported_mode"))).otherwise(F.array().cast("array<string>"))
    told = ledger.dispositions(rows, issues)
    got = {(r.member, r.row_no): (r.state, r.issues, r.representative_member) for r in told.collect()}
    assert got == {
        ("a", 0): ("valid", [], "a"),
        ("b", 4): ("quarantined", ["duplicate_battle"], "a"),
        ("c", 1): ("unsupported", ["unsupported_mode"], "c"),
        ("a", 7): ("quarantined", ["conflicting_battle"], "a"),
        ("b", 7): ("quarantined", ["conflicting_battle", "unsupported_mode"], "a"),
    }
    lost = spark.createDataFrame([("a", 3, "invalid", ["malformed_row"])], "member string, row_no long, state string, issues array<string>")
    whole = ledger.with_unadaptable(told, lost)
    assert {r.state: r.n for r in ledger.state_counts(whole).collect()} == {"valid": 1, "invalid": 1, "unsupported": 1, "quarantined": 3, "insufficient_data": 0}
    assert ledger.repeated_keys(whole, "member", "row_no").count() == 0
    assert {r.verdict for r in ledger.first_sightings(rows).where("event_key = 'e3'").collect()} == {"accepted", "conflict"}
    with pytest.raises(ValueError):
        ledger.conserved(6, 4, 1)


def test_splits_are_half_open(spark):
    rows = spark.createDataFrame([(T0 + dt.timedelta(days=d),) for d in (-1, 0, 5)], "ts timestamp")
    label = splits.temporal(F.col("ts"), "2026-05-10T12:00:00Z", "2026-05-15T12:00:00Z")
    assert sorted(r.p for r in rows.select(label.alias("p")).collect()) == ["test", "train", "validation"]
    with pytest.raises(ValueError):
        splits.temporal(F.col("ts"), "2026-05-11", "2026-05-10")
    with pytest.raises(ValueError):
        splits.require_each(splits.split_summary(rows.withColumn("partition", F.lit("train"))))


RAW = {f"{s}_card_{i}": i for s in ("winner", "loser") for i in range(8)} | {f"{s}_card_{i}_level": 16 for s in ("winner", "loser") for i in range(8)} | {"winner_id": " #abc ", "loser_id": "B", "time": "2026-05-10T12:00:00Z", "game_mode": " F "}


@pytest.mark.parametrize(
    ("change", "state", "issues"),
    [
        ({}, "valid", []),
        ({"time": "2026-05-10T12:00:00", "winner_card_0": None}, "invalid", ["malformed_timestamp"]),
        ({"winner_id": "  "}, "invalid", ["malformed_row"]),
        ({"winner_card_0": None}, "quarantined", ["incomplete_deck"]),
        ({"winner_card_0_level": None, "winner_card_1": 999}, "quarantined", ["incomplete_deck"]),
        ({"winner_card_1": 999, "winner_card_2": None}, "quarantined", ["unknown_card"]),
        ({"loser_card_5": 4}, "quarantined", ["repeated_card"]),
        ({"winner_card_3_level": 17}, "invalid", ["malformed_row"]),
        ({"loser_id": "#ABC"}, "quarantined", ["identical_players"]),
        ({"game_mode": " "}, "invalid", ["malformed_row"]),
        ({"game_mode": "O", "loser_card_0_level": 15, "time": "2026-06-01T00:00:00Z"}, "unsupported", ["unsupported_mode", "non_max_card_level", "stale_balance_era"]),
    ],
)
def test_first_error_wins(spark, change, state, issues):
    eras = spark.createDataFrame([("a", dt.datetime(2026, 5, 5, tzinfo=UTC), dt.datetime(2026, 6, 1, tzinfo=UTC)), ("b", dt.datetime(2026, 6, 2, tzinfo=UTC), None)], "era string, valid_from timestamp, valid_to timestamp")
    raw = RAW | change
    names = [c.split()[0] for c in adapt.RAW_SCHEMA.split(", ")]
    row = adapt.adapt(spark.createDataFrame([tuple(raw[n] for n in names)], adapt.RAW_SCHEMA), tuple(range(8)), eras, "F").first()
    assert (row.state, row.issues) == (state, issues)


# Scores ------------------------------------------------------------------------


def test_metrics_golden(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 0.8), (0, 0.3)], "label int, p double")
    got = metrics.summary(rows).first()
    assert got.log_loss == pytest.approx(-(math.log(0.5) + math.log(0.8) + math.log(0.7)) / 3)
    assert got.brier == pytest.approx((0.25 + 0.04 + 0.09) / 3)
    assert got.accuracy == pytest.approx(2.5 / 3)
    assert got.ece == pytest.approx((0.5 + 0.2 + 0.3) / 3)
    assert got.ties == 1


def test_dyadic_is_brute_force(spark):
    pairs = [tuple(x.split("-")) for x in "A-B B-A B-C D-E A-F G-H C-D".split()]
    values = [0.3, -0.1, 0.4, 0.2, -0.5, 0.1, 0.7]
    got = metrics.dyadic(spark.createDataFrame([(a, b, v) for (a, b), v in zip(pairs, values, strict=True)], "player_a string, player_b string, v double"), "v").first()
    mean = sum(values) / 7
    want = sum((values[i] - mean) * (values[j] - mean) for i in range(7) for j in range(7) if set(pairs[i]) & set(pairs[j])) / 49
    assert (got.pairs, got.n) == (6, 7)
    assert got.variance == pytest.approx(want)
    assert got.max_incidence == pytest.approx(3 / 7)
    assert got.few_players


def test_holm(spark):
    told = lambda rows: {r.name: r.adjusted for r in metrics.holm(spark.createDataFrame(rows, "name string, p double")).collect()}
    assert told([("a", 0.01), ("b", 0.04), ("c", 0.03)]) == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.06})
    assert told([("a", 0.01), ("b", None)]) == {"a": pytest.approx(0.02), "b": None}
    assert metrics.normal_p_values(-1.959963984540054) == pytest.approx((0.025, 0.05))


def test_pairing_fails_closed(spark):
    a = spark.createDataFrame([(1, 1, 0.5), (2, 0, 0.4)], "k int, label int, p double")
    assert metrics.paired(a, a, ("k",), ("label",)).count() == 2
    for b in (a.where("k = 1"), a.withColumn("label", F.lit(1)), a.union(a)):
        with pytest.raises(ValueError):
            metrics.paired(a, b, ("k",), ("label",))


def observations(spark, rows):
    return spark.createDataFrame([("A", T0 + dt.timedelta(minutes=m), f"f{m}", "m", m, p, w) for m, p, w in rows], "player string, ts timestamp, fingerprint string, member string, row_no long, chance double, win int")


def test_rolling_golden(spark):
    got = history.rolling(observations(spark, [(1, 0.25, 1), (2, 0.5, 0), (3, 0.75, 1)]), 3).first()
    assert (got.sos, got.expected_wins, got.actual_wins, got.above_expectation) == (0.5, 1.5, 2, 0.5)
    got = history.rolling(observations(spark, [(3, 0.7, 1), (1, 0.1, 0), (4, 0.9, 1), (2, 0.3, 0)]), 2).first()
    assert (got.expected_wins, got.eligible) == (pytest.approx(1.6), 4)
    assert history.rolling(observations(spark, [(1, 0.5, 1)]), 2).first().status == "insufficient_data"
    with pytest.raises(ValueError):
        history.rolling(observations(spark, []), 0)


BOUT = "ts timestamp, fingerprint string, member string, row_no long, player_a string, player_b string, outcome string, p double, label int"


def test_prior_skill_by_hand(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        a, b = rng.sample("ABCD", 2)
        y = rng.randrange(2)
        rows.append((T0 + dt.timedelta(minutes=i // 4), f"f{i:03}", "m", i, a, b, "side_a_win" if y else "side_b_win", 0.5, y))
    df = spark.createDataFrame(rows, BOUT)
    rating = lambda w, n: math.log((w + 1) / (n - w + 1))
    for apart in (True, False):
        got = {r.row_no: r.gap for r in history.prior_skill(df, apart).collect()}
        wins, games, waiting = defaultdict(int), defaultdict(int), []
        for i, (ts, *_, a, b, _, _, y) in enumerate(rows):
            if apart or (waiting and waiting[-1][0] != ts):
                for _, p, won in waiting:
                    games[p] += 1
                    wins[p] += won
                waiting = []
            assert got[i] == pytest.approx(rating(wins[a], games[a]) - rating(wins[b], games[b]), abs=1e-9)
            waiting += [(ts, a, y), (ts, b, 1 - y)]


def test_components_and_support(spark):
    rows = [(T0, f"f{i}", "m", i, a, b, "draw", 0.5, None) for i, (a, b) in enumerate(["AB", "BC", "DE", "CA", "FG", "GE"])]
    got = {r.player: r.component for r in history.opponent_components(spark.createDataFrame(rows, BOUT)).collect()}
    assert got == {"A": "A", "B": "A", "C": "A", "D": "D", "E": "D", "F": "D", "G": "D"}


# Models and features --------------------------------------------------------------


def test_serial_updates_follow_the_order(spark):
    rows = [(i, [i % 3], [(i + 1) % 3], i % 2) for i in range(30)]
    got = {r.item: r.effect for r in models.serial_updates(spark.createDataFrame(rows, "i int, items_a array<int>, items_b array<int>, label int"), ("i",), 0.1).collect()}
    w = defaultdict(float)
    for _, (a,), (b,), y in rows:
        g = 0.1 * (y - 1 / (1 + math.exp(-(w[a] - w[b]))))
        w[a] += g
        w[b] -= g
    assert got == pytest.approx(dict(w))


def test_temperature(spark):
    rows = spark.range(400).selectExpr("case when id % 4 = 0 then 0 else 1 end as label", "ln(0.9 / 0.1) as logit")
    assert models.fit_temperature(rows, "logit") == pytest.approx(math.log(9) / math.log(3), rel=0.02)
    with pytest.raises(ValueError):
        models.fit_temperature(rows.withColumn("label", F.lit(1)), "logit")


def test_features_are_antisymmetric(spark):
    from boutworks.plans.features import entry

    rng = random.Random(2)
    rows = [(i, rng.sample(range(104), 8), rng.sample(range(104), 8)) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a array<int>, b array<int>").select("i", F.transform("a", entry).alias("a"), F.transform("b", entry).alias("b"))
    every = (mechanics.response, mechanics.cycle, mechanics.patterns)
    there = {r.i: r for r in mechanics.features(df, "a", "b", every, ("i",)).collect()}
    back = {r.i: r for r in mechanics.features(df, "b", "a", every, ("i",)).collect()}
    for i in there:
        assert [-x for x in there[i][1:]] == pytest.approx(list(back[i][1:]))


def test_conditional_channels_by_hand(spark):
    names = {c: "boolean" for c in ("airborne", "spell", "targets_air", "spell_damage", "spell_control", *channels.CAPABILITIES)}
    words = ("airborne_mode", "airborne_condition", "targets_air_condition", "conditional_air_trigger", "conditional_air_response_scope", "conditional_air_control_kind", "ability_usage")
    schema = "kind string, inapplicable array<string>, ability_cost double, " + ", ".join([f"{n} {t}" for n, t in names.items()] + [f"{w} string" for w in words])
    rising = {k: v for k, v in channels.HYBRID.items()}
    paid = {"conditional_air_control": True, "conditional_air_trigger": "paid_ability", "conditional_air_response_scope": "moving_area", "conditional_air_control_kind": "pull", "ability_usage": "single_use_per_deployment", "targets_air": False}
    deck = [
        rising,
        rising | {"airborne_condition": None},  # a hybrid that is not whole has no channel
        paid | {"ability_cost": 2.0},
        paid,  # its cost is missing
        paid | {"ability_usage": None},
        paid | {"kind": "tower"},
        {"inapplicable": ["conditional_airborne"]},
        {},
    ]
    base = {"kind": "card", "inapplicable": None, "ability_cost": None} | dict.fromkeys([*names, *words])
    d = spark.createDataFrame([([tuple((base | e).values()) for e in deck], [tuple(base.values())] * 8)], f"a array<struct<{schema}>>, b array<struct<{schema}>>")
    d = d.select(*[channels.told(F.col(c)).alias(c) for c in "ab"])
    got = d.select(*[v.alias(k.replace(".", "__")) for k, v in channels.conditional_air(F.col("a"), F.col("b")).items()]).first().asDict()
    want = {"airborne": 1, "airborne__unavailable": 6, "air_damage": 1, "air_control": 2, "air_control__unavailable": 6, "trigger__paid_ability": 2, "scope__moving_area": 2, "scope__flying_form_attack": 1, "control__pull": 2}
    want |= {"additional_response_cards": 3, "ability_cost": 2, "ability_cost_missing": 1}
    assert {k: got[f"conditional_air__{k}"] for k in want} == want
    issues = d.select(F.transform("a", channels.hybrid_issues).alias("x")).first().x
    assert issues[0] == [] and issues[1] == ["airborne_condition"] and len(issues[7]) == len(channels.HYBRID)
    asked = d.select(F.transform("a", lambda e: channels.channel_fields(e, "conditional_air_control", cost=True)).alias("x")).first().x
    assert asked[2][-2:] == ["ability_usage", "ability_cost"] and len(asked[0]) == 4
    with pytest.raises(ValueError):
        channels.channel_fields(F.col("a"), "flying")


def test_return_cost_by_hand(spark):
    from boutworks.plans.features import entry

    def card(i):
        on = i % 17 != 0
        return {"cost": i % 9 + 1 if i % 11 and i % 19 and i % 23 else None, "ordinary": on and i % 13 != 0, "air": on and i % 5 == 0}

    rng = random.Random(5)
    rows = [(i, rng.sample(range(104), 8)) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, d array<int>")
    got = {r.i: r.c for r in df.select("i", mechanics.return_costs(F.transform("d", entry), lambda e: mechanics.yes(e, "airborne")).alias("c")).collect()}
    for i, deck in rows:
        cards, want = [card(x) for x in deck], []
        for k, c in enumerate(cards):
            costs = sorted(o["cost"] for j, o in enumerate(cards) if j != k and o["ordinary"] and o["cost"] is not None)
            if c["air"] and len(costs) >= 4:
                want.append(sum(costs[:4]))
        assert got[i] == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(0, 1)), min_size=1, max_size=20))
def test_log_loss_forms_agree(spark, rows):
    df = spark.createDataFrame(rows, "p double, label int")
    got = df.select(S.row_log_loss(F.col("label"), F.col("p")).alias("a"), S.logit_loss(F.col("label"), S.logit(F.col("p"))).alias("b"), S.sigmoid(S.logit(F.col("p"))).alias("p2"), "p").collect()
    assert all(r.a == pytest.approx(r.b, abs=1e-9) and r.p2 == pytest.approx(r.p) for r in got)


def test_swapping_twice_is_nothing(spark):
    df = spark.createDataFrame([("f", "A", "B", 1)], "fingerprint string, player_a string, player_b string, label int")
    pairs = (("player_a", "player_b"),)
    once = counts.swapped(df, pairs)
    assert once.first()[1:] == ("B", "A", 0)
    assert counts.swapped(once, pairs).first() == df.first()


# Live logs and protocol ------------------------------------------------------------


def test_live_log_rejections(spark):
    cards = [{"id": i, "name": f"Card  {i}", "level": 14, "maxLevel": 14} for i in range(8)]
    tower = {"id": 90, "name": "Tower", "level": 15, "maxLevel": 15}
    side = lambda tag, crowns, **more: {"tag": tag, "name": "n", "crowns": crowns, "cards": cards, "supportCards": [tower]} | more
    good = {"battleTime": "20260510T120000.000Z", "type": "pathOfLegend", "gameMode": {"name": "Ranked1v1_NewArena2"}, "team": [side("#AAA", 2)], "opponent": [side("#BBB", 1)]}
    cases = [
        (good, None, None),
        (good | {"team": []}, "team_battle", None),
        (good | {"team": [side("bad tag", 2)]}, "invalid_player_tag", None),
        (good | {"opponent": [side("#BBB", 1, cards=cards[:7])]}, "incomplete_deck", None),
        (good | {"opponent": [side("#BBB", 1, cards=[*cards[:7], cards[0]])]}, "repeated_card", None),
        (good | {"opponent": [side("#BBB", 1, cards=[*cards[:7], {"id": 77, "name": "x", "level": 1, "maxLevel": 14}])]}, "unknown_card", None),
        (good | {"team": [side("#AAA", 2, cards=[*cards[:7], cards[7] | {"level": 15}])]}, "invalid_card_level", None),
        (good | {"team": [side("#AAA", 2, cards=[*cards[:7], cards[7] | {"id": 99}])]}, "invalid_card_id", None),
        (good | {"team": [side("#AAA", 2, cards=[*cards[:7], cards[7] | {"maxLevel": 15}])]}, "invalid_card_level", None),
        (good | {"team": [side("#AAA", 2, cards=[*cards[:7], cards[7] | {"evolutionLevel": 1}])]}, None, None),
        (good | {"team": [side("#AAA", 2, cards=[*cards[:7], cards[7] | {"evolutionLevel": 3}])]}, "unknown_card", None),
        (good | {"team": [side("#AAA", 2, cards=[*cards[:7], cards[6] | {"heroLevel": 1}])]}, "unknown_card", None),
        (good | {"team": [side("#AAA", 2, cards=[*cards[:7], "x"])]}, "incomplete_deck", None),
        (good | {"team": [side("#AAA", 2, supportCards=[])]}, "missing_tower", None),
        (good | {"team": [side("#AAA", 2, supportCards=[tower | {"id": 91}])]}, "unknown_tower", None),
        (good | {"team": [side("#AAA", 2, supportCards=[tower | {"name": "Other"}])]}, "invalid_tower", None),
        (good | {"team": [side("#AAA", 2, supportCards=[tower | {"level": 16}])]}, "invalid_tower", None),
        (good | {"team": [side("#AAA", 2, supportCards=[tower | {"level": None}])]}, "invalid_tower", None),
        (good | {"team": [side("#CCC", 2)]}, "player_not_in_battle", None),
        (good | {"battleTime": "soon"}, "invalid_battle_time", None),
        (good | {"team": [side("#AAA", -1)]}, "invalid_outcome", None),
        (good | {"gameMode": {}}, "invalid_mode", None),
        (good | {"team": [side("#AAA", 1)]}, None, "draw"),
        (good | {"type": "casual"}, None, "unsupported_mode"),
        (good | {"team": [side("#AAA", 2, cards=[*cards[:7], cards[7] | {"level": 13}])]}, None, "non_max_level"),
    ]
    raw = spark.createDataFrame([(i, "#aaa", json.dumps(c)) for i, (c, _, _) in enumerate(cases)], "i int, tag string, raw string")
    catalog = [live.Entry(f"Card {i}", f"card-{i}:base", i, 14) for i in range(8)] + [live.Entry("Evo Card 7", "card-7:evo", 7, 14)]
    got = live.normalized(live.parsed(raw), "tag", catalog, [live.Entry("Tower", "tower:tower", 90, 15)]).orderBy("i").collect()
    assert [(r.rejection, r.exclusion) for r in got] == [(a, b) for _, a, b in cases]
    plain = [[f"card-{i}:base", 16] for i in range(8)]
    sides = [{"cards": plain, "tag": t, "tower": "tower:tower", "tower_level": 16} for t in ("#AAA", "#BBB")]
    told = {"battle_type": "pathOfLegend", "mode": "Ranked1v1_NewArena2", "sides": sides, "timestamp": "2026-05-10T12:00:00Z", "winner_tag": "#AAA"}
    digest = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    draw = next(r for r in got if r.exclusion == "draw")
    assert got[0].event_key == draw.event_key == digest({"source": "official-api", "timestamp": told["timestamp"], "players": ["#AAA", "#BBB"]})
    assert (got[0].variant, draw.variant) == (digest(told), digest(told | {"winner_tag": None}))


def test_json_text_is_ascii(spark):
    texts = ["", "plain", 'a"b\\c', "\n\r\t\f\b\x01\x1f\x7f", "é日本😀", "$1 \\u"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", S.json_text(F.col("t")).alias("j")).orderBy("i").collect()
    assert [r.j for r in got] == [json.dumps(t) for t in texts]


def test_protocol(spark, tmp_path):
    with pytest.raises(ValueError):
        protocol.stages("2026-01-01", "2026-01-01", "2026-02-01", "2026-03-01", "2026-04-01")
    rows = spark.createDataFrame([("fit", "e1"), ("reporting", "e2")], "role string, event_key string")
    assert protocol.read(rows, "fit", "train").count() == 1
    with pytest.raises(PermissionError):
        protocol.read(rows, "reporting", "train")
    protocol.reserve(rows, str(tmp_path / "used"))
    with pytest.raises(ValueError):
        protocol.reserve(rows.limit(1), str(tmp_path / "used"))
    assert protocol.unconsumed(rows.union(spark.createDataFrame([("fit", "e9")], rows.schema)), rows).count() == 1
    with pytest.raises(ValueError):
        protocol.synthetic_population(spark, 40)


def test_digests(spark):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "k int, v string")
    again = rows.repartition(3).orderBy(F.desc("k"))
    assert digests.ordered_digest(rows, ["k"]) == digests.ordered_digest(again, ["k"])
    assert digests.ordered_digest(rows, ["k"]) != digests.ordered_digest(rows.where("k > 0"), ["k"])
    assert digests.bag_digest(rows, ["k", "v"]).first() == digests.bag_digest(again, ["k", "v"]).first()


def test_shuffled_labels_keep_counts(spark):
    rows = spark.range(100).selectExpr("cast(id as string) as fingerprint", "if(id < 40, 'fit', 'watch') as role", "cast(id % 2 as int) as label")
    got = models.shuffled_labels(rows, 3, "role", "fingerprint")
    assert sorted(map(tuple, got.groupBy("role", "label").count().collect())) == sorted(map(tuple, rows.groupBy("role", "label").count().collect()))
    assert got.join(rows, ["fingerprint", "role", "label"]).count() < 100
