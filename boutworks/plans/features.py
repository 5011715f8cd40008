"""Mechanics, live-log, protocol and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import channels, digests, history, live, mechanics, models, protocol
from ..sources.shared import written
from .bouts import BOUTS_SQL, TRAIN_END, VALIDATION_END, decided, table
from .registry import query, rounded
from .scoring import ORIENTED_SQL, oriented

#: A made-up catalog by arithmetic on an item's number; every 17th lacks its flags.
_FLAGS = {"airborne": 5, "multi_unit": 4, "building_targeting": 7, "targets_air": 3, "spell": 6, "spell_damage": 12, "spell_control": 18, "area_damage": 4, "targets_ground": 2, "defensive_building": 9, "building_disruption": 12, "ordinary_cycle": 0}


def entry(i: Column) -> Column:
    def flag(name: str, k: int) -> Column:
        value = (i % 13 != 0) if k == 0 else (i % k == 0)
        return F.when(i % 17 != 0, value).alias(name)

    return F.struct(
        i.alias("item"), F.lit("card").alias("kind"), F.when(i % 3 == 0, "evolution").otherwise("base").alias("form"),
        F.when(i % 11 == 0, "conditional").when(i % 19 != 0, "fixed").alias("cost_kind"), F.when(i % 23 != 0, i % 9 + 1).alias("deploy_cost"),
        *[flag(n, k) for n, k in _FLAGS.items()],
    )


def _entry_sql(items: str) -> str:
    flags = ", ".join(f"'{n}': CASE WHEN i % 17 <> 0 THEN " + ("i % 13 <> 0" if k == 0 else f"i % {k} = 0") + " END" for n, k in _FLAGS.items())
    return f"list_transform({items}, lambda i: {{'item': i, 'kind': 'card', 'form': CASE WHEN i % 3 = 0 THEN 'evolution' ELSE 'base' END, 'cost_kind': CASE WHEN i % 11 = 0 THEN 'conditional' WHEN i % 19 <> 0 THEN 'fixed' END, 'deploy_cost': CASE WHEN i % 23 <> 0 THEN (i % 9 + 1)::DOUBLE END, {flags}}})"


DECKS_SQL = ORIENTED_SQL + f", dk2 AS (SELECT member, row_no, {_entry_sql('items_a')} AS da, {_entry_sql('items_b')} AS db FROM items)\n"


def decks(spark, sf_dir):
    return oriented(spark, sf_dir).select("member", "row_no", "items_a", "items_b", F.transform("items_a", entry).alias("da"), F.transform("items_b", entry).alias("db"))


def _n(deck: str, cond: str) -> str:
    return f"len(list_filter({deck}, lambda e: coalesce({cond}, false)))"


_ANSWER = {
    "airborne": "coalesce(e.targets_air, false) AND (coalesce(NOT e.spell, false) OR (coalesce(e.spell, false) AND (coalesce(e.spell_damage, false) OR coalesce(e.spell_control, false))))",
    "multi_unit": "coalesce(e.area_damage, false)",
    "building_targeting": "coalesce(e.defensive_building, false) OR (coalesce(e.spell, false) AND coalesce(e.building_disruption, false))",
}


def _response(a: str, b: str) -> dict[str, str]:
    out = {}
    for f, ans in _ANSWER.items():
        t, d, s = _n(a, f"e.{f}"), _n(b, f"({ans}) AND NOT e.spell"), _n(b, f"({ans}) AND e.spell")
        cost = f"list_min(list_transform(list_filter({b}, lambda e: ({ans}) AND e.spell IS NOT NULL AND e.cost_kind = 'fixed' AND e.deploy_cost IS NOT NULL), lambda e: e.deploy_cost))"
        blank = " + ".join([_n(a, f"e.{f} IS NULL"), *[_n(b, f"e.{x} IS NULL") for x in mechanics.ANSWER_FIELDS]])
        out |= {
            f"response__{f}__threat_count": t, f"response__{f}__deployable_answers": f"least({d}, 2)", f"response__{f}__spell_answers": f"least({s}, 2)", f"response__{f}__tower_answers": "0",
            f"response__{f}__minimum_response_cost": f"coalesce({cost}, 0)", f"response__{f}__response_cost_missing": f"({cost} IS NULL)::INT", f"response__{f}__unanswered_exposure": f"{t} * ({d} + {s} = 0)::INT",
            f"response__{f}__sole_answer_pressure": f"greatest({t} - 1, 0) * ({d} = 1)::INT", f"response__{f}__response_context": f"{t} * ({d} + {s} > 0)::INT", f"response__{f}__unknown_fields": f"({blank})",
        }
    return out


def _cycle(a: str, b: str) -> dict[str, str]:
    costs = f"list_transform(list_filter({a}, lambda e: e.cost_kind = 'fixed' AND e.deploy_cost IS NOT NULL), lambda e: e.deploy_cost)"
    m = f"coalesce(list_avg({costs}), 0)"
    return {
        "cycle__mean_fixed_cost": m,
        "cycle__cost_dispersion": f"coalesce(list_var_pop({costs}), 0)",
        "cycle__cheap_count": f"len(list_filter({costs}, lambda c: c <= 2))",
        "cycle__expensive_count": f"len(list_filter({costs}, lambda c: c >= 5))",
        "cycle__conditional_count": _n(a, "e.cost_kind = 'conditional'"),
        "cycle__cost_unknown_count": _n(a, "e.cost_kind IS NULL OR (e.cost_kind = 'fixed' AND e.deploy_cost IS NULL)"),
        "cycle__special_cycle_count": _n(a, "NOT e.ordinary_cycle"),
        "cycle__cycle_unknown_count": _n(a, "e.ordinary_cycle IS NULL"),
    }


def _return_cost(deck: str, test: str) -> str:
    """SQL of the least, over cards that pass, of the four cheapest other ordinary fixed costs."""
    others = f"list_sort(list_transform(list_filter(range(1, 9), lambda j: j <> k AND coalesce({deck}[j].ordinary_cycle AND {deck}[j].cost_kind = 'fixed' AND {deck}[j].deploy_cost IS NOT NULL, false)), lambda j: {deck}[j].deploy_cost))"
    each = f"list_transform(range(1, 9), lambda k: {{'e': {deck}[k], 'o': {others}}})"
    return f"list_min(list_transform(list_filter({each}, lambda s: coalesce({test.replace('e.', 's.e.')}, false) AND len(s.o) >= 4), lambda s: list_sum(s.o[1:4])))"


def _returns(a: str, b: str) -> dict[str, str]:
    out = {}
    for f, ans in _ANSWER.items():
        cost = lambda deck, test: f"list_transform(list_filter({deck}, lambda e: coalesce(({test}) AND e.cost_kind = 'fixed' AND e.deploy_cost IS NOT NULL, false)), lambda e: e.deploy_cost)"
        x, y, least = _return_cost(a, f"e.{f}"), _return_cost(b, f"({ans})"), f"list_min({cost(b, ans)})"
        out |= {
            f"cycle__{f}__threat_commitment": f"coalesce(list_sum({cost(a, f'e.{f}')}), 0)", f"cycle__{f}__response_commitment": f"coalesce({least}, 0)", f"cycle__{f}__commitment_missing": f"({least} IS NULL)::INT",
            f"cycle__{f}__return_cost_gap": f"coalesce({x} - {y}, 0)", f"cycle__{f}__return_cost_missing": f"({x} - {y} IS NULL)::INT",
        }
    return out


def _patterns(a: str, b: str) -> dict[str, str]:
    out = {}
    for name, threat, support, defend, least, most in mechanics.PATTERNS:
        t, r = _n(a, f"e.{threat}"), _n(b, f"e.{defend} AND NOT coalesce(e.spell, false)")
        side = _n(a, f"e.spell AND e.{support} AND NOT coalesce(e.{threat}, false)")
        out[f"pattern__{name}"] = f"CASE WHEN {t} >= {least} AND {side} > 0 AND {r} BETWEEN 1 AND {most} THEN least({t}, {mechanics.PATTERN_CAP}) ELSE 0 END"
    return out


def _antisymmetric(f) -> str:
    there, back = f("da", "db"), f("db", "da")
    return "SELECT member, row_no, " + ", ".join(f"round(({there[n]} - ({back[n]}))::DOUBLE, 6) + 0.0 AS {n}" for n in there) + " FROM dk2"


KEYS = ("member", "row_no")


@query("m20_response_features", DECKS_SQL + _antisymmetric(_response))
def response(spark, sf_dir):
    return rounded(mechanics.features(decks(spark, sf_dir), "da", "db", (mechanics.response,), KEYS))


@query("m21_cycle_features", DECKS_SQL + _antisymmetric(_cycle))
def cycle(spark, sf_dir):
    got = mechanics.features(decks(spark, sf_dir), "da", "db", (mechanics.cycle,), KEYS)
    return rounded(got.select(*KEYS, *_cycle("da", "db")))


@query("m21_return_costs", DECKS_SQL + _antisymmetric(_returns))
def return_costs(spark, sf_dir):
    got = mechanics.features(decks(spark, sf_dir), "da", "db", (mechanics.cycle,), KEYS)
    return rounded(got.select(*KEYS, *[c for c in got.columns if c.count("__") == 2]))


@query("m25_pattern_features", DECKS_SQL + _antisymmetric(_patterns))
def pattern_features(spark, sf_dir):
    return rounded(mechanics.features(decks(spark, sf_dir), "da", "db", (mechanics.patterns,), KEYS))


#: Entries of a made-up catalog with what `channels` reads, by arithmetic on an item's number i that both engines know.
_ITEM = {n: f"CASE WHEN i % 17 <> 0 THEN i % {k} = 0 END" for n, k in {
    "airborne": 5, "multi_unit": 4, "building_targeting": 7, "targets_air": 3, "spell": 6, "spell_damage": 12, "spell_control": 18, "area_damage": 4, "targets_ground": 2, "defensive_building": 9,
    "building_disruption": 12, "conditional_airborne": 2, "conditional_air_damage": 1, "conditional_air_control": 3, "conditional_air_reflection": 5, "conditional": 4, "shield": 5, "spawns_units": 3, "control": 7,
}.items()} | {
    "identity": "concat('c', i, CASE WHEN i % 7 = 1 THEN ':champion' ELSE ':base' END)",
    "base_identity": "CASE WHEN i % 3 = 0 THEN concat('b', i) END",
    "airborne_mode": "CASE i % 4 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'air' ELSE 'ground' END",
    "airborne_condition": "CASE WHEN i % 8 <> 4 THEN 'available_elixir_at_least_6' END",
    "targets_air_condition": "'available_elixir_at_least_6'",
    "conditional_air_trigger": "CASE WHEN i % 7 = 0 THEN NULL WHEN i % 4 = 0 THEN 'available_elixir_at_least_6' ELSE 'paid_ability' END",
    "conditional_air_response_scope": "CASE WHEN i % 9 = 0 THEN NULL WHEN i % 4 = 0 THEN 'flying_form_attack' WHEN i % 2 = 0 THEN 'moving_area' ELSE 'enhanced_attack_area' END",
    "conditional_air_control_kind": "CASE WHEN i % 10 = 9 THEN NULL WHEN i % 2 = 0 THEN 'pull' ELSE 'slow' END",
    "ability_usage": "CASE WHEN i % 5 <> 4 THEN 'single_use_per_deployment' END",
    "ability_cost": "CASE WHEN i % 6 <> 5 THEN CAST(i % 5 AS DOUBLE) END",
    "activation_cycles": "CASE WHEN i % 3 <> 1 THEN CAST(i % 2 + 1 AS DOUBLE) END",
    "not_cycles": "i % 6 = 1",
}
#: Three towers, by the number t.
_TOWER = {
    "identity": "concat('tower', t)", "targets_air": "t < 2", "targets_ground": "CASE WHEN t > 0 THEN true END", "area_damage": "t = 2", "tower_support": "t = 1", "burst": "CASE WHEN t < 2 THEN false END",
    "damage_per_hit": "CAST(50 + t AS DOUBLE)", "attack_interval": "CASE WHEN t < 2 THEN CAST(2 AS DOUBLE) END", "recharge": "CASE WHEN t = 1 THEN CAST(3 AS DOUBLE) END", "not_recharge": "t = 0",
}


def conditional_decks(spark, sf_dir):
    """Both decks of a row as nine entries: eight cards and a tower."""
    made = oriented(spark, sf_dir).select(*KEYS, "items_a", "items_b")
    card, tower = ("named_struct(" + ", ".join(f"'{n}', {e}" for n, e in of.items()) + ")" for of in (_ITEM, _TOWER))
    names = sorted({*_ITEM, *_TOWER} - {"not_cycles", "not_recharge"})
    numbers = {"ability_cost", "activation_cycles", *channels.TOWER_NUMBERS}
    kinds = {n: "double" if n in numbers else "string" if n in _ITEM and "'" in _ITEM[n] else "boolean" for n in names}

    def whole(e: Column, of: dict, kind: str, flag: str, field: str) -> Column:
        gone = F.when(e[flag], F.array(F.lit(field))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.lit(kind).alias("kind"), gone.alias("inapplicable"), *[(e[n] if n in of else F.lit(None)).cast(kinds[n]).alias(n) for n in names])

    for side in ("a", "b"):
        eight = F.transform(F.expr(f"transform(items_{side}, i -> {card})"), lambda e: whole(e, _ITEM, "card", "not_cycles", "activation_cycles"))
        ninth = F.transform(F.expr(f"transform(array(items_{side}[0] % 3), t -> {tower})"), lambda e: whole(e, _TOWER, "tower", "not_recharge", "recharge"))
        made = made.withColumn(f"d{side}", F.concat(eight, ninth))
    return made.drop("items_a", "items_b")


def _struct_sql(of: dict) -> str:
    return "{" + ", ".join(f"'{n}': {e}" for n, e in of.items()) + "}"


_WHOLE = "(e.airborne_mode = 'hybrid' AND coalesce(e.conditional_airborne AND e.conditional_air_damage AND NOT e.spell AND e.airborne_condition = 'available_elixir_at_least_6' AND e.targets_air_condition = 'available_elixir_at_least_6' AND e.conditional_air_trigger = 'available_elixir_at_least_6' AND e.conditional_air_response_scope = 'flying_form_attack', false))"
_TOLD = f"(e.conditional_air_trigger IS NOT NULL AND e.conditional_air_response_scope IS NOT NULL AND (e.conditional_air_trigger <> 'paid_ability' OR e.ability_usage IS NOT NULL) AND (e.airborne_mode <> 'hybrid' OR {_WHOLE}))"
_HAS = {"airborne": f"e.conditional_airborne AND {_TOLD}", "air_damage": f"e.conditional_air_damage AND {_TOLD}", "air_control": f"e.conditional_air_control AND {_TOLD} AND e.conditional_air_control_kind IS NOT NULL", "air_reflection": f"e.conditional_air_reflection AND {_TOLD}"}
_HAS_SQL = ", ".join(f"has_{n} := coalesce({sql}, false)" for n, sql in _HAS.items()) + f", whole := {_WHOLE}, in_form := (e.base_identity IS NOT NULL OR e.identity LIKE '%:champion'), " + ", ".join(f"meets_{f} := coalesce({sql}, false)" for f, sql in _ANSWER.items())
CONDITIONAL_SQL = ORIENTED_SQL + ", dk3 AS MATERIALIZED (SELECT member, row_no, " + ", ".join(f"list_transform(list_transform(items_{s}, lambda i: {_struct_sql(_ITEM)}), lambda e: struct_insert(e, {_HAS_SQL})) AS d{s}, list_transform([items_{s}[1] % 3], lambda t: {_struct_sql(_TOWER)})[1] AS t{s}" for s in "ab") + " FROM items)\n"


def _air(a: str, b: str, _t: str) -> dict[str, str]:
    """Column names and SQL of the conditional-air features."""
    common, conditional = _n(b, "e.airborne"), _n(b, "e.has_airborne AND NOT coalesce(e.airborne, false)")
    any_response, active = "(e.has_air_damage OR e.has_air_control OR e.has_air_reflection)", "(e.has_airborne OR e.has_air_damage OR e.has_air_control OR e.has_air_reflection)"
    out = {}
    for n in _HAS:
        out |= {n: _n(a, f"e.has_{n}"), f"{n}__unavailable": _n(a, f"e.conditional_{n} IS NULL OR (e.conditional_{n} AND NOT e.has_{n})")}
        if n != "airborne":
            out |= {f"{n}__opposing_ordinary_threats": f"{_n(a, f'e.has_{n}')} * {common}", f"{n}__opposing_conditional_threats": f"{_n(a, f'e.has_{n}')} * {conditional}"}
    out |= {f"trigger__{v}": _n(a, f"{active} AND e.conditional_air_trigger = '{v}'") for v in ("available_elixir_at_least_6", "paid_ability")}
    out |= {f"scope__{v}": _n(a, f"{active} AND e.conditional_air_response_scope = '{v}'") for v in ("departure_bomb_area", "eligible_incoming_projectiles", "enhanced_attack_area", "flying_form_attack", "moving_area", "selected_troop_ground_only_splash")}
    out |= {f"control__{v}": _n(a, f"e.has_air_control AND e.conditional_air_control_kind = '{v}'") for v in ("knockback", "pull", "slow", "throw_and_stun")}
    paid = f"{active} AND e.conditional_air_trigger = 'paid_ability'"
    out["additional_response_cards"] = _n(a, f"{any_response} AND NOT e.meets_airborne AND (coalesce(NOT e.targets_air, false) OR e.whole)")
    out["ability_cost"] = f"coalesce(list_sum(list_transform(list_filter({a}, lambda e: coalesce({paid}, false)), lambda e: e.ability_cost)), 0)"
    out["ability_cost_missing"] = _n(a, f"{paid} AND e.ability_cost IS NULL")
    rising = _n(a, "e.has_airborne AND NOT coalesce(e.airborne, false)")
    out |= {f"airborne__opposing_{k}_answers": f"{rising} * least({_n(b, f'{t} AND e.meets_airborne')}, 2)" for k, t in (("deployable", "NOT e.spell"), ("spell", "e.spell"))}
    return {f"conditional_air__{n}": sql for n, sql in out.items()}


def _forms(a: str, b: str, _t: str) -> dict[str, str]:
    """Column names and SQL of the form features."""
    out = {}
    for d in ("targets_air", "area_damage", "shield", "spawns_units", "control", "conditional"):
        n = _n(a, f"e.in_form AND e.{d}")
        out |= {d: n, f"{d}__opposing_multi_unit": f"{n} * {_n(b, 'e.multi_unit')}", f"{d}__unknown": _n(a, f"e.in_form AND e.{d} IS NULL")}
    for d, known in (("activation_cycles", "NOT e.not_cycles"), ("ability_cost", "true")):
        out |= {d: f"coalesce(list_sum(list_transform(list_filter({a}, lambda e: e.in_form), lambda e: e.{d})), 0)", f"{d}__unknown": _n(a, f"e.in_form AND e.{d} IS NULL AND {known}")}
    for f in ("airborne", "multi_unit", "building_targeting"):
        troops, spells, n = _n(b, f"NOT e.spell AND e.meets_{f}"), _n(b, f"e.spell AND e.meets_{f}"), _n(a, f"e.in_form AND e.{f}")
        out |= {f"{f}__unanswered_form_exposure": f"{n} * ({troops} + {spells} = 0)::INT", f"{f}__shared_response_pressure": f"{n} * ({_n(a, f'e.{f}')} > 1 AND {troops} = 1)::INT"}
    return {f"form__{n}": sql for n, sql in out.items()}


def _towers(a: str, b: str, t: str) -> dict[str, str]:
    """Column names and SQL of the tower features with numbers."""
    met = {f: _n(b, f"e.{f}") for f in ("airborne", "multi_unit", "building_targeting")} | {"own_troops": f"(8 - {_n(a, 'e.spell')})"}
    out = {}
    for d in ("targets_air", "targets_ground", "area_damage", "tower_support", "burst"):
        out |= {f"{d}__{f}": f"coalesce({t}.{d}, false)::INT * {n}" for f, n in met.items()} | {f"{d}__unknown": f"({t}.{d} IS NULL)::INT"}
    out |= {f"{f}__unknown": _n(b, f"e.{f} IS NULL") for f in ("airborne", "multi_unit", "building_targeting")}
    for d in ("damage_per_hit", "attack_interval", "recharge"):
        out |= {f"{d}__{f}": f"coalesce({t}.{d}, 0) * {n}" for f, n in met.items()}
        out[f"{d}__not_applicable"] = f"({t}.not_recharge)::INT" if d == "recharge" else "0"
    return {f"tower__{n}": sql for n, sql in out.items()}


def _differences(f, having: str = "") -> str:
    there, back = f("da", "db", "ta"), f("db", "da", "tb")
    return "SELECT member, row_no, " + ", ".join(f"round(({there[n]} - ({back[n]}))::DOUBLE, 6) + 0.0 AS {n}" for n in there) + f" FROM dk3 {having}"


@query("m22_conditional_air_features", CONDITIONAL_SQL + _differences(_air))
def conditional_air(spark, sf_dir):
    rows = conditional_decks(spark, sf_dir).withColumns({d: channels.told(F.col(d)) for d in ("da", "db")})
    return rounded(mechanics.features(rows, "da", "db", (channels.conditional_air,), KEYS))


@query("m23_form_features", CONDITIONAL_SQL + _differences(_forms))
def form_features(spark, sf_dir):
    return rounded(mechanics.features(conditional_decks(spark, sf_dir), "da", "db", (channels.forms,), KEYS))


@query("m24_tower_features", CONDITIONAL_SQL + _differences(_towers, "WHERE ta.attack_interval IS NOT NULL AND tb.attack_interval IS NOT NULL"))
def tower_features(spark, sf_dir):
    """Rows whose towers lack a number are refused, as the gap query lists them."""
    rows = conditional_decks(spark, sf_dir).where(channels.tower_gap(F.col("da")[8]).isNull() & channels.tower_gap(F.col("db")[8]).isNull())
    return rounded(mechanics.features(rows, "da", "db", (channels.quantitative_towers,), KEYS))


@query("m24_tower_gaps", CONDITIONAL_SQL + "SELECT t.identity || '/' || CASE WHEN t.attack_interval IS NULL THEN 'attack_interval' ELSE 'recharge' END AS gap, count(*) AS n FROM (SELECT unnest([ta, tb]) AS t FROM dk3) WHERE t.attack_interval IS NULL OR (t.recharge IS NULL AND NOT t.not_recharge) GROUP BY 1")
def tower_gaps(spark, sf_dir):
    """What the towers of rows lack."""
    towers = conditional_decks(spark, sf_dir).select(F.explode(F.array(F.col("da")[8], F.col("db")[8])).alias("t"))
    return towers.select(channels.tower_gap(F.col("t")).alias("gap")).where("gap IS NOT NULL").groupBy("gap").agg(F.count("*").alias("n"))


@query("v11_channels", CONDITIONAL_SQL + "SELECT identity, " + ", ".join(f"sum(has_{n}::INT)::BIGINT AS {n}" for n in _HAS) + ", sum((airborne_mode = 'hybrid' AND NOT whole)::INT)::BIGINT AS broken_hybrids FROM (SELECT unnest(da, recursive := true) FROM dk3) GROUP BY 1")
def channel_counts(spark, sf_dir):
    """How often each entry holds each conditional channel, and is a hybrid with issues."""
    e = conditional_decks(spark, sf_dir).select(F.explode(F.slice("da", 1, 8)).alias("e")).select("e.*")
    x = F.struct(*[F.col(c) for c in e.columns])
    has = [F.sum(channels.has_channel(x, c).cast("long")).alias(c.removeprefix("conditional_")) for c in channels.CAPABILITIES]
    broken = F.sum(((F.col("airborne_mode") == "hybrid") & (F.size(channels.hybrid_issues(x)) > 0)).cast("long")).alias("broken_hybrids")
    return e.groupBy("identity").agg(*has, broken)


_ROLES = ("spell", "building")


@query("a58_deck_summary", ORIENTED_SQL + """, c AS (SELECT member, row_no, list_transform(items_a, lambda i: CASE WHEN i % 23 <> 0 THEN (i % 9 + 1)::DOUBLE END) AS x, items_a FROM items)
SELECT member, row_no, round((coalesce(list_sum(x), 0) + (coalesce(list_avg(x), 0) + 1) * (8 - len(list_filter(x, lambda v: v IS NOT NULL)))) / 8, 6) + 0.0 AS mean_cost, len(list_filter(items_a, lambda i: i % 6 = 0))::DOUBLE AS spell, len(list_filter(items_a, lambda i: i % 9 = 0))::DOUBLE AS building,
  round(list_avg(x), 6) + 0.0 AS known_mean FROM c""")
def deck_summary(spark, sf_dir):
    attr = lambda i: F.struct(F.when(i % 23 != 0, i % 9 + 1).alias("cost"), F.array_compact(F.array(F.when(i % 6 == 0, "spell"), F.when(i % 9 == 0, "building"))).alias("roles"))
    deck = F.transform("items_a", attr)
    return rounded(oriented(spark, sf_dir).select(*KEYS, *mechanics.deck_summary(deck, _ROLES), mechanics.average_cost(deck).alias("known_mean")))


@query("p28_legal_decks", ORIENTED_SQL + ", f AS (SELECT member, row_no, len(list_filter(items_a, lambda i: i % 3 = 0)) AS ev, len(list_filter(items_a, lambda i: i % 7 = 1 AND i % 3 <> 0)) AS he FROM items) SELECT member, row_no, CASE WHEN ev > 2 THEN 'too_many_evolutions' WHEN he > 2 THEN 'too_many_heroes' WHEN ev + he > 3 THEN 'too_many_special' END AS reason FROM f")
def legal(spark, sf_dir):
    forms = F.transform("items_a", lambda i: F.when(i % 3 == 0, "evolution").when(i % 7 == 1, "hero").otherwise("base"))
    return oriented(spark, sf_dir).select(*KEYS, mechanics.legal_deck(F.col("items_a"), forms).alias("reason"))


def catalog(spark):
    """Two forms of each card; forms lack what they inherit."""
    base = spark.range(0, 104).select(F.col("id").cast("int").alias("i")).select(F.col("i").alias("card_id"), entry(F.col("i")).alias("e")).select("card_id", "e.*").withColumn("form", F.lit("base"))
    special = base.where("card_id % 3 = 0").withColumn("form", F.lit("evolution")).withColumn("targets_air", F.lit(None).cast("boolean"))
    return base.unionByName(special)


_CATALOG_SQL = "WITH b AS (SELECT i::INT AS card_id, 'base' AS form, CASE WHEN i % 17 <> 0 THEN i % 3 = 0 END AS targets_air, CASE WHEN i % 17 <> 0 THEN i % 6 = 0 END AS spell FROM range(0, 104) t(i)), c AS (SELECT * FROM b UNION ALL SELECT card_id, 'evolution', NULL, spell FROM b WHERE card_id % 3 = 0) "


@query("v8_inherited_fields", _CATALOG_SQL + "SELECT c.card_id, c.form, coalesce(c.targets_air, b.targets_air) AS targets_air FROM c LEFT JOIN b USING (card_id)")
def inherited(spark, sf_dir):
    return mechanics.inherited(catalog(spark), ("targets_air",)).select("card_id", "form", "targets_air")


@query("a49_field_coverage", _CATALOG_SQL + "SELECT u.f AS field, sum((u.v IS NOT NULL)::BIGINT)::BIGINT AS known, sum((u.v IS NULL)::BIGINT)::BIGINT AS unknown FROM (SELECT unnest([{'f': 'targets_air', 'v': targets_air}, {'f': 'spell', 'v': spell}]) AS u FROM c) GROUP BY 1")
def coverage(spark, sf_dir):
    return mechanics.coverage(catalog(spark), ("targets_air", "spell"))


@query("a50_lacking_fields", _CATALOG_SQL + "SELECT card_id, form, CASE WHEN spell IS NULL AND targets_air IS NULL THEN 'spell,targets_air' WHEN spell IS NULL THEN 'spell' ELSE 'targets_air' END AS missing FROM c WHERE spell IS NULL OR (NOT coalesce(spell, false) AND targets_air IS NULL)")
def lacking(spark, sf_dir):
    need = F.array_compact(F.array(F.when(F.col("spell").isNull(), "spell"), F.when(~F.coalesce("spell", F.lit(False)) & F.col("targets_air").isNull(), "targets_air")))
    return mechanics.lacking(catalog(spark), need).select("card_id", "form", F.array_join("missing", ",").alias("missing"))


# Scalar functions ------------------------------------------------------------


@query("f_text_functions", "SELECT c_custkey, trim(c_name) AS player, regexp_matches(upper(trim('#' || replace(c_name, '#', ''))), '^#[A-Z0-9]{3,15}$') AS tag, regexp_matches(lower(replace(c_mktsegment, ' ', '-')), '^[a-z0-9]+(-[a-z0-9]+)*$') AS slug, lower(regexp_replace(trim(c_mktsegment || '  X'), '\\s+', ' ', 'g')) AS folded, c_custkey::VARCHAR AS root, c_mktsegment AS form, sha256(c_name) AS digest FROM customer")
def text_functions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    identity = F.concat_ws(":", F.col("c_custkey").cast("string"), "c_mktsegment")
    return c.select("c_custkey", S.player_id(F.col("c_name")).alias("player"), S.is_tag(F.concat(F.lit("#"), F.regexp_replace("c_name", "#", ""))).alias("tag"), S.is_slug(F.lower(F.regexp_replace("c_mktsegment", " ", "-"))).alias("slug"), S.folded(F.concat("c_mktsegment", F.lit("  X"))).alias("folded"), S.identity_root(identity).alias("root"), S.identity_form(identity).alias("form"), S.sha256(F.col("c_name")).alias("digest"))


@query("f_time_functions", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END || '+00:00' AS iso, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0*$', '') || 'Z' AS z, epoch_us(ts) AS micros, ts + INTERVAL 1 DAY AS next_day, ts::DATE AS day FROM events")
def time_functions(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", S.iso_utc(ts).alias("iso"), S.canonical_z(ts).alias("z"), F.unix_micros(ts).alias("micros"), S.day_shift(ts, 1).cast("timestamp_ntz").alias("next_day"), F.to_date(ts).alias("day"))


@query("f_probability_functions", BOUTS_SQL + "SELECT member, row_no, round(ln(p / (1 - p)), 6) + 0.0 AS logit, round(p, 6) + 0.0 AS back, CASE WHEN p < 0.2 THEN 0 WHEN p < 0.4 THEN 1 WHEN p < 0.6 THEN 2 WHEN p < 0.8 THEN 3 ELSE 4 END::INT AS band, least(9, floor(p * 10)::INT)::INT AS bin, CASE WHEN deck_a = 0 THEN '0' WHEN deck_a < 4 THEN '1_3' WHEN deck_a < 20 THEN '4_19' ELSE '20_plus' END AS support, (deck_a % 10 + 16 - 14)::INT AS level FROM bouts")
def probability_functions(spark, sf_dir):
    from .bouts import bouts

    p = F.col("p")
    got = bouts(spark, sf_dir).select(*KEYS, S.logit(p).alias("logit"), S.sigmoid(S.logit(p)).alias("back"), S.probability_band(p).alias("band"), S.equal_width_bin(p, 10).alias("bin"), S.support_band(F.col("deck_a")).alias("support"), S.normal_level(F.col("deck_a") % 10, F.lit(14)).alias("level"))
    return rounded(got)


@query("f_identity_hashes", """
WITH s AS (SELECT o_orderkey, o_orderdate AS ts, 'P' || o_custkey::VARCHAR AS pa, 'Q' || (o_custkey % 7)::VARCHAR AS pb, o_orderstatus AS st FROM orders),
x AS (SELECT *, '["k1:base",1],["k2:evo",2]' AS ca, '["k1:base",3],["k2:evo",4]' AS cb FROM s),
y AS (SELECT *, '{"player_id":"' || pa || '","cards":[' || ca || ']}' AS oa, '{"player_id":"' || pb || '","cards":[' || cb || ']}' AS ob, '{"cards":[' || ca || '],"player_id":"' || pa || '"}' AS ba, '{"cards":[' || cb || '],"player_id":"' || pb || '"}' AS bb FROM x),
z AS (SELECT *, '{"mode":"ranked","sides":[' || CASE WHEN oa <= ob THEN ba || ',' || bb ELSE bb || ',' || ba END || '],"source_id":"src","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00"' AS body FROM y)
SELECT o_orderkey, sha256(body || '}') AS event_key, sha256(body || ',"winner":' || CASE st WHEN 'F' THEN '"' || pa || '"' WHEN 'O' THEN '"' || pb || '"' ELSE '"draw"' END || '}') AS fingerprint, sha256('k1:base|k2:evo') AS deck, sha256('k1:base:1|k2:evo:2') AS content FROM z""")
def identity_hashes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    keys = F.array(F.lit("k2:evo"), F.lit("k1:base"))
    pa, pb = F.concat(F.lit("P"), F.col("o_custkey").cast("string")), F.concat(F.lit("Q"), (F.col("o_custkey") % 7).cast("string"))
    body = S.event_body(F.lit("ranked"), F.lit("src"), F.col("o_orderdate").cast("timestamp"), (pa, keys, F.array(F.lit(2), F.lit(1))), (pb, keys, F.array(F.lit(4), F.lit(3))))
    winner = F.when(F.col("o_orderstatus") == "F", pa).when(F.col("o_orderstatus") == "O", pb)
    ids, forms = F.array(F.lit("k2"), F.lit("k1")), F.array(F.lit("evo"), F.lit("base"))
    return o.select("o_orderkey", S.event_key(body).alias("event_key"), S.fingerprint(body, winner).alias("fingerprint"), S.deck_hash(ids, forms).alias("deck"), S.deck_content_hash(ids, forms, F.array(F.lit(2), F.lit(1))).alias("content"))


# Live logs ---------------------------------------------------------------------


def live_logs(spark, sf_dir):
    """A battle log a decided bout, as nested JSON with planted faults."""
    rows = decided(spark, sf_dir)

    def side(player: str, won: Column, low: Column) -> Column:
        card = lambda i: F.struct((F.lit(26000000) + i).cast("long").alias("id"), F.concat(F.lit("Card "), i.cast("string")).alias("name"), F.when(low, 13).otherwise(14).alias("level"), F.lit(14).alias("maxLevel"))
        tag = F.concat(F.lit("#"), F.upper(F.lpad(F.col(player), 4, "0")))
        tower = F.when(F.col("deck_a") == 5, F.array().cast("array<struct<id:bigint,name:string,level:int,maxLevel:int>>")).otherwise(F.array(F.struct(F.lit(159000000).cast("long").alias("id"), F.lit("Tower").alias("name"), F.lit(15).alias("level"), F.lit(15).alias("maxLevel"))))
        n = F.when((F.col("deck_a") == 3) & F.lit(player == "player_a"), 6).otherwise(7)
        return F.struct(tag.alias("tag"), F.col(player).alias("name"), won.cast("int").alias("crowns"), F.transform(F.sequence(F.lit(0), n), card).alias("cards"), tower.alias("supportCards"))

    a, b = side("player_a", F.col("label"), F.col("deck_b") % 10 == 0), side("player_b", 1 - F.col("label"), F.lit(False))
    when = F.when(F.col("deck_a") == 7, F.lit("soon")).otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss'.000Z'"))
    log = F.struct(when.alias("battleTime"), F.lit("pathOfLegend").alias("type"), F.struct(F.when(F.col("deck_b") % 11 == 0, "Casual").otherwise("Ranked1v1_NewArena").alias("name")).alias("gameMode"), F.when(F.col("deck_a") == 9, F.array(a, a)).otherwise(F.array(a)).alias("team"), F.array(b).alias("opponent"))
    raw = rows.select(*KEYS, F.concat(F.lit("#"), F.upper(F.lpad(F.col("player_a"), 4, "0"))).alias("tag"), F.to_json(log).alias("raw"))
    logs = written(raw, "live-logs")
    return written(live.normalized(live.parsed(logs), "tag", [live.Entry(f"Card {i}", f"card-{i}:base", 26000000 + i, 14) for i in range(8)], [live.Entry("Tower", "tower:tower", 159000000, 15)]), "normalized-logs")


@query("p25_normalized_logs", BOUTS_SQL + """SELECT member, row_no,
 CASE WHEN deck_a = 9 THEN 'team_battle' WHEN deck_a = 3 THEN 'incomplete_deck' WHEN deck_a = 5 THEN 'missing_tower' WHEN deck_a = 7 THEN 'invalid_battle_time' END AS rejection,
 CASE WHEN deck_a IN (9, 3, 5, 7) THEN NULL WHEN deck_b % 11 = 0 THEN 'unsupported_mode' WHEN deck_b % 10 = 0 THEN 'non_max_level' END AS exclusion,
 CASE WHEN deck_a IN (9, 3, 5, 7) THEN NULL WHEN label = 1 THEN '#' || upper(lpad(player_a, 4, '0')) ELSE '#' || upper(lpad(player_b, 4, '0')) END AS winner FROM decided""")
def normalized_logs(spark, sf_dir):
    return live_logs(spark, sf_dir).select(*KEYS, "rejection", "exclusion", "winner")


LOGS_SQL = BOUTS_SQL + """, tagged AS (SELECT *, '#' || upper(lpad(player_a, 4, '0')) AS ta, '#' || upper(lpad(player_b, 4, '0')) AS tb FROM decided WHERE deck_a NOT IN (9, 3, 5, 7)),
logs AS (SELECT ts, sha256('{"players":["' || least(ta, tb) || '","' || greatest(ta, tb) || '"],"source":"official-api","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z"}') AS event_key,
  CASE WHEN label = 1 THEN ta ELSE tb END AS winner_tag, CASE WHEN label = 1 THEN tb ELSE ta END AS loser_tag, CASE WHEN deck_b % 11 = 0 THEN 'Casual' ELSE 'Ranked1v1_NewArena' END AS mode,
  CASE WHEN deck_b % 10 = 0 THEN ta END AS low, CASE WHEN deck_b % 11 = 0 THEN 'unsupported_mode' WHEN deck_b % 10 = 0 THEN 'non_max_level' END AS reason FROM tagged),
states AS (SELECT event_key, count(DISTINCT {'w': winner_tag, 'm': mode, 'l': low}) AS variants, max(reason) AS reason, count(*) AS seen FROM logs GROUP BY 1)
"""


@query("j19_match_states", LOGS_SQL + "SELECT event_key, CASE WHEN variants > 1 THEN 'conflicted' WHEN reason IS NULL THEN 'eligible' ELSE 'ineligible' END AS state, variants, seen FROM states")
def match_states(spark, sf_dir):
    return live.match_states(live_logs(spark, sf_dir))


@query("s20_export", LOGS_SQL + "SELECT DISTINCT event_key, ts::TIMESTAMP AS ts, winner_tag, loser_tag, mode FROM logs JOIN states USING (event_key) WHERE variants = 1 AND states.reason IS NULL AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1997-01-01'")
def export(spark, sf_dir):
    return live.export_rows(live_logs(spark, sf_dir), "1996-01-01", "1997-01-01").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_SNAPSHOT_CARDS = ",".join(f"card-{i}" for i in range(8))


@query("s32_snapshot_rows", LOGS_SQL + f"""SELECT event_key, ts::TIMESTAMP AS "timestamp", 'side_a_win' AS outcome, winner_tag AS side_a_player_id, loser_tag AS side_b_player_id, '{_SNAPSHOT_CARDS}' AS side_a_card_ids, 'base' AS side_b_card_forms,
 128::BIGINT AS side_a_card_levels, sha256('{"|".join(f"card-{i}:base:16" for i in range(8))}') AS side_b_deck_hash, 'tower:tower' AS side_a_tower, 16 AS side_b_tower_level, row_number() OVER (ORDER BY ts, event_key) - 1 AS row_number
 FROM (SELECT DISTINCT event_key, ts, winner_tag, loser_tag FROM logs JOIN states USING (event_key) WHERE variants = 1 AND states.reason IS NULL AND ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1997-01-01')""")
def snapshot_rows(spark, sf_dir):
    rows, _ = live.snapshot_rows(live_logs(spark, sf_dir), "1996-01-01", "1997-01-01", "v", "era", "member")
    levels = F.aggregate("side_a_card_levels", F.lit(0).cast("long"), lambda n, x: n + x).alias("side_a_card_levels")
    return rows.select("event_key", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "outcome", "side_a_player_id", "side_b_player_id", F.array_join("side_a_card_ids", ",").alias("side_a_card_ids"), F.array_join(F.array_distinct("side_b_card_forms"), ",").alias("side_b_card_forms"), levels, "side_b_deck_hash", "side_a_tower", "side_b_tower_level", "row_number")


@query("p36_counter_report", "SELECT coalesce(a.name, b.name) AS name, (coalesce(b.n, 0) - coalesce(a.n, 0))::BIGINT AS change FROM (SELECT event_type AS name, count(*) AS n FROM events WHERE event_id < 1000 GROUP BY 1) a FULL JOIN (SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1) b ON a.name = b.name")
def counter_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    early = table(spark, sf_dir, "events").where("event_id < 1000").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    return live.counter_report(early, e)


@query("p29_encoded_decks", ORIENTED_SQL + "SELECT member, row_no, CASE WHEN list_max(items_a) < 100 THEN array_to_string(list_append(list_sort(list_transform(items_a, lambda i: i * 2)), 999), ',') END AS tokens FROM items")
def encoded(spark, sf_dir):
    vocabulary = {str(i): 2 * i for i in range(100)} | {"tower": 999}
    keys = F.transform("items_a", lambda i: i.cast("string"))
    return oriented(spark, sf_dir).select(*KEYS, F.array_join(live.encode_deck(keys, vocabulary, F.lit("tower")), ",").alias("tokens"))


# Protocol ------------------------------------------------------------------------


@query("v1_slice_resolution", BOUTS_SQL + f"SELECT r AS role, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT ts, CASE WHEN ts < TIMESTAMP '1996-07-01' THEN 'fit' WHEN ts < TIMESTAMP '{TRAIN_END}' THEN 'watch' WHEN ts < TIMESTAMP '{VALIDATION_END}' THEN 'calibration' ELSE 'reporting' END AS r FROM decided) GROUP BY 1")
def slices(spark, sf_dir):
    stages = protocol.stages("1992-01-01", "1996-07-01", TRAIN_END, VALIDATION_END, "2100-01-01")
    got = protocol.resolve(decided(spark, sf_dir), stages)
    return got.select("role", "n", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


@query("v29_shuffled_label_counts", BOUTS_SQL + "SELECT mode || '-' || member AS role, label, count(*) AS n FROM decided GROUP BY 1, 2")
def shuffled(spark, sf_dir):
    rows = decided(spark, sf_dir).withColumn("role", F.concat_ws("-", "mode", "member"))
    return models.shuffled_labels(rows, 3, "role", "fingerprint").groupBy("role", "label").agg(F.count("*").alias("n"))


@query("v33_consume_once", "SELECT o_orderkey AS event_key FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0")
def consume_once(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return protocol.unconsumed(o.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("event_key")), o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("event_key")))


@query("v15_block_order", BOUTS_SQL + "SELECT row_number() OVER () - 1 AS ordinal, (row_number() OVER () - 1) // 1000 AS block FROM decided")
def blocks(spark, sf_dir):
    return models.block_order(history.trailing(decided(spark, sf_dir), 0.1), 1, 0, 1000).select("ordinal", "block")


@query("a59_ordered_digest")
def ordered_digest(spark, sf_dir):
    rows = decided(spark, sf_dir).select(*history.KEY)
    return spark.createDataFrame([(digests.ordered_digest(rows, list(history.KEY)),)], "digest string")


@query("a60_key_digest", BOUTS_SQL + "SELECT count(*) AS n, count(DISTINCT (ts, fingerprint, member, row_no)) AS keys FROM decided")
def key_digest(spark, sf_dir):
    return digests.bag_digest(decided(spark, sf_dir), list(history.KEY)).select("n", "keys")


@query("v26_synthetic_population", "SELECT (i % 4)::INT AS context, count(*) AS n FROM range(0, 128) t(i) GROUP BY 1")
def synthetic(spark, sf_dir):
    return protocol.synthetic_population(spark, 128).groupBy("context").agg(F.count("*").alias("n"))


# Windows beyond the contest operators ----------------------------------------------


@query("x_sliding_windows", "SELECT (to_timestamp((floor(epoch(ts) / 3600) - k) * 3600))::TIMESTAMP AS start, count(*) AS n FROM events, range(0, 3) t(k) GROUP BY 1")
def sliding(spark, sf_dir):
    """Extra: three-hour windows each hour."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy(F.window("ts", "3 hours", "1 hour")).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("x_sessions", "SELECT user_id, sum(new)::BIGINT AS sessions FROM (SELECT user_id, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 1 HOUR)::INT AS new FROM events) GROUP BY 1")
def sessions(spark, sf_dir):
    """Extra: sessions of a user that end after an idle hour."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    got = e.groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return got.groupBy("user_id").agg(F.count("*").alias("sessions"))


