"""Catalogs of cards, attributes, towers and API ids: JSON documents that become checked dimensions.

A catalog has some hundreds of entries, so its document is read on the driver, once. Shape and types are checked entry by
entry, rules over entries by expressions on the dimension; the first broken rule is the error.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import folded, is_slug
from ..operators.live import Entry

#: Forms, those that a root card may have, roles, summary columns, the one card without a cost, tower tops.
FORMS = ("base", "champion", "evolution", "hero")
ROOT_FORMS = ("base", "champion")
ROLES = ("win_condition", "building", "spell", "cycle", "air_defense", "bait")
SUMMARY = ["mean_elixir", "win_condition_count", "building_count", "spell_count", "cycle_count", "air_defense_count", "bait_count"]
COSTLESS = "mirror"
TOWER_TOPS = (8, 11, 16)
TOP = 16


def pinned(path: str, sha256: str | None = None) -> dict:
    """The JSON object of a file; with a digest, only if the file's bytes have it."""
    data = Path(path).read_bytes()
    if sha256 is not None and hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError(f"{path} is not the pinned file")
    body = json.loads(data)
    if not isinstance(body, dict):
        raise ValueError(f"{path} is not an object")
    return body


def _has(value: object, *kinds: type) -> bool:
    """Exact types: true is no number."""
    return type(value) in kinds


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _version(body: Mapping, key: str) -> None:
    _need(_has(body.get(key), str) and bool(body[key].strip()), f"{key} is required")


def _hold(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """df, if each rule (an aggregate that must be true) holds; all are evaluated in one pass."""
    got = df.agg(*[F.coalesce(F.expr(sql), F.lit(False)).alias(name) for name, sql in rules.items()]).first()
    for name in rules:
        _need(got[name], name)
    return df


def _distinct(*names: str) -> dict[str, str]:
    return {f"{n} must be unique and not empty": f"count(distinct {n}) = count(*) and count_if({n} is null or trim(cast({n} as string)) = '') = 0" for n in names}


def cards(spark: SparkSession, body: Mapping) -> DataFrame:
    """(source_id, name, card_id, form, identity) of [id, name, card, form] entries; ids count from zero in order."""
    _version(body, "catalog_version")
    rows = body.get("entries")
    _need(_has(rows, list) and len(rows) > 0, "entries are required")
    for i, row in enumerate(rows):
        shape = _has(row, list) and len(row) == 4 and _has(row[0], int) and all(_has(x, str) for x in row[1:])
        _need(shape and row[3] in FORMS, f"entry {i} is not [id, name, card, form]")
        _need(row[0] == i, "ids must count from zero in order")
    df = spark.createDataFrame([tuple(r) for r in rows], "source_id int, name string, card_id string, form string")
    df = df.withColumns({"identity": F.concat_ws(":", "card_id", "form"), "slug": is_slug(F.col("card_id"))})
    roots = ", ".join(f"'{f}'" for f in ROOT_FORMS)
    _hold(df, _distinct("name", "identity") | {
        "card ids must be slugs": "bool_and(slug)",
        "each form needs its root card": f"size(array_except(collect_set(card_id), collect_set(case when form in ({roots}) then card_id end))) = 0",
    })
    return df.drop("slug")


def attributes(spark: SparkSession, body: Mapping) -> DataFrame:
    """(card_id, cost, roles); exactly one card, COSTLESS, has no cost."""
    _version(body, "attribute_version")
    _need(body.get("summary_columns") == SUMMARY, "summary columns differ")
    rows = body.get("cards")
    _need(_has(rows, dict) and len(rows) > 0, "cards are required")
    for card, told in rows.items():
        _need(_has(told, dict), f"{card} is not an object")
        cost, roles = told.get("elixir"), told.get("roles")
        _need(cost is None or (_has(cost, int) and 1 <= cost <= 9), f"cost of {card}")
        _need(_has(roles, list) and all(r in ROLES for r in roles) and len(set(roles)) == len(roles), f"roles of {card}")
    df = spark.createDataFrame([(c, t.get("elixir"), sorted(t["roles"])) for c, t in rows.items()], "card_id string, cost int, roles array<string>")
    return _hold(df, {f"{COSTLESS} must be the only card without a cost": f"count_if(cost is null) = 1 and count_if(cost is null and card_id = '{COSTLESS}') = 1"})


def towers(spark: SparkSession, body: Mapping) -> DataFrame:
    """(tower_id, name, api_id, top, identity); API ids, folded names and identities are unique."""
    _version(body, "catalog_version")
    rows = body.get("entries")
    _need(_has(rows, list, tuple) and len(rows) > 0, "entries are required")
    for i, row in enumerate(rows):
        _need(_has(row, dict) and set(row) == {"tower_id", "name", "api_id", "max_api_level"}, f"fields of tower {i}")
        _need(_has(row["tower_id"], str) and _has(row["name"], str) and _has(row["api_id"], int) and row["api_id"] > 0, f"types of tower {i}")
        _need(_has(row["max_api_level"], int) and row["max_api_level"] in TOWER_TOPS, f"top level of tower {i}")
    df = spark.createDataFrame([(r["tower_id"], r["name"], r["api_id"], r["max_api_level"]) for r in rows], "tower_id string, name string, api_id int, top int")
    df = df.withColumns({"identity": F.concat("tower_id", F.lit(":tower")), "folded_name": folded(F.col("name")), "slug": is_slug(F.col("tower_id"))})
    return _hold(df, _distinct("api_id", "folded_name", "identity") | {"tower ids must be slugs": "bool_and(slug)"}).drop("folded_name", "slug")


def api_ids(spark: SparkSession, body: Mapping, catalog: DataFrame) -> DataFrame:
    """(card_id, api_id, top) of exactly the root cards of a card catalog."""
    rows = body.get("cards")
    _need(_has(rows, dict) and len(rows) > 0, "cards are required")
    for card, told in rows.items():
        ok = _has(told, dict) and _has(told.get("api_id"), int) and _has(told.get("max_api_level"), int) and 1 <= told["max_api_level"] <= TOP
        _need(ok, f"API entry of {card}")
    df = spark.createDataFrame([(c, t["api_id"], t["max_api_level"]) for c, t in rows.items()], "card_id string, api_id int, top int")
    roots = catalog.where(F.col("form").isin(*ROOT_FORMS)).select("card_id").distinct()
    both = df.select("card_id", F.lit(1).alias("told")).join(roots.withColumn("root", F.lit(1)), "card_id", "full")
    _hold(both, {"API entries must cover the root cards": "count_if(told is null or root is null) = 0"})
    return _hold(df, _distinct("api_id"))


def card_entries(catalog: DataFrame, api: DataFrame) -> list[Entry]:
    """What the live normaliser needs of each card; forms share their root's API id."""
    rows = catalog.join(api, "card_id").orderBy("source_id").collect()
    return [Entry(r["name"], r["identity"], r["api_id"], r["top"]) for r in rows]


def tower_entries(catalog: DataFrame) -> list[Entry]:
    return [Entry(r["name"], r["identity"], r["api_id"], r["top"]) for r in catalog.collect()]


def deck_summaries(decks: DataFrame, key: str, identities: str, table: DataFrame) -> DataFrame:
    """Per deck (a key and identities `card:form`) the SUMMARY columns; forms have their root's attributes.

    A card without a cost costs one more than the mean of the deck's others, 1 beside none; an empty or null deck is zeros; a
    card without attributes is an error when the rows are made. The table goes out as a map literal: it is catalog-sized.
    """
    rows = table.collect()
    made = F.create_map(*[x for r in rows for x in (F.lit(r["card_id"]), F.struct(F.lit(r["cost"]).cast("double").alias("cost"), F.array(*map(F.lit, r["roles"])).cast("array<string>").alias("roles")))])
    missing = lambda i: F.raise_error(F.concat(F.lit("no attributes of "), i)).cast("struct<cost:double,roles:array<string>>")
    root = lambda i: F.regexp_replace(i, ":[^:]*$", "")
    told = F.transform(F.coalesce(identities, F.array()), lambda i: F.coalesce(F.try_element_at(made, root(i)), missing(i)))
    known = F.array_compact(F.transform("told", lambda e: e["cost"]))
    paid = F.aggregate("known", F.lit(0.0), lambda a, x: a + x)
    n, k = F.size("told"), F.size("known")
    mean = F.when(k > 0, paid / k).otherwise(0.0)
    out = [F.when(n > 0, (paid + (mean + 1.0) * (n - k)) / n).otherwise(0.0).alias(SUMMARY[0])]
    has = lambda role: lambda e: F.array_contains(e["roles"], role)
    out += [F.size(F.filter("told", has(r))).cast("double").alias(f"{r}_count") for r in ROLES]
    return decks.select(key, told.alias("told")).withColumn("known", known).select(key, *out)
