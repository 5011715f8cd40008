"""URL filters: domain rules, and a character language-model ratio for URLs without a rule. DataFrame functions only.

Pages that a rule decides train two smoothed variable-order Markov models, of accepted and of rejected URLs: a character
after its last three, backing off to two, one and none (each order adds DISCOUNT counts spread as the order below says).
A URL's score is the difference of log-likelihoods a character; the threshold lies between the two classes' mean scores
on the rule-decided pages, each weighted by the other's spread.

Only counts of four-character windows are joined back. Letters, one digit, eleven signs, one stand-in for all else and
two marks for the ends are the alphabet, so there can be no more than 41**4 of them however many pages there are; their
number is checked before they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import materialize

#: (verdict, host and path), from the contract.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

ORDER = 4
SIGNS = "./_?=&#:%~-"
ALPHABET = 26 + 1 + len(SIGNS) + 1 + 2
DISCOUNT = 4.0
BROADCAST_ROWS = 300_000
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOW), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for _, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        out = F.when(fits, text).otherwise(out)
    return out


def _plain(url: Column) -> Column:
    """The URL in the models' alphabet, with marks for its ends."""
    low = F.translate(F.coalesce(url, F.lit("")), _UPPER + "123456789", _LOW + "0" * 9)
    return F.concat(F.lit("^" * (ORDER - 1)), F.regexp_replace(low, "[^a-z0./_?=&#:%~-]", "*"), F.lit("$"))


def _grams(pages: DataFrame) -> DataFrame:
    """A row for each window of four characters."""
    s = _plain(F.col("url"))
    return pages.withColumn("gram", F.explode(F.transform(F.sequence(F.lit(1), F.length(s) - (ORDER - 1)), lambda i: F.substr(s, i, F.lit(ORDER)))))


def _model(told: DataFrame) -> DataFrame:
    """(gram, ratio): the difference of log-probabilities for each window that any page has."""
    counts = _grams(told).groupBy("gram").agg(*(F.sum((F.col("ruled") == v).cast("long")).alias(v) for v in ("allow", "block")))
    counts = materialize(counts.na.fill(0), "url-windows")
    for v in ("allow", "block"):
        counts = materialize(_with_likelihood(counts, v), f"url-{v}")
    return counts.select("gram", (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def _with_likelihood(counts: DataFrame, v: str) -> DataFrame:
    """Counts of lower orders are sums over the windows that end alike; an order's table joins by its own suffix."""
    p = F.lit(1.0 / ALPHABET)
    out = counts
    for k in range(1, ORDER + 1):
        suffix = F.substring("gram", ORDER + 1 - k, k)
        context = F.substring("gram", ORDER + 1 - k, k - 1) if k > 1 else F.lit("")
        seen = counts.groupBy(suffix.alias(f"s{k}")).agg(F.sum(v).alias(f"n{k}"))
        total = counts.groupBy(context.alias(f"c{k}")).agg(F.sum(v).alias(f"t{k}"))
        out = out.withColumn(f"s{k}", suffix).withColumn(f"c{k}", context).join(seen, f"s{k}").join(total, f"c{k}")
        p = (F.col(f"n{k}") + F.lit(DISCOUNT) * p) / (F.col(f"t{k}") + F.lit(DISCOUNT))
    return out.select(*counts.columns, p.alias(f"p_{v}"))


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, ratio.

    verdict is the rule's, else allow where ratio (rounded to six digits) reaches the threshold, else block. A null URL
    or one without "://" has empty host and path and no rule; its characters are judged all the same. Without rule-decided
    pages of both kinds the threshold is 0. Equal rows share one score. An empty table gives an empty one; other columns
    are ignored.
    """
    told = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    told = told.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    ruled = F.lit(None).cast("string")
    for v, text in rules:
        ruled = F.when(F.col("rule") == text, v).otherwise(ruled)
    told = materialize(told.withColumn("ruled", ruled).withColumn("key", F.xxhash64("page_id", F.coalesce("url", F.lit("")))), "url-pages")
    model = materialize(_model(told), "url-model")
    small = model.count() <= BROADCAST_ROWS
    scored = _grams(told.select("key", "url")).join(F.broadcast(model) if small else model, "gram").groupBy("key").agg(F.round(F.avg("ratio"), 6).alias("ratio"))
    scored = materialize(told.join(scored, "key", "left").drop("key"), "url-scored")
    by = {r.ruled: r for r in scored.where("ruled is not null").groupBy("ruled").agg(F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("spread")).collect()}
    limit = 0.0
    if len(by) == 2:
        a, b = by["allow"], by["block"]
        limit = (a.mean * b.spread + b.mean * a.spread) / (a.spread + b.spread) if a.spread + b.spread > 0 else (a.mean + b.mean) / 2
    verdict = F.coalesce("ruled", F.when(F.col("ratio") >= F.lit(round(limit, 6)), "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "ratio")
