"""Scalar expressions shared by the operators: identity, text, time and probability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Clip of probabilities before a logarithm.
EPSILON = 1e-15


# Identity ------------------------------------------------------------------


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def deck_hash(ids: Column, forms: Column) -> Column:
    """Digest of a deck without levels; the order of its cards does not matter."""
    return sha256(F.array_join(F.array_sort(F.zip_with(ids, forms, lambda i, f: F.concat_ws(":", i, f))), "|"))


def deck_content_hash(ids: Column, forms: Column, levels: Column) -> Column:
    keys = F.zip_with(ids, forms, lambda i, f: F.concat_ws(":", i, f))
    return sha256(F.array_join(F.array_sort(F.zip_with(keys, levels, lambda k, n: F.concat_ws(":", k, n.cast("string")))), "|"))


def iso_utc(ts: Column) -> Column:
    """`2026-06-01T10:00:00+00:00`, with microseconds only where they are not zero."""
    micros = F.unix_micros(ts) % 1_000_000
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(seconds, F.when(micros != 0, F.date_format(ts, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def canonical_z(ts: Column) -> Column:
    """`…Z` with trailing zeros of the microseconds trimmed."""
    return F.concat(F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0*$", ""), F.lit("Z"))


#: Escapes with a letter of their own.
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def json_text(c: Column) -> Column:
    """A JSON string in ASCII: all else as four hexadecimal digits a UTF-16 unit."""
    short = F.create_map(*[F.lit(x) for kv in _ESCAPES.items() for x in kv])

    def one(ch: Column) -> Column:
        units = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
        long = F.regexp_replace(units, "(.{4})", r"\\u$1")
        return F.coalesce(F.try_element_at(short, ch), F.when((ch == "") | ch.between(" ", "~"), ch), long)

    return F.concat(F.lit('"'), F.array_join(F.transform(F.split(c, ""), one), ""), F.lit('"'))


def event_body(mode: Column, source: Column, ts: Column, side_a: tuple[Column, Column, Column], side_b: tuple[Column, Column, Column]) -> Column:
    """The identity text of an event up to its outcome. A side: (player, card keys, levels).

    Sides are ordered by their text with the player first, and written with the cards first.
    """

    def cards(keys: Column, levels: Column) -> Column:
        pairs = F.array_sort(F.zip_with(keys, levels, lambda k, n: F.struct(k.alias("k"), n.alias("l"))))
        return F.concat(F.lit("["), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('["'), p["k"], F.lit('",'), p["l"].cast("string"), F.lit("]"))), ","), F.lit("]"))

    texts = []
    for player, keys, levels in (side_a, side_b):
        c = cards(keys, levels)
        order = F.concat(F.lit('{"player_id":"'), player, F.lit('","cards":'), c, F.lit("}"))
        body = F.concat(F.lit('{"cards":'), c, F.lit(',"player_id":"'), player, F.lit('"}'))
        texts.append(F.struct(order.alias("o"), body.alias("b")))
    first, second = F.least(*texts), F.greatest(*texts)
    return F.concat(F.lit('{"mode":'), json_text(mode), F.lit(',"sides":['), first["b"], F.lit(","), second["b"], F.lit('],"source_id":'), json_text(source), F.lit(',"timestamp":"'), iso_utc(ts), F.lit('"'))


def lineup_hash(deck: Column, tower: Column, level: Column) -> Column:
    return sha256(F.concat_ws("|", deck, tower, level.cast("string")))


def event_key(body: Column) -> Column:
    return sha256(F.concat(body, F.lit("}")))


def fingerprint(body: Column, winner: Column) -> Column:
    """winner: the winning player, or null for a draw."""
    told = F.coalesce(F.concat(F.lit('"'), winner, F.lit('"')), F.lit('"draw"'))
    return sha256(F.concat(body, F.lit(',"winner":'), told, F.lit("}")))


def seeded_first_byte(seed: int, key: Column) -> Column:
    return F.conv(F.substring(sha256(F.concat(F.lit(f"{seed}:"), key)), 1, 2), 16, 10).cast("int")


def mirrored(seed: int, fingerprint: Column) -> Column:
    """Whether a row swaps its sides: the first byte of the seeded digest is odd."""
    return seeded_first_byte(seed, fingerprint) % 2 == 1


def hash_fraction(seed: int, key: Column) -> Column:
    """The first eight bytes of the seeded digest, big-endian, as a share of 2**64."""
    top = F.conv(F.substring(sha256(F.concat(F.lit(f"{seed}:"), key)), 1, 16), 16, 10)
    return top.cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


# Text ----------------------------------------------------------------------


def player_id(c: Column) -> Column:
    """Trimmed; upper-cased when it is a tag."""
    t = F.trim(c)
    return F.when(t.startswith("#"), F.upper(t)).otherwise(t)


def is_tag(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)).rlike("^#[A-Z0-9]{3,15}$"), F.lit(False))


def is_slug(c: Column) -> Column:
    return F.coalesce(c.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False))


def folded(c: Column) -> Column:
    """Lower case with white space collapsed."""
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def identity_root(c: Column) -> Column:
    """The part before the last colon."""
    return F.regexp_replace(c, ":[^:]*$", "")


def identity_form(c: Column) -> Column:
    return F.substring_index(c, ":", -1)


def allowed_url(c: Column, prefixes: tuple[str, ...]) -> Column:
    ok = F.lit(False)
    for p in prefixes:
        ok = ok | c.startswith(p)
    return F.when(ok, c)


# Time ----------------------------------------------------------------------


def strict_timestamp(c: Column) -> Column:
    """ISO text with `Z` or an offset; null for anything else, naive text included."""
    shape = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"
    return F.when(c.rlike(shape), F.try_to_timestamp(c))


def compact_timestamp(c: Column) -> Column:
    """`yyyyMMddTHHmmss[.SSS]Z`."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyyMMdd'T'HHmmss.SSSX")), F.try_to_timestamp(c, F.lit("yyyyMMdd'T'HHmmssX")))


def day_shift(ts: Column, days: int) -> Column:
    return ts + F.make_dt_interval(F.lit(days))


def six_hour_start(ts: Column) -> Column:
    """The start of the tumbling window of six hours, aligned to the day."""
    return F.timestamp_micros(F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(21_600_000_000)).cast("long") * F.lit(21_600_000_000))


# Probability ---------------------------------------------------------------


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))


def logit(p: Column) -> Column:
    q = clipped(p)
    return F.log(q / (1 - q))


def sigmoid(s: Column) -> Column:
    e = F.exp(-F.abs(s))
    return F.when(s >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def laplace(wins: Column, trials: Column, alpha: float = 1.0) -> Column:
    return (wins + F.lit(alpha)) / (trials + F.lit(2 * alpha))


def log_odds(wins: Column, trials: Column, alpha: float = 1.0) -> Column:
    return logit(laplace(wins, trials, alpha))


def row_log_loss(label: Column, p: Column) -> Column:
    q = clipped(p)
    return -(label * F.log(q) + (1 - label) * F.log(1 - q))


def logit_loss(label: Column, score: Column) -> Column:
    """The same from a logit, without overflow."""
    signed = F.when(label == 1, -score).otherwise(score)
    return F.greatest(signed, F.lit(0.0)) + F.log1p(F.exp(-F.abs(signed)))


def symmetrized(p_ab: Column, p_ba: Column) -> Column:
    return 0.5 * (p_ab + 1 - p_ba)


def normal_level(level: Column, top: Column, scale: int = 16) -> Column:
    """A level counted from its rarity's top, on one scale."""
    return level + scale - top


def triangle_index(i: Column, j: Column, n: int) -> Column:
    """Place of the pair i < j in the upper triangle, row by row."""
    return (i * n - F.floor(i * (i + 1) / 2) + j - i - 1).cast("long")


def support_band(n: Column) -> Column:
    return F.when(n == 0, "0").when(n < 4, "1_3").when(n < 20, "4_19").otherwise("20_plus")


def probability_band(p: Column) -> Column:
    out = F.lit(4)
    for k, upper in reversed(list(enumerate((0.2, 0.4, 0.6, 0.8)))):
        out = F.when(p < upper, k).otherwise(out)
    return out


def equal_width_bin(p: Column, bins: int) -> Column:
    """The last bin is closed."""
    return F.least(F.lit(bins - 1), F.floor(p * bins).cast("int"))


def seen_class(a: Column, b: Column) -> Column:
    n = (a > 0).cast("int") + (b > 0).cast("int")
    return F.when(n == 0, "both_unseen").when(n == 1, "one_unseen").otherwise("both_seen")


def upset(win: Column, p: Column) -> Column:
    return F.when(win & (p < 0.4), "upset_win").when(~win & (p > 0.6), "upset_loss")
