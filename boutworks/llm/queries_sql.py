"""DuckDB SQL of the queries that SQL can say."""

from __future__ import annotations

from .license_scan import PHRASES, TEMPLATES
from .url_filter import ALPHABET, DISCOUNT, RULES

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, {_WORD}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD}, {_WORD}) AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, 13 AS n, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM b WHERE len(w) >= 13)
  UNION SELECT item_id, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 12),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, i, n, item_id FROM pos JOIN win USING (n, s)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def _fits(text: str) -> str:
    host, _, start = text.partition("/")
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{start}'))"


_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[1]))


def _likelihood(v: str) -> str:
    """The smoothed probability of a window's last character, from the shortest context to the longest."""
    p = f"(1.0::DOUBLE / {ALPHABET})"
    for k in range(1, 5):
        own = f"substr(gram, {5 - k}, {k})"
        before = f"substr(gram, {5 - k}, {k - 1})" if k > 1 else "''"
        p = f"((sum({v}) OVER (PARTITION BY {own}) + {DISCOUNT} * {p}) / (sum({v}) OVER (PARTITION BY {before}) + {DISCOUNT}))"
    return p


OP5 = f"""
WITH r AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
t AS (SELECT *, CASE {" ".join(f"WHEN {_fits(x)} THEN '{x}'" for _, x in _BY_LENGTH)} END AS rule FROM h),
u AS (SELECT *, CASE rule {" ".join(f"WHEN '{x}' THEN '{v}'" for v, x in RULES)} END AS ruled,
  '^^^' || regexp_replace(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^a-z0./_?=&#:%~-]', '*', 'g') || '$' AS s FROM t),
g AS (SELECT page_id, ruled, substr(s, i, 4) AS gram FROM (SELECT page_id, ruled, s, unnest(range(1, length(s) - 2)) AS i FROM u)),
c AS (SELECT gram, count(*) FILTER (ruled = 'allow')::DOUBLE AS a, count(*) FILTER (ruled = 'block')::DOUBLE AS b FROM g GROUP BY 1),
m AS (SELECT gram, ln({_likelihood("a")}) - ln({_likelihood("b")}) AS ratio FROM c),
sc AS (SELECT page_id, round(avg(ratio), 6) AS ratio FROM g JOIN m USING (gram) GROUP BY 1),
st AS (SELECT ruled, avg(ratio) AS mean, stddev_pop(ratio) AS spread FROM u JOIN sc USING (page_id) WHERE ruled IS NOT NULL GROUP BY 1),
li AS (SELECT CASE WHEN count(*) < 2 THEN 0 WHEN sum(spread) > 0 THEN (max(mean) FILTER (ruled = 'allow') * max(spread) FILTER (ruled = 'block') + max(mean) FILTER (ruled = 'block') * max(spread) FILTER (ruled = 'allow')) / sum(spread) ELSE avg(mean) END AS bound FROM st)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN ratio >= round(bound, 6) THEN 'allow' ELSE 'block' END) AS verdict FROM u JOIN sc USING (page_id), li
"""

_PHRASE_ROWS = ", ".join(f"({list(p.split())!r}, '{label}')" for p, label in PHRASES.items())
_TEMPLATE_ROWS = ", ".join(f"({i}, '{label}', {text.split()!r}, {name.split()!r}::VARCHAR[])" for i, (label, text, name) in enumerate(TEMPLATES))

OP7 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, {_WORD}) AS w FROM documents),
ph(p, label) AS (VALUES {_PHRASE_ROWS}), tp(tid, label, t, name) AS (VALUES {_TEMPLATE_ROWS}),
spot AS (SELECT doc_id, i - 1 AS i, label FROM (SELECT doc_id, w, p, label, unnest(range(1, len(w) - len(p) + 2)) AS i FROM d, ph) WHERE w[i:i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM spot GROUP BY 1),
wd AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
every AS (SELECT doc_id, tid, p, word, t FROM wd JOIN (SELECT DISTINCT tid, t, unnest(t) AS word FROM tp) USING (word)),
hit AS (SELECT doc_id, tid, p, word, len(t) AS n FROM every SEMI JOIN (SELECT doc_id, tid FROM every GROUP BY doc_id, tid, t HAVING count(DISTINCT word) >= 0.8 * list_unique(t) - 1e-9) USING (doc_id, tid)),
blk AS (SELECT doc_id, tid, p, n, list_unique(list(word) OVER (PARTITION BY doc_id, tid ORDER BY p RANGE BETWEEN CURRENT ROW AND n - 1 FOLLOWING)) AS c FROM hit),
met AS (SELECT doc_id, label, c / list_unique(t) AS c FROM blk JOIN tp USING (tid) JOIN d USING (doc_id)
  WHERE c >= ceil(0.8 * list_unique(t) - 1e-9)
    AND (len(name) = 0 OR len(list_filter(range(p, p + n - len(name) + 1), lambda i: w[i:i + len(name) - 1] = name)) > 0)),
lab AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS score FROM (SELECT doc_id, label, 1.0::DOUBLE AS c FROM spot UNION ALL SELECT doc_id, label, c FROM met) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN lab USING (doc_id)
"""

OP8 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY s) AS kept, sha256(s) AS text_sha256
FROM t
"""
