"""Secret scans: patterns of known secrets, and a token-efficiency test for random strings.

A tokenizer's merges come from ordinary text, so a random string has few characters a token. Strings of letters, digits
and a few signs are encoded with a tiktoken vocabulary; below `ratio` characters a token they are secrets, unless each of
their parts between signs is ordinary: a number, a known digest (hexadecimal of a digest's length), a UUID, one token, or
of at least `ratio` characters a token itself. In a string above `ratio`, stretches of parts that are not ordinary are
tried alone, so that words glued to a random string do not hide it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import kept, slices, small_batches

#: Kinds in the order of the contract, then this method's.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: A match of these is a whole run, so its least length can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_STRING = re.compile(r"[A-Za-z0-9+/_=-]+")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_DIGEST_SIZES = {32, 40, 48, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PART = re.compile(rf"(?<![A-Za-z0-9]){_UUID.pattern}(?![A-Za-z0-9])|[A-Za-z0-9]+")
#: Pieces for the tokenizer, whose time grows faster than a string.
_ENCODED = 1000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the contract's patterns, leftmost and non-overlapping per kind."""
    out = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    out += [(*m.span(), 1) for m in _ACCESS.finditer(text)]
    return out + [(*m.span(), 2) for m in _HEX.finditer(text)]


class Efficiency:
    """Characters a token under a tiktoken vocabulary."""

    def __init__(self, ranks: str, pattern: str) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ratio(self, s: str) -> float:
        return len(s) / max(1, self.tokens(s))

    def tokens(self, s: str) -> int:
        return sum(len(self.encoding.encode_ordinary(s[i : i + _ENCODED])) for i in range(0, len(s), _ENCODED))

    def ordinary(self, part: str, ratio: float) -> bool:
        if part.isdigit() or len(part) in _DIGEST_SIZES and _DIGEST.fullmatch(part) or _UUID.fullmatch(part):
            return True
        n = self.tokens(part)
        return n == 1 or len(part) >= ratio * n


def _efficiency(ranks: str, pattern: str) -> Efficiency:
    return kept(("efficiency", hash((ranks, pattern))), lambda: Efficiency(ranks, pattern))


def random_spans(text: str, taken: list[tuple[int, int, int]], efficiency: Efficiency, ratio: float, least: int = 16) -> list[tuple[int, int, int]]:
    out = []
    free = lambda a, b: not any(x < b and a < y for x, y, _ in taken)
    for m in _STRING.finditer(text):
        a, b = m.span()
        if b - a < least:
            continue
        parts = [(*p.span(), efficiency.ordinary(p.group(), ratio)) for p in _PART.finditer(m.group())]
        if all(known for *_, known in parts):
            continue
        if free(a, b) and efficiency.ratio(m.group()) < ratio:
            out.append((a, b, 3))
            continue
        for known, run in groupby(parts, key=lambda p: p[2]):
            run = list(run)
            x, y = a + run[0][0], a + run[-1][1]
            if not known and y - x >= least and free(x, y) and efficiency.ratio(text[x:y]) < ratio:
                out.append((x, y, 3))
    return out


def secret_scan(docs: DataFrame, vocabulary_path: str, pattern: str, ratio: float = 2.0, least: int = 16) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, over the whole match, sorted by start and then by kind in
    the order assign, access, hex, random; random strings have `least` characters at least. A null text counts as empty: no spans, the digest of an empty string.
    Repeated rows each get a row, an empty table gives an empty one, other columns are ignored.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(Path(vocabulary_path).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        efficiency = _efficiency(ranks.value, pattern)
        for piece in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                text = text or ""
                base = sorted(base_spans(text), key=lambda x: (x[0], x[2]))
                more = sorted([*base, *random_spans(text, base, efficiency, ratio, least)], key=lambda x: (x[0], x[2]))
                told, every = (",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in x) for x in (base, more))
                kinds = [k for _, _, k in base]
                rows.append((doc_id, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(told.encode()).hexdigest(), every))
            kinds_ = (*[pa.int64()] * 4, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds_)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
