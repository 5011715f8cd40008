"""Benchmark decontamination as a prefix-filtered set join on word sequences.

A benchmark item's windows are its runs of `window` consecutive words (all its words, if fewer). Shingles of two words
are ordered by how often the corpus has them. A window that stands in a document has all its shingles there, so the
necessary prefix is its rarest shingle: documents are joined on that alone, candidates must lie within the document
(positional and length bounds), and the words of each are compared byte by byte.

The benchmark comes to the driver and goes to the executors in blocks of at most BLOCK_BYTES of text, whose index has
some ten bytes for each of theirs; an item beyond that is cut into parts that overlap by a window. A benchmark of one
block takes one pass that counts and one that joins, and documents never move. Each further block takes two more, and
the documents and their hits so far are written in between.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import column_of, map_slices, materialize, release, slices, small_batches
from ._text import LOWER, WORDLIKE, U, _weights, buffer, mix, same_words, word_hashes, word_spans

BLOCK_BYTES = 4 << 20
_FILTER_BITS = 22
_CHUNK = 1 << 16
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Words:
    """The words of a text column: lower-cased bytes, spans, hashes, and words before each row."""

    def __init__(self, column: pa.Array) -> None:
        raw, off = buffer(column)
        self.starts, self.ends, self.before = word_spans(raw, off, WORDLIKE)
        self.hashes = word_hashes(raw, self.starts, self.ends)
        self.low = LOWER[raw]


def _pairs(words: np.ndarray, single: bool) -> np.ndarray:
    """A hash of each word with the next one, or of it alone."""
    if single:
        return mix(words + U(1))
    out = np.zeros(len(words), np.uint64)
    out[:-1] = mix(words[:-1] * U(3) + words[1:] * U(0x9E3779B97F4A7C15))
    return out


def _sums(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` words from each start on."""
    out, w = np.zeros(len(starts), np.uint64), _weights(size)
    for j in range(size):
        out += words[starts + j] * w[j]
    return mix(out)


def _unique_rows(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    first = np.ones(len(order), bool)
    first[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0) if len(order) else False
    return tuple(c[first] for c in columns)


class Windows:
    """Distinct windows of some items, and once frequencies are known the join index, in flat arrays."""

    def __init__(self, item_ids: list, texts: list, window: int) -> None:
        told = Words(pa.array(texts, pa.string()))
        self.low, self.starts, self.ends = told.low, told.starts, told.ends
        self.names = item_ids
        words, before = told.hashes, told.before
        count = np.diff(before)
        each = np.where(count > 0, np.maximum(count - window + 1, 1), 0)
        item = np.repeat(np.arange(len(count)), each)
        first = before[item] + np.arange(len(item)) - np.repeat(np.cumsum(each) - each, each)
        size = np.minimum(count[item], window)
        #: By length: sorted hashes, first words, and where each window's items begin in `items`.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        owners: list[np.ndarray] = []
        total = 0
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            h = _sums(words, first[own], n)
            order = np.lexsort((item[own], h))
            own, h = own[order], h[order]
            new = np.concatenate(([True], h[1:] != h[:-1]))
            self._tell_apart(first[own], n, new)
            base = np.flatnonzero(new)
            owners.append(item[own])
            self.by_length[n] = (h[base], first[own[base]], np.append(base, len(own)) + total)
            total += len(own)
        self.items = np.concatenate(owners).astype(np.int32) if owners else np.zeros(0, np.int32)
        self.singles = 1 in self.by_length
        pair = _pairs(words, False)
        self.vocabulary = np.unique(np.concatenate([_pairs(words[f], True) if n == 1 else np.unique(pair[f[:, None] + np.arange(n - 1)]) for n, (_, f, _) in self.by_length.items()])) if self.by_length else np.zeros(0, np.uint64)
        self.words = words
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.vocabulary >> U(64 - _FILTER_BITS)] = True

    def _tell_apart(self, first: np.ndarray, n: int, new: np.ndarray) -> None:
        """Windows of one hash whose words differ from those of the window before get a group of their own."""
        again = np.flatnonzero(~new)
        for part in range(0, len(again), _CHUNK):
            at = again[part : part + _CHUNK]
            same = self.same(first[at], first[at - 1], n, self.low, self.starts, self.ends)
            new[at[~same]] = True

    def same(self, mine: np.ndarray, theirs: np.ndarray, n: int, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of the n words from `mine` on are those of another text from `theirs` on."""
        a, b = (x[:, None] + np.arange(n) for x in (mine, theirs))
        a, b = a.reshape(-1), b.reshape(-1)
        return same_words(self.low, self.starts[a], self.ends[a], low, starts[b], ends[b]).reshape(-1, n).all(axis=1)

    def occurrences(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `words` of the items' shingles, and which."""
        at, which = [], []
        for single in (False, True)[: 1 + self.singles]:
            h = _pairs(words, single)
            near = np.flatnonzero(self.filter[h >> U(64 - _FILTER_BITS)])
            k = np.minimum(np.searchsorted(self.vocabulary, h[near]), len(self.vocabulary) - 1)
            same = self.vocabulary[k] == h[near]
            at.append(near[same])
            which.append(k[same])
        return np.concatenate(at), np.concatenate(which)

    def index(self, frequency: np.ndarray) -> None:
        """Choose each window's rarest shingle: (shingle, its place in the window, the window's length)."""
        rows = [np.zeros((0, 3), np.int64)]
        pair = _pairs(self.words, False)
        for n, (_, firsts, _) in self.by_length.items():
            for part in range(0, len(firsts), _CHUNK):
                f = firsts[part : part + _CHUNK]
                h = _pairs(self.words[f], True)[:, None] if n == 1 else pair[f[:, None] + np.arange(n - 1)]
                k = np.searchsorted(self.vocabulary, h)
                seen = frequency[k]
                place = np.where(seen == seen.min(axis=1, keepdims=True), k, len(self.vocabulary)).argmin(axis=1)
                rows.append(np.stack(_unique_rows(k[np.arange(len(f)), place], place, np.full(len(f), n)), axis=1))
        shingle, place, size = _unique_rows(*np.concatenate(rows).T)
        self.place_start = np.searchsorted(shingle, np.arange(len(self.vocabulary) + 1)).astype(np.int32)
        self.place = np.stack((place, size), axis=1).astype(np.int32)
        self.starts, self.ends = self.starts.astype(np.int32), self.ends.astype(np.int32)
        del self.words

    def hits(self, text: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, first and last item at `items`) of each window that stands in a row."""
        at, which = self.occurrences(text.hashes)
        n = self.place_start[which + 1] - self.place_start[which]
        at, which, n = at[n > 0], which[n > 0], n[n > 0].astype(np.int64)
        ends = np.cumsum(n)
        place = self.place[np.repeat(self.place_start[which] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.repeat(at, n)
        row = np.searchsorted(text.before, at, "right") - 1
        start, length = at - place[:, 0], place[:, 1]
        fits = (start >= text.before[row]) & (start + length <= text.before[row + 1])
        start, length = start[fits], length[fits]
        out = [(np.zeros(0, np.int64),) * 4]
        for size, (hashes, firsts, owners) in self.by_length.items():
            s = np.unique(start[length == size])
            if not len(s):
                continue
            h = _sums(text.hashes, s, size)
            lo = np.searchsorted(hashes, h)
            many = np.searchsorted(hashes, h, "right") - lo  # more than one only where hashes clash
            s = np.repeat(s, many)
            k = np.repeat(lo, many) + np.arange(len(s)) - np.repeat(np.cumsum(many) - many, many)
            same = self.same(firsts[k], s, size, text.low, text.starts, text.ends)
            s, k = s[same], k[same]
            out.append((s, s + size, owners[k], owners[k + 1]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def _parts(text: str, limit: int, window: int) -> Iterator[str]:
    """A text, or parts of its words that overlap so that each window is in one."""
    if len(text) * 4 <= limit or len(data := text.encode()) <= limit:
        yield text
        return
    words, size, at = _WORD.findall(data.translate(bytes(LOWER))), 0, 0
    for i, word in enumerate(words):
        size += len(word) + 1
        if size > limit and i - at >= 2 * window:
            yield b" ".join(words[at : i + 1]).decode()
            at = i + 2 - window
            size = sum(len(w) + 1 for w in words[at : i + 1])
    yield b" ".join(words[at:]).decode()


def _blocks(benchmark: DataFrame, limit: int, window: int) -> Iterator[tuple[list, list]]:
    """(item ids, texts) of at most `limit` bytes of text, or of one part of a text."""
    ids: list = []
    texts: list = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").toLocalIterator():
        for part in _parts(r.text, limit, window):
            if ids and size + len(part.encode()) > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(r.item_id)
            texts.append(part)
            size += len(part.encode())
    yield ids, texts


def _counted(docs: DataFrame, told) -> np.ndarray:
    """How often the corpus has each shingle of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = told.value
        seen = np.zeros(len(index.vocabulary), np.int64)
        for piece in slices(batches, "text"):
            seen += np.bincount(index.occurrences(Words(piece.column("text")).hashes)[1], minlength=len(seen))
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(seen[used], pa.int64())], names=["k", "n"])

    out = np.zeros(len(told.value.vocabulary), np.int64)
    for row in docs.mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.k] = row.n
    return out


_HITS = T.StructType().add("n_words", "long").add("spans", "binary").add("items", T.ArrayType(T.StringType()))


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, judge: Callable[[pa.RecordBatch], pa.RecordBatch], result: T.StructType) -> DataFrame:
    """judge on batches of (row, n_words, spans, items): rows of docs, the spans of their hits, and items' ids, null among them."""
    spark = docs.sparkSession
    state = small_batches(docs.select(F.struct("*").alias("row")))
    told = T.StructType([state.schema["row"], *_HITS])
    blocks = _blocks(benchmark, BLOCK_BYTES, window)
    block = next(blocks)
    first = True
    while True:
        index = Windows(*block, window)
        text = state.select(F.col("row.text").alias("text"))
        index.index(_counted(text, spark.sparkContext.broadcast(index)) if len(index.vocabulary) else np.zeros(0, np.int64))
        block = next(blocks, None)
        index_of = spark.sparkContext.broadcast(index)
        if block is None:
            return map_slices(state, "row.text", _pass(index_of, first, judge), result)
        done, state = state, small_batches(materialize(map_slices(state, "row.text", _pass(index_of, first, lambda x: x), told), "contamination"))
        release(done)
        first = False


def _pass(told, first: bool, then: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Adds a block's hits to each row."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        index = told.value
        text = Words(column_of(piece, "row.text"))
        start, end, lo, hi = index.hits(text) if len(index.vocabulary) else (np.zeros(0, np.int64),) * 4
        row = np.searchsorted(text.before, start, "right") - 1
        order = np.argsort(row, kind="stable")
        start, end, lo, hi, row = start[order], end[order], lo[order], hi[order], row[order]
        cuts = np.searchsorted(row, np.arange(piece.num_rows + 1))
        spans = [b""] * piece.num_rows if first else piece.column("spans").to_pylist()
        items: list[list] = [[]] * piece.num_rows if first else piece.column("items").to_pylist()
        for i in np.unique(row).tolist():
            a, b = cuts[i], cuts[i + 1]
            spans[i] += (np.stack([start[a:b], end[a:b]], 1) - text.before[i]).astype("<i8").tobytes()
            names = {index.names[x] for p, q in set(zip(lo[a:b].tolist(), hi[a:b].tolist(), strict=True)) for x in index.items[p:q].tolist()}
            items[i] = list(names.union(items[i]))
        out = [piece.column("row"), pa.array(np.diff(text.before), pa.int64()), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))]
        return then(pa.RecordBatch.from_arrays(out, names=["row", "n_words", "spans", "items"]))

    return run


def _n_hit(spans: bytes) -> int:
    hit, at = 0, 0
    for a, b in sorted(map(tuple, np.frombuffer(spans, "<i8").reshape(-1, 2).tolist())):
        hit += max(0, b - max(a, at))
        at = max(at, b)
    return hit


_RESULT = T.StructType().add("doc_id", "long").add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean").add("items", T.ArrayType(T.StringType()))


def decontamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, least_share: int = 20) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    Words are runs of a-z (A-Z lower-cased), digits and non-ASCII bytes. n_hit counts the document's words inside any
    occurrence of any window, n_items the items with such windows; contaminated: n_hit > 0 and least_share * n_hit >=
    n_words. A null or empty text has no words; an item without words has no window; an empty benchmark hits nothing.
    Item ids may be any string. Items without an id count as one together, as in the SQL, and are in neither items nor
    the digest; items of one id are one. Repeated rows, and rows without a doc_id, each get their row; other columns are
    ignored, an empty table gives an empty one.
    """
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, n, spans, items in zip(*(column_of(batch, c).to_pylist() for c in ("row.doc_id", "n_words", "spans", "items")), strict=True):
            hit, names = _n_hit(spans), sorted(x for x in items if x is not None)
            rows.append((doc_id, n, hit, len(items), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0 and least_share * hit >= n, names))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=_RESULT.names)

    return _judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, window, judge, _RESULT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, least_share: int = 20) -> DataFrame:
    """docs less the contaminated rows. Each row is judged by its own text, whatever its doc_id, null ones too.

    Rows with a null or empty text stay; columns are as before; an empty table gives an empty one.
    """

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        hit = [(n, _n_hit(s)) for n, s in zip(batch.column("n_words").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
        return batch.select(["row"]).filter(pa.array([h == 0 or least_share * h < n for n, h in hit], pa.bool_()))

    row = T.StructField("row", T.StructType(docs.schema.fields))
    return _judged(docs, benchmark, window, judge, T.StructType([row])).select("row.*")
