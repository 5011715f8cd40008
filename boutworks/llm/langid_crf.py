"""Language ID with a linear-chain conditional random field over words.

Each word has affix and n-gram features (its byte 2- to 5-grams with marks at both ends, hashed) and lexicon features
(the languages whose list of frequent words has it); transitions between labels are learned with them. Training text is
cut into short sequences, half of which switch between documents of different languages, and the field is fitted by its
exact gradient from forward-backward. Texts are labelled word by word with forward-backward marginals over the whole
chain; a document's language is the label of most marginal mass.

Chains of any length are done in step: each is cut into segments, whose transfer matrices give the messages at the cuts,
and from those the messages within all segments follow together. That is the same forward-backward, in another order.

Only the bounded sample of whole documents that fits the model reaches the driver. Each distinct word of a slice is
scored once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import kept, slices, small_batches
from ._text import LOWER, WORDLIKE, U, buffer, mix, word_hashes, word_spans

#: Training documents a language, and bytes of them in all: whole documents, the first by hash that fit.
SAMPLE_ROWS, SAMPLE_BYTES = 100, 4 << 20
LEXICON_WORDS = 500
BUCKETS = 1 << 16
LENGTH = 40
SEGMENT = 64
CHAIN_WORDS = 200_000
ROUNDS, RATE, DECAY = 50, 0.2, 1e-5


def ngrams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte 2- to 5-grams of marked words: (buckets, the word of each)."""
    size = ends - starts + 2
    stop = np.cumsum(size)
    first = stop - size
    flat = np.empty(int(stop[-1]) if len(stop) else 0, np.uint64)
    word = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(flat)) - first[word]
    inner = (at > 0) & (at < size[word] - 1)
    flat[inner] = LOWER[raw[(starts[word] + at - 1)[inner]]]
    flat[at == 0] = 1
    flat[at == size[word] - 1] = 2
    buckets, words = [], []
    for n in range(2, 6):
        if len(flat) < n:
            break
        h = np.zeros(len(flat) - n + 1, np.uint64)
        for j in range(n):
            h = h * U(1_000_003) + flat[j : len(flat) - n + 1 + j]
        same = word[: len(h)] == word[n - 1 :]
        buckets.append((mix(h[same] + U(n << 56)) >> U(64 - 16)).astype(np.int64))
        words.append(word[: len(h)][same])
    return (np.concatenate(buckets), np.concatenate(words)) if buckets else (np.zeros(0, np.int64),) * 2


def forward_backward(emission: np.ndarray, transition: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (B, T, K), summed pair marginals (K, K) and the log partition function's sum, in scaled probabilities.

    emission: (B, T, K) scores; a sequence's places from its length on are ignored.
    """
    b, t, k = emission.shape
    top = emission.max(axis=2, keepdims=True) if t else emission
    e = np.exp(emission - top)
    m = np.exp(transition)
    live = np.arange(t)[None, :] < length[:, None]
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones((b, t))
    for i in range(t):
        a = e[:, i] if i == 0 else (alpha[:, i - 1] @ m) * e[:, i]
        scale[:, i] = a.sum(axis=1)
        alpha[:, i] = a / scale[:, i : i + 1]
    for i in range(t - 2, -1, -1):
        x = (e[:, i + 1] * beta[:, i + 1]) @ m.T / scale[:, i + 1 : i + 2]
        beta[:, i] = np.where(live[:, i + 1 : i + 2], x, 1.0)
    marginal = alpha * beta
    marginal /= marginal.sum(axis=2, keepdims=True)
    pairs = np.zeros((k, k))
    if t > 1:
        right = e[:, 1:] * beta[:, 1:] / scale[:, 1:, None] * live[:, 1:, None]
        pairs = np.einsum("bti,btj->ij", alpha[:, :-1], right) * m
    total = float((np.log(scale) + top[:, :, 0])[live].sum()) if t else 0.0
    return marginal, pairs, total


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def chain_marginals(emission: np.ndarray, transition: np.ndarray, before: np.ndarray) -> np.ndarray:
    """(words, K): marginals of chains of any length; chain i has the words before[i] to before[i + 1]."""
    k = emission.shape[1]
    counts = np.diff(before)
    segments = -(-counts // SEGMENT)
    chain = np.repeat(np.arange(len(counts)), segments)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(segments) - segments, segments)
    lo = before[chain] + SEGMENT * number
    hi = np.minimum(lo + SEGMENT, before[chain + 1])
    length = hi - lo
    longest = int(length.max(initial=0))
    grid = np.minimum(lo[:, None] + np.arange(longest), max(len(emission) - 1, 0))
    live = np.arange(longest)[None, :] < length[:, None]
    e = emission[grid].astype(np.float64)
    e = np.exp(e - e.max(axis=2, keepdims=True, initial=-np.inf)) if longest else e
    e[~live] = 1
    m = np.exp(transition)
    first = (number == 0)[:, None]
    # What a segment makes of the message before it; a chain's first word has no word before it.
    product = np.where(first[:, :, None], np.eye(k), m)
    for i in range(longest):
        step = (product if i == 0 else product @ m) * e[:, i, None, :]
        product = np.where(live[:, i, None, None], step / step.sum(axis=(1, 2), keepdims=True), product)
    into, out = np.ones((len(chain), k)), np.ones((len(chain), k))
    by_number = np.argsort(number, kind="stable")
    cuts = np.searchsorted(number[by_number], np.arange(int(number.max(initial=-1)) + 2))
    for j in range(1, len(cuts) - 1):
        own = by_number[cuts[j] : cuts[j + 1]]
        into[own] = _scaled(np.einsum("sk,skl->sl", into[own - 1], product[own - 1]))
    for j in range(len(cuts) - 2, 0, -1):
        own = by_number[cuts[j] : cuts[j + 1]]
        out[own - 1] = _scaled(np.einsum("skl,sl->sk", product[own], out[own]))
    alpha, beta = np.empty_like(e), np.empty_like(e)
    a = np.where(first, into, into @ m)
    for i in range(longest):
        a = _scaled((a if i == 0 else alpha[:, i - 1] @ m) * e[:, i])
        alpha[:, i] = a
    b = out
    for i in range(longest - 1, -1, -1):
        beta[:, i] = b
        b = np.where(live[:, i, None], _scaled((e[:, i] * b) @ m.T), b)
    return _scaled(alpha * beta)[live]


@dataclass(frozen=True)
class Field:
    labels: tuple[str, ...]
    weights: np.ndarray  # (BUCKETS, K)
    lexicon: np.ndarray  # sorted word hashes
    lists: np.ndarray  # (words of the lexicon, K): which lists have the word
    by_list: np.ndarray  # (K, K)
    transition: np.ndarray

    def emissions(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        buckets, word = ngrams(raw, starts, ends)
        out = np.zeros((len(starts), len(self.labels)), np.float32)
        for k in range(len(self.labels)):
            out[:, k] = np.bincount(word, weights=self.weights[buckets, k], minlength=len(starts))
        if len(self.lexicon) and len(hashes):
            at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
            known = self.lexicon[at] == hashes
            out[known] += (self.lists[at[known]] @ self.by_list).astype(np.float32)
        return out


def _sequences(docs: list[np.ndarray], label: list[int], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of LENGTH words: every other one as in its document, the others switching between documents."""
    words, gold = [], []
    runs = [(d[a : a + LENGTH], y) for d, y in zip(docs, label, strict=True) for a in range(0, len(d) - LENGTH + 1, LENGTH)]
    for i, (run, y) in enumerate(runs):
        run, ys = run.copy(), np.full(LENGTH, y)
        if i % 2:
            at = int(rng.integers(3, LENGTH - 8))
            stop = min(LENGTH, at + int(rng.integers(4, 20)))
            other, z = runs[int(rng.integers(len(runs)))]
            run[at:stop], ys[at:stop] = other[at:stop], z
        words.append(run)
        gold.append(ys)
    return (np.stack(words), np.stack(gold)) if words else (np.zeros((0, LENGTH), np.int64),) * 2


def fit(texts: list[str], languages: list[str], seed: int = 5) -> Field:
    """Fit the field on a sample. Documents shorter than a sequence are read together with others of their language."""
    labels = tuple(sorted(set(languages)))
    k = len(labels)
    order = sorted(range(len(texts)), key=lambda i: (languages[i], i))
    raw, off = buffer(pa.array([texts[i] for i in order], pa.string()))
    starts, ends, before = word_spans(raw, off, WORDLIKE)
    hashes, first, word = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    y = [labels.index(languages[i]) for i in order]
    streams, stream_label = [], []
    for c in range(k):
        own = [word[before[i] : before[i + 1]] for i in range(len(order)) if y[i] == c]
        streams.append(np.concatenate(own) if own else word[:0])
        stream_label.append(c)
    tops = [Counter(s.tolist()) for s in streams]
    sizes = [max(1, len(s)) for s in streams]
    member = np.zeros((len(hashes), k), np.float32)
    for c, top in enumerate(tops):
        for w, n in top.most_common(LEXICON_WORDS):
            if n >= 3 and n / sizes[c] > 3 * max([0.0, *(tops[d][w] / sizes[d] for d in range(k) if d != c)]):
                member[w, c] = 1
    listed = np.flatnonzero(member.any(axis=1))
    buckets, of = ngrams(raw, starts[first], ends[first])
    seq, gold = _sequences(streams, stream_label, np.random.default_rng(seed))
    length = np.full(len(seq), LENGTH)
    weights, by_list, transition = np.zeros((BUCKETS, k)), np.eye(k), np.zeros((k, k))
    squares = [np.full_like(x, 1e-8) for x in (weights, by_list, transition)]
    n = max(1, seq.size)
    want = np.zeros((len(hashes), k))
    np.add.at(want, (seq.reshape(-1), gold.reshape(-1)), 1)
    want_pairs = np.zeros((k, k))
    np.add.at(want_pairs, (gold[:, :-1].reshape(-1), gold[:, 1:].reshape(-1)), 1)
    for _ in range(ROUNDS if k > 1 and len(seq) else 0):
        emission = np.stack([np.bincount(of, weights=weights[buckets, c], minlength=len(hashes)) for c in range(k)], axis=1) + member @ by_list
        marginal, pairs, _ = forward_backward(emission[seq], transition, length)
        have = np.stack([np.bincount(seq.reshape(-1), weights=marginal[:, :, c].reshape(-1), minlength=len(hashes)) for c in range(k)], axis=1)
        slope = (want - have) / n
        steps = (np.stack([np.bincount(buckets, weights=slope[of, c], minlength=BUCKETS) for c in range(k)], axis=1) - DECAY * weights, member.T @ slope - DECAY * by_list, (want_pairs - pairs) / n - DECAY * transition)
        for x, g, s in zip((weights, by_list, transition), steps, squares, strict=True):
            s += g * g
            x += RATE * g / np.sqrt(s)
    return Field(labels, weights.astype(np.float32), hashes[listed], member[listed], by_list, transition)


class Labeller:
    """A field with the emissions of the words seen so far."""

    KEPT = 500_000

    def __init__(self, field: Field) -> None:
        self.field = field
        self.row: dict[int, int] = {}
        self.table = np.zeros((1 << 14, len(field.labels)), np.float32)

    def _rows(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h, first, inverse = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        if len(self.row) >= self.KEPT:
            self.row.clear()
        names = h.tolist()
        new = np.array([i for i, x in enumerate(names) if x not in self.row], np.int64)
        if len(new):
            base = len(self.row)
            while base + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[base : base + len(new)] = self.field.emissions(raw, starts[first[new]], ends[first[new]], h[new])
            self.row.update(zip([names[i] for i in new.tolist()], range(base, base + len(new)), strict=True))
        return np.array([self.row[x] for x in names], np.int64)[inverse] if names else np.zeros(0, np.int64)

    def marginals(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
        """(words, K): forward-backward marginals of every word."""
        k = len(self.field.labels)
        rows = self._rows(raw, starts, ends)
        out = np.zeros((len(rows), k), np.float32)
        # Chains of some hundred thousand words at a time, or one chain.
        cut = 0
        while cut < len(before) - 1:
            stop = max(cut + 1, int(np.searchsorted(before, before[cut] + CHAIN_WORDS, "right")) - 1)
            a, b = int(before[cut]), int(before[stop])
            out[a:b] = chain_marginals(self.table[rows[a:b]], self.field.transition, before[cut : stop + 1] - a)
            cut = stop
        return out

    def documents(self, column: pa.Array) -> tuple[list[str], list[float], list[int]]:
        """(language, score, words labelled otherwise) of each row."""
        raw, off = buffer(column)
        starts, ends, before = word_spans(raw, off, WORDLIKE)
        counts = np.diff(before)
        low = LOWER[raw]
        ascii_ = np.concatenate(([0], np.cumsum((low >= 97) & (low <= 122))))
        lettered = np.diff(ascii_[off]) > 0
        for i in np.flatnonzero(~lettered & (counts > 0)).tolist():
            lettered[i] = any(map(str.isalpha, column[i].as_py()))
        if not self.field.labels:
            return ["und"] * len(counts), [0.0] * len(counts), [0] * len(counts)
        marginal = self.marginals(raw, starts, ends, before)
        sums = np.diff(np.concatenate((np.zeros((1, marginal.shape[1])), np.cumsum(marginal, axis=0, dtype=np.float64)))[before], axis=0)
        best = sums.argmax(axis=1)
        share = sums[np.arange(len(best)), best] / np.maximum(counts, 1)
        other = marginal.argmax(axis=1) != np.repeat(best, counts)
        others = np.diff(np.concatenate(([0], np.cumsum(other)))[before])
        names = [self.field.labels[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        score = np.where(lettered, np.clip(share, 0, 1), 0.0)
        return names, score.tolist(), np.where(lettered, others, 0).tolist()


def training_rows(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[str]]:
    """Whole texts and languages of a bounded sample of rows whose crc32(doc_id) mod 4 is not 2.

    Of each language the first by hash, at most sample_rows; a text that would pass the language's share of sample_bytes
    is not taken.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("lang is not null and text is not null and crc32(cast(doc_id as string)) % 4 <> 2")
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "size")
    sizes = known.select("doc_id", "lang", F.octet_length("text").alias("size"), F.xxhash64("text").alias("own"))
    first = sizes.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= sample_rows).collect()  # numbers alone
    share = sample_bytes // max(1, len({r.lang for r in first}))
    used: Counter = Counter()
    chosen = []
    for r in sorted(first, key=lambda r: (r.lang, r.place)):
        if used[r.lang] + r.size <= share:
            used[r.lang] += r.size
            chosen.append((r.doc_id, r.lang, r.own))
    if not chosen:
        return [], []
    told = docs.sparkSession.createDataFrame(chosen, "doc_id long, lang string, own long")
    rows = known.join(F.broadcast(told), (known["doc_id"] == told["doc_id"]) & (known["lang"] == told["lang"]) & (F.xxhash64(known["text"]) == told["own"])).select(known["doc_id"], known["text"], known["lang"]).distinct().collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang, r.text))
    return [r.text for r in rows], [r.lang for r in rows]


def language_id(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, n_other.

    lang_pred is a learned language, or `und` (score 0) for a null text or one without a letter, and everywhere if no
    row teaches a language. score is the mean marginal of that language over the words, n_other the number of words
    labelled otherwise. Ties go to the first language by name. Repeated rows each get a row, an empty table gives an
    empty one; other columns are ignored and no column but text enters a prediction.
    """
    field = docs.sparkSession.sparkContext.broadcast(fit(*training_rows(docs, sample_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = kept(("language", hash(field.value.weights.tobytes()), field.value.labels), lambda: Labeller(field.value))
        for piece in slices(batches, "text"):
            names, score, others = labeller.documents(piece.column("text"))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(others, pa.int64())], names=["doc_id", "lang_pred", "score", "n_other"])

    out = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_other long")
    return out.select("doc_id", F.expr("coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)").alias("held_out"), "lang_pred", "score", "n_other")
