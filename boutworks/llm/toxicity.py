"""Toxicity by compression distance under two zstandard dictionaries.

A window is a word between marks. Both dictionaries are raw content and begin alike, with the commonest ordinary words;
one goes on with word beginnings and words that texts labelled toxic have far more often, the other with as many bytes of
ordinary words. How many bytes shorter a window becomes under the toxic dictionary is its distance. A document's score is
a logistic function of how many of its windows, and what share of them, reach each of a few distances; the weights are
fitted, so the thresholds on the score are calibrated.

The toxic part is chosen by cover: again and again the segment whose share among the toxic texts not yet met (by MEETS
segments) most exceeds its share among ordinary ones, until none does so beyond chance.

Only the bounded sample of whole labelled rows that fits the model reaches the driver. Each distinct word of a slice is
compressed once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import keep_rows, kept, slices, small_batches
from ._text import LOWER, WORDLIKE, buffer, word_hashes, word_spans

#: Labelled documents of each class that a model is fitted on, and bytes of them in all: whole texts, the first by hash.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 16 << 20
BASE_WORDS = 1200
#: A segment is chosen where at least so many toxic texts not yet met have it, and its share differs by so many deviations.
LEAST_TEXTS, LEAST_DEVIATIONS = 5, 6.0
#: So many chosen segments meet a text.
MEETS = 4
DISTANCES = (3, 4, 5, 6, 8)
LEFT, RIGHT = b"\x02\x03\x05", b"\x06\x07\x08\x0b\x0c"
#: Ends each window and opens both dictionaries: without it a short window would be stored as it is.
FILL = bytes(range(14, 32))
WORDS_KEPT = 500_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class ToxicityModel:
    base: bytes
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        kind = zstandard.ZstdCompressionParameters(window_log=15, hash_log=15, chain_log=15, search_log=7, min_match=5, target_length=64, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_dict_id=False, write_checksum=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        both = (self.base + self.toxic, self.base + self.ordinary)
        toxic, ordinary = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=kind) for x in both)
        return toxic, ordinary

    def score(self, features: np.ndarray) -> np.ndarray:
        x = (features - np.array(self.mean)) / np.array(self.scale)
        return 1 / (1 + np.exp(-(x @ np.array(self.weights[:-1]) + self.weights[-1])))


class Windows:
    """Distances of words under a model, kept by the words' hashes."""

    def __init__(self, model: ToxicityModel) -> None:
        self.toxic, self.ordinary = model.compressors()
        self.known: dict[int, int] = {}

    def distances(self, words: list[bytes]) -> list[int]:
        if not words:
            return []
        marked = [LEFT + w + RIGHT + FILL for w in words]
        a, b = (c.multi_compress_to_buffer(marked, threads=0) for c in (self.ordinary, self.toxic))
        return [len(a[i]) - len(b[i]) for i in range(len(marked))]

    def features(self, column: pa.Array) -> np.ndarray:
        raw, off = buffer(column)
        starts, ends, before = word_spans(raw, off, WORDLIKE)
        h, first, inverse = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) >= WORDS_KEPT:
            self.known.clear()
        names = h.tolist()
        new = [i for i, x in enumerate(names) if x not in self.known]
        low = LOWER[raw].tobytes()
        at = first[new] if new else first[:0]
        self.known.update(zip([names[i] for i in new], self.distances([low[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]), strict=True))
        distance = np.array([self.known[x] for x in names], np.int64)[inverse] if names else np.zeros(0, np.int64)
        counts = np.diff(before)
        reached = [np.diff(np.concatenate(([0], np.cumsum(distance >= t)))[before]) for t in DISTANCES]
        n = np.maximum(counts, 1)
        made = (np.log1p, lambda x: x > 0, lambda x: x > 1, lambda x: np.sqrt(x / n))
        return np.stack([f(x).astype(float) for x in reached for f in made] + [np.log1p(counts)], axis=1)


FEATURES = 4 * len(DISTANCES) + 1


def _segments(words: set[bytes]) -> set[bytes]:
    """Beginnings of three characters or more, as marked; a whole word has its end mark."""
    out = set()
    for word in words:
        text = word.decode(errors="ignore")
        out.add(LEFT + word + RIGHT)
        out.update(LEFT + text[:k].encode() for k in range(3, min(len(text), 10)))
    return out


def _alike(a: bytes, b: bytes) -> bool:
    """Whether one segment's word begins the other's."""
    a, b = a.removesuffix(RIGHT), b.removesuffix(RIGHT)
    return a.startswith(b) or b.startswith(a)


def _words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().translate(bytes(LOWER)))


def _cover(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Segments by cover; of those that the same texts have, the longest. A text's segments are made when needed."""
    n1, n0 = max(1, len(toxic)), max(1, len(ordinary))
    hot, cold = Counter(), Counter()
    for text in toxic:
        hot.update(_segments(set(_words(text))))
    able = {x for x, n in hot.items() if n >= LEAST_TEXTS}
    for text in ordinary:
        cold.update(_segments(set(_words(text))) & able)
    names = sorted(x for x in able if hot[x] / n1 > 3 * (cold[x] + 0.5) / n0)
    place = {x: i for i, x in enumerate(names)}
    has = np.zeros((len(toxic), len(names)), bool)
    for i, text in enumerate(toxic):
        has[i, [place[x] for x in _segments(set(_words(text))) if x in place]] = True
    q = np.array([cold[x] / n0 for x in names])
    size = np.array([len(x) for x in names])
    left, seen, out = np.full(len(toxic), MEETS), has.sum(axis=0), []
    while len(names):
        n = seen / n1
        p = (seen + q * n0) / (n1 + n0)
        z = (n - q) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
        z[seen < LEAST_TEXTS] = 0
        best = int(np.lexsort((size, np.round(z, 6)))[-1])
        if z[best] < LEAST_DEVIATIONS:
            break
        out.append(names[best])
        left -= has[:, best]
        has[:, [i for i, x in enumerate(names) if _alike(x, names[best])]] = False
        met = (left == 0) & has.any(axis=1)
        has[met] = False
        seen = has.sum(axis=0)
    return out


def fit(texts: list[str], toxic: list[int]) -> ToxicityModel:
    """Choose the dictionaries' content, then fit the weights."""
    y = np.array(toxic, float)
    chosen = _cover([t for t, label in zip(texts, toxic, strict=True) if label], [t for t, label in zip(texts, toxic, strict=True) if not label])
    common: Counter = Counter()
    for text, label in zip(texts, toxic, strict=True):
        if not label:
            common.update(_words(text))
    marked = [LEFT + w + RIGHT for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))]
    tail = b"".join(reversed(chosen))
    own = (w for w in marked[BASE_WORDS : BASE_WORDS + len(tail)] if not any(w[: len(LEFT) + 3] == c[: len(LEFT) + 3] for c in chosen))
    rest = b"".join(own)[: len(tail)].rjust(len(tail), b"\x00")
    base = FILL + b"".join(reversed(marked[:BASE_WORDS]))
    bare = ToxicityModel(base, tail, rest, (), (), ())
    windows = Windows(bare)
    x = np.concatenate([windows.features(pa.array(texts[i : i + 100], pa.string())) for i in range(0, len(texts), 100)]) if texts else np.zeros((0, FEATURES))
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    a = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    ridge = np.eye(len(w)) * 0.3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (p - y) + ridge @ w)
    return ToxicityModel(base, tail, rest, tuple(w.tolist()), tuple(mean.tolist()), tuple(scale.tolist()))


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """Whole texts of a bounded sample of labelled rows, of those whose crc32(doc_id) mod 3 is not 1.

    Of each class the first by hash, at most sample_rows; a text that would pass half of sample_bytes is not taken.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y is not null and crc32(cast(doc_id as string)) % 3 <> 1")
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    rows = texts.join(F.broadcast(chosen), "doc_id")  # at most 2 * sample_rows labels
    sizes = rows.select("doc_id", "y", F.xxhash64("doc_id").alias("place"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("own")).collect()
    used = {0: 0, 1: 0}
    taken = []
    for r in sorted(sizes, key=lambda r: (r.y, r.place, r.doc_id, r.size, r.own)):
        if used[r.y] + r.size <= sample_bytes // 2:
            used[r.y] += r.size
            taken.append((r.doc_id, r.y, r.own))
    if not taken:
        return [], []
    told = docs.sparkSession.createDataFrame(taken, "doc_id long, y int, own long").distinct()
    found = texts.withColumn("own", F.xxhash64("text")).join(F.broadcast(told), ["doc_id", "own"]).select("doc_id", "text", "y").distinct().collect()
    found.sort(key=lambda r: (r.doc_id, r.y, r.text))
    return [r.text for r in found], [r.y for r in found]


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.7) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    score is the fitted chance that the label is 1, predicted 1 from the threshold on; both take the text alone. A null
    or empty text has no windows and the score of that. Without labels of both kinds, scores are near the share of the
    labels there are (one half if none). Repeated rows each get a row, an empty table gives an empty one; other columns
    are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(*training_rows(docs, labels, sample_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = kept(("toxicity", hash(model.value)), lambda: Windows(model.value))
        for piece in slices(batches, "text"):
            score = model.value.score(windows.features(piece.column("text")))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
    held = F.expr("coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)")
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.7) -> DataFrame:
    """docs less the rows whose score reaches the threshold. Each row is judged by its text, whatever its doc_id.

    A null or empty text has no toxic window. Columns are as before; an empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(*training_rows(docs, labels, sample_rows)))

    def stays(column: pa.Array) -> np.ndarray:
        windows = kept(("toxicity", hash(model.value)), lambda: Windows(model.value))
        return model.value.score(windows.features(column)) < threshold

    return keep_rows(docs, stays)
