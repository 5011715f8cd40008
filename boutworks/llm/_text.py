"""Words and shingles of whole Arrow string columns, computed on the bytes with numpy."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
_LOWER = np.arange(256)
_LOWER[65:91] += 32
LOWER = _LOWER.astype(np.uint8)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed in one go.
_LONG = 1 << 12

#: `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z, by byte.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
WORDLIKE = np.zeros(256, bool)
WORDLIKE[48:58] = WORDLIKE[97:123] = WORDLIKE[65:91] = WORDLIKE[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_spans(raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words before each row (with the total at the end)."""
    inside = table[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; there are zeros after the end."""
    return np.ndarray((len(raw) + 1,), "<u8", np.concatenate((raw, np.zeros(8, np.uint8))), strides=(1,))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of lower-cased words, mixed after every eight bytes; words of one length up to eight never clash."""
    low = LOWER[raw]
    eight, size = eights(low), ends - starts
    h = size.astype(np.uint64)
    live = np.arange(len(size))
    at = 0
    while len(live) and at < _LONG:
        left = size[live] - at
        h[live] = mix(h[live] * U(0x9E3779B97F4A7C15) + (eight[starts[live] + at] & _MASK[np.minimum(left, 8)]))
        live, at = live[left > 8], at + 8
    for i in live.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_words(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """Which words low[starts:ends] are byte by byte the words other[firsts:lasts]; both are lower-cased."""
    size = ends - starts
    same = size == lasts - firsts
    a, b = eights(low), eights(other)
    live, at = np.flatnonzero(same), 0
    while len(live):
        left = np.minimum(size[live] - at, 8)
        equal = (a[starts[live] + at] ^ b[firsts[live] + at]) & _MASK[left] == 0
        same[live[~equal]] = False
        live = live[equal & (left == 8)]
        at += 8
        live = live[size[live] > at]
    return same


@functools.lru_cache(8)
def _weights(k: int) -> np.ndarray:
    return np.random.default_rng(k).integers(1, 2**63, k, dtype=np.uint64) | U(1)


def shingle_sets(column: pa.Array, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each row its sorted distinct k-word shingles as 64-bit hashes, and its number of words.

    Words are runs of non-space bytes, A-Z lower-cased. A row with fewer than k words, but some, has
    one shingle of all of them; a null or blank row has none.
    """
    raw, off = buffer(column)
    starts, ends, before = word_spans(raw, off, SPACED)
    words = word_hashes(raw, starts, ends)
    w = _weights(k)
    whole = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        whole += words[j : j + len(whole)] * w[j]
    whole = mix(whole)
    sets = []
    counts = np.diff(before)
    for a, n in zip(before[:-1].tolist(), counts.tolist(), strict=True):
        if n >= k:
            s = np.sort(whole[a : a + n - k + 1])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:
            sets.append(mix((words[a : a + n] * w[:n]).sum(keepdims=True, dtype=np.uint64) + U(n)))
        else:
            sets.append(words[:0])
    return sets, counts


def signature(shingles: np.ndarray, bits: int = 64, taken: frozenset = frozenset()) -> tuple[int, int]:
    """A signed name of a shingle set that is none of `taken`, and 64 bits that check it."""
    data, turn = shingles.tobytes(), 0
    while True:
        told = hashlib.blake2b(data, digest_size=16, salt=turn.to_bytes(4, "little")).digest()
        name = int.from_bytes(told[:8], "little", signed=True) >> 64 - bits
        if name not in taken:
            return name, int.from_bytes(told[8:], "little", signed=True)
        turn += 1
