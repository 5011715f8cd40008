"""Exact n-gram Jaccard join: a blocked sparse product of the document by shingle incidence.

The incidence matrix is cut by shingle into blocks of columns; a block's rows are document signatures. Columns are put in
order of rarity. Two documents with Jaccard >= t share at least ceil(t n) columns, so a document with fewer columns that
any other text has leaves before any pair is formed, and two linked documents meet in one of their n - ceil(t n) + 1
rarest. Documents that meet there are multiplied in blocks of rows, which accumulates their overlap counts; pairs below
the bound that their sizes give are dropped.

Copies (equal shingle sets) are one row. Groups of near copies are joined first within small blocks of rows with the same
min-hash. After that only columns whose rows are in several classes count. Small ones are dealt to blocks of some hundred
rows, and each block is multiplied whole; of a large column a block holds rows that are not in its largest class against
rows of that column, and gives one link for each pair of a row and a class; so a group of near copies never makes all its
pairs. Overlaps are counted exactly, hence no link between different texts is lost.

Rows are named by 64 bits of their set; another 64 are compared over the whole table, and sets that share a name get
others. Shingles are compared by 64 bits. The number of partitions grows with the number of the matrix's entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import first_of_groups, kept, map_slices, materialize, release, shuffle_partitions, slices, small_batches
from ._text import U, mix, shingle_sets, signature
from .components import connected_components

BLOCK_ROWS = 192
#: Groups of at most so many rows of one min-hash are left to the columns.
FEW_ROWS = 8
#: Entries of the matrix for each partition of its two exchanges, some eleven bytes each.
PARTITION_ENTRIES = 4_000_000
BROADCAST_ROWS = 400_000
_BANDS = 2


class Bounds:
    """Size-derived bounds for Jaccard >= t, in whole numbers."""

    def __init__(self, t: Fraction) -> None:
        self.num, self.den = t.numerator, t.denominator

    def least(self, n):
        """ceil(t n): the least size of a partner, and the least overlap with it."""
        return -(-n * self.num // self.den)

    def linked(self, both, n, m):
        return both * (self.num + self.den) >= self.num * (n + m)


def _described(docs: DataFrame, k: int, bits: int, taken: frozenset) -> DataFrame:
    """(doc_id, n_shingles, sig, check): one row per document."""

    def one(piece: pa.RecordBatch) -> pa.RecordBatch:
        sets, _ = shingle_sets(piece.column("text"), k)
        told = [signature(s, bits, taken) if len(s) else (None, None) for s in sets]
        return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([t[i] for t in told], pa.int64()) for i in (0, 1))], names=["doc_id", "n_shingles", "sig", "check"])

    return map_slices(docs, "text", one, "doc_id long, n_shingles long, sig long, check long")


def _named(docs: DataFrame, k: int, bits: int) -> tuple[DataFrame, frozenset]:
    """Described documents with a name for each set, and the names that had to go because two sets had them."""
    taken: frozenset = frozenset()
    while True:
        told = materialize(_described(docs, k, bits, taken), "jaccard-docs")
        shared = told.where("sig is not null").groupBy("sig").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi")
        more = frozenset(r.sig for r in shared.select("sig").collect())  # of n names about n * n / 2**65
        if not more:
            return told, taken
        release(told)
        taken |= more


_LOW = U((1 << 48) - 1)


def _packed(bucket: np.ndarray, entries: dict[str, np.ndarray]) -> Iterator[dict]:
    """Rows of (bucket, one binary per field), a block of the matrix each."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else []
    fields = {f: x[order] for f, x in entries.items()}
    for a, b in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
        yield {"bucket": int(bucket[a]), **{f: x[a:b].tobytes() for f, x in fields.items()}}


def _batch(rows: list[dict], fields: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r["bucket"] for r in rows], pa.int32()), *(pa.array([r[f] for r in rows], pa.binary()) for f in fields)], names=["bucket", *fields])


def _columns(docs: DataFrame, k: int, buckets: int, bits: int, taken: frozenset) -> DataFrame:
    """The incidence matrix in blocks of (bucket of columns, slice of documents).

    A column's name is its bucket and 48 bits. A block has its rows' signatures and sizes once, how many of its columns
    each row has, and the columns' names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("jaccard", dict)
        for piece in slices(batches, "text"):
            sets, _ = shingle_sets(piece.column("text"), k)
            part, sigs, seen = [], [], set()
            for s in sets:
                if len(s) and (sig := signature(s, bits, taken)[0]) not in seen:  # a copy adds nothing
                    seen.add(sig)
                    part.append(s)
                    sigs.append(sig)
            if not part:
                continue
            size = np.array([len(x) for x in part])
            h = mix(np.concatenate(part))
            row = np.repeat(np.arange(len(part), dtype=np.int32), size)
            sig = np.array(sigs, np.int64)
            bucket = ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
            out = []
            for block in _packed(bucket, {"h": h & _LOW, "row": row}):
                own, count = np.unique(np.frombuffer(block["row"], np.int32), return_counts=True)
                name = np.frombuffer(block["h"], np.uint64).view(np.uint16).reshape(-1, 4)
                out.append({"bucket": block["bucket"], "h": name[:, :3].tobytes(), "sig": sig[own].tobytes(), "n": size[own].astype(np.uint32).tobytes(), "has": count.astype(np.uint16).tobytes() if count.max() < 1 << 16 else count.astype(np.uint32).tobytes()})
            yield _batch(out, ("h", "sig", "n", "has"))

    return docs.mapInArrow(run, "bucket int, h binary, sig binary, n binary, has binary")


def _gathered(batches: Iterator[pa.RecordBatch], fields: dict[str, type]) -> tuple[np.ndarray, ...] | None:
    parts: dict[str, list[bytes]] = {f: [] for f in fields}
    for batch in batches:
        for f in fields:
            parts[f] += batch.column(f).to_pylist()
    if not any(parts[next(iter(fields))]):
        return None
    return tuple(np.frombuffer(b"".join(parts.pop(f)), dtype) for f, dtype in fields.items())


def _unpacked(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(column, signature, size) of every entry of some blocks."""
    hs, sigs, ns, has = [], [], [], []
    for batch in batches:
        for block in batch.to_pylist():
            low = np.frombuffer(block["h"], np.uint16).reshape(-1, 3)
            name = np.empty((len(low), 4), np.uint16)
            name[:, :3], name[:, 3] = low, block["bucket"] & 0xFFFF
            hs.append(name.reshape(-1).view(np.uint64))
            sigs.append(np.frombuffer(block["sig"], np.int64))
            ns.append(np.frombuffer(block["n"], np.uint32))
            width = len(block["has"]) // len(sigs[-1])
            has.append(np.frombuffer(block["has"], f"<u{width}").astype(np.int64))
    if not hs:
        return None
    has = np.concatenate(has)
    return np.concatenate(hs), np.repeat(np.concatenate(sigs), has), np.repeat(np.concatenate(ns), has)


def _shared_columns(blocks: DataFrame, buckets: int) -> DataFrame:
    """Columns with two rows or more, as blocks by row signature: (bucket, sig, n, h, rows in the column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _unpacked(batches)
        if got is None:
            return
        h, sig, n = got
        order = np.argsort(h)
        h = h[order]
        again = h[1:] == h[:-1]
        keep = np.concatenate(([False], again)) | np.concatenate((again, [False]))
        h, order = h[keep], order[keep]
        sig, n = sig[order], n[order]
        order = np.lexsort((sig, h))
        h, sig, n = h[order], sig[order], n[order]
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (sig[1:] != sig[:-1])  # copies from other slices
        h, sig, n = h[keep], sig[keep], n[keep]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        rows = np.diff(np.append(first, len(h)))
        rows = np.repeat(rows, rows).astype(np.uint32)
        keep = rows > 1
        h, sig, n, rows = h[keep], sig[keep], n[keep], rows[keep]
        if len(h):
            bucket = ((mix(sig.view(np.uint64)) >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
            yield _batch(list(_packed(bucket, {"sig": sig, "n": n, "h": h, "df": rows})), ("sig", "n", "h", "df"))

    return blocks.repartitionById(buckets, F.col("bucket")).mapInArrow(run, "bucket int, sig binary, n binary, h binary, df binary")


def _postings(shared: DataFrame, bounds: Bounds, buckets: int) -> DataFrame:
    """(tok, sig, n): the rare columns of rows that can have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gathered(batches, {"sig": np.int64, "n": np.uint32, "h": np.uint64, "df": np.uint32})
        if got is None:
            return
        sig, n, h, df = got
        order = np.lexsort((h, df, sig))
        sig, n, h = sig[order], n[order].astype(np.int64), h[order]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        count = np.diff(np.append(first, len(sig)))
        size = n[first]
        alone = size - count  # columns of this row alone come first in the order of rarity
        prefix = np.where(count >= bounds.least(size), size - bounds.least(size) + 1 - alone, 0)
        place = np.arange(len(sig)) - np.repeat(first, count)
        keep = place < np.repeat(prefix, count)
        yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(sig[keep]), pa.array(n[keep])], names=["tok", "sig", "n"])

    return shared.repartitionById(buckets, F.col("bucket")).mapInArrow(run, "tok long, sig long, n long")


def _block_edges(bounds: Bounds):
    """Links within a block of rows, as a star for each class: breadth first, each row against those not yet reached."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sig", kind="stable").drop_duplicates("sig")
        sigs = pdf["sig"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in pdf["items"]]
        size = np.array([len(s) for s in sets])
        items = np.concatenate(sets)
        _, col = np.unique(items, return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(col, kind="stable")
        by_col, starts = row[order], np.searchsorted(col[order], np.arange(col.max() + 2))
        of = np.split(col, np.cumsum(size)[:-1])
        a, b, left = [], [], np.ones(len(sets), bool)
        for root in range(len(sets)):
            if not left[root]:
                continue
            left[root], queue = False, [root]
            while queue and left.any():
                i = queue.pop()
                hits = np.concatenate([by_col[starts[c] : starts[c + 1]] for c in of[i].tolist()])
                both = np.bincount(hits, minlength=len(sets))
                new = np.flatnonzero(left & bounds.linked(both, size[i], size))
                left[new] = False
                queue += new.tolist()
                a += [sigs[root]] * len(new)
                b += sigs[new].tolist()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def _close(sets: DataFrame, bounds: Bounds) -> DataFrame:
    """Edges between rows of one min-hash, found in blocks of at most BLOCK_ROWS rows and two pivots."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = batch.column("sig").to_pylist()
            out = [(s, j, int(mix(np.frombuffer(x, np.uint64) ^ U(7919 * (j + 1))).min().view(np.int64))) for s, x in zip(sig, batch.column("items").to_pylist(), strict=True) for j in range(_BANDS)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["sig", "band", "key"])

    found = materialize(sets.mapInArrow(keys, "sig long, band int, key long"), "jaccard-keys")
    groups = materialize(found.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("sig").alias("lo"), F.max("sig").alias("hi")).where(F.col("m") > FEW_ROWS), "jaccard-groups")
    placed = found.join(groups, ["band", "key"]).withColumn("blocks", F.ceil(F.col("m") / BLOCK_ROWS).cast("int"))
    own = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    placed = placed.select("sig", "band", "key", F.explode(F.when((F.col("sig") == F.col("lo")) | (F.col("sig") == F.col("hi")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))).alias("block"))
    return placed.join(sets.select("sig", "items"), "sig").groupBy("band", "key", "block").applyInPandas(_block_edges(bounds), "a long, b long")


def _open(named: DataFrame) -> DataFrame:
    """Columns whose rows are in several classes: (tok, rows m, rows beside the largest class s, that class, the least row).
    Of columns with the same rows, one stands for all."""
    by_class = named.groupBy("tok", "cls").agg(F.count("*").alias("c"), F.min("sig").alias("lo"), F.bit_xor(F.xxhash64("sig")).alias("x"), F.bit_xor(F.xxhash64("sig", F.lit(1))).alias("y"))
    by_tok = by_class.groupBy("tok").agg(F.sum("c").alias("m"), F.count("*").alias("classes"), F.max(F.struct("c", "cls")).alias("top"), F.min("lo").alias("lo"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("classes > 1")
    return by_tok.groupBy("x", "y", "m", "lo").agg(F.min(F.struct("tok", "top")).alias("t")).select("t.tok", "m", (F.col("m") - F.col("t.top.c")).alias("s"), F.col("t.top.cls").alias("top"), "lo")


def _within(named: DataFrame, small: DataFrame, sets: DataFrame, bounds: Bounds) -> DataFrame:
    """Links within small columns: columns of one least row share blocks, of some 2 * BLOCK_ROWS rows, multiplied whole."""
    size = 2 * BLOCK_ROWS
    blocks = max(1, (small.agg(F.sum("m")).first()[0] or 0) // size)
    load = small.groupBy("lo").agg(F.ceil(F.sum("m") / size).cast("int").alias("parts"))
    block = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("lo"), F.lit(blocks))).otherwise(F.xxhash64("lo", F.pmod(F.xxhash64("tok"), F.col("parts"))))
    placed = small.select("tok", "lo").join(load, "lo").select("tok", block.alias("block")).join(named.select("tok", "sig"), "tok").select("block", "sig").distinct()
    return placed.join(sets, "sig").groupBy("block").applyInPandas(_block_edges(bounds), "a long, b long")


def _across(named: DataFrame, open_: DataFrame, sets: DataFrame, bounds: Bounds) -> DataFrame:
    """Links between classes within large columns, by blocks of (rows beside the largest class) x (all rows)."""
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_ROWS).cast("int")
    rows = named.join(open_, "tok").select("tok", "sig", "cls", "top", blocks("s").alias("i_blocks"), blocks("m").alias("j_blocks"))
    spot = lambda c: F.pmod(F.xxhash64("sig"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    beside = rows.where("cls <> top").select("tok", "sig", "cls", F.lit(0).alias("role"), spot("i_blocks").alias("i"), every("j_blocks").alias("j"))
    against = rows.select("tok", "sig", "cls", F.lit(1).alias("role"), every("i_blocks").alias("i"), spot("j_blocks").alias("j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, m = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
        a, b = [], []
        if len(s) and len(m):
            sets = [np.frombuffer(x, np.uint64) for x in m["items"]]
            size = np.array([len(x) for x in sets])
            items = np.concatenate(sets)
            order = np.argsort(items, kind="stable")
            items, row = items[order], np.repeat(np.arange(len(sets)), size)[order]
            cls, sig = m["cls"].to_numpy(), m["sig"].to_numpy()
            for own, c, x in zip(s["sig"].tolist(), s["cls"].tolist(), s["items"], strict=True):
                x = np.frombuffer(x, np.uint64)
                lo, hi = np.searchsorted(items, x), np.searchsorted(items, x, "right")
                hits = np.concatenate([row[p:q] for p, q in zip(lo.tolist(), hi.tolist(), strict=True)])
                both = np.bincount(hits, minlength=len(sets))
                found = np.flatnonzero((cls != c) & bounds.linked(both, len(x), size))
                _, one = np.unique(cls[found], return_index=True)
                a += [own] * len(one)
                b += sig[found[one]].tolist()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    placed = beside.unionByName(against).join(sets, "sig")
    return placed.groupBy("tok", "i", "j").applyInPandas(run, "a long, b long")


def jaccard_components(docs: DataFrame, shingle_words: int = 5, threshold: Fraction | str = "0.8", name_bits: int = 64) -> DataFrame:
    """One row per row of docs: (doc_id, n_shingles, component_id).

    component_id is the smallest doc_id reachable over links of Jaccard >= threshold between the sets of distinct
    shingles. A null or blank text has no shingles and is linked with nothing; equal texts are linked. Repeated rows each
    get their row; so do rows without a doc_id, whose component_id is null if no row of theirs has one. An empty table
    gives an empty one. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    bounds = Bounds(Fraction(threshold))
    docs = small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    told, taken = _named(docs, shingle_words, name_bits)
    entries = told.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(shuffle_partitions(spark), entries // PARTITION_ENTRIES)
    shared = _shared_columns(_columns(docs, shingle_words, buckets, name_bits, taken), buckets)
    postings = materialize(_postings(shared, bounds, buckets), "jaccard-postings")
    reps = materialize(told.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep")), "jaccard-reps")

    live = materialize(postings.select("sig").distinct().join(reps, "sig").select("rep", "sig"), "jaccard-live")
    few = live.count() <= BROADCAST_ROWS
    chosen = docs.join(F.broadcast(live) if few else live, docs.doc_id == live.rep, "left_semi").union(docs.where("doc_id is null"))

    def whole(piece: pa.RecordBatch) -> pa.RecordBatch:
        sets, _ = shingle_sets(piece.column("text"), shingle_words)
        sets = [s for s in sets if len(s)]
        return pa.RecordBatch.from_arrays([pa.array([signature(s, name_bits, taken)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sig", "items"])

    sets = materialize(map_slices(chosen, "text", whole, "sig long, items binary").dropDuplicates(["sig"]), "jaccard-sets")
    near = materialize(_close(sets, bounds), "jaccard-near")
    label = connected_components(near, "jaccard-first")

    named = materialize(postings.join(label, postings.sig == label.node, "left").select("tok", "sig", F.coalesce("label", "sig").alias("cls")), "jaccard-named")
    open_ = materialize(_open(named), "jaccard-open")
    links = _within(named, open_.where(F.col("m") <= BLOCK_ROWS), sets, bounds).unionByName(_across(named, open_.where(F.col("m") > BLOCK_ROWS), sets, bounds))
    edges = materialize(links.unionByName(label.select(F.col("node").alias("a"), F.col("label").alias("b"))), "jaccard-links")
    label = connected_components(edges, "jaccard-last")

    of_sig = reps.join(label, reps.sig == label.node, "left").select("sig", "rep", F.coalesce("label", "sig").alias("cls"))
    of_sig = materialize(of_sig, "jaccard-classes")
    smallest = materialize(of_sig.groupBy("cls").agg(F.min("rep").alias("component_id")), "jaccard-smallest")
    names = materialize(of_sig.join(smallest, "cls").select("sig", "component_id"), "jaccard-names")
    release(postings, live, sets, near, named, open_, edges, reps, label, of_sig, smallest)
    return told.join(names, "sig", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, shingle_words: int = 5, threshold: Fraction | str = "0.8") -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, rows without one coming last.

    Rows whose text is null or blank all stay. Columns are as before; an empty table gives an empty one.
    """
    return first_of_groups(docs, lambda rows: jaccard_components(rows, shingle_words, threshold).select("doc_id", F.col("component_id").alias("label")), "jaccard")
