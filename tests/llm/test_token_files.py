"""Token files, packing and exact dedup: exact round trips and brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from .conftest import awkward_rows

pytest.importorskip("boutworks.llm")

from boutworks.llm import packing, token_binary  # noqa: E402
from boutworks.llm.exact_dedup import exact_groups  # noqa: E402
from boutworks.llm.queries import word_tokenizer  # noqa: E402


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_byte_aligned_code():
    values = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 5], np.uint32)
    for n in range(len(values) + 1):
        control, data = token_binary.encode_block(values[:n])
        assert len(control) == -(-n // 4)
        assert token_binary.decode_block(control, data, n).tolist() == values[:n].tolist()


def test_token_files_round_trip(spark, awkward, library):
    got = [tuple(r) for r in token_binary.token_files(awkward, word_tokenizer(), 2).orderBy("doc_id").collect()]
    want, at = [], 0
    for r in sorted(awkward_rows()):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    assert token_binary.token_files(awkward.limit(0), word_tokenizer(), 2).count() == 0


def test_token_files_are_in_order(spark, awkward, library, tmp_path):
    """Files by name, and blocks in them, ascend by doc_id; rows without one come first; repeated rows stay."""
    import glob

    import pyarrow.parquet as pq

    rows = [(2**60 + 1, "one two"), (None, "three"), (None, "four five six"), (2**60, "seven"), (5, None), (5, "eight"), (5, "eight"), (-3, "nine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(awkward.select("doc_id", "text")).repartition(5)
    path = str(tmp_path / "files")
    token_binary.write_token_files(docs, path, word_tokenizer(), 2)
    starts, ids = [], []
    for file in sorted(glob.glob(f"{path}/blocks/*.parquet")):
        for block in pq.read_table(file).to_pylist():
            starts.append(block["start"])
            ids += block["doc_ids"]
    assert starts == sorted(starts)
    assert ids == sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i or 0))
    got = token_binary.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == ids
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]
    want = Counter((i, crc([*library.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in docs.collect())
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want


def test_ids_of_odd_strings(library):
    """The shortcuts for plain words give the library's ids."""
    import random
    from pathlib import Path

    import pyarrow as pa

    from boutworks.llm.tokenize import WordTokenizer

    rng = random.Random(3)
    signs = "aAbzZéÉßÿÀ×÷ñ09'’.,;-_/ \n\t\r\x0b\x1c\x85\xa0\u2009日本語😀ﬁ½İı\u0301<|>endoftext'stdllre"
    texts = ["".join(rng.choices(signs, k=rng.randrange(0, 40))) for _ in range(3000)] + ["<|endoftext|>x", "it's WE'LL x'Re", "a" * 200]
    ids, off = WordTokenizer(Path(word_tokenizer()).read_text()).encode(pa.array([*texts, None]))
    for i, text in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert off[-1] == off[-2]


def test_packing_of_equal_and_odd_rows(spark, library):
    rows = [(i, "one two three four five six seven eight nine") for i in range(3000)] + [(None, "one"), (None, None), (7, "again"), (7, "again")]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), word_tokenizer()).collect()
    assert Counter(r.doc_id for r in packed) == Counter(i for i, _ in rows)
    length = Counter(r.length for r in packed).most_common(1)[0][0]
    least = -(-3000 // (2048 // length))
    assert len({r.sequence_id for r in packed}) <= 1.05 * least
    spots = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    for (s, a, n), (t, b, _) in zip(spots, spots[1:], strict=False):
        assert b == (a + n if s == t else 0)


def test_packing(spark, awkward, library):
    rows = packing.pack(awkward, word_tokenizer(), 1, 256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, text, *_ in awkward_rows():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc.pop(doc_id), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert not by_doc
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    used = sum(r.length for r in rows)
    assert used / (256 * len(by_sequence)) > 0.95
    assert packing.pack(awkward.limit(0), word_tokenizer()).count() == 0


def test_pack_histogram_places_each_length_as_often():
    histogram = {2048: 5, 1500: 3, 700: 9, 548: 4, 30: 100, 1: 7}
    placed = Counter()
    for count, pattern in packing.pack_histogram(histogram, 2048):
        assert sum(pattern) <= 2048
        for length in pattern:
            placed[length] += count
    assert placed == Counter(histogram)


def test_pack_histogram_puts_copies_of_one_length_together():
    assert sum(count for count, _ in packing.pack_histogram({100: 1000}, 2048)) == 50
    rest = {length: 1 for length in range(1, 2049, 7)}
    histogram = rest | {60: 3000}
    used = sum(length * n for length, n in histogram.items())
    assert used / (2048 * sum(count for count, _ in packing.pack_histogram(histogram, 2048))) > 0.97


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_groups_are_brute_force(spark, awkward, bits):
    rows = [(r[0], re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")) for r in awkward_rows()]
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text].append(doc_id)
    want = sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert sorted(tuple(r) for r in exact_groups(awkward, bits).collect()) == want


def test_exact_groups_keep_rows_without_a_doc_id(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a  b"), (7, "a b"), (8, "a b"), (None, "c")], "doc_id long, text string")
    rows = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(docs).collect()]
    assert sorted(rows, key=repr) == sorted([(None, 7, 4, None), (None, 7, 4, None), (7, 7, 4, True), (8, 7, 4, False), (None, None, 1, None)], key=repr)


def test_exact_groups_of_many_copies(spark):
    """Hundreds of copies, so that several share a salted list."""
    docs = spark.range(700).selectExpr("id as doc_id", "case when id % 7 = 0 then 'odd ' || id else 'the  same\\ntext' end as text")
    rows = exact_groups(docs).collect()
    assert {(r.keep_id, r.group_size) for r in rows if r.doc_id % 7} == {(1, 600)}
    assert all(r.group_size == 1 for r in rows if r.doc_id % 7 == 0)
    assert sum(r.kept for r in rows) == 101


def test_exact_groups_of_repeated_rows(spark, awkward):
    once = awkward.where("doc_id < 40")
    got = exact_groups(once.union(once)).collect()
    assert len(got) == 2 * once.count()
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert exact_groups(awkward.limit(0)).count() == 0
