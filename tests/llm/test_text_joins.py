"""Decontamination, n-gram Jaccard join, license and secret scans against brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import pytest
import tiktoken

from .conftest import LOW, awkward_rows

pytest.importorskip("boutworks.llm")

from boutworks.llm import license_scan as licenses  # noqa: E402
from boutworks.llm import ngram_jaccard, secret_scan  # noqa: E402
from boutworks.llm.components import connected_components  # noqa: E402
from boutworks.llm.decontaminate import decontamination  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def brute_hits(docs, items, window=13):
    wins = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOW))
        for s in range(max(1, len(w) - window + 1)) if w else ():
            wins.setdefault(tuple(w[s : s + window]), set()).add(str(item))
    sizes = {len(x) for x in wins}
    out = []
    for doc_id, text in docs:
        w = WORD.findall((text or "").translate(LOW))
        hit, names = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit.update(range(s, s + n))
                    names |= wins[tuple(w[s : s + n])]
        told = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), told, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def got_hits(df):
    return sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


@pytest.mark.parametrize("block_bytes", [16 << 20, 300])
def test_decontamination_is_brute_force(spark, awkward, monkeypatch, block_bytes):
    from boutworks.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    rows = [(r[0], r[1]) for r in awkward_rows()]
    long = rows[14][1].split()
    items = [(1, " ".join(long[5:40])), (2, None), (3, ""), (4, "one two"), (5, "ALPHA"), (10, " ".join(long[100:])), (11, "never seen words stand here at all but they are thirteen of them"), (12, rows[14][1]), (12, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got_hits(decontamination(awkward, bench)) == brute_hits(rows, items)
    assert got_hits(decontamination(awkward, bench.limit(0))) == brute_hits(rows, [])
    assert decontamination(awkward.limit(0), bench).count() == 0


def test_decontamination_on_the_tables(spark, small):
    docs, bench = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got_hits(decontamination(docs, bench)) == want
    assert any(r[5] for r in want)


def shingles(text, k):
    w = SPACED.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


@pytest.mark.parametrize(("few_rows", "block_rows", "name_bits"), [(8, 192, 64), (1, 4, 9), (0, 2, 64)])
def test_jaccard_components_are_brute_force(spark, awkward, monkeypatch, few_rows, block_rows, name_bits):
    monkeypatch.setattr(ngram_jaccard, "FEW_ROWS", few_rows)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_ROWS", block_rows)
    got = sorted(tuple(r) for r in ngram_jaccard.jaccard_components(awkward, 4, "0.85", name_bits).collect())
    assert got == brute_components([(r[0], r[1]) for r in awkward_rows()], 4, 85, 100)


def test_jaccard_keeps_repeated_rows_and_empty_tables(spark, awkward):
    assert ngram_jaccard.jaccard_components(awkward.limit(0)).count() == 0
    twice = awkward.where("doc_id < 30").union(awkward.where("doc_id < 30"))
    assert ngram_jaccard.jaccard_components(twice).count() == twice.count()


def test_jaccard_of_rows_without_a_doc_id(spark):
    base = [f"w{i}" for i in range(60)]
    near, far = [*base[:-1], "x"], [f"v{i}" for i in range(60)]
    rows = [(None, " ".join(base)), (9, " ".join(near)), (5, " ".join(far)), (None, " ".join([*far, "y"])), (None, "alone"), (None, None)]
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, "0.85").collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == sorted([(None, 9), (9, 9), (5, 5), (None, 5), (None, None), (None, None)], key=repr)


def thue_morse(n: int, a: str, b: str) -> str:
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


def test_words_that_clash_under_polynomial_hashes_stay_apart(spark):
    words = [thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    assert sorted(r.component_id for r in ngram_jaccard.jaccard_components(docs).collect()) == [0, 1]
    items = spark.createDataFrame([("i", words[0])], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in decontamination(docs, items).collect()} == {0: 1, 1: 0}
    licensed = licenses.license_scan(docs, templates=(("own", words[0], ""),))
    assert {r.doc_id: r.labels for r in licensed.collect()} == {0: "own", 1: ""}


def test_words_are_compared_to_their_last_byte():
    import numpy as np
    import pyarrow as pa

    from boutworks.llm._text import LOWER, WORDLIKE, buffer, same_words, word_hashes, word_spans

    rng = random.Random(1)
    words = ["a" * n for n in (1, 7, 8, 9, 16, 17, 5000)]
    words += [w[:-1] + "b" for w in words] + ["".join(rng.choices("abAB1", k=rng.randrange(1, 30))) for _ in range(500)]
    raw, off = buffer(pa.array([" ".join(words)]))
    starts, ends, _ = word_spans(raw, off, WORDLIKE)
    hashes, low = word_hashes(raw, starts, ends), LOWER[raw]
    i, j = np.random.default_rng(0).integers(0, len(words), (2, 20000))
    want = np.array([words[a].lower() == words[b].lower() for a, b in zip(i, j, strict=True)])
    assert (same_words(low, starts[i], ends[i], low, starts[j], ends[j]) == want).all()
    assert ((hashes[i] == hashes[j]) == want).all()


def test_items_with_odd_ids(spark):
    docs = spark.createDataFrame([(1, "one two three"), (None, "four five six"), (3, "seven eight"), (3, "seven eight")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two"), (None, "two three"), ("", "one two"), ("a\nb", "four five"), ("z", None), ("q", "seven")], "item_id string, text string")
    got = sorted(((r.doc_id, r.n_hit, r.n_items, r.items, r.items_sha256) for r in decontamination(docs, items).collect()), key=repr)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted([(1, 3, 2, [""], digest("")), (None, 2, 1, ["a\nb"], digest("a\nb")), (3, 1, 1, ["q"], digest("q")), (3, 1, 1, ["q"], digest("q"))], key=repr)


def test_components_of_a_chain(spark):
    nodes = list(range(60))
    random.Random(3).shuffle(nodes)
    edges = [*zip(nodes, nodes[1:], strict=False), (100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(60)} | {100: 100, 101: 100}


def brute_license(text):
    w = WORD.findall((text or "").translate(LOW))
    places = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(s, label) for s in range(len(w) - len(p) + 1) if w[s : s + len(p)] == p]
    labels = {x for _, x in places}
    best = 0.0
    more = set(labels)
    for label, template, name in licenses.TEMPLATES:
        t, n = template.split(), name.split()
        for s in range(max(1, len(w) - len(t) + 1)):
            block = w[s : s + len(t)]
            share = len(set(block) & set(t)) / len(set(t))
            if share >= 0.8 and any(block[i : i + len(n)] == n for i in range(len(block) - len(n) + 1)):
                more.add(label)
                best = max(best, share)
    at = [s for s, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), 1.0 if places else best


def test_license_scan_is_brute_force(spark, awkward, small):
    extra = [(9001, "x\nReleased under the MIT License.\n\nAll rights RESERVED"), (9002, "CC\nBY and mit license apache license mit license"), (9003, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"), (9004, "license")]
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).union(spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 100000", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = licenses.license_scan(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == pytest.approx(brute_license(texts[r.doc_id])), r.doc_id
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_license_scan_tells_licenses_apart(spark):
    texts = {
        "This work is licensed under the GNU General Public License version 3": "gpl",
        "This work is licensed under the GNU Affero General Public License version 3": "agpl",
        "Licensed under the GNU Lesser General Public License, version 2.1": "lgpl",
        "Licensed under CC BY 4.0": "cc-by",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",  # the phrase of the contract stands in it
        "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa",
        "Released under the BSD license": "",
        "we released it under pressure and the driver lost the license": "",
        "Released under the Apache License": "apache",
        "a b released under the terms of the MIT License": "mit",
    }
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "Released under the MIT License")], "doc_id int, text string")
    got = {r.doc_id: r.labels for r in licenses.license_scan(docs.union(docs)).collect()}
    assert got == dict(enumerate(texts.values())) | {None: "mit"}
    for label, text, name in licenses.TEMPLATES:
        assert f" {name} " in f" {text} " or not name, label


def test_license_scan_finds_wrapped_licenses(spark):
    texts = {
        1: ("mit", "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the Software)"),
        2: ("bsd", "x\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"),
        3: ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided"),
        4: ("", "Permission is hereby granted, free of charge, to any person obtaining a copy\n" + "other " * 30 + "\nof this software and associated documentation files"),
    }
    docs = spark.createDataFrame([(i, t) for i, (_, t) in texts.items()] + [(5, "Permission is hereby granted, free of charge, to any person"), (6, "obtaining a copy of this software and associated documentation files")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.labels, r.score) for r in licenses.license_scan(docs).collect()}
    assert got == {i: (label, 1.0 if label else 0.0) for i, (label, _) in texts.items()} | {5: ("", 0.0), 6: ("", 0.0)}


def test_secret_scan(spark, awkward):
    import public_tokenizers

    key = "sk" + "Q7x2Lr9VbT4mZp0KdW8f" + "Hj3N"
    texts = [
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x',
        "PASSWORD:token:abcdefgh12 api-key=12345678 API_KEY: 'abc' apikey=abcdefgh",
        "AKIA0123456789AB AKIA01234567 xAKIAAKIAAKIAAKIA",
        "é" * 5 + "0" * 32 + " " + "a" * 31,
        f"use {key} now",
        "/usr/share/applications/python3/organization and some_long_identifier_name_42",
        "6f9619ff-8b86-d011-b42d-00c04fc964ff",
        "paſſword=abcdefgh1 toKen=abcdefgh1",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in secret_scan.secret_scan(docs, str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN).collect()}
    spans = {i: r.spans for i, r in rows.items()}
    assert spans[0] == "assign:0:49,hex:9:49"
    assert (rows[1].n_assign, spans[1]) == (1, "assign:58:73")
    assert spans[2] == "access:0:16,access:31:47"
    assert spans[3] == "hex:5:37"
    assert spans[4] == f"random:4:{4 + len(key)}"
    assert spans[5] == spans[6] == ""
    assert rows[0].base_sha256 == hashlib.sha256(b"assign:0:49,hex:9:49").hexdigest()
    scanned = secret_scan.secret_scan(awkward, str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    assert scanned.count() == awkward.count()


def brute_spans(text, tokens):
    """The contract's patterns and the ratio test, by scanning."""
    import regex

    found = [(m.start(), 0, m.end()) for m in regex.finditer(r"""(?a)(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]

    def runs(letters, opening, least):
        at = 0
        while at < len(text):
            if text.startswith(opening, at) and text[at] in letters:
                end = at + len(opening)
                while end < len(text) and text[end] in letters:
                    end += 1
                if end - at >= max(least, len(opening) + 1):
                    yield at, end
                    at = end
                    continue
                at = end if not opening else at
            at += 1

    import string

    found += [(a, 1, b) for a, b in runs(string.ascii_uppercase + string.digits, "AKIA", 16)]
    found += [(a, 2, b) for a, b in runs("0123456789abcdef", "", 32)]
    found.sort()
    every = list(found)
    for a, b in runs(string.ascii_letters + string.digits + "+/_=-", "", 16):
        whole, parts, at = text[a:b], [], a
        while at < b:
            uuid = regex.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}").match(text, at)
            glued = uuid and (at > a and text[at - 1].isalnum() or uuid.end() < b and text[uuid.end()].isalnum())
            if uuid and not glued:
                parts.append((at, uuid.end(), True))
                at = uuid.end()
            elif text[at].isalnum():
                end = at
                while end < b and text[end].isalnum():
                    end += 1
                p, n = text[at:end], tokens(text[at:end])
                hexed = len(p) in (32, 40, 48, 56, 64, 96, 128) and (not set(p) - set("0123456789abcdef") or not set(p) - set("0123456789ABCDEF"))
                parts.append((at, end, p.isdigit() or hexed or n == 1 or len(p) >= 2 * n))
                at = end
            else:
                at += 1
        free = lambda x, y: all(q <= x or y <= p for p, _, q in found)
        if all(k for *_, k in parts):
            continue
        if free(a, b) and len(whole) < 2 * tokens(whole):
            every.append((a, 3, b))
            continue
        while parts:
            same = [parts[0]]
            while len(same) < len(parts) and parts[len(same)][2] == same[0][2]:
                same.append(parts[len(same)])
            x, y = same[0][0], same[-1][1]
            if not same[0][2] and y - x >= 16 and free(x, y) and y - x < 2 * tokens(text[x:y]):
                every.append((x, 3, y))
            parts = parts[len(same) :]
    told = lambda spans: ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return [sum(k == i for _, k, _ in found) for i in range(3)], told(found), told(every)


def test_secret_scan_is_brute_force(spark, awkward, small):
    import string

    import public_tokenizers

    rng = random.Random(11)
    bits = ["password=", "token: ", "API_KEY='", "secret", " ", "\n", "AKIA", "-", "_", "/", "é", "applications", "6f9619ff-8b86-d011-b42d-00c04fc964ff", "=", "+", "."]
    letters = [string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_uppercase + string.digits, string.digits]
    odd = ["".join(rng.choice(bits) if rng.random() < 0.5 else "".join(rng.choices(rng.choice(letters), k=rng.choice([3, 8, 17, 33, 40]))) for _ in range(12)) for _ in range(400)]
    docs = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    docs = docs.union(awkward.select("doc_id", "text")).union(spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id + 100000", "text"))
    path = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path).read().splitlines() if x)}
    encoding = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = lambda s: sum(len(encoding.encode_ordinary(s[i : i + 1000])) for i in range(0, len(s), 1000))
    rows = secret_scan.secret_scan(docs.union(docs.limit(3)), path, public_tokenizers.PATTERN).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == len(texts) + 3
    for r in rows:
        counts, base, every = brute_spans(texts[r.doc_id], tokens)
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256, r.spans) == (counts, hashlib.sha256(base.encode()).hexdigest(), every), texts[r.doc_id]
    assert any("random" in r.spans for r in rows)
    assert secret_scan.secret_scan(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_random_strings_meet_the_ratio_test_whatever_their_letters():
    import string
    from pathlib import Path

    import public_tokenizers

    efficiency = secret_scan.Efficiency(Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_text(), public_tokenizers.PATTERN)
    spans = lambda s: secret_scan.random_spans(s, [], efficiency, 2.0)
    rng = random.Random(5)
    for size in (16, 20, 24, 32, 40):
        for letters in (string.ascii_letters + string.digits, string.ascii_letters):
            found = sum(bool(spans("".join(rng.choices(letters, k=size)))) for _ in range(300))
            assert found >= 290, (size, letters)
    hidden = "Q7x2Lr9VbT4mZp0KdW8fHj3N"
    glued = "/usr/share/applications/organization/configuration/documentation/" + hidden + "/international_information"
    assert [glued[a:b] for a, b, _ in spans(glued)] == [hidden]
    for known in ("/usr/share/applications/python3/organization", "some_long_identifier_name_42", "a/b/c/d/e/f/g/h/i/j", "internationalization", "2024-01-01-12-30-59-000", "commit/04dbebab91ab85687d33eeaaf9ac699e1188f962", "id=6f9619ff-8b86-d011-b42d-00c04fc964ff", "=-" * 20):
        assert not spans(known), known
    assert spans("x" * 70000) == []
