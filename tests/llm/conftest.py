"""Documents with every awkward case: nulls, blanks, copies, ties, long texts, clashing column names."""

from __future__ import annotations

import random

import pytest

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words_of(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "of", "Alpha", "beta", "gamma", "delta", "été", "x1", "zu", "licht", "rough", "stone"]) + rng.choice(["", "", ",", "."]) for _ in range(n))


def awkward_rows() -> list[tuple]:
    rng = random.Random(7)
    texts: list[str | None] = [None, "", " ", "\n\t", "one", "One", "one two", "one  two", "one\ntwo\t", "a b c", "A B C d", "😀 日本 ok", "It's <|endoftext|> here", "é̂ ﬁ ½ İ"]
    base = words_of(rng, 120)
    texts += [base, base, base.replace(" ", "  ", 3), base.upper()]
    for _ in range(30):
        w = base.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(9)}"
        texts.append(" ".join(w))
    texts += [words_of(rng, rng.randrange(1, 300)) for _ in range(40)]
    texts.append(words_of(rng, 30000))
    texts.append("x" * 70000)
    rows = [(i * 3 + 1, t, None if i % 7 == 0 else rng.choice(["en", "de"]), "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("sig", "part", "rank", "label", "size", "key", "n", "start", "length"):  # names that operators use inside
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
