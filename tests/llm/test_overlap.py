import random
import re

import numpy as np
from pyspark.sql import functions as F

from mathloom.llm import bloom, kernels, overlap

WORD = re.compile(r"[^\W_]+")


def words(t):
    return WORD.findall((t or "").lower())


def grams(t):
    w = words(t)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def test_pairs_equal_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 60))) for _ in range(60)]

    def edit(t, n):
        w = t.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        return " ".join(w)

    left = [(f"L-{i}", edit(t, rng.randrange(4)), "valid" if i % 2 else None) for i, t in enumerate(base)] + [("x 1", "one two", "test"), (None, None, "test"), ("--", "", "test"), ("L-1", "...", "test")]
    right = [(f"r{i}", edit(t, rng.randrange(4)).upper(), "a") for i, t in enumerate(base)] + [("X1", "ONE, two!", None), ("X-1", "quite different", "b"), (None, base[0], "b"), ("r0", base[0], "b")]
    schema = "id string, question string, part string, row_no long"
    a = spark.createDataFrame([(*x, n) for n, x in enumerate(left)], schema)
    b = spark.createDataFrame([(*x, 1000 + n) for n, x in enumerate(right)], schema)
    clean = lambda i: re.sub("[^A-Za-z0-9]", "", i or "").upper()
    expected = set()
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            p, q = grams(x[1]), grams(y[1])
            if (clean(x[0]) and clean(x[0]) == clean(y[0])) or (words(x[1]) and words(x[1]) == words(y[1])) or (p | q and len(p & q) >= 0.6 * len(p | q)):
                expected.add((i, 1000 + j))
    key = F.upper(F.regexp_replace("id", "[^A-Za-z0-9]", ""))
    found = overlap.split_overlaps(a, b, key=key)
    assert {(r.left_row, r.right_row) for r in found.collect()} == expected
    table = overlap.report(found, a, b.withColumnRenamed("part", "source"), "part", "source").collect()
    assert sum(r.pairs for r in table) == len(expected)
    assert overlap.split_overlaps(a.limit(0), b, key=key).collect() == []
    # Frequent segments are spread: the same pairs.
    spread = overlap.split_overlaps(a, b, key=key, hot_rows=1)
    assert {(r.left_row, r.right_row) for r in spread.collect()} == expected


def test_codes_of_similar_texts_are_within_the_radius():
    rng = random.Random(3)
    texts, other, share = [], [], []
    for _ in range(300):
        w = [f"w{rng.randrange(5000)}" for _ in range(80)]
        v = w[:]
        for _ in range(rng.randrange(9)):
            v[rng.randrange(len(v))] = f"e{rng.randrange(900)}"
        texts.append(" ".join(w))
        other.append(" ".join(v))
        p, q = grams(texts[-1]), grams(other[-1])
        share.append(len(p & q) / len(p | q))
    a, b = (overlap.fingerprints(kernels.words(t)) for t in (texts, other))
    far = overlap.hamming(a, b)
    near = np.array(share) >= 0.6
    assert near.sum() > 50 and (far[near] <= overlap.radius(0.6)).all()
    meet = (overlap.segments(a) == overlap.segments(b)).any(axis=1)
    assert meet[near].all()
    assert (overlap.hamming(a[1:], b[:-1]) > overlap.radius(0.6)).all()


def test_filter_keeps_what_was_put_in(spark):
    rng = np.random.default_rng(4)
    inside, outside = (kernels.mix64(rng.integers(0, 2**62, 3000).astype(np.uint64)) for _ in range(2))
    df = spark.createDataFrame([(int(x),) for x in inside.view(np.int64)], "h long")
    words = bloom.build(df, "h")
    assert bloom.contains(words, inside).all() and bloom.contains(words, outside).mean() < 0.01
    assert not bloom.contains(bloom.build(df.limit(0), "h"), inside).any()
