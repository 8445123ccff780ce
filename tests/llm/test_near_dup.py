import random
import re

import numpy as np

from mathloom.llm import near_dup

WORD = re.compile(r"[^\W_]+")


def words(t):
    return tuple(WORD.findall((t or "").lower()))


def grams(t, k):
    w = words(t)
    return {w[i : i + k] for i in range(len(w) - k + 1)}


def corpus(rng, families, size):
    out = []
    for f in range(families):
        w = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(30, 60))]
        for _ in range(size):
            v = w[:]
            for _ in range(rng.randrange(3)):
                v[rng.randrange(len(v))] = f"e{rng.randrange(90)}"
            out.append(" ".join(v))
    return out


def brute(texts, least, k, least_words):
    found = set()
    sets = [grams(t, k) for t in texts]
    for i, a in enumerate(texts):
        for j in range(i + 1, len(texts)):
            if min(len(words(a)), len(words(texts[j]))) < max(least_words, k) or words(a) == words(texts[j]):
                continue
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
                found.add((i, j))
    return found


def test_pairs_equal_brute_force_in_leaves_and_large_trees(spark):
    rng = random.Random(10)
    texts = corpus(rng, 20, 6) + corpus(rng, 1, 60) + [None, "", "short one", "w1 " * 3000]
    texts += [texts[0].upper() + "!", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").selectExpr("*", "1 as seq", "2 as key")
    expected = brute(texts, 0.6, 3, 30)
    for leaf, subtree, hot in ((128, 1024, 64), (2, 8, 64), (32, 8, 4)):
        got = near_dup.near_pairs(df, 0.6, 3, 30, leaf, subtree, hot).collect()
        assert {(r.row_a, r.row_b) for r in got} == expected and len(got) == len(expected)
    assert {(r.row_a, r.row_b) for r in near_dup.near_pairs(df).collect()} == brute(texts, 0.8, 5, 0)
    assert near_dup.near_pairs(df.limit(0), 0.6, 3).collect() == []


def test_links_come_from_trees_of_every_size(spark, monkeypatch):
    """Links by path: of trees traversed where their texts meet, and of trees cut into subtrees."""
    from fractions import Fraction

    monkeypatch.setattr(near_dup, "UPPER_FAN", 2)
    rng = random.Random(13)
    texts = corpus(rng, 12, 4) + corpus(rng, 1, 90)
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    expected = brute(texts, 0.6, 3, 30)
    hot = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    postings = near_dup._postings(df, 3, 30, Fraction(3, 5), hot).repartition("key", "salt").sortWithinPartitions("key")
    found = near_dup._trees(postings, 32, Fraction(3, 5)).collect()
    small = {(r.a, r.b) for r in found if r.kind == 0}
    members = {(r.a, r.b) for r in found if r.kind == 1}
    # Bitmaps prune: few candidates of small trees are no links.
    assert 12 * 3 <= len(small) <= 2 * len(expected) and len(members) > 33
    assert all(r.size > 0 for r in found if r.kind == 1)
    got = near_dup.near_pairs(df, 0.6, 3, 30, 32, 8).collect()
    assert {(r.row_a, r.row_b) for r in got} == expected and len(got) == len(expected)


def test_groups_are_the_connected_texts(spark):
    rng = random.Random(11)
    w = [f"w{i}" for i in range(40)]
    chain = []
    for i in range(9):
        w = w[:]
        w[4 * i] = f"c{i}"
        chain.append(" ".join(w))
    texts = chain + corpus(rng, 4, 3) + [chain[0], "tiny", None]
    pairs = brute(texts, 0.6, 3, 30)
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(words(texts[i])) >= 30 and words(texts[i]) == words(texts[j]):
                pairs.add((j, i))
    for _ in texts:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = {r.row: r.group for r in near_dup.near_groups(df, 0.6, 3, 30).collect()}
    assert got == {i: label[i] for i, t in enumerate(texts) if len(words(t)) >= 30}


def test_groups_of_long_chains_are_whole(spark):
    w = [f"w{i}" for i in range(40)]
    chain = []
    for i in range(120):
        w = w[:]
        w[4 * i % 36 + 2] = f"c{i}"
        chain.append(" ".join(w))
    # Row numbers rise and then fall along the chain.
    order = [*range(0, 120, 2), *range(119, 0, -2)]
    df = spark.createDataFrame(list(zip(order, chain)), "row long, text string")
    pairs = near_dup.near_pairs(df, 0.8, 3, 30)
    assert pairs.count() == 119
    assert {(r.row, r.group) for r in near_dup.near_groups(df, 0.8, 3, 30).collect()} == {(i, 0) for i in range(120)}


def test_dual_traversal_loses_no_pair():
    from fractions import Fraction

    rng = np.random.default_rng(12)
    tokens = [set(rng.integers(0, 250, 40).tolist()) for _ in range(30)]
    sets = [s if i % 2 else (tokens[i // 2] | {999 + i}) for i, s in enumerate(tokens * 2)]
    bits = np.zeros((len(sets), 4), dtype=np.uint64)
    for i, s in enumerate(sets):
        for t in s:
            b = hash((t, 7)) % 256
            bits[i, b // 64] |= np.uint64(1) << np.uint64(b % 64)
    sizes = np.array([len(s) for s in sets])
    forest = near_dup.SignatureForest(bits, sizes, np.array([0]))
    assert forest.height == 2 and len(forest.levels[2][0]) == 1
    root = np.array([0])
    a, b = near_dup.dual_traversal(forest, forest, root, root, Fraction(3, 5), most=50)
    assert (a != b).all()
    got = set(zip(a.tolist(), b.tolist())) | set(zip(b.tolist(), a.tolist())) | {(i, i) for i in range(len(sets))}
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if len(x & y) >= 0.6 * len(x | y):
                assert (i, j) in got
    assert len(got) < len(sets) ** 2


def test_few_pairs_at_the_limit_are_missed():
    for least in (0.5, 0.6, 0.8, 0.9):
        keys, minima = near_dup.plan(least)
        assert (1 - least**minima) ** keys <= 0.0002
