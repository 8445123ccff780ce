"""Near-duplicate records with small edits (problem 3).

A forest of signature trees.  A tree's root is a key: the joined minima of a few hash functions
over a text's word sequences.  Texts enter the trees of all their keys with their signature, a
bitmap of their sequences and their number, and two texts meet in a tree with a probability that
depends on their similarity alone (``plan``).

The nodes of every tree, of two texts or of millions, hold the OR-combined bitmaps of their texts
and the range of their sizes; pairs of nodes are traversed together from the roots down and
dropped as soon as the largest overlap any two members could have is too small.  Trees up to
``LEAF`` texts are traversed where their texts meet, all trees of a batch at once.  Larger ones are
cut into subtrees, whose pairs are found by the same traversal over tables and traversed by
different tasks.  Surviving pairs are verified on the texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mathloom.llm import kernels
from mathloom.scratch import free, stage

_U = np.uint64
#: Texts of a tree that is traversed where its texts meet, and of a subtree of a larger one.
LEAF, SUBTREE = 128, 1024
#: Words of 64 bits of a signature.
BITMAP = 2
#: Children of a node.
FAN_OUT = 8
#: Subtrees of a node of the upper levels of a large tree.
UPPER_FAN = 64
#: Texts whose keys are counted to plan the partitions; no result depends on them.
PLAN_TEXTS = 8_192
#: A key is spread over several tasks if this many of the counted texts have it.
HOT_TEXTS = 16
#: Row numbers up to this many are broadcast (8 bytes each).
BROADCAST_ROWS = 200_000
_BITS = [f"s{i}" for i in range(BITMAP)]


def _least(share: Fraction, n: np.ndarray) -> np.ndarray:
    """Smallest whole number that is at least ``share`` of n."""
    return -((-share.numerator * n) // share.denominator)


def plan(least: float, miss: float = 0.0002) -> tuple[int, int]:
    """(keys of a text, minima of a key): pairs just at the limit are missed at most that often.

    For a limit of 0.6: 36 keys of 3 minima; a pair of similarity 0.6 is missed once in 6,000, one
    of 0.65 once in 100,000, one of 0.7 once in 3 million.
    """
    minima = 1
    while least < 1 and least**minima > 0.22:
        minima += 1
    agree = least**minima
    return (1 if agree >= 1 else math.ceil(math.log(miss) / math.log(1 - agree))), minima


def tree_keys(w: kernels.Words, k: int, keys: int, minima: int, chosen: np.ndarray) -> np.ndarray:
    """Keys of the chosen texts, one row each; every chosen text has at least k words."""
    grams, offsets = kernels.ngrams(w, k)
    sizes = np.diff(offsets)
    use = np.zeros(len(sizes), dtype=bool)
    use[chosen] = True
    grams = grams[np.repeat(use, sizes)]
    out = np.empty((len(chosen), keys), dtype=_U)
    if not len(chosen):
        return out
    start = np.concatenate(([0], np.cumsum(sizes[use])[:-1]))
    factors = np.random.default_rng(3).integers(1, 2**62, (keys, minima)).astype(_U) * _U(2) + _U(1)
    product = np.empty_like(grams)
    for i in range(keys):
        key = np.full(len(chosen), i, dtype=_U)
        for f in factors[i]:
            np.multiply(grams, f, out=product)
            key = kernels.mix64(key * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(product, start))
        out[:, i] = key
    return out


def _bitmaps(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A signature per text: each distinct sequence sets one bit."""
    n = len(offsets) - 1
    bits = np.zeros((n, BITMAP), dtype=_U)
    place = (kernels.mix64(grams) >> _U(40)) % _U(64 * BITMAP)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    np.bitwise_or.at(bits, (owner, (place >> _U(6)).astype(np.int64)), _U(1) << (place & _U(63)))
    return bits


def _members(texts: DataFrame, k: int, least_words: int, share: Fraction) -> DataFrame:
    """(row, seq) of the texts long enough, and (key, seq) of the few whose keys are counted."""
    keys, minima = plan(float(share))
    every = max(1, texts.count() // PLAN_TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = batch.column(1).to_pylist()
            for lo, hi in kernels.chunks(strings):
                w = kernels.words(strings[lo:hi])
                seq = kernels.sequence_hash(w)
                good = np.flatnonzero(w.counts >= max(least_words, k))
                own = seq.view(np.int64)
                none = pa.nulls(len(good), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good + lo)), pa.array(own[good]), none], ["row", "seq", "key"])
                counted = good[seq[good] % _U(every) == 0]
                if len(counted):
                    found = tree_keys(w, k, keys, minima, counted).ravel().view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.int64()), pa.array(np.repeat(own[counted], keys)), pa.array(found)], ["row", "seq", "key"])

    return texts.mapInArrow(run, "row bigint, seq bigint, key bigint")


def _hot(counted: DataFrame, hot_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of many texts, ascending, and how many parts each is spread over.

    At most the number of counted keys divided by ``hot_texts`` of them: some 40,000 at a limit of 0.6.
    """
    found = counted.groupBy("key").agg(F.count_distinct("seq").alias("n")).where(F.col("n") >= hot_texts).orderBy("key").collect()
    keys, n = np.array([r[0] for r in found], dtype=np.int64), np.array([r[1] for r in found], dtype=np.int64)
    return keys, np.ceil(n / hot_texts).astype(np.int64)


_POSTING = "key bigint, salt int, seq bigint, size int, " + ", ".join(f"{n} bigint" for n in _BITS)


def _postings(texts: DataFrame, k: int, least_words: int, share: Fraction, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Each text with its signature under its keys; copies within a task only once.

    ``salt`` is -1, or the part of a key that is spread.
    """
    keys, minima = plan(float(share))
    sent = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        names, parts = sent.value
        for batch in batches:
            strings = batch.column(1).to_pylist()
            for lo, hi in kernels.chunks(strings):
                w = kernels.words(strings[lo:hi])
                seq = kernels.sequence_hash(w).view(np.int64)
                fresh = []
                for i in np.flatnonzero(w.counts >= max(least_words, k)).tolist():
                    x = int(seq[i])
                    if x not in seen:
                        seen.add(x)
                        fresh.append(i)
                if not fresh:
                    continue
                chosen = np.array(fresh, dtype=np.int64)
                key = tree_keys(w, k, keys, minima, chosen).ravel().view(np.int64)
                own = np.repeat(seq[chosen], keys)
                salt = np.full(len(key), -1, dtype=np.int32)
                if len(names):
                    at = np.minimum(np.searchsorted(names, key), len(names) - 1)
                    spread = names[at] == key
                    salt[spread] = (own.view(_U)[spread] >> _U(20)) % parts[at[spread]].astype(_U)
                grams, offsets = kernels.distinct_ngrams(w, k)
                bits, size = _bitmaps(grams, offsets)[chosen], np.diff(offsets)[chosen].astype(np.int32)
                cols = [key, salt, own, np.repeat(size, keys), *(np.repeat(bits[:, i].view(np.int64), keys) for i in range(BITMAP))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "salt", "seq", "size", *_BITS])

    return texts.mapInArrow(run, _POSTING)


def _least_overlap(share: Fraction, sizes: np.ndarray) -> np.ndarray:
    return _least(share / (1 + share), sizes)


class SignatureForest:
    """Signature trees over one array of texts, level by level.

    A node has the OR of its texts' bitmaps, their size range, the largest slack and the range of
    its children.  Slack is how many sequences of a text share a bit with another one: the overlap
    of two texts is at most the bits both bitmaps have plus the smaller slack.  ``starts``: where
    each tree's texts begin.  All trees are given the height of the largest.
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, starts: np.ndarray, height: int = 1):
        slack = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        none = np.zeros(0, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, slack, none, none)]
        bounds = np.append(starts, len(sizes))
        while len(self.levels) <= height or len(self.levels[-1][0]) > len(starts):
            b, low, high, free, _, _ = self.levels[-1]
            count = np.diff(bounds)
            nodes = -(-count // FAN_OUT)
            place = np.arange(int(nodes.sum())) - np.repeat(np.cumsum(nodes) - nodes, nodes)
            at = np.repeat(bounds[:-1], nodes) + place * FAN_OUT
            end = np.minimum(at + FAN_OUT, np.repeat(bounds[1:], nodes))
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(free, at), at, end))
            bounds = np.concatenate(([0], np.cumsum(nodes)))

    @property
    def height(self) -> int:
        return len(self.levels) - 1


def possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, share: Fraction) -> np.ndarray:
    """Whether members of nodes i and j could be similar enough."""
    common = np.bitwise_count(a[0][i] & b[0][j]).sum(axis=1, dtype=np.int64) + np.minimum(a[3][i], b[3][j])
    n, d = share.numerator, share.denominator
    return (common >= _least_overlap(share, a[1][i] + b[1][j])) & (d * a[2][i] >= n * b[1][j]) & (d * b[2][j] >= n * a[1][i])


def dual_traversal(x: SignatureForest, y: SignatureForest, i: np.ndarray, j: np.ndarray, share: Fraction, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Texts of the trees i of ``x`` and j of ``y``, pair by pair, that may be similar.

    Pairs of nodes are opened together, from the roots down.  Of a forest with itself each pair of
    texts comes once, and none with itself.  At most ``most`` pairs are opened at a time.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    work = [(x.height, i, j)]
    while work:
        level, i, j = work.pop()
        a, b = x.levels[level], y.levels[level]
        good = possible(a, i, b, j, share)
        if x is y:
            good &= (i < j) if level == 0 else (i <= j)
        i, j = i[good], j[good]
        if not len(i):
            continue
        if level == 0:
            found.append((i, j))
            continue
        n, m = a[5][i] - a[4][i], b[5][j] - b[4][j]
        size = n * m
        cut = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(size) // most)))) if size.sum() > most else np.zeros(0, dtype=np.int64)
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(i)]):
            if lo == hi:
                continue
            part = size[lo:hi]
            place = np.arange(int(part.sum())) - np.repeat(np.cumsum(part) - part, part)
            wide = np.repeat(m[lo:hi], part)
            work.append((level - 1, np.repeat(a[4][i[lo:hi]], part) + place // wide, np.repeat(b[4][j[lo:hi]], part) + place % wide))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


_FOUND = "kind int, a bigint, b bigint, size int, " + ", ".join(f"{n} bigint" for n in _BITS)


def _trees(postings: DataFrame, leaf: int, share: Fraction) -> DataFrame:
    """From postings sorted by key: pairs of the trees traversed here (kind 0), members of larger
    or spread ones (kind 1: ``a`` is the tree, ``b`` the text)."""
    names = ["kind", "a", "b", "size", *_BITS]

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, dtype=np.int32)), pa.array(a), pa.array(b), pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.int64()) for _ in _BITS)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        large: int | None = None

        def members(cols: list[np.ndarray], at: np.ndarray) -> pa.RecordBatch:
            key, _, seq, *rest = cols
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), dtype=np.int32)), pa.array(key[at]), pa.array(seq[at]), *(pa.array(c[at]) for c in rest)], names)

        def work(cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, large
            held = None
            key, salt = cols[:2]
            if not len(key):
                return
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            end = np.append(start[1:], len(key))
            big = (end - start > leaf) | (salt[start] >= 0)
            if large is not None:
                big |= key[start] == large
            if not last:
                if big[-1]:
                    # A large tree's members pass through; only its name is remembered.
                    large = int(key[-1])
                else:
                    large = None
                    held = [c[start[-1] :] for c in cols]
                    start, end, big = start[:-1], end[:-1], big[:-1]
            if big.any():
                size = (end - start)[big]
                yield members(cols, np.repeat(start[big] - (np.cumsum(size) - size), size) + np.arange(int(size.sum())))
            small = ~big & (end - start > 1)
            if not small.any():
                return
            size = (end - start)[small]
            rows = np.repeat(start[small] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            tree, (_, _, seq, weight, *bits) = np.repeat(np.arange(len(size)), size), [c[rows] for c in cols]
            # Texts of like size and bitmap become neighbours, copies from several tasks one text.
            order = np.lexsort((seq, *bits, weight, tree))
            tree, seq, weight = tree[order], seq[order], weight[order]
            first = np.concatenate(([True], (tree[1:] != tree[:-1]) | (seq[1:] != seq[:-1])))
            tree, seq, order = tree[first], seq[first], order[first]
            forest = SignatureForest(np.column_stack([b[order] for b in bits]).view(_U), weight[first].astype(np.int64), np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1]))))
            root = np.arange(len(size))
            i, j = dual_traversal(forest, forest, root, root, share)
            if len(i):
                a, b = np.minimum(seq[i], seq[j]), np.maximum(seq[i], seq[j])
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
                yield pairs(a[new], b[new])

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            yield from work(cols if held is None else [np.concatenate(x) for x in zip(held, cols)], False)
        if held is not None:
            yield from work(held, True)

    return postings.mapInArrow(run, _FOUND)


def _grams(texts: DataFrame, k: int, least_words: int) -> DataFrame:
    """Distinct k-word hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = batch.column(1).to_pylist()
            for lo, hi in kernels.chunks(strings):
                w = kernels.words(strings[lo:hi])
                grams, offsets = kernels.distinct_ngrams(w, k)
                good = np.flatnonzero(w.counts >= max(least_words, k))
                if len(good):
                    use = np.repeat(w.counts >= max(least_words, k), np.diff(offsets))
                    sizes = np.diff(offsets)[good]
                    own = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(grams[use].view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(kernels.sequence_hash(w)[good].view(np.int64)), own], ["seq", "grams"])

    return texts.mapInArrow(run, "seq bigint, grams array<bigint>")


def _bit_rows(lists: list[np.ndarray]) -> np.ndarray:
    """A bitmap per list, one bit for each different value of any list."""
    size = np.array([len(x) for x in lists])
    _, place = np.unique(np.concatenate(lists), return_inverse=True)
    width = (int(place.max(initial=0)) >> 6) + 1
    out = np.zeros((len(lists), width), dtype=_U)
    np.bitwise_or.at(out, (np.repeat(np.arange(len(lists)), size), place >> 6), _U(1) << (place.astype(_U) & _U(63)))
    return out


def _shared(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits that rows i and j have in common, a bounded number of pairs at a time."""
    step = max(1, 4_000_000 // rows.shape[1])
    parts = [np.bitwise_count(rows[i[x : x + step]] & rows[j[x : x + step]]).sum(axis=1, dtype=np.int64) for x in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _traverse(table: pa.Table, share: Fraction) -> pa.Table:
    """Links of the members of two subtrees: traversed, taken in their first common tree, verified."""
    side, token = table.column("side").to_numpy(), table.column("token")[0].as_py()
    seq, size = table.column("seq").to_numpy(), table.column("size").to_numpy().astype(np.int64)
    bits = np.column_stack([table.column(n).to_numpy() for n in _BITS]).view(_U)
    height = max(1, math.ceil(math.log(max(len(side), 2), FAN_OUT)))
    order = np.lexsort((*bits.T, size))
    one, two = order[side[order] == 0], order[side[order] == 1]
    root = np.zeros(1, dtype=np.int64)
    first = SignatureForest(bits[one], size[one], root, height)
    i, j = dual_traversal(first, SignatureForest(bits[two], size[two], root, first.height) if len(two) else first, root, root, share)
    i, j = one[i], (two if len(two) else one)[j]
    # Texts of a large tree mostly share many trees: a pair belongs to the first of them.
    earlier = [np.array([t for t in x if t < token], dtype=np.int64) for x in table.column("trees").to_pylist()]
    fresh = _shared(_bit_rows(earlier), i, j) == 0
    i, j = i[fresh], j[fresh]
    shared = _shared(_bit_rows([np.array(x, dtype=np.int64) for x in table.column("grams").to_pylist()]), i, j)
    near = share.denominator * shared >= share.numerator * (size[i] + size[j] - shared)
    x, y = seq[i[near]], seq[j[near]]
    return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})


def _fits(share: Fraction) -> Column:
    """``possible`` over columns a_ and b_ of two nodes."""
    n, d = share.numerator, share.denominator
    common = sum((F.bit_count(F.col(f"a_{x}").bitwiseAND(F.col(f"b_{x}"))) for x in _BITS), F.lit(0)) + F.least("a_slack", "b_slack")
    return (common * (n + d) >= n * (F.col("a_low") + F.col("b_low"))) & (d * F.col("a_high") >= n * F.col("b_low")) & (d * F.col("b_high") >= n * F.col("a_low"))


def _subtree_pairs(nodes: DataFrame, share: Fraction, fan: int) -> DataFrame:
    """Pairs of subtrees (token, a_part <= b_part) that may have similar members.

    The same dual traversal over tables: levels of ``fan`` nodes each are put above the subtrees,
    and surviving pairs of nodes are opened together, so no task meets more than ``fan`` times
    ``fan`` pairs of children of one pair.
    """
    up = [*(F.bit_or(n).alias(n) for n in _BITS), F.min("low").alias("low"), F.max("high").alias("high"), F.max("slack").alias("slack")]
    levels = [stage(nodes.withColumn("up", F.floor(F.col("part") / fan)), "tree-nodes")]
    while levels[-1].where("up > 0").limit(1).count():
        above = levels[-1].groupBy("token", F.col("up").alias("part")).agg(*up)
        levels.append(stage(above.withColumn("up", F.floor(F.col("part") / fan)), "tree-nodes"))
    pairs = levels[-1].select("token", F.lit(0).cast("bigint").alias("a_up"), F.lit(0).cast("bigint").alias("b_up")).distinct()
    for at, level in enumerate(reversed(levels)):
        a, b = (level.select("token", *(F.col(c).alias(f"{x}_{c}") for c in level.columns if c != "token")) for x in "ab")
        opened = pairs.join(a, ["token", "a_up"]).join(b, ["token", "b_up"]).where((F.col("a_part") <= F.col("b_part")) & _fits(share))
        pairs = stage(opened.select("token", "a_part", "b_part"), "node-pairs")
        if at < len(levels) - 1:
            pairs = pairs.withColumnsRenamed({"a_part": "a_up", "b_part": "b_up"})
    return pairs


def _large_trees(members: DataFrame, grams: DataFrame, share: Fraction, subtree: int) -> DataFrame:
    """Verified links of the large trees' members (token, seq, size, bitmap).

    Subtrees hold texts of like size: the texts of a tree are ordered by size, in steps of a
    quarter of an octave, and each step is cut by hash into parts of about ``subtree`` texts.
    The list of a text's trees is as long as the number of its keys at most.
    """
    step = F.floor(F.log2(F.col("size") + 1) * 4)
    cut = members.withColumn("step", step)
    counts = cut.groupBy("token", "step").agg(F.ceil(F.count("*") / subtree).alias("parts"))
    before = F.coalesce(F.sum("parts").over(Window.partitionBy("token").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("first", before)
    trees = members.groupBy("seq").agg(F.collect_list("token").alias("trees")).join(grams, "seq")
    part = (F.col("first") + F.pmod(F.xxhash64("seq"), F.col("parts"))).cast("bigint").alias("part")
    spread = cut.join(counts, ["token", "step"]).select("token", part, "seq", "size", *_BITS).join(trees, "seq")
    spread = stage(spread, "tree-members")
    pop = sum((F.bit_count(n) for n in _BITS[1:]), F.bit_count(_BITS[0]))
    nodes = spread.groupBy("token", "part").agg(*(F.bit_or(n).alias(n) for n in _BITS), F.min("size").alias("low"), F.max("size").alias("high"), F.max(F.col("size") - pop).alias("slack"))
    joined = _subtree_pairs(nodes, share, UPPER_FAN)
    joined = joined.withColumn("pair", F.concat_ws("|", F.col("token").cast("string"), "a_part", "b_part"))
    left = spread.join(joined.withColumnRenamed("a_part", "part"), ["token", "part"]).withColumn("side", F.lit(0))
    right = spread.join(joined.where("a_part != b_part").withColumnRenamed("b_part", "part"), ["token", "part"]).withColumn("side", F.lit(1))
    columns = ["pair", "token", "side", "seq", "size", "trees", "grams", *_BITS]

    def traverse(table: pa.Table) -> pa.Table:
        return _traverse(table, share)

    return left.select(columns).unionByName(right.select(columns)).groupBy("pair").applyInArrow(traverse, "a bigint, b bigint")


def _verified(pairs: DataFrame, firsts: DataFrame, texts: DataFrame, share: Fraction, k: int) -> DataFrame:
    """Pairs of sequences whose texts are similar enough, by their distinct k-word sequences."""
    named = pairs.join(firsts.select(F.col("seq").alias("a"), F.col("row").alias("row_a")), "a").join(firsts.select(F.col("seq").alias("b"), F.col("row").alias("row_b")), "b")
    named = stage(named, "near-pairs")
    sides = named.select(F.col("row_a").alias("row"), "a", "b", F.lit(0).alias("side")).unionByName(named.select(F.col("row_b").alias("row"), "a", "b", F.lit(1).alias("side")))
    both = sides.join(texts, "row").groupBy("a", "b").agg(F.max(F.when(F.col("side") == 0, F.col("text"))).alias("ta"), F.max(F.when(F.col("side") == 1, F.col("text"))).alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for lo, hi in kernels.chunks(a, kernels.MAX_CHARS // 2):
                shared, united = kernels.jaccard(kernels.words(a[lo:hi]), kernels.words(b[lo:hi]), k)
                at = pa.array(np.flatnonzero((united > 0) & (share.denominator * shared >= share.numerator * united)) + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def near_links(texts: DataFrame, least: float = 0.8, k: int = 5, least_words: int = 0, leaf: int = LEAF, subtree: int = SUBTREE, hot_texts: int = HOT_TEXTS) -> tuple[DataFrame, DataFrame]:
    """(links, members) of the texts (row, text).

    Members: ``row``, ``seq`` of every text of at least ``max(least_words, k)`` words; rows of the
    same word sequence have the same ``seq``.  Links: ``a`` < ``b``, all pairs of different
    sequences whose distinct k-word sequences have a Jaccard similarity of at least ``least``, but for
    the share of misses near the limit that ``plan`` states.
    Rows must be unique; null and short texts are left out; an empty table gives empty results.
    """
    share = Fraction(least).limit_denominator(1000)
    if not 0 < share <= 1:
        raise ValueError("least must be in (0, 1]")
    texts = texts.where(F.col("text").isNotNull()).select("row", "text")
    both = stage(_members(texts, k, least_words, share), "near-members")
    members = both.where("key is null").select("row", "seq")
    hot = _hot(both.where("key is not null"), hot_texts)
    postings = _postings(texts, k, least_words, share, hot).repartition("key", "salt")
    found = stage(_trees(postings.sortWithinPartitions("key"), leaf, share), "tree-pairs")
    pairs = found.where("kind = 0").select("a", "b")
    large = found.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("seq"), "size", *_BITS)
    firsts = members.groupBy("seq").agg(F.min("row").alias("row"))
    links = _verified(pairs.distinct(), firsts, texts, share, k)
    if large.limit(1).count():
        large = large.distinct()
        rows = stage(large.select("seq").distinct().join(firsts, "seq").select("row"), "tree-rows")
        # Only texts of large trees are read again; few of them are picked without a shuffle.
        picked = texts.join(F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows, "row")
        links = links.unionByName(_large_trees(large, _grams(picked, k, least_words).dropDuplicates(["seq"]), share, subtree)).distinct()
    return links, members


def near_pairs(texts: DataFrame, least: float = 0.8, k: int = 5, least_words: int = 0, leaf: int = LEAF, subtree: int = SUBTREE, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """Pairs ``row_a`` < ``row_b`` of rows with similar texts of different word sequences."""
    links, members = near_links(texts, least, k, least_words, leaf, subtree, hot_texts)
    a = members.select(F.col("row").alias("ra"), F.col("seq").alias("a"))
    b = members.select(F.col("row").alias("rb"), F.col("seq").alias("b"))
    return links.join(a, "a").join(b, "b").select(F.least("ra", "rb").alias("row_a"), F.greatest("ra", "rb").alias("row_b"))


def connected(edges: DataFrame) -> DataFrame:
    """``v`` and ``label``, the smallest vertex of its component, from edges (v, u) in both directions.

    Each step, a vertex and the vertex its label names take the smallest label next to it, and then
    the label's own label.  Hooking the labels' vertices joins whole trees at once: chains of
    200,000 vertices took up to 18 steps in a simulation.  Labels only fall, so the steps end;
    there is no limit on them.
    """
    kept = stage(edges.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("label")), "near-labels")
    while True:
        labels = kept.select("v", "label")
        around = edges.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("near"))
        known = labels.join(around, "v").select("v", F.least("label", "near").alias("near"), F.col("label").alias("old"))
        hooks = known.select(F.col("old").alias("v"), "near", F.lit(None).cast(labels.schema["label"].dataType).alias("old"))
        hooked = stage(known.unionByName(hooks).groupBy("v").agg(F.min("near").alias("label"), F.max("old").alias("old")), "near-hooks")
        jump = hooked.select(F.col("v").alias("label"), F.col("label").alias("further"))
        new = stage(hooked.join(jump, "label", "left").select("v", F.least("label", F.coalesce("further", "label")).alias("label"), "old"), "near-labels")
        # A step's tables aren't read again after it.
        free(kept)
        free(hooked)
        kept = new
        if not new.where("label != old").limit(1).count():
            return new.select("v", "label")


def near_groups(texts: DataFrame, least: float = 0.8, k: int = 5, least_words: int = 0) -> DataFrame:
    """One row per text: ``row``, ``group`` (smallest row of its connected texts) and ``links``
    (to different word sequences)."""
    links, members = near_links(texts, least, k, least_words)
    links = stage(links, "near-links")
    firsts = stage(members.groupBy("seq").agg(F.min("row").alias("first")), "near-firsts")
    edges = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = edges.join(firsts.select(F.col("seq").alias("a"), F.col("first").alias("v")), "a").join(firsts.select(F.col("seq").alias("b"), F.col("first").alias("u")), "b")
    edges = stage(edges.select("v", "u"), "near-edges")
    labels = connected(edges)
    degree = edges.groupBy("v").agg(F.count("*").alias("links"))
    out = members.join(firsts, "seq").join(labels.withColumnRenamed("v", "first"), "first", "left").join(degree.withColumnRenamed("v", "first"), "first", "left")
    return out.select("row", F.coalesce("label", "first").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
