"""Repetition inside single documents (problem 9).

Each text is reduced to a few cheap rule statistics.  An isolation forest, grown on a bounded
sample, scores every document by its mean path length: rare combinations are isolated after few
random splits.  The limit of the path length is calibrated on labelled rows, a bounded sample on
which the exact rule has been computed.  Only documents the forest finds anomalous have their word
runs counted; the rule on these counts is the second step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mathloom.llm import kernels

STATISTICS = ("share1", "share2", "lines", "log_words")
#: Rows that are labelled by the rule; the bound doesn't depend on the corpus.
LABELLED_ROWS = 32_768
#: Rows of these the forest is grown on.
SAMPLE_ROWS = 4096
TREES = 64
PER_TREE = 256


def statistics(texts: list[str | None], w: kernels.Words) -> np.ndarray:
    """One row per text: shares of repeated words, word pairs and lines, logarithm of the words."""
    n = w.counts
    shares = []
    for size in (1, 2):
        _, offsets = kernels.distinct_ngrams(w, size)
        a = np.maximum(n - (size - 1), 0)
        shares.append(np.where(a > 0, 1.0 - np.diff(offsets) / np.maximum(a, 1), 0.0))
    lines = np.zeros(len(texts))
    for i, t in enumerate(texts):
        if t and "\n" in t:
            own = [x for x in t.split("\n") if x.strip()]
            if own:
                lines[i] = 1.0 - len(set(own)) / len(own)
    return np.column_stack([*shares, lines, np.log1p(n)])


def run_counts(w: kernels.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of k-word runs of each text, and of distinct ones."""
    _, offsets = kernels.distinct_ngrams(w, k)
    return np.maximum(w.counts - (k - 1), 0), np.diff(offsets)


def rule(words: np.ndarray, runs: np.ndarray, distinct: np.ndarray, least_share: float, least_words: int) -> np.ndarray:
    """Whether the share of repeated runs reaches its limit; whole numbers decide, so that a share
    on the limit isn't lost to rounding."""
    return (words >= least_words) & (runs > 0) & (runs - distinct >= np.ceil(least_share * runs - 1e-9))


def _average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (np.log(n - 1.0) + 0.5772156649) - 2.0 * (n - 1.0) / n


class IsolationForest:
    """Isolation forest in arrays: split column, split value, children, path length at leaves."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.depth = int(np.ceil(np.log2(max(per_tree, 2))))
        self.trees = [self._tree(rows, rng, per_tree) for _ in range(trees)] if len(rows) else []

    def _tree(self, rows: np.ndarray, rng: np.random.Generator, per_tree: int):
        picked = rows[rng.choice(len(rows), min(per_tree, len(rows)), replace=False)]
        column, value, child, path = [], [], [], []

        def grow(part: np.ndarray, depth: int) -> int:
            me = len(column)
            column.append(-1)
            value.append(0.0)
            child.append((me, me))
            path.append(depth + _average_path(len(part)))
            low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(1), np.zeros(1))
            open_columns = np.flatnonzero(high > low)
            if depth < self.depth and len(part) > 1 and len(open_columns):
                c = int(rng.choice(open_columns))
                v = float(rng.uniform(low[c], high[c]))
                left = part[:, c] < v
                column[me], value[me] = c, v
                child[me] = (grow(part[left], depth + 1), grow(part[~left], depth + 1))
            return me

        grow(picked, 0)
        return np.array(column), np.array(value), np.array(child), np.array(path)

    def path_lengths(self, rows: np.ndarray) -> np.ndarray:
        """Mean path length of each row; short ones are anomalous."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for column, value, child, path in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                c = column[at]
                right = rows[every, np.maximum(c, 0)] >= value[at]
                at = np.where(c >= 0, child[at, right.astype(np.int64)], at)
            total += path[at]
        return total / max(len(self.trees), 1)


def _labelled(df: DataFrame, least_share: float, least_words: int, k: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the ``rows`` rows (key, text) of smallest hashed key.

    A fixed bound, the same for every partitioning of the corpus.  Tasks look only at rows below a
    hash that about twice as many rows pass, and send numbers, no texts.
    """
    share = min(1.0, 2.0 * rows / max(df.count(), 1))
    pool = df.where(F.col("text").isNotNull()).select(F.xxhash64("key").alias("h"), "text")
    pool = pool.where(F.col("h") <= min(int(2**64 * share) - 2**63, 2**63 - 1))
    names = ["h", *STATISTICS, "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in kernels.chunks(texts):
                w = kernels.words(texts[lo:hi])
                found = statistics(texts[lo:hi], w)
                labels = rule(w.counts, *run_counts(w, k), least_share, least_words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, found.T.copy()), pa.array(labels)], names)

    sent = pool.mapInArrow(run, "h bigint, " + ", ".join(f"{n} double" for n in STATISTICS) + ", label boolean")
    table = sent.orderBy(*names).limit(rows).toArrow()
    columns = [table.column(n).to_numpy() for n in STATISTICS]
    return np.column_stack(columns), table.column("label").to_numpy()


def calibrate(forest: IsolationForest, rows: np.ndarray, labels: np.ndarray) -> float:
    """Limit of the path length: all labelled rows are within it, and others a little beyond.

    It lies as far above the longest path of a labelled row as the 99th percentile lies below.
    With no labelled row nothing is known of their paths, and every document is within.
    """
    if not labels.any():
        return float("inf")
    paths = forest.path_lengths(rows[labels])
    return float(2 * paths.max() - np.quantile(paths, 0.99))


def fit(df: DataFrame, least_share: float, least_words: int, k: int, sample_rows: int, labelled_rows: int) -> tuple[IsolationForest, float]:
    """Forest and path-length limit of a table (key, text)."""
    rows, labels = _labelled(df, least_share, least_words, k, labelled_rows)
    forest = IsolationForest(rows[:sample_rows])
    return forest, calibrate(forest, rows, labels)


_PARTS = [("words", T.LongType()), ("repeated_share", T.DoubleType()), ("path_length", T.DoubleType()), ("anomalous", T.BooleanType()), ("repetitive", T.BooleanType())]


def _scored(df: DataFrame, text: str, key: str, least_share: float, least_words: int, sample_rows: int, labelled_rows: int, every: bool, k: int = 5) -> DataFrame:
    """The columns of ``repetition``; unless ``every``, only of the anomalous documents."""
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    sent = df.sparkSession.sparkContext.broadcast(fit(rows, least_share, least_words, k, sample_rows, labelled_rows))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, longest = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in kernels.chunks(texts):
                w = kernels.words(texts[lo:hi])
                paths = forest.path_lengths(statistics(texts[lo:hi], w))
                odd = paths <= longest
                at = np.arange(hi - lo) if every else np.flatnonzero(odd)
                if not every:
                    w = kernels.take(w, at)
                runs, distinct = run_counts(w, k)
                share = np.where(runs > 0, 1.0 - distinct / np.maximum(runs, 1), 0.0)
                found = odd[at] & rule(w.counts, runs, distinct, least_share, least_words)
                arrays = [w.counts.astype(np.int64), share, paths[at], odd[at], found]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + lo)), *map(pa.array, arrays)], ["key", *(p for p, _ in _PARTS)])

    out = rows.mapInArrow(run, f"key {kind}, " + ", ".join(f"{n} {t.simpleString()}" for n, t in _PARTS))
    return out.select(out["key"].alias(key), *(p for p, _ in _PARTS))


def repetition(df: DataFrame, text: str = "text", key: str = "doc_id", least_share: float = 0.3, least_words: int = 20, sample_rows: int = SAMPLE_ROWS, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """Per document: ``words``, ``repeated_share`` of its 5-word runs, ``path_length``, ``anomalous``
    (the forest's verdict) and ``repetitive`` (anomalous, and confirmed by the exact rule).

    A null, empty or short text has a share of 0 and is never repetitive.  One row per input row.
    """
    return _scored(df, text, key, least_share, least_words, sample_rows, labelled_rows, True)


def repetitive(df: DataFrame, text: str = "text", key: str = "doc_id", least_share: float = 0.3, least_words: int = 20, sample_rows: int = SAMPLE_ROWS, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """The rows of ``repetition`` that are repetitive; runs are counted of anomalous documents only."""
    return _scored(df, text, key, least_share, least_words, sample_rows, labelled_rows, False).where("repetitive")
