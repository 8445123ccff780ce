"""Records that occur in two splits, exactly or almost (problem 6).

Each question gets a similarity hash of bits: the lower 8 bits of the minima of 120 hash functions
over its distinct 3-word sequences, so that two fingerprints differ in about half the bits of the
minima that differ, and these are the more the less similar the questions are.  The code is cut
into segments of three minima.  Splits are joined on the segments; pairs within a Hamming radius,
which no pair at the limit of similarity exceeds but by chance of one in a million, are verified on
the texts.  Equal questions and equal ids are joined exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathloom.llm import bloom, kernels
from mathloom.scratch import stage

_U = np.uint64
#: Segments of a code, and minima of a segment.  A pair of similarity 0.6 agrees in no segment once
#: in 17,000, one of 0.7 once in ten million; unrelated questions agree in one once in 400,000 pairs.
SEGMENTS, PER_SEGMENT = 40, 3
MINIMUM_BITS = 8
#: Rows of one segment's value that one task joins.
HOT_ROWS = 4096


def radius(least: float, minima: int = SEGMENTS * PER_SEGMENT, bits: int = MINIMUM_BITS) -> int:
    """Hamming distance that a pair of similarity ``least`` exceeds with a probability below a millionth.

    A minimum differs with probability 1 - least, and then in half its bits on average.
    """
    apart = 1 - least
    mean = apart * bits / 2
    variance = apart * (bits * bits + bits) / 4 - mean * mean
    return math.ceil(minima * mean + 5 * math.sqrt(minima * variance))


def fingerprints(w: kernels.Words, k: int = 3) -> np.ndarray:
    """A row of 8-bit minima per text; of zeros for a text of fewer than k words."""
    grams, offsets = kernels.distinct_ngrams(w, k)
    codes = np.zeros((len(w.counts), SEGMENTS * PER_SEGMENT), dtype=np.uint8)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        factors = np.random.default_rng(20).integers(1, 2**62, codes.shape[1]).astype(_U) * _U(2) + _U(1)
        product = np.empty_like(grams)
        for i, f in enumerate(factors):
            np.multiply(grams, f, out=product)
            codes[some, i] = kernels.mix64(np.minimum.reduceat(product, offsets[:-1][some])).astype(np.uint8)
    return codes


def segments(codes: np.ndarray) -> np.ndarray:
    """Hashes of each code's segments with their numbers: one row per code, one column per segment."""
    parts = codes.reshape(len(codes), SEGMENTS, PER_SEGMENT).astype(_U)
    value = np.zeros((len(codes), SEGMENTS), dtype=_U)
    for i in range(PER_SEGMENT):
        value = (value << _U(MINIMUM_BITS)) | parts[:, :, i]
    return kernels.mix64(value * _U(64) + np.arange(SEGMENTS, dtype=_U))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the codes of each row differ."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _codes(column: pa.Array) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, SEGMENTS * PER_SEGMENT)


def _side(df: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(row, seq) of a split's rows with words, and (seq, first, code) of its distinct questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in kernels.chunks(texts):
                w = kernels.words(texts[lo:hi])
                seq = kernels.sequence_hash(w).view(np.int64)
                some = np.flatnonzero(w.counts)
                fresh = []
                for i, x in zip(some.tolist(), seq[some].tolist()):
                    if x not in seen:
                        # Copies of a question share one code, however many they are.
                        seen.add(x)
                        fresh.append(i)
                code: list[bytes | None] = [None] * (hi - lo)
                for i, row in zip(fresh, fingerprints(kernels.take(w, np.array(fresh, dtype=np.int64)), k)):
                    code[i] = row.tobytes() if w.counts[i] >= k else b""
                at = pa.array(some)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(at), pa.array(seq[some]), pa.array(code, pa.binary()).take(at)], ["row", "seq", "code"])

    rows = stage(df.where(F.col("text").isNotNull()).mapInArrow(run, "row bigint, seq bigint, code binary"), "split-rows")
    unique = rows.where("code is not null").groupBy("seq").agg(F.min("row").alias("first"), F.min_by("code", "row").alias("code"))
    return rows.select("row", "seq"), stage(unique, "split-questions")


def _blocks(unique: DataFrame, among: np.ndarray | None = None) -> DataFrame:
    """(segment, seq) of the distinct questions; with a filter only of segments that may be in it."""
    sent = None if among is None else unique.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = segments(_codes(batch.column(1)))
            use = np.ones(value.shape, dtype=bool) if sent is None else bloom.contains(sent.value, value.ravel()).reshape(value.shape)
            owner, _ = np.nonzero(use)
            yield pa.RecordBatch.from_arrays([pa.array(value[use].view(np.int64)), batch.column(0).take(pa.array(owner))], ["segment", "seq"])

    return unique.where("length(code) > 0").select("seq", "code").mapInArrow(run, "segment bigint, seq bigint")


def _candidates(left: DataFrame, right: DataFrame, hot_rows: int) -> DataFrame:
    """Pairs (a, b) of questions that agree in a segment.

    The left split's segments go into a filter of fixed size, so that of the right one only those
    are moved that can meet.  The right rows of a frequent segment are spread over parts of about
    ``hot_rows``, its left rows go to each part.
    """
    a = stage(_blocks(left), "split-segments")
    b = stage(_blocks(right, bloom.build(a, "segment")), "split-segments")
    parts = b.groupBy("segment").agg(F.ceil(F.count("*") / hot_rows).cast("int").alias("parts")).where("parts > 1")
    parts = stage(parts, "split-hot")
    if parts.limit(1).count():
        a = a.join(parts, "segment", "left").select("segment", "seq", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        b = b.join(parts, "segment", "left").select("segment", "seq", F.pmod(F.xxhash64("seq"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    on = [c for c in a.columns if c != "seq"]
    return a.withColumnRenamed("seq", "a").join(b.withColumnRenamed("seq", "b"), on).where("a != b").select("a", "b").distinct()


def _within(pairs: DataFrame, most: int) -> DataFrame:
    """Rows (a, b, first_a, first_b) of the pairs with codes whose Hamming distance is at most ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array(np.flatnonzero(hamming(_codes(batch.column(4)), _codes(batch.column(5))) <= most))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in range(4)], ["a", "b", "first_a", "first_b"])

    return pairs.mapInArrow(run, "a bigint, b bigint, first_a bigint, first_b bigint")


def _verify(pairs: DataFrame, least: float, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for lo, hi in kernels.chunks(a, kernels.MAX_CHARS // 2):
                shared, united = kernels.jaccard(kernels.words(a[lo:hi]), kernels.words(b[lo:hi]), k)
                good = np.flatnonzero((united > 0) & (shared >= np.ceil(least * united - 1e-9)))
                at = pa.array(good + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(shared[good] / united[good])], ["a", "b", "similarity"])

    return pairs.mapInArrow(run, "a bigint, b bigint, similarity double")


def split_overlaps(left: DataFrame, right: DataFrame, row: str = "row_no", text: str = "question", key: Column | None = None, least: float = 0.6, k: int = 3, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs of rows of two splits with equal keys, equal word sequences or similar texts.

    Columns: ``left_row``, ``right_row``, ``similarity`` (of the distinct k-word sequences; 1 for
    the same words; null for a pair of equal keys only).  Null or wordless texts and null or empty
    keys match nothing; repeated rows are each reported.  Questions of fewer than k words match
    only the same words.  ``least`` is a similarity of 0.6 or more; below, more pairs are missed.
    """
    texts = [x.select(x[row].alias("row"), x[text].alias("text")) for x in (left, right)]
    (rows_a, unique_a), (rows_b, unique_b) = (_side(x, k) for x in texts)
    pairs = _candidates(unique_a, unique_b, hot_rows)
    for n, u in (("a", unique_a), ("b", unique_b)):
        pairs = pairs.join(u.select(F.col("seq").alias(n), F.col("first").alias(f"first_{n}"), F.col("code").alias(f"code_{n}")), n)
    close = stage(_within(pairs.select("a", "b", "first_a", "first_b", "code_a", "code_b"), radius(least)), "split-pairs")
    for n, t in zip("ab", texts):
        close = close.join(t.select(F.col("row").alias(f"first_{n}"), F.col("text").alias(f"t{n}")), f"first_{n}")
    near = _verify(close.select("a", "b", "ta", "tb"), least, k)
    same = unique_a.select(F.col("seq").alias("a")).join(unique_b.select(F.col("seq").alias("b")), F.col("a") == F.col("b")).withColumn("similarity", F.lit(1.0))
    alike = near.unionByName(same)
    by_text = alike.join(rows_a.select(F.col("row").alias("left_row"), F.col("seq").alias("a")), "a").join(rows_b.select(F.col("row").alias("right_row"), F.col("seq").alias("b")), "b").select("left_row", "right_row", "similarity")
    if key is None:
        return by_text
    ids = [x.select(x[row].alias(n), key.alias("key")).where("key != ''") for x, n in ((left, "left_row"), (right, "right_row"))]
    by_key = ids[0].join(ids[1], "key").select("left_row", "right_row", F.lit(None).cast("double").alias("similarity"))
    return by_text.unionByName(by_key).groupBy("left_row", "right_row").agg(F.max("similarity").alias("similarity"))


def report(overlaps: DataFrame, left: DataFrame, right: DataFrame, split: str, source: str, row: str = "row_no") -> DataFrame:
    """Overlaps per split of the left and source of the right table: pairs and rows touched.

    A null split or source is its own group.
    """
    joined = overlaps.join(left.select(left[row].alias("left_row"), left[split].alias(split)), "left_row").join(right.select(right[row].alias("right_row"), right[source].alias(source)), "right_row")
    return joined.groupBy(split, source).agg(F.count("*").alias("pairs"), F.countDistinct("left_row").alias("left_rows"), F.countDistinct("right_row").alias("right_rows"))
