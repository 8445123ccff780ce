"""Duplicates hidden by formatting (problem 5).

A text's bytes run through a look-up table that skips characters without meaning and folds case,
straight into two polynomial hashes: each kept character is weighed by the power of its rank among
the kept ones, a skipped one by nothing, and no canonical string is built.  A text that is one JSON
object, or a list of labelled lines, is the set of its fields, so the order of fields doesn't matter.
Rows of equal hashes are then compared with the first of them: two pointers advance over the two
texts, each to its next kept character, and what they meet is folded and compared.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathloom.llm import kernels
from mathloom.scratch import stage

_U = np.uint64
#: Fixed value: what is kept besides letters and digits.
SYMBOLS = "+-*/^=<>"
#: Rows of one group that are compared by one task.
GROUP_ROWS = 20_000
#: Larger groups up to this number are broadcast (some 50 bytes each), more are joined in parts.
BROADCAST_GROUPS, SALTS = 100_000, 16
_LABEL = re.compile(r"[ \t]*[A-Za-z][A-Za-z ]*:")
_LINE = re.compile(r"\r\n|[\r\n]")


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Of each code point: its folded one, or 0 where it is skipped."""
    table = np.zeros(len(kernels.alnum_table()), dtype=np.uint32)
    for c in np.flatnonzero(kernels.alnum_table()).tolist():
        low = chr(c).lower()
        table[c] = ord(low) if len(low) == 1 else c
    symbols = [ord(c) for c in SYMBOLS]
    table[symbols] = symbols
    return table


@lru_cache(maxsize=1)
def weight_table() -> np.ndarray:
    """Of each code point: the hash weight of its folded one, or 0 where it is skipped."""
    fold = fold_table()
    return np.where(fold > 0, kernels.mix64(fold.astype(_U) + _U(0x51ED270B27)), _U(0))


def lowered(text: str) -> str:
    """The text, lower-cased where that isn't a matter of single characters."""
    return text.lower() if "Σ" in text or "İ" in text else text


def fields(text: str) -> list[str]:
    """The fields of a JSON object or of labelled lines; a list of the text itself otherwise."""
    bare = text.strip()
    if bare[:1] == "{" and bare[-1:] == "}":
        try:
            found = json.loads(bare)
        except (ValueError, RecursionError):
            found = None
        if isinstance(found, dict):
            return [k + (v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in found.items()]
    if _LABEL.match(bare):
        lines = [x for x in _LINE.split(bare) if x.strip()]
        if all(map(_LABEL.match, lines)):
            return lines
    return [text]


class Folded:
    """Hashes of a batch of texts, fields in the order of their hashes, and their comparison.

    ``k1``, ``k2``: hashes of each text's set of fields; ``alnum``: whether it has a letter or digit.
    Only the texts' own code points are held, and the fields' places in them.
    """

    def __init__(self, texts: list[str | None]):
        units: list[str] = []
        owner: list[int] = []
        for i, t in enumerate(texts):
            if t:
                own = fields(lowered(t))
                units += own
                owner += [i] * len(own)
        n = len(texts)
        self.codes, self.begin = kernels.code_points(units, lower=False)
        kept = fold_table()[self.codes] != 0
        # Rank of a kept character within its field: how many of the field's are kept before it.
        rank = np.cumsum(kept, dtype=np.int64)
        self.total = np.concatenate(([0], rank))
        first, size = self.total[self.begin[:-1]], np.diff(self.total[self.begin])
        rank -= np.repeat(first, np.diff(self.begin)) + 1
        weight = weight_table()[self.codes]
        full = np.flatnonzero(size)
        hashes = np.zeros((2, len(units)), dtype=_U)
        if len(full):
            some = np.flatnonzero(np.diff(self.begin))
            for row, base in enumerate((0xD1342543DE82EF95, 0xAF251AF3B0F025B5)):
                summed = np.add.reduceat(weight * kernels.powers(base, int(size.max()) + 1)[np.maximum(rank, 0)], self.begin[:-1][some])
                hashes[row, some] = np.where(size[some] > 0, kernels.mix64(summed + size[some].astype(_U)), _U(0))
        own = np.asarray(owner, dtype=np.int64)
        order = full[np.lexsort((hashes[1, full], hashes[0, full], own[full]))]
        if len(order):
            a, b = order[1:], order[:-1]
            new = (own[a] != own[b]) | (hashes[0, a] != hashes[0, b]) | (hashes[1, a] != hashes[1, b])
            order = order[np.concatenate(([True], new))]
        self.k1, self.k2 = (self._sum(h, own, order, n) for h in hashes)
        self.alnum = np.zeros(n, dtype=bool)
        letters = np.concatenate(([0], np.cumsum(kernels.alnum_table()[self.codes])))
        self.alnum[own[np.diff(letters[self.begin]) > 0]] = True
        #: Fields of each text, by their hashes, and how many characters they keep.
        self.order, self.field = order, np.concatenate(([0], np.cumsum(np.bincount(own[order], minlength=n))))
        self.size = size

    @staticmethod
    def _sum(h: np.ndarray, own: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n, dtype=_U)
        np.add.at(out, own[order], kernels.mix64(h[order] ^ _U(0x2545F4914F6CDD1D)))
        return out

    def pointer(self, i: int) -> np.ndarray:
        """Where the pointer of text i stops: its kept characters' places, field by field."""
        stops = [self.begin[f] + np.flatnonzero(fold_table()[self.codes[self.begin[f] : self.begin[f + 1]]]) for f in self.order[self.field[i] : self.field[i + 1]]]
        return np.concatenate(stops) if stops else np.zeros(0, dtype=np.int64)

    def same(self, other: Folded) -> np.ndarray:
        """Whether the texts at equal places are equal, comparing every kept character."""
        fold, n = fold_table(), len(self.field) - 1
        equal = np.zeros(n, dtype=bool)
        for i in range(n):
            mine, theirs = (x.size[x.order[x.field[i] : x.field[i + 1]]] for x in (self, other))
            if len(mine) == len(theirs) and (mine == theirs).all():
                equal[i] = bool((fold[self.codes[self.pointer(i)]] == fold[other.codes[other.pointer(i)]]).all())
        return equal

    def digest(self, i: int) -> str:
        return hashlib.sha256(fold_table()[self.codes[self.pointer(i)]].tobytes()).hexdigest()


def _keys(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in kernels.chunks(texts):
                c = Folded(texts[lo:hi])
                at = pa.array(np.flatnonzero(c.alnum) + lo)
                mine = np.flatnonzero(c.alnum)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(c.k1[mine].view(np.int64)), pa.array(c.k2[mine].view(np.int64))], ["row", "scope", "k1", "k2"])

    return rows.mapInArrow(run, "row bigint, scope string, k1 bigint, k2 bigint")


def _compare(rows: DataFrame) -> DataFrame:
    """Rows sorted by (first, salt, row), each group led by its first row: equal to it or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lead = None, None
        for batch in batches:
            first, salt, row, counted = (batch.column(i).to_pylist() for i in range(4))
            texts = batch.column(4).to_pylist()
            leads = []
            for key, t in zip(zip(first, salt), texts):
                if key != group:
                    group, lead = key, t
                leads.append(lead)
            other = [""] * len(texts)
            hard = [i for i, (t, u) in enumerate(zip(texts, leads)) if t != u]
            for lo, hi in kernels.chunks([texts[i] for i in hard], kernels.MAX_CHARS // 2):
                part = hard[lo:hi]
                mine, theirs = Folded([texts[i] for i in part]), Folded([leads[i] for i in part])
                for j in np.flatnonzero(~mine.same(theirs)):
                    other[part[j]] = mine.digest(j)
            use = [i for i, c in enumerate(counted) if c]
            yield pa.RecordBatch.from_arrays([pa.array([first[i] for i in use], pa.int64()), pa.array([row[i] for i in use], pa.int64()), pa.array([other[i] for i in use], pa.string())], ["first", "row", "other"])

    return rows.mapInArrow(run, "first bigint, row bigint, other string")


def hidden_duplicates(df: DataFrame, scope: Column, text: str = "solution", row: str = "row_no", group_rows: int = GROUP_ROWS) -> DataFrame:
    """``row_no`` of the first row and ``copies`` of each group of two or more equal rows.

    Rows are equal if ``scope`` is and the text is, in letters, digits and ``+ - * / ^ = < >``,
    lower-cased, its fields in any order.  Rows with a null scope, a null text or a text without
    letter or digit take no part.  ``row`` must be unique; other columns aren't read.
    """
    rows = df.select(df[row].alias("row"), scope.alias("scope"), df[text].alias("text")).where(F.col("scope").isNotNull() & F.col("text").isNotNull())
    keys = stage(_keys(rows), "format-keys")
    on = ["scope", "k1", "k2"]
    groups = stage(keys.groupBy(*on).agg(F.count("*").alias("size"), F.min("row").alias("first")).where(F.col("size") > 1), "format-groups")
    large = groups.where(F.col("size") > group_rows)
    few = large.limit(BROADCAST_GROUPS + 1).count()
    members = keys.join(groups.where(F.col("size") <= group_rows), on)
    if 0 < few <= BROADCAST_GROUPS:
        members = members.unionByName(keys.join(F.broadcast(large), on))
    elif few:
        # So many large groups that they are joined too, each in parts.
        parts = large.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        members = members.unionByName(keys.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(parts, [*on, "part"]).drop("part"))
    members = members.select("row", "first", F.ceil(F.col("size") / group_rows).cast("int").alias("salts"))
    # A large group is compared by several tasks, each of which gets the first row too.
    own = F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")
    salts = F.when(F.col("row") == F.col("first"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(own))
    members = members.select("row", "first", F.explode(salts).alias("salt")).withColumn("counted", (F.col("row") != F.col("first")) | (F.col("salt") == 0))
    texts = rows.select("row", "text").join(members, "row").select("first", "salt", "row", "counted", "text")
    compared = _compare(texts.repartition("first", "salt").sortWithinPartitions("first", "salt", "row"))
    found = compared.groupBy("first", "other").agg(F.min("row").alias("row_no"), F.count("*").alias("copies"))
    return found.where(F.col("copies") > 1).select(F.col("row_no").alias(row), "copies")
