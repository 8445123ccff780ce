"""Operators on keyed tables.  Rows with equal keys are compared by an explicit row number; no
result depends on the order in which tasks see the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leading bits of a hash that pick the bar of its histogram.
_BARS = 4096


def _one_of(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    # A window and not max_by of the whole row: columns that nobody reads aren't moved, and each
    # task sends one row a key.
    ranked = df.withColumn("n_", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.where("n_ = 1").drop("n_")


def last_by(df: DataFrame, keys: list[str], row: str = "row_no") -> DataFrame:
    """The row of largest ``row`` for each key (a dictionary's last write)."""
    return _one_of(df, keys, F.col(row).desc())


def first_by(df: DataFrame, keys: list[str], row: str | Column = "row_no") -> DataFrame:
    """The row of smallest ``row`` for each key."""
    return _one_of(df, keys, (F.col(row) if isinstance(row, str) else row).asc_nulls_last())


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def require(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """``df`` if it has the columns (``exact``: just these, in order); raises otherwise."""
    missing = sorted(set(columns) - set(df.columns))
    if missing or exact and df.columns != columns:
        raise ValueError(f"missing columns {missing}" if missing else f"columns {df.columns}, not {columns}")
    return df


def assert_unique(df: DataFrame, keys: list[str], name: str = "table") -> DataFrame:
    """``df`` if its keys are unique; raises with one of the repeated keys otherwise."""
    twice = duplicate_keys(df, keys).first()
    if twice:
        raise ValueError(f"{name}: repeated key {[twice[k] for k in keys]}")
    return df


def assert_disjoint(a: DataFrame, b: DataFrame, key: str = "id") -> None:
    """Raises with the five smallest keys that both tables have."""
    both = [r[0] for r in overlap(a, b, key).orderBy(key).limit(5).collect()]
    if both:
        raise ValueError(f"shared by both tables: {both}")


def lookup(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its key's row of ``table``; raises with a key the table lacks."""
    absent = pending(df, table, keys).first()
    if absent:
        raise KeyError(tuple(absent[k] for k in keys))
    return df.join(table, keys)


def overlap(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Distinct keys of both tables."""
    return a.select(key).join(b.select(key), key, "left_semi").distinct()


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key isn't done yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def stale(done: DataFrame, current: DataFrame, keys: list[str], pairs: list[tuple[str, Column]]) -> DataFrame:
    """Finished rows whose stored hash differs from the current one, or whose input is gone.

    ``pairs``: stored column and the current value's expression over ``current``.
    """
    now = current.select(*keys, *(e.alias(f"now_{c}") for c, e in pairs), F.lit(True).alias("here_"))
    joined = done.join(now, keys, "left")
    differs = F.lit(False)
    for c, _ in pairs:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"now_{c}"))
    return joined.where(F.col("here_").isNull() | differs).select(*done.columns)


def first_seen(df: DataFrame, key: str = "id", row: str = "row_no") -> DataFrame:
    """Each key with the row where it first occurs."""
    return df.groupBy(key).agg(F.min(row).alias("first_row"))


def head(df: DataFrame, n: int, row: str = "row_no") -> DataFrame:
    """The first ``n`` rows in file order; all of them for 0."""
    return df.orderBy(row).limit(n) if n else df


def hash_split(df: DataFrame, percent: int, key: str = "id") -> DataFrame:
    """Distinct keys with ``share``: ``first`` for exactly the floor of ``percent`` of them, the
    smallest by SHA-256, and ``rest`` for the others.

    A histogram of leading hash bits finds the bar in which the last key of the first share lies;
    only the keys of that bar are ranked, so no task ever sorts all keys.
    """
    if not 1 <= percent <= 99:
        raise ValueError("percent must be between 1 and 99")
    ids = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("h_", F.sha2(key, 256))
    ids = ids.withColumn("bar_", F.conv(F.substring("h_", 1, 3), 16, 10).cast("int"))
    bars = {r[0]: r[1] for r in ids.groupBy("bar_").count().collect()}
    want, at = sum(bars.values()) * percent // 100, 0
    while at < _BARS and want > bars.get(at, 0):
        want -= bars.get(at, 0)
        at += 1
    edge = ids.where(F.col("bar_") == at).withColumn("n_", F.row_number().over(Window.partitionBy("bar_").orderBy("h_")))
    inside = edge.select(key, F.when(F.col("n_") <= want, "first").otherwise("rest").alias("share"))
    outside = ids.where(F.col("bar_") != at).select(key, F.when(F.col("bar_") < at, "first").otherwise("rest").alias("share"))
    return outside.unionByName(inside)


def ordinal(df: DataFrame, key: str, order: str, into: str, ties: str, width: int = 4096) -> DataFrame:
    """Rank from 0 of each row within its key, by an integer column, then by ``ties``.

    Ranked within blocks of ``width`` values, then shifted by the rows of earlier blocks, so that a
    key of any size is spread over many tasks.
    """
    blocks = df.withColumn("block_", F.floor(F.col(order) / width))
    sizes = blocks.groupBy(key, "block_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(key).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = blocks.join(sizes.select(key, "block_", before.alias("before_")), [key, "block_"])
    within = F.row_number().over(Window.partitionBy(key, "block_").orderBy(order, ties))
    return shifted.withColumn(into, (F.col("before_") + within - 1).cast("long")).drop("block_", "before_")


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, or null.  A rule that is null doesn't hold."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(rule, F.lit(name)).otherwise(out)
    return out


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))


def nearest_rank(df: DataFrame, column: str, percents: tuple[int, ...] = (50, 95, 99), limit: int | None = None) -> DataFrame:
    """One row: nearest-rank percentiles, the maximum and how many values exceed ``limit``."""
    kind = df.schema[column].dataType
    parts = [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {column})").cast(kind).alias(f"p{p}") for p in percents]
    parts.append(F.max(column).alias("max"))
    if limit is not None:
        parts.append(F.count_if(F.col(column) > limit).alias("over_limit"))
    return df.agg(*parts)


def best_epoch(results: DataFrame, epoch: str = "epoch") -> DataFrame:
    """One row: the epoch of highest accuracy, then of least parse failures, least truncation, and
    the earliest.  An empty table gives a null."""
    order = F.struct((-F.col("accuracy")).alias("a"), F.col("parse_failure_rate").alias("p"), F.col("truncation_rate").alias("t"), F.col(epoch).alias("e"))
    return results.agg(F.min_by(epoch, order).alias(epoch))
