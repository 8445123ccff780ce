"""Consensus of annotators who disagree (problem 2).

Confidence-aware truth discovery.  Two steps alternate: the consensus of each item is the label of
the smallest weighted distance to the item's labels, and each annotator's error variance is
estimated from the distance of their labels to the consensus.  Not the plain estimate counts but the
upper bound of its chi-squared confidence interval, so that an annotator of the long tail, with few
labels, has little weight.  Variances are kept for the two true labels apart.  An annotator worse
than chance is read reversed, with the upper bound of the reversed labels' variance.  The weight of
a label is the logarithm of how much likelier these variances make it under the one consensus than
under the other; the label all items have most often weighs as one more label of each item.

Items labelled alike by the same annotators form one pattern; the steps run over patterns.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mathloom.scratch import stage

#: Normal quantile of the two-sided 95 % interval.
Z = 1.959963984540054
#: Annotators up to this number are held by the driver between steps (some 40 bytes each).
DRIVER_ANNOTATORS = 20_000


def chi_squared(n: Column, z: float) -> Column:
    """Quantile of chi-squared with ``n`` degrees of freedom at the normal quantile ``z``.

    Wilson and Hilferty's cube of a normal; exact enough from one degree of freedom on.
    """
    part = F.lit(2.0) / (F.lit(9.0) * n)
    return n * F.pow(F.greatest(F.lit(1.0) - part + F.lit(z) * F.sqrt(part), F.lit(1e-3)), F.lit(3.0))


def error_bound(errors: Column, n: Column) -> Column:
    """Upper bound of the error variance, at most a half, within (0, 1).

    Of more errors than not, 1 less the upper bound of the reversed labels'.
    """
    least, half = F.lit(1e-4), F.lit(0.5)
    upper = lambda e: F.greatest(F.least((e + half) / chi_squared(n + F.lit(1.0), -Z), half), least)
    return F.when(errors > n / 2, 1 - upper(n - errors)).otherwise(upper(errors))


def _weights(stats: DataFrame) -> DataFrame:
    """Log ratio of a FAIL and of a PASS label of each annotator, and the reliability estimates."""
    miss = error_bound(F.col("miss"), F.col("n_fail"))
    alarm = error_bound(F.col("alarm"), F.col("n_pass"))
    return stats.select(
        "judge", "votes", "n_fail", "n_pass", miss.alias("error_fail"), alarm.alias("error_pass"),
        F.log((1 - miss) / alarm).alias("if_fail"), F.log(miss / (1 - alarm)).alias("if_pass"),
    )


def _local(spark: SparkSession, rows: list) -> DataFrame:
    """Rows as a literal relation: it is part of the plan and needs no job of its own."""
    frame = pa.Table.from_pylist([r.asDict() for r in rows], pa.schema([("judge", pa.string()), *((n, pa.float64()) for n in ("votes", "miss", "n_fail", "alarm", "n_pass"))]))
    return spark.createDataFrame(frame)


def _prior(fail: float | None, good: float | None) -> float:
    """Log odds of FAIL over all votes."""
    return math.log((fail + 1) / (good + 1)) if fail is not None and good is not None else 0.0


def _same(old: DataFrame, new: DataFrame) -> bool:
    """Whether no annotator's errors have changed; they are whole numbers."""
    both = new.alias("x").join(old.alias("y"), "judge")
    return both.where((F.col("x.miss") != F.col("y.miss")) | (F.col("x.alarm") != F.col("y.alarm"))).limit(1).count() == 0


def votes(parts: list[DataFrame]) -> DataFrame:
    """Latest vote of each judge about each item, from tables (item_a, item_b, judge, label, ok, at, row).

    Rows with a null item or judge are left out; a null time counts as the earliest.  A vote that
    isn't ok, or neither PASS nor FAIL, abstains: it replaces an older one and then counts for
    nothing.
    """
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    label = F.upper(F.regexp_replace("label", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", ""))
    when = F.struct(F.coalesce(F.col("at"), F.lit("0001-01-01").cast("timestamp")).alias("at"), F.col("row"))
    valued = F.when(F.coalesce(F.col("ok"), F.lit(False)) & label.isin("PASS", "FAIL"), label == "FAIL")
    last = (
        rows.where(F.col("item_a").isNotNull() & F.col("item_b").isNotNull() & F.col("judge").isNotNull())
        .groupBy("item_a", "item_b", "judge")
        .agg(F.max(F.struct(when.alias("when"), valued.alias("fail"))).alias("last"))
    )
    return last.select("item_a", "item_b", "judge", F.col("last.fail").alias("fail")).where(F.col("fail").isNotNull())


def discover(cast: DataFrame, most_steps: int = 200, driver_annotators: int = DRIVER_ANNOTATORS) -> tuple[DataFrame, DataFrame]:
    """(consensus per item, reliability per annotator) of votes (item_a, item_b, judge, fail).

    Items: ``fail_weight`` (weighted distance to PASS less that to FAIL), ``consensus`` (FAIL if it
    is above 0, otherwise PASS, ties included), ``agreement`` (share of the item's votes equal to the
    consensus) and ``votes``.  Annotators: ``votes``, ``error_fail`` and ``error_pass`` (bounds of
    their error variance on items whose consensus is FAIL and PASS).  The steps alternate until no
    consensus changes, or until they come back to an earlier state; more than ``most_steps`` raise.
    An empty table gives empty results.
    """
    spark = cast.sparkSession
    cast = stage(cast, "votes")
    # Order-free pattern of an item: two independent exclusive-ors over its votes; no list is built.
    one, two = F.bit_xor(F.xxhash64("judge", "fail")), F.bit_xor(F.xxhash64(F.lit(7), "fail", "judge"))
    items = cast.groupBy("item_a", "item_b").agg(one.alias("h1"), two.alias("h2"), F.avg(F.col("fail").cast("double")).alias("share"), F.count("*").alias("votes"))
    items = stage(items, "vote-patterns")
    patterns = items.groupBy("h1", "h2").agg(F.count("*").cast("double").alias("n"), F.min(F.struct("item_a", "item_b")).alias("one"), F.min("share").alias("share"))
    patterns = patterns.select("h1", "h2", "n", "share", F.col("one.item_a").alias("item_a"), F.col("one.item_b").alias("item_b"))
    lines = stage(cast.join(patterns, ["item_a", "item_b"]).select("h1", "h2", "n", "share", "judge", "fail"), "pattern-votes")

    def statistics(scored: DataFrame) -> DataFrame:
        q = F.col("q") * F.col("n")
        p = (1 - F.col("q")) * F.col("n")
        out = scored.groupBy("judge").agg(
            F.sum("n").alias("votes"), F.sum(F.when(~F.col("fail"), q).otherwise(0.0)).alias("miss"), F.sum(q).alias("n_fail"),
            F.sum(F.when(F.col("fail"), p).otherwise(0.0)).alias("alarm"), F.sum(p).alias("n_pass"),
        )
        return out

    def step(stats: DataFrame, prior: float) -> DataFrame:
        weights = _weights(stats)
        value = F.when(F.col("fail"), F.col("if_fail")).otherwise(F.col("if_pass"))
        score = F.sum(value).over(Window.partitionBy("h1", "h2")) + F.lit(prior)
        joined = lines.join(F.broadcast(weights) if few else weights, "judge")
        return statistics(joined.withColumn("q", (score > 0).cast("double")))

    few = cast.select("judge").distinct().limit(driver_annotators + 1).count() <= driver_annotators

    def cut(stats: DataFrame) -> tuple[DataFrame, float, tuple]:
        # Cuts the lineage of a step: few annotators as rows of the driver, many as a table.
        if not few:
            stats = stage(stats, "annotators")
            return stats, _prior(*stats.agg(F.sum("n_fail"), F.sum("n_pass")).first()), ()
        rows = stats.orderBy("judge").collect()
        return _local(spark, rows), _prior(sum(r.n_fail for r in rows), sum(r.n_pass for r in rows)), tuple((r.judge, r.miss, r.alarm) for r in rows)

    stats, prior, state = cut(statistics(lines.withColumn("q", (F.col("share") > 0.5).cast("double"))))
    seen = {state}
    for _ in range(most_steps):
        new, prior, state = cut(step(stats, prior))
        done = state in seen if few else _same(stats, new)
        stats = new
        seen.add(state)
        if done:
            break
    else:
        raise RuntimeError(f"the consensus still changes after {most_steps} steps")
    weights = _weights(stats)
    value = F.when(F.col("fail"), F.col("if_fail")).otherwise(F.col("if_pass"))
    scores = lines.join(F.broadcast(weights) if few else weights, "judge").groupBy("h1", "h2").agg((F.sum(value) + F.lit(prior)).alias("fail_weight"))
    fail = F.col("fail_weight") > 0
    found = items.join(scores, ["h1", "h2"]).select(
        "item_a", "item_b", F.when(fail, "FAIL").otherwise("PASS").alias("consensus"),
        "fail_weight", F.when(fail, F.col("share")).otherwise(1 - F.col("share")).alias("agreement"), "votes",
    )
    return found, weights.select("judge", F.col("votes").cast(T.LongType()).alias("votes"), "error_fail", "error_pass")


def judgment_votes(solution: DataFrame, deepseek: DataFrame, sympy: DataFrame) -> DataFrame:
    """Votes about candidates from the two judgment tables and the symbolic check."""
    shared = [F.col("id").alias("item_a"), F.col("candidate_index").alias("item_b")]
    last = [F.col("appended_at").alias("at"), F.col("row_no").alias("row")]
    judged = [x.select(*shared, F.col("model").alias("judge"), F.col("verdict").alias("label"), (F.col("parse_status") == "ok").alias("ok"), *last) for x in (solution, deepseek)]
    checked = sympy.select(*shared, F.lit("sympy").alias("judge"), F.col("status").alias("label"), F.lit(True).alias("ok"), *last)
    return votes([*judged, checked])
