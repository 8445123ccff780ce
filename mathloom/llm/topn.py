"""Top N rows of every group (problem 1).

A histogram of scores per group gives the lowest score bucket that must be kept for N rows to
survive; rows below it are dropped before any row is ranked, so that a group of any size reaches
the exact ranking with few rows.  Rows of one group are spread over many tasks until then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mathloom.functions import text as text_functions
from mathloom.scratch import stage

#: Groups of at most this many rows go straight to the ranking.
SMALL_GROUP = 256
#: Thresholds up to this number are broadcast (some 60 bytes each).
BROADCAST_GROUPS = 100_000


def _thresholds(scored: DataFrame, n: int, small_group: int) -> DataFrame:
    """Group, lowest kept bucket and rows, of each group of more than ``small_group`` rows."""
    bars = scored.groupBy("g_", "b_").agg(F.count("*").alias("rows"))
    group = Window.partitionBy("g_")
    above = F.coalesce(F.sum("rows").over(group.orderBy(F.desc("b_")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = bars.withColumn("above", above).withColumn("size", F.sum("rows").over(group))
    return sized.where((F.col("size") > small_group) & (F.col("above") < n)).groupBy("g_").agg(F.min("b_").alias("least"), F.first("size").alias("size"))


def top_n(
    df: DataFrame, group: str, score: Column, ties: list[Column], n: int, bucket: Column, small_group: int = SMALL_GROUP, broadcast_groups: int = BROADCAST_GROUPS
) -> DataFrame:
    """The ``n`` rows of highest ``score`` of each group, equal scores in the order of ``ties``.

    ``bucket`` is an integer that never falls when the score rises; it should take few values.
    Rows with a null group take no part; null scores rank last.  All columns of ``df`` are kept,
    with ``rank`` (from 1) added; a column of that name is replaced.  Rows equal in score and all ties have an undefined order, so
    the last tie should be unique.
    """
    if n < 1:
        raise ValueError("n must be positive")
    names = [f"t{i}_" for i in range(len(ties))]
    keep = [c for c in df.columns if c != "rank"]
    # The row travels as one value, so that no column of its can clash with those added here.
    scored = df.where(F.col(group).isNotNull()).select(
        F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row_"), F.col(group).alias("g_"), score.alias("s_"), F.coalesce(bucket.cast("long"), F.lit(-(2**62))).alias("b_"), *(t.alias(x) for t, x in zip(ties, names))
    )
    limits = stage(_thresholds(scored, n, small_group), "topn-limits")
    if limits.count() <= broadcast_groups:
        pruned = scored.join(F.broadcast(limits), "g_", "left")
    else:
        # Groups of more than this share of all rows are at most ``broadcast_groups``; a task of the
        # join by group meets no larger one.
        hot = limits.where(F.col("size") > F.lit(scored.count() / max(broadcast_groups, 1)))
        rest = scored.join(F.broadcast(hot.select("g_")), "g_", "left_anti").join(limits, "g_", "left")
        pruned = scored.join(F.broadcast(hot), "g_").unionByName(rest)
    pruned = pruned.where(F.col("least").isNull() | (F.col("b_") >= F.col("least")))
    order = Window.partitionBy("g_").orderBy(F.col("s_").desc_nulls_last(), *names)
    ranked = pruned.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= n)
    return ranked.select("row_.*", F.col("rank_").alias("rank"))


FINAL_LABEL = rf"(?imd){text_functions.FINAL_LABEL}"
CUE, CUE_CAP, LENGTH_SPAN, LENGTH_AIM = text_functions.CUES, text_functions.CUE_CAP, text_functions.LENGTH_SPAN, text_functions.LENGTH_AIM


def clean_id(column: str) -> Column:
    """ASCII letters and digits only, upper-cased."""
    return F.upper(F.regexp_replace(F.col(column), "[^A-Za-z0-9]", ""))


def best_solutions(df: DataFrame, n: int = 3, small_group: int = SMALL_GROUP, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """The ``n`` best candidates of each clean id: ``group``, ``row_no``, ``rank``.

    Rows with null id, candidate_index or solution, or whose index isn't an integer, take no part.
    Of rows with equal clean id and index the smallest row_no counts.  More equation cues come
    first, then a length nearer 700, then the smaller index.
    """
    text = text_functions.strip(F.col("solution"))
    body = F.element_at(F.split(text, FINAL_LABEL, 2), 1)
    rows = df.where(F.col("solution").isNotNull()).select(
        clean_id("id").alias("group"),
        F.expr("try_cast(trim(candidate_index) as decimal(38,0))").alias("index"),
        "row_no",
        F.least(F.regexp_count(body, F.lit(CUE)), F.lit(CUE_CAP)).alias("cues"),
        F.greatest(F.lit(0), LENGTH_SPAN - F.abs(F.length(text) - LENGTH_AIM)).alias("fit"),
    ).where(F.col("group").isNotNull() & F.col("index").isNotNull())
    first = rows.groupBy("group", "index").agg(F.min(F.struct("row_no", "cues", "fit")).alias("row")).select("group", "index", "row.*")
    # Read twice, for the thresholds and for the rows: the texts are scored once.
    first = stage(first, "scored-solutions")
    score = F.col("cues") * (LENGTH_SPAN + 1) + F.col("fit")
    best = top_n(first, "group", score, [F.col("index"), F.col("row_no")], n, F.floor(score / 100), small_group, broadcast_groups)
    return best.select("group", "row_no", "rank")
