"""Queries over the problems of training data, for the entry module."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.llm import consensus, defects, format_dup, leak, near_dup, overlap, repetition, tokenizer, topn
from mathloom.llm.oracle import ORACLE

#: Folder of the vocabulary files; never copied.
TOKENIZERS = os.environ.get("MATHLOOM_TOKENIZERS", "/opt/tokenizers")
Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.best_solutions(_read(spark, d, "solution_candidates"), 3).select("row_no")


def _consensus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    tables = (_read(spark, d, t) for t in ("solution_judgments", "deepseek_candidate_judgments", "sympy_crosschecks"))
    return consensus.discover(consensus.judgment_votes(*tables))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    items, _ = _consensus(spark, d)
    return items.where("consensus = 'FAIL'").select(F.col("item_a").alias("id"), F.col("item_b").alias("candidate_index"))


def p2_judges(spark: SparkSession, d: str) -> DataFrame:
    _, judges = _consensus(spark, d)
    return judges.select("judge", "votes", F.round("error_fail", 4).alias("error_fail"), F.round("error_pass", 4).alias("error_pass"))


def _solutions(spark: SparkSession, d: str) -> DataFrame:
    first = _read(spark, d, "solution_candidates").select(F.col("row_no").alias("row"), F.col("solution").alias("text"))
    return first.unionByName(_read(spark, d, "reasoning_train_sft").select(F.col("row_no").alias("row"), F.col("completion").alias("text")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_pairs(_solutions(spark, d), 0.6, 3, 30)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_groups(_solutions(spark, d), 0.6, 3, 30).select(F.col("row").alias("row_no"), "group", "links")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.broken_pairs(_read(spark, d, "solution_candidates")).select("row_no", "defect")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return format_dup.hidden_duplicates(_read(spark, d, "solution_candidates"), topn.clean_id("id"))


def _overlaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    held, train = _read(spark, d, "valid_problems"), _read(spark, d, "reasoning_train_sft")
    return overlap.split_overlaps(held, train, key=topn.clean_id("id")), held, train


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found, _, _ = _overlaps(spark, d)
    return found.select(F.col("left_row").alias("eval_row"), F.col("right_row").alias("train_row"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    found, held, train = _overlaps(spark, d)
    return overlap.report(found, held, train, "eval_split", "solution_source")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(_read(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_spans(_read(spark, d, "documents"), _read(spark, d, "benchmark"), 12).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(_read(spark, d, "documents")).select("doc_id")


def p9_share(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(_read(spark, d, "documents")).select("doc_id", "words", F.round("repeated_share", 6).alias("repeated_share"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p2_found, p2_judges, p3_found, p3_groups, p4_found, p5_found, p6_found, p6_report, p7_ids, p8_found, p9_found, p9_share)
}
