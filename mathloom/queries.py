"""Queries over the engine's own operators, for the entry module; SQL for them is in ``oracle``."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom.functions import chat, parsing
from mathloom.functions import text as T
from mathloom.operators import curation, keyed
from mathloom.oracle import ORACLE as ORACLE
from mathloom.plans import inference
from mathloom.plans.rebuild import Rebuild

FLAGSHIP = "missing_policy"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
RATE = 6
#: Folder of the vocabulary files; never copied.
TOKENIZERS = os.environ.get("MATHLOOM_TOKENIZERS", "/opt/tokenizers")


def query(f: Callable[[Rebuild], DataFrame]) -> Callable[[Rebuild], DataFrame]:
    QUERIES[f.__name__] = lambda spark, folder: f(Rebuild(spark, folder))
    return f


def rate(a: Column, b: Column) -> Column:
    """Share rounded for comparison; 0 of an empty table."""
    return F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), RATE)


def longs(df: DataFrame) -> DataFrame:
    """Whole numbers of one width."""
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


def scalar(name: str, value: Callable[[Column], Column], column: str = "solution") -> None:
    """A scalar function over all candidates."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = Rebuild(spark, folder).table("solution_candidates").where(F.col(column).isNotNull())
        return longs(rows.select("row_no", value(F.col(column)).alias("value")))

    QUERIES[name] = run


scalar("normalize_integer", T.normalize_integer, "answer")
scalar("extract_last_number", T.last_number)
scalar("normalize_text", T.collapse)
scalar("normalize_solution_text", T.normalize_solution)
scalar("tokens", lambda c: F.array_join(F.array_sort(T.tokens(T.normalize_solution(c))), " "))
scalar("equation_fingerprint", lambda c: T.equations(T.normalize_solution(c)))
scalar("solution_sha256", T.sha256)
scalar("equation_cues", T.equation_cues)
scalar("length_score", T.length_score)
scalar("count_final_markers", T.final_markers)


def _answers(r: Rebuild, fallback: bool) -> DataFrame:
    rows = r.table("solution_candidates").where("solution is not null").withColumn("p", T.final_answer(F.col("solution"), fallback))
    return rows.select("row_no", F.col("p.value").alias("value"), F.col("p.method").alias("method"))


@query
def extract_final_answer(r):
    return _answers(r, False)


@query
def extract_final_answer_fallback(r):
    return _answers(r, True)


@query
def jaccard(r):
    """Of each candidate to its problem's text."""
    words = lambda c: T.tokens(T.normalize_solution(F.col(c)))
    rows = r.candidates.withColumn("j", F.round(T.jaccard(words("solution"), words("question")), RATE))
    return rows.select("row_no", F.col("j").alias("similarity"))


# Scans and constraints


@query
def scan_math_csv(r):
    return r.source.where("valid").select("id", "question", "answer")


@query
def scan_candidates_checked(r):
    required = ["id", "candidate_index", "question", "answer", "solution", "parsed_answer", "parser_method", "answer_match", "finish_status"]
    return keyed.require(r.table("solution_candidates"), required).select("row_no", *required)


@query
def scan_candidates_eligible(r):
    return r.table("solution_candidates").where("answer_match and parser_method = 'final_answer' and finish_status = 'eos'").select("row_no", "id", "candidate_index")


@query
def scan_judgments_unique(r):
    return keyed.duplicate_keys(r.table("solution_judgments"), curation.KEY)


@query
def scan_sft(r):
    return curation.checked_sft(r.table("reasoning_train_sft")).select("row_no", "problem")


# Predicates and projections


@query
def answer_match(r):
    return r.candidates.select("row_no", ((F.col("parsed_answer") != "") & (F.col("parsed_answer") == F.col("answer"))).alias("matches"))


@query
def label_changed(r):
    return r.reconciled.select("row_no", "original_answer", "answer", "label_changed")


@query
def cheap_filter(r):
    return r.reconciled.select("row_no", curation.cheap_reason().alias("reason"))


@query
def candidate_rejection_reason(r):
    return r.candidates.select("row_no", curation.text_reason().alias("reason"))


@query
def sft_gate_v1(r):
    return r.gated_v1.select("row_no", "reason")


@query
def sft_gate_v2(r):
    return r.gated_v2.select("row_no", "reason")


@query
def verify_eligible(r):
    own = r.independent.where("parser_method = 'final_answer' and finish_status = 'eos'").select("id", F.col("parsed_answer").alias("own"))
    src = r.source.where("valid").select("id", "answer")
    return r.unique.select("id").distinct().join(own, "id").join(src, "id").where("own = answer").select("id")


@query
def sympy_eligible(r):
    return r.judged.where("verdict = 'PASS' and parse_status = 'ok'").select("id", "candidate_index")


@query
def usable_verdict(r):
    return r.judged.select("row_no", curation.usable_verdict().alias("usable"))


@query
def reconcile_projection(r):
    return r.reconciled.select("row_no", "id", "candidate_index", "question", "answer", "parsed_answer", "parser_method", "answer_match", "finish_status", "original_answer", "label_changed")


@query
def sft_projection(r):
    return r.sft_v1("drop")


@query
def missing_policy(r):
    return r.sft_v1("final-only")


@query
def recommended_action(r):
    return r.queue.select("id", "recommended_next_action")


# Joins


@query
def reconcile_join(r):
    good = r.reconciled.groupBy(F.lit("RECONCILED").alias("outcome")).agg(F.count("*").alias("rows"))
    return good.unionByName(r.issues.groupBy(F.col("issue").alias("outcome")).agg(F.sum("candidate_rows").alias("rows")))


@query
def composite_lookup(r):
    """Solution hash of each judged candidate."""
    return r.judged.join(r.candidates.select(*curation.KEY, T.sha256(F.col("solution")).alias("sha")), curation.KEY).select("row_no", "sha")


@query
def sympy_lookup(r):
    status = keyed.last_by(r.checks.select(*curation.KEY, "status", "row_no"), curation.KEY).select(*curation.KEY, "status")
    return r.judged.join(status, curation.KEY, "left").select("row_no", F.coalesce("status", F.lit("")).alias("status"))


@query
def semi_join_selected(r):
    return r.candidates.join(r.table("reasoning_train_sft").select("id"), "id", "left_semi").select("row_no")


@query
def anti_join_rejudge(r):
    return r.judged.join(r.queue.select("id"), "id", "left_anti").select("row_no")


@query
def anti_join_resume(r):
    return keyed.pending(r.candidates.where("answer_match"), r.table("solution_judgments"), curation.KEY).select("row_no")


@query
def id_overlap_check(r):
    return keyed.overlap(r.table("problems"), r.table("reasoning_train_sft"))


@query
def question_profile_join(r):
    return r.profiled.select("id", "reconciled_candidates", "unique_matching_candidates", F.coalesce("own_answer", F.lit("")).alias("own_answer"), "passes", "fails", "unsure", "judged", "sympy_fail", "usable")


@query
def judgment_items(r):
    """Each judged candidate's item in its question's raw output; a missing one gets the defaults."""
    return _judgment_items(r).select("row_no", "item_verdict", "item_status")


def _judgment_items(r: Rebuild) -> DataFrame:
    parsed = r.judged.where("raw_judgment != ''").withColumn("p", parsing.parse_judgments("raw_judgment"))
    items = parsed.select("id", F.col("row_no").alias("raw_row"), F.posexplode("p.items").alias("place", "item"))
    last = items.groupBy("id", F.col("item.candidate_index").alias("candidate_index")).agg(F.max_by("item", F.struct("raw_row", "place")).alias("item"))
    raw = parsed.groupBy("id").agg(F.max_by(F.col("p.parse_status"), F.col("row_no")).alias("raw_status"))
    rows = r.judged.join(last, curation.KEY, "left").join(raw, "id", "left")
    verdict, reason = F.coalesce("item.verdict", F.lit("UNCERTAIN")), F.coalesce("item.reason", F.lit("Missing candidate judgment."))
    good = verdict.isin("PASS", "FAIL", "UNCERTAIN") & (reason != "")
    status = F.when(good & (F.col("raw_status") == "ok") & (F.col("parse_status") == "ok"), "ok").otherwise("incomplete_or_parse_error")
    return rows.withColumn("item_verdict", F.when(good, verdict).otherwise("UNCERTAIN")).withColumn("item_status", status)


# Aggregates


@query
def count_per_id(r):
    return r.reconciled.groupBy("id").agg(F.count("*").alias("rows"))


@query
def verdict_counts(r):
    return curation.verdict_counts(r.judged)


@query
def sympy_fail_count(r):
    return r.checks.where("status = 'FAIL'").groupBy("id").agg(F.count("*").alias("rows"))


@query
def issue_rollup(r):
    return r.issues


@query
def reason_set(r):
    return r.queue.select("id", "reason_codes")


@query
def usable_passes(r):
    return r.profiled.select("id", F.col("usable").alias("usable_passes"))


@query
def rejudge_queue(r):
    return r.queue


@query
def reason_histogram(r):
    return keyed.histogram(r.queue.select(F.explode(F.split("reason_codes", "\\|")).alias("reason")), "reason")


@query
def action_histogram(r):
    return keyed.histogram(r.queue, "recommended_next_action")


@query
def rejection_histogram(r):
    return keyed.histogram(r.gated_v2, "reason")


@query
def generation_summary(r):
    rows = r.candidates.join(r.source.where("valid").select("id"), "id", "left_semi")
    total = r.source.where("valid").agg(F.count("*").alias("questions"))
    out = rows.agg(F.count("*").alias("candidate_rows"), F.count_if("answer_match").alias("matched_rows"), F.countDistinct(F.when(F.col("answer_match"), F.col("id"))).alias("covered"))
    return out.crossJoin(total).withColumn("coverage", rate(F.col("covered"), F.col("questions")))


@query
def judge_summary(r):
    good = (F.col("verdict") == "PASS") & (F.col("parse_status") == "ok")
    out = r.judged_v1.agg(F.count("*").alias("judged"), F.count_if(good).alias("passed"), F.count_if(F.col("parse_status") != "ok").alias("parse_errors"))
    return out.withColumn("failed", F.col("judged") - F.col("passed")).withColumn("pass_rate", rate(F.col("passed"), F.col("judged")))


@query
def independent_summary(r):
    total = r.source.where("valid").agg(F.count("*").alias("questions"))
    return r.independent.agg(F.count("*").alias("completed"), F.count_if(F.expr("parsed_answer != ''")).alias("parsed"), F.count_if(F.expr("finish_status = 'eos'")).alias("finished")).crossJoin(total)


@query
def verify_summary(r):
    v = F.col("verdict")
    return r.judged.agg(F.count("*").alias("rows"), *(F.count_if(v == x).alias(x.lower()) for x in ("PASS", "FAIL", "UNCERTAIN")), F.count_if(F.col("parse_status") != "ok").alias("parse_errors"))


@query
def sympy_summary(r):
    return r.checks.agg(F.count("*").alias("rows"), *(F.count_if(F.col("status") == x).alias(x.lower()) for x in ("PASS", "FAIL", "NOT_APPLICABLE")))


@query
def reconcile_summary(r):
    return r.reconciled.agg(F.count("*").alias("reconciled"), F.count_if("label_changed").alias("label_changed_rows"), F.count_if(F.expr("not label_changed")).alias("unchanged_rows"), F.countDistinct("id").alias("questions"))


@query
def dedup_summary(r):
    why = r.reconciled.select(curation.cheap_reason().alias("why"))
    names = ("answer_mismatch", "missing_final_marker", "truncated")
    rows = why.agg(F.count("*").alias("input_rows"), F.count_if(F.expr("why is null")).alias("eligible_before_dedup"), *(F.count_if(F.col("why") == n).alias(n) for n in names))
    kept = r.unique.agg(F.count("*").alias("unique_rows"), F.countDistinct("id").alias("questions"), F.max("dedup_group").alias("largest_group"))
    return rows.crossJoin(kept).withColumn("duplicate_rows_removed", F.col("eligible_before_dedup") - F.col("unique_rows"))


@query
def sft_summary_v1(r):
    """With the first 20 ids, in the problems' order, that have no accepted solution."""
    order = r.source.where("valid").select("id", "row_no")
    rows = r.sft_v1("final-only").join(order, "id")
    made = F.col("solution_source") != "final-only-fallback"
    out = rows.agg(F.count("*").alias("sft_rows"), F.count_if(made).alias("reasoning_rows"), F.count_if(~made).alias("final_only_rows"))
    first = rows.where(~made).orderBy("row_no").limit(20).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "id"))), lambda x: x["id"]), "|").alias("missing_examples"))
    out = out.crossJoin(order.agg(F.count("*").alias("source_rows"))).crossJoin(first)
    return out.withColumn("dropped_rows", F.col("source_rows") - F.col("sft_rows")).withColumn("coverage", rate(F.col("reasoning_rows"), F.col("source_rows")))


@query
def sft_summary_v2(r):
    total = r.source.where("valid").agg(F.count("*").alias("source_rows"))
    return r.sft_v2.agg(F.count("*").alias("sft_rows")).crossJoin(total).withColumn("coverage", rate(F.col("sft_rows"), F.col("source_rows")))


def _predictions(r: Rebuild) -> DataFrame:
    """Each candidate as a prediction for its problem's current label."""
    rows = r.candidates.join(r.source.where("valid").select("id", F.col("answer").alias("label")), "id").withColumn("p", T.final_answer(F.col("solution")))
    return rows.select("row_no", F.col("p.value").alias("prediction"), F.col("p.method").alias("method"), (F.col("p.value") == F.col("label")).alias("correct"), (F.col("finish_status") != "eos").alias("truncated"))


@query
def correct_flags(r):
    return _predictions(r).select("row_no", "correct", "truncated")


@query
def eval_summary_v2(r):
    out = _predictions(r).agg(
        F.count("*").alias("rows"), F.count_if("correct").alias("correct"), F.count_if(F.expr("prediction = ''")).alias("parse_failures"),
        F.count_if(F.expr("method = 'final_answer'")).alias("marker_parses"), F.count_if("truncated").alias("truncated"),
    )
    n = F.col("rows")
    return out.withColumns({"accuracy": rate(F.col("correct"), n), "parse_failure_rate": rate(F.col("parse_failures"), n), "truncation_rate": rate(F.col("truncated"), n)})


@query
def eval_summary_v1(r):
    """The prediction is the last number of the text."""
    rows = r.candidates.join(r.source.where("valid").select("id", F.col("answer").alias("label")), "id").withColumn("prediction", T.last_number(F.col("solution")))
    out = rows.agg(F.count("*").alias("rows"), F.count_if(F.expr("prediction != ''")).alias("valid_predictions"), F.count_if(F.expr("prediction = label")).alias("correct"))
    return out.withColumn("accuracy", rate(F.col("correct"), F.col("rows")))


@query
def length_percentiles(r):
    """Characters of the completions."""
    rows = r.table("reasoning_train_sft").select(F.length("completion").alias("size"))
    return longs(keyed.nearest_rank(rows, "size", limit=600))


@query
def token_length_percentiles(r):
    """Tokens of whole training examples: system text, question and completion, by a public tokenizer."""
    m = chat.training_example(chat.STUDENT, F.col("question"), F.col("completion"))
    parts = [m["prompt"][0]["content"], m["prompt"][1]["content"], m["completion"][0]["content"]]
    rows = r.table("reasoning_train_sft").where("question is not null and completion is not null").select(F.concat_ws("\n", *parts).alias("example"))
    return longs(keyed.nearest_rank(inference.token_lengths(rows, "example", _tokenizer).select("tokens"), "tokens", limit=600))


def _tokenizer() -> Callable[[list[str]], list[int]]:
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json").encode_batch
    return lambda texts: [len(x.ids) for x in encode(texts, add_special_tokens=False)]


# Order, top 1, partitions


@query
def best_candidate_v2(r):
    return curation.best(r.eligible).select("id", "candidate_index")


@query
def best_candidate_v1(r):
    return curation.best(r.reconciled.where("answer_match"), prefer_finished=True).select("id", "candidate_index")


@query
def first_exact_dedup(r):
    rows = r.candidates.withColumn("form", T.collapse(F.col("solution")))
    return rows.groupBy("id", "form").agg(F.min("row_no").alias("row_no")).select("row_no")


@query
def greedy_near_dedup(r):
    return r.unique.select("row_no", "id", "candidate_index")


@query
def dedup_group(r):
    return r.unique.select("row_no", "dedup_group")


@query
def hash_rank_partition(r):
    return keyed.hash_split(r.table("problems"), 70)


@query
def first_seen_ids(r):
    return keyed.first_seen(r.table("solution_candidates").where("id is not null"))


@query
def head_limit(r):
    return keyed.head(r.table("problems"), 20).select("id", "row_no")


@query
def best_epoch(r):
    """The judge, as an epoch: pass rate, then parse failures, then the smaller name.

    No table of epochs is given; judgments have no truncation, so that rate is 0.
    """
    ok, n = F.upper(T.strip(F.col("verdict"))) == "PASS", F.count("*")
    rates = r.table("solution_judgments").groupBy("model").agg((F.count_if(ok) / n).alias("accuracy"), (F.count_if(F.col("parse_status") != "ok") / n).alias("parse_failure_rate"))
    return keyed.best_epoch(rates.withColumn("truncation_rate", F.lit(0.0)), "model")


# Sets


@query
def bundle_indices(r):
    """Ids whose judged candidates are exactly their unique ones."""
    have = r.unique.groupBy("id").agg(F.count("*").alias("n"))
    both = r.judged.join(r.unique.select(*curation.KEY), curation.KEY, "left_semi").groupBy("id").agg(F.count("*").alias("m"))
    judged = r.judged.groupBy("id").agg(F.count("*").alias("j"))
    return have.join(both, "id").join(judged, "id").where("n = m and m = j").select("id")


@query
def incomplete_bundles(r):
    missing = r.unique.join(r.judged.select(*curation.KEY), curation.KEY, "left_anti").groupBy("id").agg(F.count("*").alias("missing"))
    return missing.join(r.judged.select("id"), "id", "left_semi")


@query
def stale_judgments(r):
    now = r.candidates.withColumn("sha", T.sha256(F.col("solution")))
    return keyed.stale(r.judged_v1, now, curation.KEY, [("solution_sha256", F.col("sha"))]).select("row_no")


@query
def stale_independent(r):
    now = r.source.where("valid").withColumn("sha", T.sha256(F.col("question")))
    return keyed.stale(r.independent, now, ["id"], [("question_sha256", F.col("sha"))]).select("id")


# Prompts


def _chat(r: Rebuild, system: str) -> DataFrame:
    m = chat.ask(system, F.col("question"))
    return r.source.where("valid").select("id", m[0]["content"].alias("system"), m[1]["content"].alias("user"))


@query
def teacher_messages(r):
    return _chat(r, chat.TEACHER)


@query
def student_messages(r):
    return _chat(r, chat.STUDENT)


@query
def answer_messages(r):
    return _chat(r, chat.ANSWER_ONLY)


@query
def judge_messages(r):
    m = chat.judge(F.col("question"), F.col("answer"), F.col("solution"))
    return r.candidates.select("row_no", m[1]["content"].alias("user"))


@query
def independent_prompt(r):
    return r.source.where("valid").select("id", chat.opened(chat.independent(F.col("question"))).alias("prompt"))


@query
def training_example(r):
    rows = r.table("reasoning_train_sft").where("question is not null and completion is not null")
    x = chat.training_example(chat.STUDENT, F.col("question"), F.col("completion"))
    return rows.select("row_no", x["prompt"][1]["content"].alias("user"), x["completion"][0]["content"].alias("assistant"))


@query
def verifier_prompt(r):
    """Prompts of the questions with unique candidates and an independent solution: one a question."""
    return inference.bundles(r.unique, r.source, r.independent).select("id", "bundle", "prompt")


# Parsed outputs


@query
def parse_judgment_v1(r):
    rows = r.table("solution_judgments").withColumn("p", parsing.parse_judgment("raw_judgment"))
    return rows.select("row_no", F.col("p.verdict").alias("verdict"), F.col("p.reason").alias("reason"), F.col("p.parse_status").alias("parse_status"))


@query
def parse_judgments_v2(r):
    rows = r.table("deepseek_candidate_judgments").withColumn("p", parsing.parse_judgments("raw_judgment"))
    return rows.select("row_no", F.col("p.parse_status").alias("parse_status"), F.size("p.items").alias("items"))


@query
def check_equalities(r):
    rows = r.table("solution_candidates").where("solution is not null").withColumn("c", parsing.check_equalities("solution"))
    return rows.select("row_no", F.col("c.status").alias("status"), F.col("c.checked").alias("checked_equalities"), F.col("c.failure").alias("failure"))


@query
def sft_v2(r):
    return r.sft_v2
