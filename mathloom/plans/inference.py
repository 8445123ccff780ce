"""The seam to models: a backend turns prompts into (text, finished) in batches.

The engine runs no model itself.  ``CallableBackend`` wraps any function over a list of prompts,
built once per Python worker; ``RecordedBackend`` replays a table of recorded outputs by prompt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from mathloom.functions import chat, parsing
from mathloom.functions import text as T
from mathloom.operators import keyed

KEY = ["id", "candidate_index"]
#: Candidates of one verifier prompt: some 50 MB of text, far beyond any model's context.
BUNDLE_CANDIDATES = 100_000
Generate = Callable[[list[str]], list[tuple[str, bool]]]


class CallableBackend:
    """``build`` runs on the worker and returns a function from prompts to (text, finished)."""

    def __init__(self, build: Callable[[], Generate], batch: int = 16):
        if batch < 1:
            raise ValueError("batch must be positive")
        self.build, self.batch = build, batch

    def run(self, prompts: DataFrame, key: list[str], prompt: str = "prompt") -> DataFrame:
        build, size = self.build, self.batch
        rows = prompts.select(*key, F.col(prompt).alias("prompt_"))
        kinds = ", ".join(f"`{k}` {prompts.schema[k].dataType.simpleString()}" for k in key)

        def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            generate = None
            for b in batches:
                generate = generate or build()
                for i in range(0, b.num_rows, size):
                    part = b.slice(i, size)
                    out = generate(part.column(len(key)).to_pylist())
                    yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(len(key))), pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.bool_())], [*key, "text", "finished"])

        return rows.mapInArrow(call, f"{kinds}, text string, finished boolean")


class RecordedBackend:
    """Outputs recorded as (prompt_sha256, text, finished); prompts without one give no row."""

    def __init__(self, recorded: DataFrame):
        self.recorded = recorded

    def run(self, prompts: DataFrame, key: list[str], prompt: str = "prompt") -> DataFrame:
        hashed = prompts.select(*key, T.sha256(F.col(prompt)).alias("prompt_sha256"))
        return hashed.join(self.recorded, "prompt_sha256").select(*key, "text", "finished")


def generate(questions: DataFrame, backend, n: int, prompt) -> DataFrame:
    """``n`` candidates of each question (id, question, answer): one row per id and index."""
    if n < 1:
        raise ValueError("n must be positive")
    work = questions.withColumn("candidate_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<string>"))).withColumn("prompt", prompt)
    out = work.join(backend.run(work, ["id", "candidate_index"]), ["id", "candidate_index"]).withColumn("solution", T.strip(F.col("text")))
    out = out.withColumn("p", T.final_answer(F.col("solution"), fallback=True))
    return out.select(
        "id", "candidate_index", "question", "answer", "solution", F.col("p.value").alias("parsed_answer"), F.col("p.method").alias("parser_method"),
        (F.col("p.value") == F.col("answer")).alias("answer_match"), F.when(F.col("finished"), "eos").otherwise("max_tokens").alias("finish_status"),
    )


def solve(questions: DataFrame, backend, model: str = "") -> DataFrame:
    """Independent solutions of questions (id, question), parsed without the fallback."""
    work = questions.withColumn("prompt", chat.independent(F.col("question")))
    out = work.join(backend.run(work, ["id"]), "id").withColumn("solution", T.strip(F.col("text")))
    out = out.withColumn("p", T.final_answer(F.col("solution")))
    return out.select(
        "id", T.sha256(F.col("question")).alias("question_sha256"), F.lit(model).alias("model"), F.col("solution").alias("independent_solution"),
        F.col("p.value").alias("parsed_answer"), F.col("p.method").alias("parser_method"), F.when(F.col("finished"), "eos").otherwise("max_tokens").alias("finish_status"),
    )


def judge(candidates: DataFrame, backend) -> DataFrame:
    """Verdicts about candidates one by one; the prompt is the chat as JSON."""
    work = candidates.withColumn("prompt", F.to_json(chat.judge(F.col("question"), F.col("answer"), F.col("solution"))))
    out = work.join(backend.run(work, KEY), KEY).withColumn("p", parsing.parse_judgment("text"))
    return out.select(*KEY, T.sha256(F.col("solution")).alias("solution_sha256"), F.col("p.verdict").alias("verdict"), F.col("p.reason").alias("reason"), F.col("p.parse_status").alias("parse_status"), F.col("text").alias("raw_judgment"))


def verify(bundles: DataFrame, members: DataFrame, backend) -> DataFrame:
    """Verdicts about all candidates of a bundle at once, in the form ``curation.gate_v2`` takes.

    ``bundles``: (id, bundle, prompt, independent_solution); ``members``: (id, bundle, place,
    candidate_index, solution).  Of items with the same index the last counts; a candidate without
    one gets the defaults.  The raw output is kept once a bundle, with its first candidate.
    """
    key = ["id", "bundle"]
    out = backend.run(bundles, key).withColumn("p", parsing.parse_judgments("text"))
    items = out.select(*key, F.posexplode("p.items").alias("at", "item"))
    last = items.groupBy(*key, F.col("item.candidate_index").alias("candidate_index")).agg(F.max_by("item", "at").alias("item"))
    first = members.groupBy(*key).agg(F.min("place").alias("first_place"))
    known = bundles.select(*key, T.sha256(F.col("independent_solution")).alias("independent_solution_sha256")).join(first, key)
    rows = members.join(out.select(*key, "finished", "text", F.col("p.parse_status").alias("status")), key).join(known, key).join(last, [*key, "candidate_index"], "left")
    verdict, kind = F.coalesce("item.verdict", F.lit("UNCERTAIN")), F.coalesce("item.failure_type", F.lit("OTHER"))
    reason = F.coalesce("item.reason", F.lit("Missing candidate judgment."))
    good = verdict.isin("PASS", "FAIL", "UNCERTAIN") & (reason != "")
    return rows.select(
        "id", "candidate_index", T.sha256(F.col("solution")).alias("solution_sha256"), "independent_solution_sha256", F.when(good, verdict).otherwise("UNCERTAIN").alias("verdict"),
        F.when(good, kind).otherwise("OTHER").alias("failure_type"), F.when(good, reason).otherwise("Invalid verifier item.").alias("reason"),
        F.when(good & F.col("finished") & (F.col("status") == "ok"), "ok").otherwise("incomplete_or_parse_error").alias("parse_status"),
        F.when(F.col("place") == F.col("first_place"), F.col("text")).otherwise("").alias("raw_judgment"),
    )


def bundles(unique: DataFrame, src: DataFrame, solved: DataFrame, most: int = BUNDLE_CANDIDATES, template=None) -> DataFrame:
    """(id, bundle, prompt, independent_solution): one prompt for all unique candidates of a question.

    A question of more than ``most`` candidates gets several, so that a prompt stays a string.
    """
    item = F.struct("dedup_group", F.col("candidate_index").alias("index"), "solution")
    listed = unique.groupBy("id", F.floor(F.col("dedup_group") / most).alias("bundle")).agg(F.array_sort(F.collect_list(item)).alias("c"))
    rows = listed.join(src.where("valid").select("id", "question", "answer"), "id").join(solved.select("id", "independent_solution"), "id")
    user = chat.bundle(F.col("question"), F.col("answer"), F.col("independent_solution"), F.col("c"))
    return rows.select("id", "bundle", chat.opened(user, template).alias("prompt"), "independent_solution")


def bundle_members(unique: DataFrame, most: int = BUNDLE_CANDIDATES) -> DataFrame:
    return unique.select("id", F.floor(F.col("dedup_group") / most).alias("bundle"), F.col("dedup_group").alias("place"), "candidate_index", "solution")


def token_lengths(df: DataFrame, text: str, build: Callable[[], Callable[[list[str]], list[int]]]) -> DataFrame:
    """``df`` with ``tokens``: lengths by a tokenizer that is built once per worker."""
    names = df.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = None
        for b in batches:
            measure = measure or build()
            sizes = measure([t or "" for t in b.column(names.index(text)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int32())], [*names, "tokens"])

    return df.mapInArrow(count, StructType([*df.schema.fields, StructField("tokens", IntegerType())]))


def require_lengths(df: DataFrame, most: int, column: str = "tokens") -> DataFrame:
    """``df`` if no row is longer than ``most`` tokens; raises with their number otherwise."""
    over = df.where(F.col(column) > most).count()
    if over:
        raise ValueError(f"{over} training rows exceed the limit of {most} tokens: raise it, or shorten the solutions")
    return df


def evaluate(questions: DataFrame, backend, prompt, last_number: bool = False) -> DataFrame:
    """Predictions of a model for held-out questions, with their correctness.

    ``last_number``: the prediction is the response's last number, whatever is labelled, and
    neither method nor truncation is told.
    """
    work = questions.withColumn("prompt", prompt)
    out = work.join(backend.run(work, ["id"]), "id")
    if last_number:
        out = out.withColumn("prediction", T.last_number(F.col("text")))
        return out.select("id", "prediction", F.col("text").alias("raw_response"), "answer", (F.col("prediction") == F.col("answer")).alias("correct"))
    out = out.withColumn("p", T.final_answer(T.strip(F.col("text")), fallback=True))
    return out.select(
        "id", F.col("p.value").alias("prediction"), F.col("p.method").alias("parser_method"), F.col("text").alias("raw_response"), "answer",
        (F.col("p.value") == F.col("answer")).alias("correct"), (~F.col("finished")).alias("truncated"),
    )


def resume(work: DataFrame, done: DataFrame, keys: list[str], pairs: list) -> DataFrame:
    """Work left after the finished rows; raises if a finished row is stale or repeated."""
    keyed.assert_unique(done, keys, "finished rows")
    old = keyed.stale(done, work, keys, pairs).first()
    if old:
        raise ValueError(f"stale finished row {[old[k] for k in keys]}")
    return keyed.pending(work, done, keys)


def resume_generation(questions: DataFrame, done: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(questions of which some of the ``n`` candidates are missing, the missing keys).

    Such a question is done over as a whole; of its candidates only those with missing keys are
    written.  Finished rows of other questions or indices, repeated or changed ones raise.
    """
    keyed.assert_unique(done, KEY, "finished candidates")
    wanted = questions.select("id", "question", "answer", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<string>")).alias("candidate_index"))
    old = keyed.stale(done, wanted, KEY, [("question", F.col("question")), ("answer", F.col("answer"))]).first()
    if old:
        raise ValueError(f"stale finished candidate {[old[k] for k in KEY]}")
    missing = keyed.pending(wanted, done, KEY).select(*KEY)
    return questions.join(missing.select("id").distinct(), "id", "left_semi"), missing


def resume_bundles(unique: DataFrame, solved: DataFrame, done: DataFrame) -> DataFrame:
    """Ids of questions whose candidates aren't judged yet.

    Raises if a finished judgment is repeated, its question has no candidates or no independent
    solution any more, its question's candidates aren't just the judged ones, or a solution or the
    independent solution has changed since.
    """
    keyed.assert_unique(done, KEY, "finished judgments")
    now = unique.select(*KEY, T.sha256(F.col("solution")).alias("now"), F.lit(True).alias("here"))
    own = solved.select("id", T.sha256(F.col("independent_solution")).alias("own"))
    judged = done.select(*KEY, "solution_sha256", "independent_solution_sha256", F.lit(True).alias("judged"))
    ids = done.select("id").distinct()
    rows = judged.join(now.join(ids, "id", "left_semi"), KEY, "full").join(own, "id", "left")
    questions = rows.groupBy("id").agg(F.bool_or("here").alias("some"), F.max("own").alias("own_now"))
    rows = rows.join(questions, "id")
    fault = keyed.first_reason([
        ("stale judgment of a question", F.col("some").isNull() | F.col("own_now").isNull()), ("partial or stale judgments", F.col("here").isNull() | F.col("judged").isNull()),
        ("candidate changed after its judgment", F.col("solution_sha256") != F.col("now")), ("independent solution changed after the judgment", F.col("independent_solution_sha256") != F.col("own")),
    ])
    wrong = rows.withColumn("fault", fault).where("fault is not null").orderBy(*KEY).first()
    if wrong:
        raise ValueError(f"{wrong['fault']}: {wrong['id']}/{wrong['candidate_index']}")
    return unique.select("id").distinct().join(ids, "id", "left_anti")
