"""Command line: run one stage over a folder of Parquet tables.

    python -m mathloom.cli STAGE FOLDER OUTPUT [--overwrite | --resume] [--limit N] ...

Stages without a model: reconcile (with its issues), dedup, queue, check, build, build-v1, split.
Stages with one: generate, judge, solve, verify, evaluate; ``--backend module:function`` names a
function without arguments that is called once a worker and returns a function from a list of
prompts to a list of (text, finished).  Each stage writes a summary beside its output.
"""

from __future__ import annotations

import argparse
import json
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mathloom import queries
from mathloom.functions import chat, parsing
from mathloom.operators import curation, keyed
from mathloom.plans import inference
from mathloom.plans.rebuild import Rebuild
from mathloom.scratch import exists
from mathloom.sources import files

KEY = curation.KEY


def _check(r: Rebuild, args) -> DataFrame:
    passed = r.judged.where("verdict = 'PASS' and parse_status = 'ok'").select(*KEY)
    rows = r.unique.join(passed, KEY, "left_semi").select(*KEY, parsing.check_equalities("solution").alias("c"))
    return rows.select(*KEY, F.col("c.status").alias("status"), F.col("c.checked").alias("checked_equalities"), F.col("c.failure").alias("failure"))


DATA = {
    "reconcile": lambda r, a: r.reconciled, "dedup": lambda r, a: r.unique, "queue": lambda r, a: r.queue, "check": _check,
    "build": lambda r, a: r.sft_v2, "build-v1": lambda r, a: r.sft_v1(a.missing), "split": lambda r, a: keyed.hash_split(r.source.where("valid"), a.percent),
}
#: Queries whose one row is a stage's summary.
SUMMARIES = {"reconcile": "reconcile_summary", "dedup": "dedup_summary", "build": "sft_summary_v2", "build-v1": "sft_summary_v1"}


def _questions(r: Rebuild, args) -> DataFrame:
    rows = r.source.where("valid")
    if args.share:
        rows = rows.join(keyed.hash_split(rows, args.percent).where(F.col("share") == args.share).select("id"), "id", "left_semi")
    return keyed.head(rows, args.limit).select("id", "question", "answer")


def _generate(r: Rebuild, args, backend, done: DataFrame | None) -> DataFrame:
    work = _questions(r, args)
    prompt = F.to_json(chat.ask(chat.TEACHER, F.col("question")))
    if done is None:
        return inference.generate(work, backend, args.candidates, prompt)
    work, missing = inference.resume_generation(work, done, args.candidates)
    return inference.generate(work, backend, args.candidates, prompt).join(missing, KEY, "left_semi")


def _judge(r: Rebuild, args, backend, done: DataFrame | None) -> DataFrame:
    rows = r.candidates.where("answer_match").join(_questions(r, args).select("id"), "id", "left_semi")
    if done is not None:
        sha = F.sha2("solution", 256)
        # Finished rows outside the limit aren't stale.
        rows = inference.resume(rows, done.join(rows.select(*KEY), KEY, "left_semi"), KEY, [("solution_sha256", sha)])
    return inference.judge(rows, backend)


def _solve(r: Rebuild, args, backend, done: DataFrame | None) -> DataFrame:
    work = _questions(r, args).select("id", "question")
    if done is not None:
        work = inference.resume(work, done.join(work.select("id"), "id", "left_semi"), ["id"], [("question_sha256", F.sha2("question", 256))])
    return inference.solve(work, backend, args.model)


def _verify(r: Rebuild, args, backend, done: DataFrame | None) -> DataFrame:
    solved = r.independent.where("parser_method = 'final_answer' and finish_status = 'eos'")
    good = solved.join(_questions(r, args).select("id", F.col("answer").alias("label")), "id").where("parsed_answer = label").drop("label")
    if done is not None:
        good = good.join(inference.resume_bundles(r.unique, r.independent, done), "id", "left_semi")
    members = inference.bundle_members(r.unique).join(good.select("id"), "id", "left_semi")
    return inference.verify(inference.bundles(r.unique, r.source, good), members, backend)


def _evaluate(r: Rebuild, args, backend, done: DataFrame | None) -> DataFrame:
    held = curation.source(r.table(args.table)).where("valid")
    work = keyed.head(held, args.limit).select("id", "question", "answer")
    if done is not None:
        work = keyed.pending(work, keyed.assert_unique(done, ["id"], "finished predictions"), ["id"])
    system = chat.ANSWER_ONLY if args.last_number else chat.STUDENT
    return inference.evaluate(work, backend, F.to_json(chat.ask(system, F.col("question"))), args.last_number)


MODEL = {"generate": _generate, "judge": _judge, "solve": _solve, "verify": _verify, "evaluate": _evaluate}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="mathloom")
    parser.add_argument("stage", choices=sorted([*DATA, *MODEL]))
    parser.add_argument("folder")
    parser.add_argument("output")
    both = parser.add_mutually_exclusive_group()
    both.add_argument("--overwrite", action="store_true")
    both.add_argument("--resume", action="store_true", help="write only what a finished output lacks")
    parser.add_argument("--backend", help="module:function of the model, for stages with one")
    parser.add_argument("--model", default="", help="name recorded with independent solutions")
    parser.add_argument("--batch", type=int, default=16)
    parser.add_argument("--limit", type=int, default=0, help="first questions in file order; 0 for all")
    parser.add_argument("--candidates", type=int, default=4)
    parser.add_argument("--percent", type=int, default=70)
    parser.add_argument("--share", choices=["first", "rest"], help="only this part of the questions, by hash")
    parser.add_argument("--missing", choices=["drop", "final-only", "error"], default="final-only")
    parser.add_argument("--table", default="valid_problems", help="held-out questions to evaluate")
    parser.add_argument("--last-number", action="store_true", help="evaluate by the last number of the response")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if args.limit < 0:
        parser.error("--limit must be 0 or positive")
    if args.stage in MODEL and not args.backend:
        parser.error(f"{args.stage} needs a --backend")
    spark = spark or SparkSession.builder.appName("mathloom").getOrCreate()
    files.guard(spark, args.output, args.overwrite or args.resume and args.stage in MODEL)
    r = Rebuild(spark, args.folder)
    if args.stage in MODEL:
        module, function = args.backend.split(":")
        backend = inference.CallableBackend(getattr(import_module(module), function), args.batch)
        done = spark.read.parquet(args.output) if args.resume and exists(spark, args.output) else None
        # What is appended was computed from the output itself, and is written only when it is whole.
        out = MODEL[args.stage](r, args, backend, done)
        files.append_parquet(out, args.output) if done is not None else files.write_parquet(out, args.output, args.overwrite)
    else:
        files.write_parquet(DATA[args.stage](r, args), args.output, args.overwrite)
        if args.stage == "reconcile":
            files.write_parquet(r.issues, f"{args.output.rstrip('/')}.issues", args.overwrite)
    values = {"stage": args.stage, "rows": spark.read.parquet(args.output).count()}
    if args.stage in SUMMARIES:
        values |= files.summary(queries.QUERIES[SUMMARIES[args.stage]](spark, args.folder))
    files.write_summary(spark, values, args.output)
    print(json.dumps(values, indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
