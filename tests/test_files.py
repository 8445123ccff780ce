import hashlib
import os

import pytest
from pyspark.sql import functions as F

from mathloom.functions import text as T
from mathloom.plans.inference import CallableBackend, RecordedBackend, evaluate, generate, judge, require_lengths, resume, resume_bundles, resume_generation, solve, token_lengths, verify
from mathloom.sources import files
from mathloom.streaming.incremental import work_off


def test_csv_round_trip_is_exact(spark, tmp_path):
    texts = ["plain", "line\r\nbreak", 'quote "x", comma', "", "back\\slash", "é 한", " blank "]
    df = spark.createDataFrame([(str(i), t, i % 2 == 0, i) for i, t in enumerate(texts)], "id string, t string, ok boolean, row_no long")
    path = str(tmp_path / "out" / "a.csv")
    assert files.write_csv(df, path) == len(texts)
    assert open(path, "rb").read().startswith(b"\xef\xbb\xbfid,t,ok\r\n")
    back = files.read_csv(spark, path, ["id", "t", "ok"], exact=True).orderBy("row_no")
    assert [r.t for r in back.collect()] == texts and [r.ok for r in back.collect()][:2] == ["True", "False"]
    hashes = [r[0] for r in back.select(T.sha256(F.col("t"))).collect()]
    assert hashes == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    with pytest.raises(FileExistsError):
        files.write_csv(df, path)
    with pytest.raises(ValueError):
        files.read_csv(spark, path, ["missing"])


def test_missing_and_empty_files_are_empty_tables(spark, tmp_path):
    empty = tmp_path / "e.csv"
    empty.write_text("")
    for path in (str(tmp_path / "none.csv"), str(empty)):
        assert files.read_or_empty(spark, path, ["id"]).collect() == []
    (tmp_path / "h.csv").write_text("id,x\n")
    assert files.read_or_empty(spark, str(tmp_path / "h.csv"), ["id"]).columns == ["id", "x", "row_no"]


def test_summaries_and_checkpoints(spark, tmp_path):
    path = files.write_summary(spark, {"rows": 2, "eval": {"loss": 0.5}}, str(tmp_path / "x.parquet"))
    assert path.endswith("x.summary.json") and files.read_summary(spark, path, "eval", "loss") == 0.5 and files.read_summary(spark, path, "no", default=1) == 1
    for n, state in (("checkpoint-9", True), ("checkpoint-10", True), ("checkpoint-11", False), ("checkpoint-x", True)):
        os.makedirs(tmp_path / "m" / n)
        if state:
            (tmp_path / "m" / n / "trainer_state.json").write_text("{}")
    assert [os.path.basename(x) for x in files.checkpoints(spark, str(tmp_path / "m"))] == ["checkpoint-x", "checkpoint-9", "checkpoint-10"]
    assert files.checkpoints(spark, str(tmp_path / "no")) == []
    assert files.display_path("/a/b/c", "/a") == "b/c" and files.display_path("/ab/c", "/a") == "/ab/c" and files.display_path("x/y", "/a") == "x/y"


def test_other_file_systems_are_asked(spark, tmp_path):
    """A path of another scheme than the local disk's: nothing is taken for missing."""
    (tmp_path / "real").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.away.link./data", f"file://{tmp_path}/real")
    base = "viewfs://away/data"
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, row_no long")
    assert files.write_csv(df, f"{base}/t.csv") == 2
    assert sorted(r.id for r in files.read_or_empty(spark, f"{base}/t.csv", ["id"]).collect()) == ["a", "b"]
    with pytest.raises(FileExistsError):
        files.guard(spark, f"{base}/t.csv", False)
    files.guard(spark, f"{base}/none.csv", False)
    assert files.read_or_empty(spark, f"{base}/none.csv", ["id"]).collect() == []
    for _ in range(2):
        df.write.mode("append").parquet(f"{base}/in")
        q = work_off(spark.readStream.schema("id string, row_no long").parquet(f"{base}/in"), ["id"], lambda x: x, f"{base}/out", f"{base}/progress")
        q.awaitTermination(60)
        q.stop()
    assert sorted(r.id for r in spark.read.parquet(f"{base}/out").collect()) == ["a", "b"]


def test_files_of_a_folder_are_numbered_by_name(spark, tmp_path):
    for name, ids in (("b.csv", "c"), ("a.csv", "ab"), ("c.csv", "")):
        (tmp_path / name).write_text("id\n" + "".join(f"{i}\n" for i in ids))
    got = files.read_csv(spark, str(tmp_path)).orderBy("row_no").collect()
    assert [r.id for r in got] == ["a", "b", "c"] and [r.row_no >> 40 for r in got] == [0, 0, 1]


def build():
    return lambda prompts: [(f" Final answer: {len(p)} ", len(p) < 4) for p in prompts]


def test_backends(spark):
    q = spark.createDataFrame([("a", "xyz", "3"), ("b", "wxyz", "9")], "id string, question string, answer string")
    out = {(r.id, r.candidate_index): r for r in generate(q, CallableBackend(build, 2), 2, F.col("question")).collect()}
    assert len(out) == 4 and out["a", "0"].answer_match and out["b", "1"].finish_status == "max_tokens"
    recorded = spark.createDataFrame([(hashlib.sha256(b"xyz").hexdigest(), "Final answer: 3", True)], "prompt_sha256 string, text string, finished boolean")
    got = evaluate(q, RecordedBackend(recorded), F.col("question")).collect()
    assert len(got) == 1 and got[0].correct and not got[0].truncated


VERDICTS = '{"judgments": [{"candidate_index": 0, "verdict": "PASS", "reason": "x"}, {"candidate_index": 0, "verdict": "fail", "reason": "y"}, {"candidate_index": 1, "verdict": "maybe", "reason": "z"}]}'


def test_solve_judge_verify(spark):
    q = spark.createDataFrame([("a", "0", "q", "5", "s")], "id string, candidate_index string, question string, answer string, solution string")
    solved = solve(q.select("id", "question"), CallableBackend(lambda: lambda ps: [("w\nFinal answer: 5 ", True) for _ in ps]), "m").first()
    assert (solved.parsed_answer, solved.parser_method, solved.finish_status, solved.independent_solution) == ("5", "final_answer", "eos", "w\nFinal answer: 5")
    judged = judge(q, CallableBackend(lambda: lambda ps: [('{"verdict": "fail", "reason": "no"}', True) for _ in ps])).first()
    assert (judged.verdict, judged.parse_status, judged.solution_sha256) == ("FAIL", "ok", hashlib.sha256(b"s").hexdigest())
    text = VERDICTS
    bundles = spark.createDataFrame([("a", 0, "p", "own")], "id string, bundle int, prompt string, independent_solution string")
    members = spark.createDataFrame([("a", 0, i + 3, str(i), "s") for i in range(3)], "id string, bundle int, place int, candidate_index string, solution string")
    rows = verify(bundles, members, CallableBackend(lambda: lambda ps: [(text, True) for _ in ps])).collect()
    assert {r.candidate_index: r.raw_judgment for r in rows} == {"0": text, "1": "", "2": ""}
    assert {r.independent_solution_sha256 for r in rows} == {hashlib.sha256(b"own").hexdigest()}
    got = {r.candidate_index: (r.verdict, r.reason, r.parse_status) for r in rows}
    assert got == {"0": ("FAIL", "y", "ok"), "1": ("UNCERTAIN", "Invalid verifier item.", "incomplete_or_parse_error"), "2": ("UNCERTAIN", "Missing candidate judgment.", "ok")}
    sized = token_lengths(q, "question", lambda: lambda ts: [len(t) for t in ts])
    assert sized.first().tokens == 1 and require_lengths(sized, 1).count() == 1
    with pytest.raises(ValueError, match="1 training rows"):
        require_lengths(sized, 0)
    last = evaluate(q, CallableBackend(lambda: lambda ps: [("3 then 5", False) for _ in ps]), F.col("question"), last_number=True).first()
    assert last.prediction == "5" and last.correct and "truncated" not in last.asDict()


def test_generation_is_resumed_by_question(spark):
    q = spark.createDataFrame([("a", "x", "1"), ("b", "y", "2")], "id string, question string, answer string")
    done = spark.createDataFrame([("a", "0", "x", "1"), ("a", "1", "x", "1"), ("b", "1", "y", "2")], "id string, candidate_index string, question string, answer string")
    work, missing = resume_generation(q, done, 2)
    assert [r.id for r in work.collect()] == ["b"] and [tuple(r) for r in missing.collect()] == [("b", "0")]
    for wrong in (done.withColumn("question", F.lit("z")), done.union(done), done.withColumn("candidate_index", F.col("candidate_index") + 1)):
        with pytest.raises(ValueError):
            resume_generation(q, wrong, 2)


def test_bundles_are_resumed_whole(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    unique = spark.createDataFrame([("a", "0", "s"), ("a", "1", "t"), ("b", "0", "u")], "id string, candidate_index string, solution string")
    solved = spark.createDataFrame([("a", "own"), ("b", "own")], "id string, independent_solution string")
    schema = "id string, candidate_index string, solution_sha256 string, independent_solution_sha256 string"
    good = [("a", "0", sha("s"), sha("own")), ("a", "1", sha("t"), sha("own"))]
    left = lambda rows: [r.id for r in resume_bundles(unique, solved, spark.createDataFrame(rows, schema)).collect()]
    assert left(good) == ["b"] and sorted(left([])) == ["a", "b"]
    for rows, why in ((good[:1], "partial"), ([*good, ("a", "2", sha("s"), sha("own"))], "partial"), ([*good, ("c", "0", "x", "y")], "stale judgment"), ([("b", "0", sha("x"), sha("own"))], "candidate changed"), ([("b", "0", sha("u"), sha("x"))], "independent solution changed"), (good + good, "repeated")):
        with pytest.raises(ValueError, match=why):
            left(rows)


def echo():
    return lambda prompts: [("work\nFinal answer: 5", True) for _ in prompts]


def test_commands(spark, tmp_path):
    from mathloom import cli

    problems = [("a", "What is it?", "5", 1), ("b", "And this?", "6", 2)]
    for name in ("problems", "valid_problems"):
        spark.createDataFrame(problems, "id string, question string, answer string, row_no long").write.parquet(f"{tmp_path}/{name}.parquet")
    out = str(tmp_path / "generated")
    run = lambda *x: cli.main([*x], spark)
    common = ["--backend", "tests.test_files:echo", "--candidates", "2"]
    assert run("generate", str(tmp_path), out, *common, "--limit", "1") == 0 and spark.read.parquet(out).count() == 2
    with pytest.raises(FileExistsError):
        run("generate", str(tmp_path), out, *common)
    assert run("generate", str(tmp_path), out, *common, "--resume") == 0 and spark.read.parquet(out).count() == 4
    assert files.read_summary(spark, f"{tmp_path}/generated.summary.json", "rows") == 4
    done = spark.read.parquet(out)
    assert {(r.id, r.answer_match) for r in done.collect()} == {("a", True), ("b", False)}
    assert run("evaluate", str(tmp_path), str(tmp_path / "eval"), "--backend", "tests.test_files:echo", "--last-number") == 0
    assert sorted((r.id, r.correct) for r in spark.read.parquet(str(tmp_path / "eval")).collect()) == [("a", True), ("b", False)]
    assert run("split", str(tmp_path), str(tmp_path / "split"), "--percent", "50") == 0
    with pytest.raises(SystemExit):
        run("solve", str(tmp_path), out)


def test_resume(spark):
    work = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, t string")
    done = spark.createDataFrame([("a", "1")], "id string, h string")
    assert [r.id for r in resume(work, done, ["id"], [("h", F.col("t"))]).collect()] == ["b"]
    with pytest.raises(ValueError, match="stale"):
        resume(work, done.withColumn("h", F.lit("x")), ["id"], [("h", F.col("t"))])
    with pytest.raises(ValueError, match="repeated"):
        resume(work, done.union(done), ["id"], [("h", F.col("t"))])


def test_stream_works_each_key_once(spark, tmp_path):
    source, output, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    spark.createDataFrame([("a", 1), ("b", 5), ("b", 2)], "id string, v int").write.parquet(source)

    def start():
        q = work_off(spark.readStream.schema("id string, v int").parquet(source), ["id"], lambda df: df.withColumn("w", F.col("v") + 1), output, progress)
        q.awaitTermination(60)
        q.stop()

    start()
    spark.createDataFrame([("b", 7), ("c", 3)], "id string, v int").write.mode("append").parquet(source)
    start()
    assert sorted((r.id, r.w) for r in spark.read.parquet(output).collect()) == [("a", 2), ("b", 3), ("c", 4)]
