import hashlib
import random

import pytest
from pyspark.sql import functions as F

from mathloom.functions import text as T
from mathloom.operators import curation, keyed


def test_last_first_and_duplicates(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", None, 3), (None, "z", 4), (None, "w", 5)], "id string, v string, row_no long")
    assert {(r.id, r.v) for r in keyed.last_by(df, ["id"]).collect()} == {("a", "y"), ("b", None), (None, "w")}
    assert {(r.id, r.v) for r in keyed.first_by(df, ["id"]).collect()} == {("a", "x"), ("b", None), (None, "z")}
    assert {(r.id, r.rows) for r in keyed.duplicate_keys(df, ["id"]).collect()} == {("a", 2), (None, 2)}
    with pytest.raises(ValueError):
        keyed.assert_unique(df, ["id"])
    assert keyed.assert_unique(df.limit(0), ["id"]).count() == 0


def test_required_columns_and_disjoint_keys(spark):
    df = spark.createDataFrame([("a", 1)], "id string, row_no long")
    assert keyed.require(df, ["id"]) is df
    for columns, exact in ((["x"], False), (["id"], True)):
        with pytest.raises(ValueError):
            keyed.require(df, columns, exact)
    with pytest.raises(ValueError, match="'a'"):
        keyed.assert_disjoint(df, df)
    keyed.assert_disjoint(df, df.limit(0))


def test_hash_split_is_exact(spark):
    for n, percent in ((10, 70), (3, 50), (1000, 33), (257, 99), (0, 50)):
        ids = [f"id{i}" for i in range(n)]
        df = spark.createDataFrame([(i,) for i in ids + ids], "id string")
        ranked = sorted(ids, key=lambda x: hashlib.sha256(x.encode()).digest())
        first = set(ranked[: n * percent // 100])
        got = keyed.hash_split(df, percent).collect()
        assert {r.id for r in got if r.share == "first"} == first and len(got) == n
    with pytest.raises(ValueError):
        keyed.hash_split(df, 100)


def test_ordinal_across_blocks(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(50), i) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, place int, row_no long")
    got = {r.row_no: r.n for r in keyed.ordinal(df, "id", "place", "n", "row_no", width=4).collect()}
    for key in "ab":
        for n, (_, r) in enumerate(sorted((p, r) for k, p, r in rows if k == key)):
            assert got[r] == n


def test_percentiles(spark):
    row = keyed.nearest_rank(spark.range(1, 21), "id", limit=15).first()
    assert (row.p50, row.p95, row.p99, row.max, row.over_limit) == (10, 19, 20, 20, 5)


def test_stale_and_pending(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "id string, t string")
    done = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "9")], "id string, h string")
    assert {r.id for r in keyed.stale(done, now, ["id"], [("h", F.col("t"))]).collect()} == {"b", "d"}
    assert {r.id for r in keyed.pending(now, done, ["id"]).collect()} == {"c"}


def greedy(rows, threshold):
    """Plain form of the greedy choice: rows of (id, index, row, norm, equations, tokens)."""
    kept, out = {}, {}
    for i, _, r, norm, eq, toks in sorted(rows, key=lambda x: (x[1], x[2])):
        mine = kept.setdefault(i, [])
        for n, e, t in mine:
            union = len(t | toks)
            if n == norm or (eq and e == eq and (len(t & toks) / union if union else 1.0) >= threshold):
                break
        else:
            out[r] = len(mine)
            mine.append((norm, eq, toks))
    return out


def test_near_dedup_equals_the_plain_greedy_choice(spark):
    rng = random.Random(3)
    rows = []
    for n in range(500):
        words = [f"w{i}" for i in range(14)]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(14)] = f"v{rng.randrange(6)}"
        text = " ".join(words[:10]) + rng.choice([" x = 1 + 2. ", " x = 1 + 3. ", ". "]) + " ".join(words[10:])
        rows.append((rng.choice(["hot", "hot", "b", "c"]), str(rng.randrange(40)), text, n))
    rows += [("b", "x", "no index", 900), ("b", "1", "", 901), ("b", "2", "", 902)]
    df = spark.createDataFrame(rows, "id string, candidate_index string, solution string, row_no long")
    forms = df.where(curation.index_of().isNotNull()).withColumn("n", T.normalize_solution(F.col("solution")))
    plain = [(r.id, int(r.candidate_index), r.row_no, r.n, r.e, set(r.t)) for r in forms.withColumn("e", T.equations(F.col("n"))).withColumn("t", T.tokens(F.col("n"))).collect()]
    for threshold in (0.6, 0.88):
        for block_links in (500_000, 3, 0):
            got = {r.row_no: r.dedup_group for r in curation.near_dedup(df, threshold, block_links=block_links).collect()}
            assert got == greedy(plain, threshold)
    again = curation.near_dedup(curation.near_dedup(df).drop("dedup_group", "normalized_similarity"))
    assert again.count() == curation.near_dedup(df).count()
    with pytest.raises(ValueError):
        curation.near_dedup(df, 0)
    assert curation.near_dedup(df.limit(0)).count() == 0


def test_near_dedup_raises_rather_than_keep_undecided_rows(spark):
    words = [f"w{i}" for i in range(24)]
    rows = []
    for i in range(9):
        words[2 * i] = f"v{i}"
        rows.append(("hot", str(i), " ".join(words) + ". x = 1 + 2", i))
    df = spark.createDataFrame(rows, "id string, candidate_index string, solution string, row_no long")
    assert {r.row_no for r in curation.near_dedup(df).collect()} == {0, 2, 4, 6, 8}
    with pytest.raises(RuntimeError):
        curation.near_dedup(df, most_rounds=2, block_links=0)
    assert {r.row_no for r in curation.near_dedup(df, block_links=0).collect()} == {0, 2, 4, 6, 8}


def test_long_chains_are_decided_to_the_end(spark):
    """1,000 candidates, each similar only to the one before: every other one is kept."""
    words, rows = [f"w{i}" for i in range(24)], []
    for i in range(1000):
        words[2 * i % 24] = f"v{i}"
        rows.append(("hot", str(i), " ".join(words) + ". x = 1 + 2", i))
    df = spark.createDataFrame(rows, "id string, candidate_index string, solution string, row_no long")
    assert {r.row_no for r in curation.near_dedup(df).collect()} == set(range(0, 1000, 2))


PROFILES = [
    # reconciled, unique, own (answer, method, finish), pass, fail, unsure, sympy fails -> reasons, label action
    (0, 0, None, 0, 0, 0, 0, "NO_RECONCILED_CANDIDATE|NO_UNIQUE_ANSWER_MATCHED_CANDIDATE", False),
    (4, 2, None, 0, 0, 0, 0, "MISSING_INDEPENDENT_SOLUTION", False),
    (4, 2, ("6", "final_answer", "eos"), 0, 0, 0, 0, "INDEPENDENT_LABEL_DISAGREEMENT", True),
    (4, 2, ("", "none", "max_tokens"), 0, 0, 0, 0, "INDEPENDENT_LABEL_DISAGREEMENT|INDEPENDENT_PARSE_FAILURE|INDEPENDENT_TRUNCATED", True),
    (4, 2, ("5", "final_answer", "eos"), 0, 0, 0, 0, "MISSING_DEEPSEEK_JUDGMENT", False),
    (4, 2, ("5", "final_answer", "eos"), 1, 1, 0, 1, "NO_CANDIDATE_MATCHES_VERIFIER_DIRECTION_AND_ANSWER|SYMPY_NUMERIC_EQUALITY_FAILURE", False),
    (4, 2, ("5", "final_answer", "eos"), 2, 0, 0, 1, None, False),
]


def test_reasons(spark):
    rows = []
    for i, (rec, uniq, own, p, f, u, s, _, _) in enumerate(PROFILES):
        a, m, e = own or (None, None, None)
        rows.append((str(i), "q", "5", i, rec, uniq, a, m, e, p, f, u, p + f + u, s, None, max(0, p - s)))
    schema = "id string, question string, label_answer string, row_no long, reconciled_candidates long, unique_matching_candidates long, own_answer string, own_method string, own_finish string, passes long, fails long, unsure long, judged long, sympy_fail long, issue string, usable long"
    got = {r.id: r for r in curation.rejudge_queue(spark.createDataFrame(rows, schema)).collect()}
    for i, (*_, reasons, label) in enumerate(PROFILES):
        if reasons is None:
            assert str(i) not in got
        else:
            assert got[str(i)].reason_codes == reasons
            assert (got[str(i)].recommended_next_action == "REJUDGE_LABEL_AND_QUESTION") == label


def test_reconcile_and_training_rows(spark):
    problems = spark.createDataFrame([(" p1 ", " Q one ", "1,000", 1), ("p2", "Q two", "7.0", 2), ("p3", "", "1", 3), ("p4", "Q", "x", 4), (None, None, None, 5)], "id string, question string, answer string, row_no long")
    src = curation.source(problems)
    assert {(r.id, r.question, r.answer) for r in src.where("valid").collect()} == {("p1", "Q one", "1000"), ("p2", "Q two", "7")}
    schema = "id string, candidate_index string, question string, answer string, solution string, parsed_answer string, parser_method string, answer_match boolean, finish_status string, row_no long, extra int"
    rows = [
        ("p1", "0", "Q one", "1,000", "a\nFinal answer: 1000", "", "", None, "eos", 1, 0), ("p1", "0", "Q one", "1000", "a = 1\nFinal answer: 1,000", "", "", None, "eos", 2, 0),
        ("p2", "0", "Q other", "7", "s", "", "", None, "eos", 3, 0), ("zz", "0", "q", "1", "s", "", "", None, "eos", 4, 0), ("zz", "1", "q", "2", "s", "", "", None, "eos", 5, 0), (None, "0", "q", "1", "s", "", "", None, "eos", 6, 0), ("p1", None, "q", "1", "s", "", "", None, "eos", 7, 0),
    ]
    good, issues = curation.reconcile(curation.candidates(spark.createDataFrame(rows, schema)), src)
    r = good.collect()
    assert len(r) == 1 and (r[0].row_no, r[0].parsed_answer, r[0].parser_method, r[0].answer_match, r[0].label_changed) == (2, "1000", "final_answer", True, False)
    assert {(x.id, x.issue, x.old_answer, x.candidate_rows) for x in issues.collect()} == {("p2", "QUESTION_CHANGED_REGENERATE", "7", 1), ("zz", "DELETED_SOURCE", "1", 2)}
    rows = curation.sft(curation.best(good), src, "made", "final-only").orderBy("id").collect()
    assert [(x.id, x.solution_source, x.completion) for x in rows] == [("p1", "made", "a = 1\nFinal answer: 1,000"), ("p2", "final-only-fallback", "Final answer: 7")]
    assert curation.sft(curation.best(good), src, "made", "drop").count() == 1
    with pytest.raises(RuntimeError, match="p2"):
        curation.sft(curation.best(good), src, "made", "error")


def test_best_candidate_ties(spark):
    rows = [("a", "2", "x = 1", "eos", 1), ("a", "1", "x = 1", "max_tokens", 2), ("a", "x", "x = 1 + 1", "eos", 3), ("b", "0", "", "eos", 4)]
    df = spark.createDataFrame(rows, "id string, candidate_index string, solution string, finish_status string, row_no long")
    assert {r.id: r.candidate_index for r in curation.best(df).collect()} == {"a": "1", "b": "0"}
    assert {r.id: r.candidate_index for r in curation.best(df, prefer_finished=True).collect()} == {"a": "2", "b": "0"}


def test_checked_training_rows(spark):
    rows = [("a", "q", "5", "Final answer: 5", 1), ("a", "q", "5", "Final answer: 5", 2), ("b", " ", "5", "Final answer: 5", 3), ("c", "q", "5", "\\boxed{5}", 4), ("d", "q", "5", None, 5), ("e", "q", None, "Final answer: 5", 6)]
    got = curation.checked_sft(spark.createDataFrame(rows, "id string, question string, answer string, completion string, row_no long")).collect()
    assert {r.row_no: r.problem for r in got} == {1: None, 2: "duplicate_id", 3: "empty_value", 4: "mismatch", 5: "empty_value", 6: "mismatch"}


def test_best_epoch(spark):
    rows = [(1, 0.5, 0.1, 0.0), (2, 0.7, 0.2, 0.1), (3, 0.7, 0.1, 0.2), (4, 0.7, 0.1, 0.1), (5, 0.7, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "epoch int, accuracy double, parse_failure_rate double, truncation_rate double")
    assert keyed.best_epoch(df).first().epoch == 4 and keyed.best_epoch(df.limit(0)).first().epoch is None


def test_strict_variants_raise(spark):
    schema = "id string, question string, answer string, row_no long"
    good = spark.createDataFrame([("a", "q", "1", 1), ("b", "r", "2.0", 2), (None, " ", None, 3)], schema)
    assert curation.strict_source(good).count() == 2
    for row in (("c", "q", "x", 4), ("c", "", "1", 4), ("a", "s", "3", 4)):
        with pytest.raises(ValueError):
            curation.strict_source(good.union(spark.createDataFrame([row], schema)))
    judged = spark.createDataFrame([("a", "0"), ("a", "1")], "id string, candidate_index string")
    table = judged.withColumn("solution", F.lit("s"))
    assert keyed.lookup(judged, table, curation.KEY).count() == 2
    with pytest.raises(KeyError):
        keyed.lookup(judged, table.where("candidate_index = '0'"), curation.KEY)
