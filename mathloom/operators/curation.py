"""From generated solutions to training rows: reconcile, filter, deduplicate, queue, gate, select.

Tables are joined on string keys.  Every operator takes the tables it needs and returns a lazy
DataFrame; tables keyed by the caller's contract (sources by id, candidates by id and index) must
have unique keys, which ``keyed.last_by`` establishes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mathloom.functions import text as T
from mathloom.operators import keyed
from mathloom.scratch import free, stage

KEY = ["id", "candidate_index"]
#: Links of one id and equations that one task decides on (some 100 bytes each).
BLOCK_LINKS = 500_000
#: Row numbers up to this many are broadcast.
BROADCAST_ROWS = 1_000_000


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of string columns as empty strings, as a text file has them."""
    return df.fillna("", subset=[c for c in columns if c in df.columns])


def source(df: DataFrame) -> DataFrame:
    """Problems with stripped id and question and a normalised answer; ``valid`` tells usable rows."""
    rows = df.select(
        F.coalesce(T.strip(F.col("id")), F.lit("")).alias("id"),
        F.coalesce(T.strip(F.col("question")), F.lit("")).alias("question"),
        F.coalesce(T.normalize_integer(F.col("answer")), F.lit("")).alias("answer"),
        "row_no",
    )
    return rows.withColumn("valid", (F.col("id") != "") & (F.col("question") != "") & (F.col("answer") != ""))


def strict_source(df: DataFrame) -> DataFrame:
    """``source`` if every row is usable and no id repeats; raises with the first row that isn't.

    Rows without id, question and answer at all are blank lines and are left out.
    """
    rows = source(df)
    blank = (F.col("id") == "") & (F.col("question") == "") & (F.col("answer") == "")
    bad = rows.where(~F.col("valid") & ~blank).orderBy("row_no").first()
    if bad:
        raise ValueError(f"row {bad['row_no']}: id, question and an integer answer are required")
    return keyed.assert_unique(rows.where("valid"), ["id"], "problems")


def candidates(df: DataFrame) -> DataFrame:
    """Last row of each key; rows without id or index are left out, other nulls become empty."""
    keep = ["id", "candidate_index", "question", "answer", "solution", "parsed_answer", "parser_method", "answer_match", "finish_status", "row_no"]
    rows = df.select(*keep).where(F.col("id").isNotNull() & F.col("candidate_index").isNotNull())
    rows = keyed.last_by(rows, KEY)
    return filled(rows, keep).withColumn("answer_match", F.coalesce("answer_match", F.lit(False)))


def _with_source(cand: DataFrame, src: DataFrame) -> DataFrame:
    now = src.where("valid").select("id", F.col("question").alias("now_question"), F.col("answer").alias("now_answer"))
    return cand.join(now, "id", "left")


def reconcile(cand: DataFrame, src: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates reparsed against the current labels, issues per id).

    A candidate whose id is gone or whose question changed becomes an issue; an id's issue is that
    of its first row, with the number of its rows.
    """
    joined = _with_source(cand, src)
    gone = F.col("now_question").isNull()
    changed = T.strip(F.col("question")) != F.col("now_question")
    bad = joined.where(gone | changed).select(
        "id", "row_no", F.when(gone, "DELETED_SOURCE").otherwise("QUESTION_CHANGED_REGENERATE").alias("issue"),
        F.col("answer").alias("old_answer"), F.coalesce("now_answer", F.lit("")).alias("current_answer"),
    )
    issues = bad.groupBy("id").agg(F.min_by(F.struct("issue", "old_answer", "current_answer"), "row_no").alias("x"), F.count("*").alias("candidate_rows")).select("id", "x.*", "candidate_rows")
    good = joined.where(~gone & ~changed).withColumn("parsed", T.final_answer(F.col("solution")))
    value = F.col("parsed.value")
    out = good.select(
        *KEY, F.col("now_question").alias("question"), F.col("now_answer").alias("answer"), "solution",
        value.alias("parsed_answer"), F.col("parsed.method").alias("parser_method"),
        ((value != "") & (value == F.col("now_answer"))).alias("answer_match"), "finish_status",
        T.strip(F.col("answer")).alias("original_answer"), (T.strip(F.col("answer")) != F.col("now_answer")).alias("label_changed"), "row_no",
    )
    return out, issues


def cheap_reason() -> Column:
    return keyed.first_reason([("answer_mismatch", ~F.col("answer_match")), ("missing_final_marker", F.col("parser_method") != "final_answer"), ("truncated", F.col("finish_status") != "eos")])


def text_reason(least: int = 80, most: int = 5000) -> Column:
    """First reason for which a single candidate is rejected, or null."""
    size = F.length(T.strip(F.col("solution")))
    return keyed.first_reason([
        ("answer_mismatch", ~F.col("answer_match")), ("missing_final_marker", F.col("parser_method") != "final_answer"), ("truncated", F.col("finish_status") != "eos"),
        ("too_short", size < least), ("too_long", size > most), ("multiple_final_markers", T.final_markers(F.col("solution")) != 1),
    ])


def index_of() -> Column:
    return F.expr("try_cast(trim(candidate_index) as bigint)")


def _earlier_links(forms: DataFrame, threshold: float) -> DataFrame:
    """Pairs (block, u, v) of similar forms of one id and equations, the earlier first.

    Similar token sets share one of their first tokens in any fixed order, so the join is on those
    tokens and not on whole blocks; long tokens, which are rarer than operators, come first.  Blocks
    and tokens are joined as hashes, and the sets themselves are moved only for pairs that share one.
    """
    n = F.size("tokens")
    rare_first = F.array_sort(F.transform("tokens", lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    prefix = F.slice(rare_first["t"], 1, F.greatest(n - F.ceil(n * threshold - 1e-9) + 1, F.lit(1)).cast("int"))
    listed = forms.select("block", F.struct("index", "row_no").alias("place"), n.alias("n"), F.explode(prefix).alias("token"))
    listed = listed.select("block", F.xxhash64("token").alias("token"), "place", "n")
    a, b = (listed.withColumnsRenamed({"place": x, "n": f"n_{x}"}) for x in "uv")
    small, large = F.least("n_u", "n_v"), F.greatest("n_u", "n_v")
    pairs = a.join(b, ["block", "token"]).where((F.col("u") < F.col("v")) & (small >= large * threshold - 1e-9)).select("block", "u", "v").distinct()
    pairs = stage(pairs, "dedup-pairs")
    needed = pairs.select(F.col("u.row_no").alias("row_no")).unionByName(pairs.select(F.col("v.row_no").alias("row_no"))).distinct()
    # Row numbers of 8 bytes each, counted before they are broadcast.
    few = needed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = stage(forms.select("row_no", "id", "equations", "tokens").join(F.broadcast(needed) if few else needed, "row_no", "left_semi"), "dedup-sets")
    for x in "uv":
        pairs = pairs.withColumn(f"row_{x}", F.col(f"{x}.row_no")).join(own.select(F.col("row_no").alias(f"row_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("id", "equations", "tokens"))), f"row_{x}")
    same = (F.col("id_u") == F.col("id_v")) & (F.col("equations_u") == F.col("equations_v"))
    return pairs.where(same & (T.jaccard(F.col("tokens_u"), F.col("tokens_v")) >= threshold)).select("block", "u", "v")


def _settled_at_once(links: DataFrame) -> DataFrame:
    """Rows that go, of blocks whose links one task holds: the greedy choice itself."""

    def choose(table: pa.Table) -> pa.Table:
        u, v = (table.column(c).to_pylist() for c in "uv")
        gone: set = set()
        for earlier, later in sorted(zip(((x["index"], x["row_no"]) for x in u), ((x["index"], x["row_no"]) for x in v))):
            # Links of an earlier row come first, and by then all links into it have been met.
            if earlier not in gone:
                gone.add(later)
        return pa.table({"row_no": pa.array([r for _, r in gone], pa.int64())})

    return links.groupBy("block").applyInArrow(choose, "row_no bigint")


def _settled_in_rounds(links: DataFrame, most_rounds: int | None) -> DataFrame | None:
    """Rows that go, of blocks of any size: a row without an earlier undecided neighbour is kept and
    its later neighbours go, until no link is left; ``most_rounds`` raises beyond."""
    links, gone, done = stage(links.select("block", F.col("u.row_no").alias("u"), F.col("v.row_no").alias("v")), "dedup-links"), None, 0
    while links.limit(1).count():
        if done == most_rounds:
            raise RuntimeError(f"near-duplicates are left after {done} rounds")
        done += 1
        behind = links.select("block", F.col("v").alias("u")).distinct()
        kept = links.select("block", "u").distinct().join(behind, ["block", "u"], "left_anti")
        dropped = stage(links.join(kept, ["block", "u"], "left_semi").select("block", F.col("v").alias("u")).distinct(), "dedup-gone")
        gone = dropped if gone is None else gone.unionByName(dropped)
        if done % 16 == 0:
            gone = stage(gone, "dedup-gone")
        left = links.join(kept, ["block", "u"], "left_anti").join(dropped, ["block", "u"], "left_anti")
        new = stage(left.join(dropped.withColumnRenamed("u", "v"), ["block", "v"], "left_anti").select("block", "u", "v"), "dedup-links")
        free(links)
        links = new
    return None if gone is None else gone.select(F.col("u").alias("row_no"))


def near_dedup(rows: DataFrame, threshold: float = 0.88, most_rounds: int | None = None, block_links: int = BLOCK_LINKS) -> DataFrame:
    """Greedy removal of near-duplicates within each id, in the order of the candidate index (equal ones: of ``row_no``).

    A row goes if its normalised text equals a kept one's, or if its equations are the same and not
    empty and its tokens at least ``threshold`` similar to a kept one's.  Adds ``dedup_group``, the
    rank of the kept row, and ``normalized_similarity``, which is 0 for every kept row.  The choice
    is made over the links of similar rows: by one task for each id and equations with up to
    ``block_links`` of them, in rounds over tables for larger ones, with the same result.
    Rows are told apart by ``row_no``, which must be unique.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    forms = rows.select(F.struct(*rows.columns).alias("row"), "id", "row_no", index_of().alias("index"), T.normalize_solution(F.col("solution")).alias("norm"))
    # Of equal texts only the first can be kept, and what removes it removes the others.
    forms = keyed.first_by(forms.where(F.col("index").isNotNull()), ["id", "norm"], F.struct("index", "row_no"))
    forms = stage(forms.withColumn("equations", T.equations(F.col("norm"))).withColumn("tokens", T.tokens(F.col("norm"))).drop("norm").withColumn("block", F.xxhash64("id", "equations")), "dedup-forms")
    links = stage(_earlier_links(forms.drop("row").where("equations != ''"), threshold), "dedup-links")
    large = links.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > block_links).select("block")
    large = stage(large, "dedup-large")
    gone = _settled_at_once(links.join(large, "block", "left_anti"))
    if large.limit(1).count() and (more := _settled_in_rounds(links.join(large, "block", "left_semi"), most_rounds)) is not None:
        gone = gone.unionByName(more)
    kept = forms.select("id", "index", "row_no").join(gone, "row_no", "left_anti")
    ranked = keyed.ordinal(kept, "id", "index", "dedup_group", ties="row_no").select("row_no", "dedup_group")
    return forms.select("row", "row_no").join(ranked, "row_no").select("row.*", "dedup_group", F.lit("0.000000").alias("normalized_similarity"))


def independent(cand: DataFrame, judged: DataFrame) -> DataFrame:
    """Independent solutions as the tables allow: the first finished response of each id.

    ``independent_sha256`` is the hash that the id's last judgment was made against, where there is
    one: judgments with another hash are stale.
    """
    rows = cand.where((F.col("finish_status") == "eos") & (F.col("solution") != ""))
    recorded = judged.groupBy("id").agg(F.max_by("independent_solution_sha256", "row_no").alias("recorded"))
    first = keyed.first_by(rows, ["id"]).join(recorded, "id", "left").withColumn("own", T.strip(F.col("solution")))
    return first.withColumn("p", T.final_answer(F.col("own"))).select(
        "id", T.sha256(T.strip(F.col("question"))).alias("question_sha256"), F.lit("recorded").alias("model"), F.col("own").alias("independent_solution"),
        F.col("p.value").alias("parsed_answer"), F.col("p.method").alias("parser_method"), "finish_status", F.coalesce("recorded", T.sha256(F.col("own"))).alias("independent_sha256"),
    )


def usable_verdict() -> Column:
    return F.when(F.col("parse_status") == "ok", F.col("verdict")).otherwise("UNCERTAIN")


def verdict_counts(judged: DataFrame) -> DataFrame:
    v = judged.withColumn("v", usable_verdict()).groupBy("id")
    return v.agg(F.count_if(F.col("v") == "PASS").alias("passes"), F.count_if(F.col("v") == "FAIL").alias("fails"), F.count_if(F.col("v") == "UNCERTAIN").alias("unsure"), F.count("*").alias("judged"))


def profile(src: DataFrame, reconciled: DataFrame, unique: DataFrame, solved: DataFrame, judged: DataFrame, checks: DataFrame, issues: DataFrame) -> DataFrame:
    """One row per problem with what is known of it.

    All tables are put under each other as (id, numbers) and summed by one aggregation, whose tasks
    send one row an id however many candidates it has; only that is joined with the problems.
    """
    numbers = ["reconciled_candidates", "unique_matching_candidates", "passes", "fails", "unsure", "judged", "sympy_fail"]
    own = F.struct(F.col("parsed_answer").alias("own_answer"), F.col("parser_method").alias("own_method"), F.col("finish_status").alias("own_finish"))
    none = {**dict.fromkeys(numbers, F.lit(0)), "own": F.lit(None).cast("struct<own_answer:string,own_method:string,own_finish:string>"), "issue": F.lit(None).cast("string")}

    def rows(df: DataFrame, **known: Column) -> DataFrame:
        return df.select("id", *((known.get(n, c)).alias(n) for n, c in none.items()))

    v = usable_verdict()
    parts = [
        rows(reconciled, reconciled_candidates=F.lit(1)), rows(unique, unique_matching_candidates=F.lit(1)), rows(solved, own=own), rows(issues, issue=F.col("issue")),
        rows(judged, judged=F.lit(1), passes=(v == "PASS").cast("int"), fails=(v == "FAIL").cast("int"), unsure=(v == "UNCERTAIN").cast("int")),
        rows(checks, sympy_fail=(F.col("status") == "FAIL").cast("int")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # An id has one independent solution and one issue at most.
    known = every.groupBy("id").agg(*(F.sum(n).alias(n) for n in numbers), F.max("own").alias("own"), F.max("issue").alias("issue"))
    out = src.where("valid").select("id", "question", F.col("answer").alias("label_answer"), "row_no").join(known, "id", "left")
    return out.select("id", "question", "label_answer", "row_no", *(F.coalesce(n, F.lit(0)).alias(n) for n in numbers), "own.*", "issue").withColumn("usable", F.greatest(F.lit(0), F.col("passes") - F.col("sympy_fail")))


LABEL_REASONS = ("INDEPENDENT_LABEL_DISAGREEMENT", "INDEPENDENT_PARSE_FAILURE", "QUESTION_CHANGED_REGENERATE")


def reasons() -> Column:
    """Sorted reasons for which a profiled problem needs another look."""
    some, own = F.col("unique_matching_candidates") > 0, F.col("own_answer").isNotNull()
    cut, unparsed, other = own & (F.col("own_finish") != "eos"), own & (F.col("own_method") != "final_answer"), own & (F.col("own_answer") != F.col("label_answer"))
    sound = some & own & ~cut & ~unparsed & ~other
    unjudged = sound & (F.col("judged") == 0)
    rules = [
        (F.col("issue").isNotNull(), F.col("issue")),
        (F.col("reconciled_candidates") == 0, "NO_RECONCILED_CANDIDATE"),
        (~some, "NO_UNIQUE_ANSWER_MATCHED_CANDIDATE"),
        (some & ~own, "MISSING_INDEPENDENT_SOLUTION"),
        (cut, "INDEPENDENT_TRUNCATED"),
        (unparsed, "INDEPENDENT_PARSE_FAILURE"),
        (other, "INDEPENDENT_LABEL_DISAGREEMENT"),
        (unjudged, "MISSING_DEEPSEEK_JUDGMENT"),
        (sound & (F.col("judged") > 0) & (F.col("usable") == 0), "NO_CANDIDATE_MATCHES_VERIFIER_DIRECTION_AND_ANSWER"),
        ((F.col("sympy_fail") > 0) & (F.col("usable") == 0), "SYMPY_NUMERIC_EQUALITY_FAILURE"),
    ]
    listed = F.array(*(F.when(rule, name if isinstance(name, Column) else F.lit(name)) for rule, name in rules))
    return F.array_sort(F.array_distinct(F.array_compact(listed)))


def rejudge_queue(profiled: DataFrame) -> DataFrame:
    """Problems with at least one reason, the reasons joined, and the recommended action."""
    q = profiled.withColumn("codes", reasons()).where(F.size("codes") > 0)
    action = F.when(F.arrays_overlap("codes", F.array(*map(F.lit, LABEL_REASONS))), "REJUDGE_LABEL_AND_QUESTION").otherwise("REJUDGE_THEN_REGENERATE_CANDIDATES_IF_UNRESOLVED")
    return q.select(
        "id", "question", "label_answer", F.array_join("codes", "|").alias("reason_codes"), F.coalesce("own_answer", F.lit("")).alias("independent_answer"),
        "reconciled_candidates", "unique_matching_candidates", F.col("passes").alias("deepseek_pass"), F.col("fails").alias("deepseek_fail"),
        F.col("unsure").alias("deepseek_uncertain"), "sympy_fail", action.alias("recommended_next_action"),
    )


def gate_v2(judged: DataFrame, unique: DataFrame, solved: DataFrame, src: DataFrame, checks: DataFrame, queue: DataFrame, least: int = 80, most: int = 5000) -> DataFrame:
    """Judgments with their candidate and ``reason``: why it is rejected, null if it is accepted."""
    own = solved.select("id", F.col("parsed_answer").alias("own_answer"), F.col("independent_sha256").alias("own_sha"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("boolean").alias("queued"))
    label = src.where("valid").select("id", F.lit(None).alias("own_answer"), F.lit(None).alias("own_sha"), F.col("answer").alias("label"), F.lit(None).alias("queued"))
    listed = queue.select("id", F.lit(None).alias("own_answer"), F.lit(None).alias("own_sha"), F.lit(None).alias("label"), F.lit(True).alias("queued"))
    # What is known of an id has one row in each table: one aggregation instead of three joins.
    of_id = own.unionByName(label).unionByName(listed).groupBy("id").agg(*(F.max(c).alias(c) for c in own.columns[1:]))
    status = checks.groupBy(*KEY).agg(F.max_by("status", "row_no").alias("status"))
    found = unique.select(*KEY, "solution", F.lit(True).alias("found"))
    joined = judged.join(found, KEY, "left").join(status, KEY, "left").join(of_id, "id", "left")
    size = F.length(T.strip(F.col("solution")))
    rules = [
        ("missing_candidate", F.col("found").isNull()),
        ("rejudge_queue", F.col("queued").isNotNull()),
        ("independent_not_confirmed", F.col("own_answer").isNull() | (F.col("own_answer") != F.col("label"))),
        ("deepseek_not_pass", (F.col("parse_status") != "ok") | (F.col("verdict") != "PASS")),
        ("solution_hash_mismatch", F.col("solution_sha256") != T.sha256(F.col("solution"))),
        ("independent_hash_mismatch", F.col("independent_solution_sha256") != F.col("own_sha")),
        ("sympy_failure", F.coalesce(F.col("status"), F.lit("")) == "FAIL"),
        ("solution_length", (size < least) | (size > most)),
    ]
    return joined.withColumn("reason", keyed.first_reason(rules))


def gate_v1(cand: DataFrame, src: DataFrame, judged: DataFrame) -> DataFrame:
    """Candidates with ``reason``: why they are rejected, null if accepted; the copy check comes last."""
    j = judged.select(*KEY, F.col("parse_status").alias("j_status"), F.col("verdict").alias("j_verdict"), F.col("solution_sha256").alias("j_sha"))
    joined = _with_source(cand, src).join(j, KEY, "left")
    rules = [
        ("unknown_id", F.col("now_question").isNull()),
        ("source_mismatch", (T.strip(F.col("question")) != F.col("now_question")) | (T.strip(F.col("answer")) != F.col("now_answer"))),
    ]
    late = [
        ("missing_judgment", F.col("j_verdict").isNull()),
        ("judgment_parse_error", F.col("j_status") != "ok"),
        ("judgment_solution_mismatch", F.col("j_sha") != T.sha256(F.col("solution"))),
        ("judge_fail", F.col("j_verdict") != "PASS"),
    ]
    gated = joined.withColumn("reason", F.coalesce(keyed.first_reason(rules), text_reason(), keyed.first_reason(late))).withColumn("form", T.collapse(F.col("solution")))
    firsts = gated.where("reason is null").groupBy("id", "form").agg(F.min("row_no").alias("first_row"))
    out = gated.join(firsts, ["id", "form"], "left")
    again = F.col("reason").isNull() & (F.col("row_no") != F.col("first_row"))
    return out.withColumn("reason", F.when(again, "duplicate_solution").otherwise(F.col("reason"))).drop("first_row", "form")


def best(accepted: DataFrame, prefer_finished: bool = False) -> DataFrame:
    """The best candidate of each id; ties go to the smaller index.  Map-side combined."""
    score = T.selection_score(F.col("solution"), index_of())
    if prefer_finished:
        score = F.struct((F.col("finish_status") == "eos").alias("done"), score.alias("s"))
    rows = accepted.where(index_of().isNotNull())
    return rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in accepted.columns if c != "id"]), F.struct(score.alias("s"), (-F.col("row_no")).alias("r"))).alias("x")).select("id", "x.*")


def sft(chosen: DataFrame, src: DataFrame, name: str, missing: str = "drop") -> DataFrame:
    """Training rows of the chosen candidates.

    ``missing``: what becomes of problems without one: ``drop``, ``final-only`` (a row with the
    label alone) or ``error``.
    """
    text = T.strip(F.col("chosen"))
    joined = src.where("valid").join(chosen.select("id", F.col("solution").alias("chosen"), "candidate_index"), "id", "inner" if missing == "drop" else "left")
    none = F.col("chosen").isNull()
    if missing == "error" and (first := joined.where(none).orderBy("row_no").first()):
        raise RuntimeError(f"no accepted solution; first id: {first['id']}")
    return joined.select(
        "id", "question", F.coalesce(text, F.lit("")).alias("solution"), "answer",
        F.coalesce(text, F.concat(F.lit("Final answer: "), F.col("answer"))).alias("completion"),
        F.when(none, "final-only-fallback").otherwise(name).alias("solution_source"), F.coalesce("candidate_index", F.lit("")).alias("candidate_index"),
    )


def checked_sft(df: DataFrame) -> DataFrame:
    """Training rows with ``problem``: empty_value, duplicate_id (all but the first row), mismatch
    (the completion's labelled answer isn't the answer) or null."""
    first = keyed.first_seen(df, "id")
    rows = df.join(first, "id", "left").withColumn("p", T.final_answer(T.strip(F.col("completion"))))
    empty = F.lit(False)
    for c in ("id", "question", "completion"):
        empty = empty | F.col(c).isNull() | (T.strip(F.col(c)) == "")
    wrong = (F.col("p.method") != "final_answer") | ~F.col("p.value").eqNullSafe(T.strip(F.col("answer")))
    return rows.withColumn("problem", keyed.first_reason([("empty_value", empty), ("duplicate_id", F.col("row_no") != F.col("first_row")), ("mismatch", wrong)])).drop("p", "first_row")
