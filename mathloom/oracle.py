"""SQL that states the same queries, for a side-by-side comparison on the same tables."""

from __future__ import annotations

from mathloom.functions import chat

# The patterns are written out here, for the SQL engine's own dialect, and not taken from the
# engine: an error in either shows as a difference.  Fixed values.
_BLANK = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_INTEGER = r"([-+]?\d[\d,]*(?:\.0+)?)"
_LABEL = rf"(?im)^{_BLANK}*final{_BLANK}+answer{_BLANK}*:"
_FINAL = rf"{_LABEL}{_BLANK}*\$?{_BLANK}*{_INTEGER}{_BLANK}*\$?{_BLANK}*[!.]?{_BLANK}*$"
_BOX = rf"\\boxed{_BLANK}*\{{{_BLANK}*{_INTEGER}{_BLANK}*\}}"
_CUE = r"\\(?:cdot|times|sqrt|frac)|[*/+=^]"
_TOKEN = r"[0-9a-z\x{AC00}-\x{D7A3}]+|[-*/+=^]"
_OTHER = r"[^-0-9a-z\x{AC00}-\x{D7A3}*/+=^().]+"
_SPAN = rf"^{_BLANK}+|{_BLANK}+$"
#: Full case folding of characters that lower-casing leaves, as far as tables of text have them.
_FOLDED = [("ß", "ss"), ("ς", "σ"), ("ſ", "s"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("µ", "μ"), ("ŉ", "ʼn"), ("ϐ", "β"), ("ϑ", "θ"), ("ϕ", "φ"), ("ϖ", "π"), ("ϰ", "κ"), ("ϱ", "ρ"), ("ϵ", "ε")]


def _fold(x: str) -> str:
    out = f"lower({x})"
    for a, b in _FOLDED:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '{_SPAN}', '', 'g')"


def _integer(x: str) -> str:
    bare = f"replace({_strip(x)}, ',', '')"
    core = rf"regexp_extract({bare}, '^([+-]?)0*([0-9]+?)(?:\.0+)?$', 2)"
    return f"CASE WHEN {core} <> '' THEN CASE WHEN starts_with({bare}, '-') AND {core} <> '0' THEN '-' ELSE '' END || {core} ELSE CASE WHEN {x} IS NOT NULL THEN '' END END"


def _all(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, '{pattern}', {group})"


def _method(x: str) -> str:
    return f"CASE WHEN len({_all(x, _FINAL, 1)}) > 0 THEN 'final_answer' WHEN len({_all(x, _BOX, 1)}) > 0 THEN 'boxed' ELSE 'none' END"


def _value(x: str) -> str:
    pick = f"CASE WHEN len({_all(x, _FINAL, 1)}) > 0 THEN {_all(x, _FINAL, 1)}[-1] ELSE {_all(x, _BOX, 1)}[-1] END"
    return f"coalesce({_integer(f'({pick})')}, '')"


def _collapse(x: str) -> str:
    return _fold(_strip(f"regexp_replace({x}, '{_BLANK}+', ' ', 'g')"))


def _norm(x: str) -> str:
    body = _fold(f"regexp_replace({x}, '{_LABEL}[^\\n]*$', '', 'g')")
    body = f"replace(replace({body}, '\\cdot', '*'), '\\times', '*')"
    return f"trim(regexp_replace(regexp_replace({body}, '{_BLANK}+', ' ', 'g'), '{_OTHER}', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"list_distinct({_all(x, _TOKEN)})"


def _equations(x: str) -> str:
    return f"coalesce(array_to_string(list_transform({_all(x, '[^.!?\\n]*=[^.!?\\n]*')}, lambda e: trim(e)), '|'), '')"


def _jaccard(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / {union} END"


def _cues(x: str) -> str:
    return f"len({_all(f"string_split_regex({_strip(x)}, '{_LABEL}')[1]", _CUE)})"


def _fit(x: str) -> str:
    return f"greatest(0, 1500 - abs(length({_strip(x)}) - 700))"


def _first(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in rules) + " END"


_CHEAP = [("answer_mismatch", "NOT answer_match"), ("missing_final_marker", "parser_method <> 'final_answer'"), ("truncated", "finish_status <> 'eos'")]
_TEXT = [
    *_CHEAP,
    ("too_short", f"length({_strip('solution')}) < 80"), ("too_long", f"length({_strip('solution')}) > 5000"),
    ("multiple_final_markers", f"len({_all('solution', f'{_LABEL}')}) <> 1"),
]
_INDEX = "try_cast(trim(candidate_index) AS BIGINT)"
_BY_SCORE = f"least({_cues('solution')}, 20) DESC, {_fit('solution')} DESC, {_INDEX}, row_no"
_DONE_FIRST = f"finish_status = 'eos' DESC, {_BY_SCORE}"


def _judged(table: str) -> str:
    return f"SELECT * REPLACE (upper({_strip('verdict')}) AS verdict) FROM {table} QUALIFY row_number() OVER (PARTITION BY id, candidate_index ORDER BY row_no DESC) = 1"


#: Named tables; each may use those before it.
TABLES = {
    "src": f"SELECT * FROM (SELECT coalesce({_strip('id')}, '') AS id, coalesce({_strip('question')}, '') AS question, coalesce({_integer('answer')}, '') AS answer, row_no FROM problems) WHERE id <> '' AND question <> '' AND answer <> ''",
    "cand": """SELECT id, candidate_index, coalesce(question, '') AS question, coalesce(answer, '') AS answer, coalesce(solution, '') AS solution, coalesce(parsed_answer, '') AS parsed_answer,
        coalesce(parser_method, '') AS parser_method, coalesce(answer_match, false) AS answer_match, coalesce(finish_status, '') AS finish_status, row_no
        FROM solution_candidates WHERE id IS NOT NULL AND candidate_index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, candidate_index ORDER BY row_no DESC) = 1""",
    "joined": "SELECT c.*, s.question AS now_question, s.answer AS now_answer FROM cand c LEFT JOIN src s ON c.id = s.id",
    "issues": f"""SELECT id, arg_min(issue, row_no) AS issue, arg_min(old_answer, row_no) AS old_answer, arg_min(current_answer, row_no) AS current_answer, count(*) AS candidate_rows FROM (
        SELECT id, row_no, CASE WHEN now_question IS NULL THEN 'DELETED_SOURCE' ELSE 'QUESTION_CHANGED_REGENERATE' END AS issue, answer AS old_answer, coalesce(now_answer, '') AS current_answer
        FROM joined WHERE now_question IS NULL OR {_strip('question')} <> now_question) GROUP BY id""",
    "recon": f"""SELECT id, candidate_index, now_question AS question, now_answer AS answer, solution, value AS parsed_answer, method AS parser_method, value <> '' AND value = now_answer AS answer_match,
        finish_status, {_strip('answer')} AS original_answer, {_strip('answer')} <> now_answer AS label_changed, row_no
        FROM (SELECT *, {_value('solution')} AS value, {_method('solution')} AS method FROM joined WHERE now_question IS NOT NULL AND {_strip('question')} = now_question)""",
    "elig": f"SELECT * FROM recon WHERE ({_first(_CHEAP)}) IS NULL",
    "forms": f"SELECT *, {_equations('norm')} AS eq, {_tokens('norm')} AS toks FROM (SELECT *, {_INDEX} AS idx, {_norm('solution')} AS norm FROM elig WHERE {_INDEX} IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY id, norm ORDER BY idx, row_no) = 1",
    "kept": f"""SELECT id, unnest(list_transform(k, lambda e: e.row_no)) AS row_no FROM (
        SELECT id, list_reduce(list_transform(list({{'row_no': row_no, 'toks': toks}} ORDER BY idx, row_no), lambda e: [e]),
            lambda acc, e: CASE WHEN len(list_filter(acc, lambda o: ({_jaccard('o.toks', 'e[1].toks')}) >= 0.88)) > 0 THEN acc ELSE list_concat(acc, e) END) AS k
        FROM forms WHERE eq <> '' GROUP BY id, eq) UNION ALL SELECT id, row_no FROM forms WHERE eq = ''""",
    "uniq": "SELECT f.* EXCLUDE (norm, eq, toks), row_number() OVER (PARTITION BY f.id ORDER BY f.idx, f.row_no) - 1 AS dedup_group FROM forms f SEMI JOIN kept k ON f.id = k.id AND f.row_no = k.row_no",
    "indep": f"""SELECT id, sha256({_strip('question')}) AS question_sha256, sol AS independent_solution, {_value('sol')} AS parsed_answer, {_method('sol')} AS parser_method, finish_status, coalesce(h.sha, sha256(sol)) AS independent_sha256
        FROM (SELECT *, {_strip('solution')} AS sol FROM cand WHERE finish_status = 'eos' AND solution <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_no) = 1)
        LEFT JOIN (SELECT id, arg_max(independent_solution_sha256, row_no) AS sha FROM deepseek_candidate_judgments GROUP BY id) h USING (id)""",
    "judged": _judged("deepseek_candidate_judgments"),
    "judged_v1": _judged("solution_judgments"),
    "checks": f"SELECT * REPLACE (upper({_strip('status')}) AS status) FROM sympy_crosschecks",
    "verdicts": """SELECT id, count(*) FILTER (v = 'PASS') AS passes, count(*) FILTER (v = 'FAIL') AS fails, count(*) FILTER (v = 'UNCERTAIN') AS unsure, count(*) AS judged
        FROM (SELECT id, CASE WHEN parse_status = 'ok' THEN verdict ELSE 'UNCERTAIN' END AS v FROM judged) GROUP BY id""",
    "profile": """SELECT s.id, s.question, s.answer AS label_answer, coalesce(a.n, 0) AS reconciled_candidates, coalesce(u.n, 0) AS unique_matching_candidates, i.parsed_answer AS own_answer, i.parser_method AS own_method,
        i.finish_status AS own_finish, coalesce(v.passes, 0) AS passes, coalesce(v.fails, 0) AS fails, coalesce(v.unsure, 0) AS unsure, coalesce(v.judged, 0) AS judged, coalesce(f.n, 0) AS sympy_fail, x.issue,
        greatest(0, coalesce(v.passes, 0) - coalesce(f.n, 0)) AS usable
        FROM src s LEFT JOIN (SELECT id, count(*) AS n FROM recon GROUP BY id) a ON a.id = s.id LEFT JOIN (SELECT id, count(*) AS n FROM uniq GROUP BY id) u ON u.id = s.id
        LEFT JOIN indep i ON i.id = s.id LEFT JOIN verdicts v ON v.id = s.id LEFT JOIN (SELECT id, count(*) AS n FROM checks WHERE status = 'FAIL' GROUP BY id) f ON f.id = s.id LEFT JOIN issues x ON x.id = s.id""",
    "reasons": """SELECT id, unnest(list_distinct(list_filter([issue,
        CASE WHEN reconciled_candidates = 0 THEN 'NO_RECONCILED_CANDIDATE' END, CASE WHEN NOT has_unique THEN 'NO_UNIQUE_ANSWER_MATCHED_CANDIDATE' END,
        CASE WHEN has_unique AND NOT own THEN 'MISSING_INDEPENDENT_SOLUTION' END, CASE WHEN cut THEN 'INDEPENDENT_TRUNCATED' END, CASE WHEN unparsed THEN 'INDEPENDENT_PARSE_FAILURE' END,
        CASE WHEN other THEN 'INDEPENDENT_LABEL_DISAGREEMENT' END, CASE WHEN sound AND judged = 0 THEN 'MISSING_DEEPSEEK_JUDGMENT' END,
        CASE WHEN sound AND judged > 0 AND usable = 0 THEN 'NO_CANDIDATE_MATCHES_VERIFIER_DIRECTION_AND_ANSWER' END,
        CASE WHEN sympy_fail > 0 AND usable = 0 THEN 'SYMPY_NUMERIC_EQUALITY_FAILURE' END], lambda r: r IS NOT NULL))) AS reason
        FROM (SELECT *, has_unique AND own AND NOT cut AND NOT unparsed AND NOT other AS sound FROM (
            SELECT *, unique_matching_candidates > 0 AS has_unique, own_answer IS NOT NULL AS own, own_answer IS NOT NULL AND own_finish <> 'eos' AS cut,
                own_answer IS NOT NULL AND own_method <> 'final_answer' AS unparsed, own_answer IS NOT NULL AND own_answer <> label_answer AS other FROM profile))""",
    "queue": """SELECT p.id, p.question, p.label_answer, r.codes AS reason_codes, coalesce(p.own_answer, '') AS independent_answer, p.reconciled_candidates, p.unique_matching_candidates,
        p.passes AS deepseek_pass, p.fails AS deepseek_fail, p.unsure AS deepseek_uncertain, p.sympy_fail,
        CASE WHEN r.label THEN 'REJUDGE_LABEL_AND_QUESTION' ELSE 'REJUDGE_THEN_REGENERATE_CANDIDATES_IF_UNRESOLVED' END AS recommended_next_action
        FROM profile p JOIN (SELECT id, string_agg(reason, '|' ORDER BY reason) AS codes,
            bool_or(reason IN ('INDEPENDENT_LABEL_DISAGREEMENT', 'INDEPENDENT_PARSE_FAILURE', 'QUESTION_CHANGED_REGENERATE')) AS label FROM reasons GROUP BY id) r ON p.id = r.id""",
    "gate2": f"""SELECT j.row_no, j.id, j.candidate_index, u.solution, CASE WHEN u.id IS NULL THEN 'missing_candidate' WHEN q.id IS NOT NULL THEN 'rejudge_queue'
        WHEN i.parsed_answer IS NULL OR i.parsed_answer <> s.answer THEN 'independent_not_confirmed' WHEN j.parse_status <> 'ok' OR j.verdict <> 'PASS' THEN 'deepseek_not_pass'
        WHEN j.solution_sha256 <> sha256(u.solution) THEN 'solution_hash_mismatch' WHEN j.independent_solution_sha256 <> i.independent_sha256 THEN 'independent_hash_mismatch'
        WHEN coalesce(c.status, '') = 'FAIL' THEN 'sympy_failure' WHEN length({_strip('u.solution')}) NOT BETWEEN 80 AND 5000 THEN 'solution_length' END AS reason
        FROM judged j LEFT JOIN uniq u ON j.id = u.id AND j.candidate_index = u.candidate_index LEFT JOIN queue q ON j.id = q.id LEFT JOIN indep i ON j.id = i.id LEFT JOIN src s ON j.id = s.id
        LEFT JOIN (SELECT id, candidate_index, arg_max(status, row_no) AS status FROM checks GROUP BY ALL) c ON j.id = c.id AND j.candidate_index = c.candidate_index""",
    "gate1": f"""SELECT * REPLACE (CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY id, form, reason IS NULL ORDER BY row_no) > 1 THEN 'duplicate_solution' ELSE reason END AS reason) FROM (
        SELECT c.*, {_collapse('c.solution')} AS form, CASE WHEN now_question IS NULL THEN 'unknown_id' WHEN {_strip('question')} <> now_question OR {_strip('answer')} <> now_answer THEN 'source_mismatch'
        {" ".join(f"WHEN {rule} THEN '{name}'" for name, rule in _TEXT)}
        WHEN j.verdict IS NULL THEN 'missing_judgment' WHEN j.parse_status <> 'ok' THEN 'judgment_parse_error' WHEN j.solution_sha256 <> sha256(c.solution) THEN 'judgment_solution_mismatch'
        WHEN j.verdict <> 'PASS' THEN 'judge_fail' END AS reason
        FROM joined c LEFT JOIN (SELECT id, candidate_index, verdict, parse_status, solution_sha256 FROM judged_v1) j ON c.id = j.id AND c.candidate_index = j.candidate_index)""",
    "best1": f"SELECT * FROM gate1 WHERE reason IS NULL AND {_INDEX} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_DONE_FIRST}) = 1",
    "best2": f"SELECT * FROM gate2 WHERE reason IS NULL AND {_INDEX} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_BY_SCORE}) = 1",
    "sft1": f"""SELECT s.id, s.question, coalesce({_strip('b.solution')}, '') AS solution, s.answer, coalesce({_strip('b.solution')}, 'Final answer: ' || s.answer) AS completion,
        CASE WHEN b.id IS NULL THEN 'final-only-fallback' ELSE 'teacher-verified' END AS solution_source, coalesce(b.candidate_index, '') AS candidate_index FROM src s LEFT JOIN best1 b ON s.id = b.id""",
    "pred": f"""SELECT c.row_no, {_value('solution')} AS prediction, {_method('solution')} AS method, s.answer AS label, finish_status <> 'eos' AS truncated FROM cand c JOIN src s ON c.id = s.id""",
}


def _needs(sql: str, found: set[str]) -> set[str]:
    import re

    for name in set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", sql)) & TABLES.keys() - found:
        found.add(name)
        _needs(TABLES[name], found)
    return found


def _with(sql: str) -> str:
    names = _needs(sql, set())
    parts = [f"{n} AS (\n{body}\n)" for n, body in TABLES.items() if n in names]
    if not parts:
        return sql
    own = sql.removeprefix("WITH ")
    return f"WITH {', '.join(parts)}" + (f", {own}" if own != sql else f"\n{sql}")


def _scalar(value: str, column: str = "solution") -> str:
    return f"SELECT row_no, {value} AS value FROM solution_candidates WHERE {column} IS NOT NULL"


def _rate(a: str, b: str) -> str:
    return f"round(CASE WHEN {b} > 0 THEN ({a})::DOUBLE / {b} ELSE 0.0 END, 6)"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _chat(system: str) -> str:
    return f"SELECT id, {_text(system)} AS system, question AS user FROM src"


def _last(x: str, number: str, after: str) -> str:
    """The last of the numbers found from left to right: one that begins within an earlier one isn't found."""
    start = f"list_transform(range(1, length({x}) + 1), lambda i: {{'s': i, 'm': regexp_extract(substr({x}, i), '^({number})(?:{after}|$)', 1)}})"
    good = f"list_filter({start}, lambda c: c.m <> '' AND (c.s = 1 OR NOT regexp_matches(substr({x}, c.s - 1, 1), '[\\p{{L}}\\p{{M}}\\p{{N}}_.]')))"
    ends = f"list_transform({good}, lambda c: {{'e': c.s + length(c.m), 's': c.s, 'm': c.m}})"
    return f"(CASE WHEN len({good}) > 0 THEN list_reduce({ends}, lambda a, c: CASE WHEN c.s >= a.e THEN c ELSE a END).m END)"


_LAST_NUMBER = _last("solution", r"[-+]?\d[\d,]*(?:\.\d+)?", r"[^\p{L}\p{M}\p{N}_]")
_LAST_INTEGER = _last("solution", r"[-+]?\d[\d,]*(?:\.0+)?", r"[^\p{L}\p{M}\p{N}_.]")


#: The JSON object in a raw output, if it is one.
_OBJECT = "CASE WHEN json_valid(regexp_extract(raw_judgment, '(?s)\\{.*\\}')) THEN regexp_extract(raw_judgment, '(?s)\\{.*\\}') END"

_PAIR = "USING (id, candidate_index)"
_QUERIES = {
    "normalize_integer": _scalar(_integer("answer"), "answer"),
    "extract_final_answer": f"SELECT row_no, {_value('solution')} AS value, {_method('solution')} AS method FROM solution_candidates WHERE solution IS NOT NULL",
    "normalize_text": _scalar(_collapse("solution")),
    "normalize_solution_text": _scalar(_norm("solution")),
    "tokens": _scalar(f"array_to_string(list_sort({_tokens(_norm('solution'))}), ' ')"),
    "equation_fingerprint": _scalar(_equations(_norm("solution"))),
    "solution_sha256": _scalar("sha256(solution)"),
    "equation_cues": _scalar(_cues("solution")),
    "length_score": _scalar(_fit("solution")),
    "count_final_markers": _scalar(f"len({_all('solution', f'{_LABEL}')})"),
    "jaccard": f"SELECT row_no, round({_jaccard('a', 'b')}, 6) AS similarity FROM (SELECT row_no, {_tokens(_norm('solution'))} AS a, {_tokens(_norm('question'))} AS b FROM cand)",
    "scan_math_csv": "SELECT id, question, answer FROM src",
    "scan_candidates_checked": "SELECT row_no, id, candidate_index, question, answer, solution, parsed_answer, parser_method, answer_match, finish_status FROM solution_candidates",
    "scan_candidates_eligible": "SELECT row_no, id, candidate_index FROM solution_candidates WHERE answer_match AND parser_method = 'final_answer' AND finish_status = 'eos'",
    "scan_judgments_unique": "SELECT id, candidate_index, count(*) AS rows FROM solution_judgments GROUP BY ALL HAVING count(*) > 1",
    "scan_sft": f"""SELECT row_no, CASE WHEN id IS NULL OR question IS NULL OR completion IS NULL OR {_strip('id')} = '' OR {_strip('question')} = '' OR {_strip('completion')} = '' THEN 'empty_value'
        WHEN row_no <> min(row_no) OVER (PARTITION BY id) THEN 'duplicate_id'
        WHEN {_method(_strip('completion'))} <> 'final_answer' OR {_value(_strip('completion'))} IS DISTINCT FROM {_strip('answer')} THEN 'mismatch' END AS problem FROM reasoning_train_sft""",
    "answer_match": "SELECT row_no, parsed_answer <> '' AND parsed_answer = answer AS matches FROM cand",
    "label_changed": "SELECT row_no, original_answer, answer, label_changed FROM recon",
    "cheap_filter": f"SELECT row_no, {_first(_CHEAP)} AS reason FROM recon",
    "candidate_rejection_reason": f"SELECT row_no, {_first(_TEXT)} AS reason FROM cand",
    "sft_gate_v1": "SELECT row_no, reason FROM gate1",
    "sft_gate_v2": "SELECT row_no, reason FROM gate2",
    "verify_eligible": "SELECT DISTINCT u.id FROM uniq u JOIN indep i ON u.id = i.id JOIN src s ON u.id = s.id WHERE i.parser_method = 'final_answer' AND i.finish_status = 'eos' AND i.parsed_answer = s.answer",
    "sympy_eligible": "SELECT id, candidate_index FROM judged WHERE verdict = 'PASS' AND parse_status = 'ok'",
    "usable_verdict": "SELECT row_no, CASE WHEN parse_status = 'ok' THEN verdict ELSE 'UNCERTAIN' END AS usable FROM judged",
    "reconcile_projection": "SELECT row_no, id, candidate_index, question, answer, parsed_answer, parser_method, answer_match, finish_status, original_answer, label_changed FROM recon",
    "sft_projection": "SELECT * FROM sft1 WHERE solution_source <> 'final-only-fallback'",
    "missing_policy": "SELECT * FROM sft1",
    "recommended_action": "SELECT id, recommended_next_action FROM queue",
    "reconcile_join": "SELECT * FROM (SELECT 'RECONCILED' AS outcome, count(*) AS rows FROM recon HAVING count(*) > 0) UNION ALL SELECT issue, CAST(sum(candidate_rows) AS BIGINT) FROM issues GROUP BY issue",
    "composite_lookup": f"SELECT j.row_no, sha256(c.solution) AS sha FROM judged j JOIN cand c {_PAIR}",
    "sympy_lookup": f"SELECT j.row_no, coalesce(c.status, '') AS status FROM judged j LEFT JOIN (SELECT id, candidate_index, arg_max(status, row_no) AS status FROM checks GROUP BY ALL) c {_PAIR}",
    "semi_join_selected": "SELECT row_no FROM cand c SEMI JOIN reasoning_train_sft s ON c.id = s.id",
    "anti_join_rejudge": "SELECT row_no FROM judged j ANTI JOIN queue q ON j.id = q.id",
    "anti_join_resume": "SELECT row_no FROM cand c ANTI JOIN solution_judgments j ON c.id = j.id AND c.candidate_index = j.candidate_index WHERE answer_match",
    "id_overlap_check": "SELECT id FROM problems INTERSECT SELECT id FROM reasoning_train_sft",
    "question_profile_join": "SELECT id, reconciled_candidates, unique_matching_candidates, coalesce(own_answer, '') AS own_answer, passes, fails, unsure, judged, sympy_fail, usable FROM profile",
    "count_per_id": "SELECT id, count(*) AS rows FROM recon GROUP BY id",
    "verdict_counts": "SELECT * FROM verdicts",
    "sympy_fail_count": "SELECT id, count(*) AS rows FROM checks WHERE status = 'FAIL' GROUP BY id",
    "issue_rollup": "SELECT * FROM issues",
    "reason_set": "SELECT id, reason_codes FROM queue",
    "usable_passes": "SELECT id, usable AS usable_passes FROM profile",
    "rejudge_queue": "SELECT * FROM queue",
    "reason_histogram": "SELECT reason, count(*) AS rows FROM reasons GROUP BY reason",
    "action_histogram": "SELECT recommended_next_action, count(*) AS rows FROM queue GROUP BY ALL",
    "rejection_histogram": "SELECT reason, count(*) AS rows FROM gate2 WHERE reason IS NOT NULL GROUP BY reason",
    "generation_summary": f"SELECT *, {_rate('covered', 'questions')} AS coverage FROM (SELECT count(*) AS candidate_rows, count(*) FILTER (answer_match) AS matched_rows, count(DISTINCT id) FILTER (answer_match) AS covered, (SELECT count(*) FROM src) AS questions FROM cand c SEMI JOIN src s ON c.id = s.id)",
    "judge_summary": f"SELECT *, judged - passed AS failed, {_rate('passed', 'judged')} AS pass_rate FROM (SELECT count(*) AS judged, count(*) FILTER (verdict = 'PASS' AND parse_status = 'ok') AS passed, count(*) FILTER (parse_status <> 'ok') AS parse_errors FROM judged_v1)",
    "independent_summary": "SELECT count(*) AS completed, count(*) FILTER (parsed_answer <> '') AS parsed, count(*) FILTER (finish_status = 'eos') AS finished, (SELECT count(*) FROM src) AS questions FROM indep",
    "verify_summary": "SELECT count(*) AS rows, count(*) FILTER (verdict = 'PASS') AS pass, count(*) FILTER (verdict = 'FAIL') AS fail, count(*) FILTER (verdict = 'UNCERTAIN') AS uncertain, count(*) FILTER (parse_status <> 'ok') AS parse_errors FROM judged",
    "sympy_summary": "SELECT count(*) AS rows, count(*) FILTER (status = 'PASS') AS pass, count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (status = 'NOT_APPLICABLE') AS not_applicable FROM checks",
    "reconcile_summary": "SELECT count(*) AS reconciled, count(*) FILTER (label_changed) AS label_changed_rows, count(*) FILTER (NOT label_changed) AS unchanged_rows, count(DISTINCT id) AS questions FROM recon",
    "dedup_summary": f"""SELECT *, eligible_before_dedup - unique_rows AS duplicate_rows_removed FROM (
        SELECT count(*) AS input_rows, count(*) FILTER (why IS NULL) AS eligible_before_dedup, count(*) FILTER (why = 'answer_mismatch') AS answer_mismatch,
            count(*) FILTER (why = 'missing_final_marker') AS missing_final_marker, count(*) FILTER (why = 'truncated') AS truncated FROM (SELECT {_first(_CHEAP)} AS why FROM recon)),
        (SELECT count(*) AS unique_rows, count(DISTINCT id) AS questions, max(dedup_group) AS largest_group FROM uniq)""",
    "sft_summary_v1": f"""SELECT *, source_rows - sft_rows AS dropped_rows, {_rate('reasoning_rows', 'source_rows')} AS coverage FROM (
        SELECT count(*) AS sft_rows, count(*) FILTER (solution_source <> 'final-only-fallback') AS reasoning_rows, count(*) FILTER (solution_source = 'final-only-fallback') AS final_only_rows,
            (SELECT count(*) FROM src) AS source_rows FROM sft1),
        (SELECT coalesce(string_agg(id, '|' ORDER BY row_no), '') AS missing_examples FROM (
            SELECT s.id, s.row_no FROM src s JOIN sft1 t ON s.id = t.id WHERE t.solution_source = 'final-only-fallback' ORDER BY s.row_no LIMIT 20))""",
    "sft_summary_v2": f"SELECT *, {_rate('sft_rows', 'source_rows')} AS coverage FROM (SELECT (SELECT count(*) FROM best2 b SEMI JOIN src s ON b.id = s.id) AS sft_rows, (SELECT count(*) FROM src) AS source_rows)",
    "correct_flags": "SELECT row_no, prediction = label AS correct, truncated FROM pred",
    "eval_summary_v2": f"SELECT *, {_rate('correct', 'rows')} AS accuracy, {_rate('parse_failures', 'rows')} AS parse_failure_rate, {_rate('truncated', 'rows')} AS truncation_rate FROM (SELECT count(*) AS rows, count(*) FILTER (prediction = label) AS correct, count(*) FILTER (prediction = '') AS parse_failures, count(*) FILTER (method = 'final_answer') AS marker_parses, count(*) FILTER (truncated) AS truncated FROM pred)",
    "eval_summary_v1": f"""SELECT *, {_rate('correct', 'rows')} AS accuracy FROM (SELECT count(*) AS rows, count(*) FILTER (prediction <> '') AS valid_predictions, count(*) FILTER (prediction = label) AS correct
        FROM (SELECT coalesce({_integer('n')}, '') AS prediction, label FROM (SELECT {_LAST_NUMBER} AS n, s.answer AS label FROM cand c JOIN src s ON c.id = s.id)))""",
    "length_percentiles": "SELECT quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.95) AS p95, quantile_disc(n, 0.99) AS p99, max(n) AS max, count(*) FILTER (n > 600) AS over_limit FROM (SELECT length(completion) AS n FROM reasoning_train_sft)",
    "best_candidate_v2": f"SELECT id, candidate_index FROM elig WHERE {_INDEX} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_BY_SCORE}) = 1",
    "best_candidate_v1": f"SELECT id, candidate_index FROM recon WHERE answer_match AND {_INDEX} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_DONE_FIRST}) = 1",
    "first_exact_dedup": f"SELECT min(row_no) AS row_no FROM cand GROUP BY id, {_collapse('solution')}",
    "greedy_near_dedup": "SELECT row_no, id, candidate_index FROM uniq",
    "dedup_group": "SELECT row_no, dedup_group FROM uniq",
    "hash_rank_partition": "SELECT id, CASE WHEN row_number() OVER (ORDER BY sha256(id)) <= (count(*) OVER ()) * 70 // 100 THEN 'first' ELSE 'rest' END AS share FROM (SELECT DISTINCT id FROM problems WHERE id IS NOT NULL)",
    "first_seen_ids": "SELECT id, min(row_no) AS first_row FROM solution_candidates WHERE id IS NOT NULL GROUP BY id",
    "head_limit": "SELECT id, row_no FROM problems ORDER BY row_no LIMIT 20",
    "best_epoch": f"""SELECT model FROM (SELECT model, count(*) FILTER (upper({_strip('verdict')}) = 'PASS')::DOUBLE / count(*) AS r, count(*) FILTER (parse_status <> 'ok')::DOUBLE / count(*) AS f
        FROM solution_judgments GROUP BY model) ORDER BY r DESC, f, model LIMIT 1""",
    "bundle_indices": f"SELECT a.id FROM (SELECT id, count(*) AS n FROM uniq GROUP BY id) a JOIN (SELECT j.id, count(*) AS m FROM judged j SEMI JOIN uniq u {_PAIR} GROUP BY j.id) b ON a.id = b.id JOIN (SELECT id, count(*) AS j FROM judged GROUP BY id) c ON a.id = c.id WHERE n = m AND m = j",
    "incomplete_bundles": f"SELECT * FROM (SELECT u.id, count(*) AS missing FROM uniq u ANTI JOIN judged j {_PAIR} GROUP BY u.id) m SEMI JOIN judged j ON m.id = j.id",
    "stale_judgments": f"SELECT j.row_no FROM judged_v1 j LEFT JOIN cand c {_PAIR} WHERE c.id IS NULL OR j.solution_sha256 IS DISTINCT FROM sha256(c.solution)",
    "stale_independent": "SELECT i.id FROM indep i LEFT JOIN src s ON i.id = s.id WHERE s.id IS NULL OR i.question_sha256 <> sha256(s.question)",
    "teacher_messages": _chat(chat.TEACHER),
    "student_messages": _chat(chat.STUDENT),
    "answer_messages": _chat(chat.ANSWER_ONLY),
    "judge_messages": "SELECT row_no, 'Problem:' || chr(10) || question || chr(10) || chr(10) || 'Reference final answer:' || chr(10) || answer || chr(10) || chr(10) || 'Candidate solution:' || chr(10) || solution AS user FROM cand",
    "independent_prompt": f"SELECT id, {_text(chat.INDEPENDENT)} || chr(10) || chr(10) || 'Problem:' || chr(10) || question || '<think>' || chr(10) AS prompt FROM src",
    "training_example": "SELECT row_no, question AS user, completion AS assistant FROM reasoning_train_sft WHERE question IS NOT NULL AND completion IS NOT NULL",
    "verifier_prompt": f"""SELECT u.id, u.bundle, {_text(chat.VERIFIER)} || chr(10) || chr(10) || 'Problem:' || chr(10) || s.question || chr(10) || chr(10) || 'Reference integer label:' || chr(10) || s.answer || chr(10) || chr(10)
        || 'Independent solution (created without the label or candidates):' || chr(10) || i.independent_solution || chr(10) || chr(10) || 'Candidates:' || chr(10) || u.c || '<think>' || chr(10) AS prompt
        FROM (SELECT id, 0::BIGINT AS bundle, string_agg('[Candidate ' || candidate_index || ']' || chr(10) || solution, chr(10) || chr(10) ORDER BY dedup_group) AS c FROM uniq GROUP BY ALL) u
        JOIN src s ON u.id = s.id JOIN indep i ON u.id = i.id""",
    "extract_last_number": f"SELECT row_no, coalesce({_integer('n')}, '') AS value FROM (SELECT row_no, {_LAST_NUMBER} AS n FROM solution_candidates WHERE solution IS NOT NULL)",
    "extract_final_answer_fallback": f"""SELECT row_no, CASE WHEN method = 'none' THEN coalesce({_integer('n')}, '') ELSE value END AS value, CASE WHEN method = 'none' AND n IS NOT NULL THEN 'last_integer' ELSE method END AS method
        FROM (SELECT row_no, {_value('solution')} AS value, {_method('solution')} AS method, {_LAST_INTEGER} AS n FROM solution_candidates WHERE solution IS NOT NULL)""",
    "parse_judgment_v1": f"""SELECT row_no, CASE WHEN good THEN v ELSE 'FAIL' END AS verdict, CASE WHEN good THEN r ELSE 'Could not parse a valid verifier JSON object.' END AS reason, CASE WHEN good THEN 'ok' ELSE 'parse_error' END AS parse_status
        FROM (SELECT *, coalesce(v IN ('PASS', 'FAIL') AND r <> '', false) AS good FROM (SELECT row_no, upper({_strip("json_extract_string(j, '$.verdict')")}) AS v, {_strip("json_extract_string(j, '$.reason')")} AS r
            FROM (SELECT row_no, {_OBJECT} AS j FROM solution_judgments)))""",
    "parse_judgments_v2": f"""SELECT row_no, CASE WHEN json_type(j, '$.judgments') = 'ARRAY' THEN 'ok' ELSE 'parse_error' END AS parse_status,
        CASE WHEN json_type(j, '$.judgments') = 'ARRAY' THEN json_array_length(j, '$.judgments')::INTEGER ELSE 0 END AS items FROM (SELECT row_no, {_OBJECT} AS j FROM deepseek_candidate_judgments)""",
    "judgment_items": f"""WITH raw AS (SELECT id, row_no, CASE WHEN json_type(j, '$.judgments') = 'ARRAY' THEN j END AS j FROM (SELECT id, row_no, {_OBJECT} AS j FROM judged WHERE raw_judgment <> '')),
        items AS (SELECT id, row_no, k, json_extract(j, '$.judgments[' || k || ']') AS x FROM (SELECT *, unnest(range(json_array_length(j, '$.judgments')::BIGINT)) AS k FROM raw WHERE j IS NOT NULL)),
        last AS (SELECT id, json_extract_string(x, '$.candidate_index') AS candidate_index, upper(coalesce(json_extract_string(x, '$.verdict'), 'UNCERTAIN')) AS v, {_strip("coalesce(json_extract_string(x, '$.reason'), 'Missing candidate judgment.')")} AS r
            FROM items QUALIFY row_number() OVER (PARTITION BY id, json_extract_string(x, '$.candidate_index') ORDER BY row_no DESC, k DESC) = 1),
        status AS (SELECT id, arg_max(j IS NOT NULL, row_no) AS parsed FROM raw GROUP BY id)
        SELECT row_no, CASE WHEN good THEN v ELSE 'UNCERTAIN' END AS item_verdict, CASE WHEN good AND parsed AND parse_status = 'ok' THEN 'ok' ELSE 'incomplete_or_parse_error' END AS item_status
        FROM (SELECT d.row_no, d.parse_status, s.parsed, coalesce(l.v, 'UNCERTAIN') AS v, coalesce(l.v, 'UNCERTAIN') IN ('PASS', 'FAIL', 'UNCERTAIN') AND coalesce(l.r, 'Missing candidate judgment.') <> '' AS good
            FROM judged d LEFT JOIN last l USING (id, candidate_index) LEFT JOIN status s ON d.id = s.id)""",
    "sft_v2": f"""SELECT s.id, s.question, {_strip('b.solution')} AS solution, s.answer, {_strip('b.solution')} AS completion, 'verified' AS solution_source, b.candidate_index FROM src s JOIN best2 b ON s.id = b.id""",
}

ORACLE: dict[str, str] = {name: _with(sql) for name, sql in _QUERIES.items()}
