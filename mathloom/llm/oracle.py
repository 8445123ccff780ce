"""Plain SQL for the queries that SQL can state over whole tables."""

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def _grams(words: str, k: int) -> str:
    parts = ", ".join(f"{words}[i + {j}]" for j in range(k))
    return f"[array_to_string([{parts}], ' ') for i in range(1, greatest(len({words}) - {k - 2}, 1))]"


#: Steps of truth discovery written out; the given tables need three.
_STEPS = 8
_Z = 1.959963984540054


def _chi(n: str, z: float) -> str:
    return f"(({n}) * pow(greatest(1 - 2.0 / (9 * ({n})) + ({z}) * sqrt(2.0 / (9 * ({n}))), 1e-3), 3))"


def _bound(e: str, n: str) -> str:
    upper = lambda x: f"greatest(least((({x}) + 0.5) / {_chi(f'{n} + 1', -_Z)}, 0.5), 1e-4)"
    return f"CASE WHEN {e} > {n} / 2 THEN 1 - {upper(f'{n} - {e}')} ELSE {upper(e)} END"


def _judge_statistics(step: int) -> str:
    """Errors of each judge against the consensus ``q`` (1 for FAIL) of the items, and the weights they imply."""
    return f"""s{step} AS MATERIALIZED (SELECT judge, count(*) AS votes, sum(q) FILTER (NOT fail) AS miss, sum(q) AS n_fail, sum(1 - q) FILTER (fail) AS alarm, sum(1 - q) AS n_pass FROM cast_votes JOIN q{step} USING (item) GROUP BY judge),
        b{step} AS MATERIALIZED (SELECT judge, votes, {_bound('coalesce(miss, 0)', 'n_fail')} AS error_fail, {_bound('coalesce(alarm, 0)', 'n_pass')} AS error_pass FROM s{step}),
        w{step} AS MATERIALIZED (SELECT *, ln((1 - error_fail) / error_pass) AS if_fail, ln(error_fail / (1 - error_pass)) AS if_pass FROM b{step}),
        q{step + 1} AS MATERIALIZED (SELECT item, CASE WHEN sum(CASE WHEN fail THEN if_fail ELSE if_pass END) + (SELECT ln((sum(n_fail) + 1) / (sum(n_pass) + 1)) FROM s{step}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS q
            FROM cast_votes JOIN w{step} USING (judge) GROUP BY item)"""


_VOTE = "SELECT {{'id': id, 'i': candidate_index}} AS item, {0} AS judge, upper(regexp_replace({1}, '^\\s+|\\s+$', '', 'g')) AS label, {2} AS ok, appended_at, row_no FROM {3}"
_DISCOVERY = f"""
        WITH every AS ({_VOTE.format('model', 'verdict', "parse_status = 'ok'", 'solution_judgments')} UNION ALL {_VOTE.format('model', 'verdict', "parse_status = 'ok'", 'deepseek_candidate_judgments')}
            UNION ALL {_VOTE.format("'sympy'", 'status', 'true', 'sympy_crosschecks')}),
        latest AS (SELECT * FROM every WHERE item.id IS NOT NULL AND item.i IS NOT NULL AND judge IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY item, judge ORDER BY coalesce(appended_at, TIMESTAMP '0001-01-01') DESC, row_no DESC) = 1),
        cast_votes AS MATERIALIZED (SELECT item, judge, label = 'FAIL' AS fail FROM latest WHERE ok AND label IN ('PASS', 'FAIL')),
        q0 AS MATERIALIZED (SELECT item, CASE WHEN avg(fail::INT) > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS q FROM cast_votes GROUP BY item),
        {", ".join(map(_judge_statistics, range(_STEPS)))}"""

_CLEAN = "upper(regexp_replace(id, '[^A-Za-z0-9]', '', 'g'))"

ORACLE: dict[str, str] = {
    "p2_found": f"{_DISCOVERY} SELECT item.id AS id, item.i AS candidate_index FROM q{_STEPS} WHERE q > 0",
    "p2_judges": f"{_DISCOVERY} SELECT judge, votes, round(error_fail, 4) AS error_fail, round(error_pass, 4) AS error_pass FROM b{_STEPS - 1}",
    "p1_found": rf"""
        WITH rows AS (
            SELECT {_CLEAN} AS g, CAST(candidate_index AS BIGINT) AS i, row_no,
                   regexp_replace(solution, '^\s+|\s+$', '', 'g') AS t
            FROM solution_candidates WHERE id IS NOT NULL AND candidate_index IS NOT NULL AND solution IS NOT NULL),
        first AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY g, i ORDER BY row_no) = 1),
        scored AS (
            SELECT *, least(20, len(regexp_extract_all(
                       string_split_regex(t, '(?im)^\s*Final\s+answer\s*:')[1], '[=+*/^]|\\(?:frac|sqrt|times|cdot)'))) AS cues,
                   greatest(0, 1500 - abs(length(t) - 700)) AS fit
            FROM first)
        SELECT row_no FROM scored
        QUALIFY row_number() OVER (PARTITION BY g ORDER BY cues DESC, fit DESC, i) <= 3""",
    "p6_found": rf"""
        WITH sides AS (
            SELECT 'e' AS side, row_no, {_CLEAN} AS k, {_WORDS.format("question")} AS w FROM valid_problems
            UNION ALL SELECT 't', row_no, {_CLEAN}, {_WORDS.format("question")} FROM reasoning_train_sft),
        sets AS (SELECT side, row_no, k, w, list_distinct({_grams("w", 3)}) AS s FROM sides),
        parts AS (SELECT side, row_no, len(s) AS n, unnest(s) AS g FROM sets WHERE len(w) >= 3),
        shared AS (
            SELECT e.row_no AS eval_row, t.row_no AS train_row, any_value(e.n) AS a, any_value(t.n) AS b, count(*) AS o
            FROM parts e JOIN parts t ON e.g = t.g AND e.side = 'e' AND t.side = 't' GROUP BY ALL)
        SELECT eval_row, train_row FROM shared WHERE o >= 0.6 * (a + b - o)
        UNION SELECT e.row_no, t.row_no FROM sets e JOIN sets t ON e.side = 'e' AND t.side = 't' AND e.w = t.w AND len(e.w) > 0
        UNION SELECT e.row_no, t.row_no FROM sets e JOIN sets t ON e.side = 'e' AND t.side = 't' AND e.k = t.k AND e.k <> ''""",
    "p3_found": rf"""
        WITH texts AS (
            SELECT row_no, {_WORDS.format("solution")} AS w FROM solution_candidates
            UNION ALL SELECT row_no, {_WORDS.format("completion")} FROM reasoning_train_sft),
        sets AS (SELECT row_no, w, list_distinct({_grams("w", 3)}) AS s FROM texts WHERE len(w) >= 30),
        parts AS (SELECT row_no, unnest(s) AS g FROM sets),
        shared AS (
            SELECT a.row_no AS x, b.row_no AS y, count(*) AS o
            FROM parts a JOIN parts b ON a.g = b.g AND a.row_no < b.row_no GROUP BY ALL)
        SELECT x AS row_a, y AS row_b FROM shared JOIN sets a ON a.row_no = x JOIN sets b ON b.row_no = y
        WHERE o >= 0.6 * (len(a.s) + len(b.s) - o) AND a.w <> b.w""",
    "p8_found": rf"""
        WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
        x AS (SELECT doc_id, unnest(list_distinct({_grams("w", 12)})) AS g FROM d WHERE len(w) >= 12),
        y AS (SELECT item_id, unnest(list_distinct({_grams("w", 12)})) AS g FROM b WHERE len(w) >= 12)
        SELECT DISTINCT doc_id, item_id FROM x JOIN y ON x.g = y.g""",
    "p9_found": rf"""
        WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
        g AS (SELECT doc_id, {_grams("w", 5)} AS s FROM d WHERE len(w) >= 20)
        SELECT doc_id FROM g WHERE 10 * (len(s) - len(list_distinct(s))) >= 3 * len(s)""",
    "p9_share": rf"""
        WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
        g AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS words, CASE WHEN len(w) >= 5 THEN {_grams("w", 5)} ELSE [] END AS s FROM d)
        SELECT doc_id, words, round(CASE WHEN len(s) > 0 THEN 1.0 - len(list_distinct(s))::DOUBLE / len(s) ELSE 0.0 END, 6) AS repeated_share FROM g""",
}

ORACLE["p6_report"] = f"""
        WITH found AS ({ORACLE["p6_found"]})
        SELECT eval_split, solution_source, count(*) AS pairs, count(DISTINCT eval_row) AS left_rows, count(DISTINCT train_row) AS right_rows
        FROM found JOIN valid_problems v ON v.row_no = eval_row JOIN reasoning_train_sft t ON t.row_no = train_row GROUP BY eval_split, solution_source"""
ORACLE["p3_groups"] = rf"""
        WITH RECURSIVE found AS MATERIALIZED ({ORACLE["p3_found"]}),
        texts AS (
            SELECT row_no, {_WORDS.format("solution")} AS w FROM solution_candidates
            UNION ALL SELECT row_no, {_WORDS.format("completion")} FROM reasoning_train_sft),
        members AS MATERIALIZED (SELECT row_no, w, min(row_no) OVER (PARTITION BY w) AS first FROM texts WHERE len(w) >= 30),
        edges AS MATERIALIZED (
            SELECT DISTINCT a.first AS v, b.first AS u FROM (SELECT row_a, row_b FROM found UNION ALL SELECT row_b, row_a FROM found) f
            JOIN members a ON a.row_no = f.row_a JOIN members b ON b.row_no = f.row_b),
        reached AS (SELECT v, v AS u FROM edges UNION SELECT r.v, e.u FROM reached r JOIN edges e ON e.v = r.u),
        labels AS (SELECT v, min(u) AS label FROM reached GROUP BY v),
        degrees AS (SELECT v, count(*) AS links FROM edges GROUP BY v)
        SELECT m.row_no, coalesce(l.label, m.first) AS "group", coalesce(d.links, 0) AS links
        FROM members m LEFT JOIN labels l ON l.v = m.first LEFT JOIN degrees d ON d.v = m.first"""

_REDUCED = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}+*/^=<>-]', '', 'g')"
_LABELLED = "'^[ \\t]*[A-Za-z][A-Za-z ]*:'"
ORACLE["p5_found"] = f"""
        WITH rows AS (
            SELECT {_CLEAN} AS g, row_no, solution, regexp_replace(solution, '^\\s+|\\s+$', '', 'g') AS t FROM solution_candidates
            WHERE id IS NOT NULL AND regexp_matches(solution, '[\\p{{L}}\\p{{N}}]')),
        parts AS (
            SELECT *, CASE WHEN starts_with(t, '{{') AND ends_with(t, '}}') AND json_valid(t) THEN t END AS j,
                list_filter(string_split_regex(t, '\\r\\n|[\\r\\n]'), lambda x: regexp_matches(x, '\\S')) AS lines FROM rows),
        fields AS (
            SELECT g, row_no, CASE
                WHEN json_type(j) = 'OBJECT' THEN list_transform(json_keys(j), lambda k: k || coalesce(json_extract_string(j, '$."' || k || '"'), 'null'))
                WHEN len(list_filter(lines, lambda x: NOT regexp_matches(x, {_LABELLED}))) = 0 THEN lines ELSE [solution] END AS f FROM parts)
        SELECT min(row_no) AS row_no, count(*) AS copies
        FROM (SELECT g, row_no, list_sort(list_distinct(list_filter(list_transform(f, lambda x: {_REDUCED.format('x')}), lambda x: x <> ''))) AS s FROM fields)
        GROUP BY g, s HAVING count(*) > 1"""
