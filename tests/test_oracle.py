"""The SQL side by side with the queries on made-up rows the given tables lack."""

import duckdb
import pytest

from mathloom import queries

#: Folded characters, blanks of other scripts, near-duplicates told apart by folding alone.
TEXTS = [
    "Die Straße GROẞ misst x = 3. Also\nFinal answer: 3", "die strasse gross misst x = 3. also\nFinal answer: 3", "ﬁx the ﬂow: x = 3 and ΛΌΓΟΣ\nFinal answer: 3", "fix the flow: x = 3 and λόγος\nFinal answer: 3",
    "ſo x = 3   done\nFinal answer: 3", "so x = 3 done\nFinal answer: 3", "σύνολος x = 3\nfinal ANSWER : 3", "ΣΎΝΟΛΟΣ x = 3\nFinal answer: 3", "\\boxed{3} x = 3", "x = 3\nFinal answer: 3",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [("p", str(i), "Q", "3", t, "3", "final_answer", True, "eos", i) for i, t in enumerate(TEXTS)]
    schema = "id string, candidate_index string, question string, answer string, solution string, parsed_answer string, parser_method string, answer_match boolean, finish_status string, row_no long"
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(f"{path}/solution_candidates.parquet")
    spark.createDataFrame([("p", "Q", "3", 1)], "id string, question string, answer string, row_no long").repartition(1).write.parquet(f"{path}/problems.parquet")
    return path


@pytest.mark.parametrize("name", ["normalize_text", "normalize_solution_text", "tokens", "first_exact_dedup", "greedy_near_dedup", "extract_final_answer_fallback", "extract_last_number", "jaccard"])
def test_sql_agrees_where_folding_matters(spark, folder, name):
    con = duckdb.connect()
    for table in ("solution_candidates", "problems"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    found = queries.QUERIES[name](spark, folder)
    expected = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(expected.fetchall())
    if name == "first_exact_dedup":
        assert found.count() == 7
