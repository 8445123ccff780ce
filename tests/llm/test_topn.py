import random
import re

from pyspark.sql import functions as F

from mathloom.llm import topn


def test_top_n_with_ties_nulls_and_hot_groups(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(30)}", rng.choice([None, *range(6)]), i) for i in range(3000)] + [(None, 9, -1)]
    df = spark.createDataFrame(rows, "g string, s int, tie int").withColumn("rank", F.lit("x")).withColumn("g_", F.lit(1)).withColumn("least", F.lit(2))
    expected = set()
    groups = {}
    for g, s, t in rows:
        groups.setdefault(g, []).append((-(s if s is not None else -1), t))
    for g, members in groups.items():
        if g is not None:
            expected |= {(g, t, i + 1) for i, (_, t) in enumerate(sorted(members)[:4])}
    for small, limit in ((256, 1000), (2, 1000), (2, 0)):
        got = topn.top_n(df, "g", F.col("s"), [F.col("tie")], 4, F.col("s"), small, limit)
        assert {(r.g, r.tie, r["rank"]) for r in got.collect()} == expected
    assert topn.top_n(df.limit(0), "g", F.col("s"), [F.col("tie")], 4, F.col("s")).collect() == []


def test_best_solutions(spark):
    rows = [
        ("A-1", "0", "x = 1 + 2", 1), ("a 1", "00", "y = 1 + 2 * 3", 2), ("A1", "1", "Final answer: 1+1+1+1", 3), ("A1", "2", "", 4), ("A1", "x", "a = b", 5),
        (None, "0", "a", 6), ("B", None, "a", 7), ("C", "0", None, 8), ("D", " 7 ", " z = 1 ", 9), ("D", "8", "z = 1", 10), ("D", "9", "z = 1" * 4000, 11), ("D", "10", "z = 1", 12),
    ]
    df = spark.createDataFrame(rows, "id string, candidate_index string, solution string, row_no long")
    best = {}
    for i, c, s, r in rows:
        if i is None or c is None or s is None or not re.fullmatch(r"\s*\d+\s*", c):
            continue
        key = (re.sub("[^A-Za-z0-9]", "", i).upper(), int(c))
        body = re.split(r"(?im)^\s*Final\s+answer\s*:", s.strip())[0]
        best.setdefault(key, (-min(20, len(re.findall(r"[=+*/^]|\\(?:frac|sqrt|times|cdot)", body))), -max(0, 1500 - abs(len(s.strip()) - 700)), key[1], r))
    expected = {}
    for (g, _), v in best.items():
        expected.setdefault(g, []).append(v)
    expected = {v[3] for g in expected.values() for v in sorted(g)[:3]}
    assert {r.row_no for r in topn.best_solutions(df, 3).collect()} == expected
