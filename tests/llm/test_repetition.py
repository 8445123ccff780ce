import re

import numpy as np

from mathloom.llm import repetition

WORD = re.compile(r"[^\W_]+")


def test_equals_the_rule_and_keeps_every_row(spark):
    rng = np.random.default_rng(1)
    texts = []
    for i in range(400):
        w = [f"w{x}" for x in rng.integers(0, 400, rng.integers(5, 80))]
        for _ in range(int(rng.integers(0, 5)) if i % 3 == 0 else 0):
            w += w[: int(rng.integers(1, 20))]
        texts.append(" ".join(w))
    texts += [None, "", "   ", "a " * 19, "a " * 20, "spam " * 5000, "line one\n" * 12]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as words", "2 as anomalous")
    got = repetition.repetition(df).collect()
    assert len(got) == len(rows)
    for r in got:
        w = WORD.findall((texts[r.doc_id] or "").lower())
        g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        share = 1 - len(set(g)) / len(g) if g else 0.0
        assert r.words == len(w) and abs(r.repeated_share - share) < 1e-9
        assert r.repetitive == (len(w) >= 20 and share >= 0.3 - 1e-12)
        assert r.anomalous or not r.repetitive
    assert repetition.repetition(df.limit(0)).collect() == []


def test_forest_calibrated_on_some_rows_finds_the_others(spark):
    rng = np.random.default_rng(2)
    texts = []
    for i in range(4000):
        w = [f"w{x}" for x in rng.integers(0, 3000, rng.integers(20, 120))]
        if i % 10 == 0:
            w += w[: len(w) // 2] * int(rng.integers(2, 6))
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = repetition.repetition(df, sample_rows=500, labelled_rows=1000).collect()
    true = {r.doc_id for r in whole if r.words >= 20 and r.repeated_share >= 0.3}
    found = {r.doc_id for r in whole if r.repetitive}
    assert len(true) >= 300 and found <= true and len(found) >= 0.97 * len(true)
    # The forest saves the counting of runs: few others are anomalous.
    assert sum(r.anomalous for r in whole) <= 0.3 * len(texts)
    alone = {r.doc_id for r in repetition.repetitive(df, sample_rows=500, labelled_rows=1000).collect()}
    assert alone == found


def test_without_labelled_rows_every_document_is_measured(spark):
    df = spark.createDataFrame([(i, f"a{i} b{i} c{i} d{i} e{i} " * 4) for i in range(30)], "doc_id long, text string")
    assert repetition.repetitive(df, least_share=0.99).collect() == []
    assert repetition.repetitive(df).count() == 30
