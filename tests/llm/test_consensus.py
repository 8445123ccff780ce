import random
from datetime import datetime

from mathloom.llm import consensus

COLUMNS = "item_a string, item_b string, judge string, label string, ok boolean, at timestamp, row long"
SKILL = {"good": (0.95, 0.95), "fair": (0.85, 0.9), "blind": (0.4, 0.97), "liar": (0.2, 0.25), "fair2": (0.9, 0.8)}


def test_recovers_planted_labels_and_skills(spark):
    rng = random.Random(7)
    truth, rows, n = {}, [], 0
    for i in range(1500):
        fail = truth[str(i)] = rng.random() < 0.3
        for j, (miss, good) in SKILL.items():
            if rng.random() < 0.85:
                right = rng.random() < (miss if fail else good)
                rows.append((str(i), "0", j, rng.choice(["PASS", " pass ", "Pass"]) if right != fail else rng.choice(["FAIL", "fail"]), True, datetime(2026, 1, 2), n := n + 1))
        rows.append((str(i), "0", f"rare{i}", "FAIL" if fail else "PASS", True, datetime(2026, 1, 2), n := n + 1))
    df = spark.createDataFrame(rows[:], COLUMNS)
    few = df.where("judge not like 'rare%'")
    items, judges = consensus.discover(consensus.votes([few]))
    got = {r.item_a: r for r in items.collect()}
    wrong = sum((got[i].consensus == "FAIL") != f for i, f in truth.items() if i in got)
    assert wrong < 0.05 * len(truth)
    assert all(0 <= r.agreement <= 1 for r in got.values())
    error = {r.judge: (r.error_fail, r.error_pass) for r in judges.collect()}
    assert error["liar"][0] > 0.5 and error["liar"][1] > 0.5 and error["good"][0] < 0.15 and error["blind"][0] > 0.45
    # Long-tail annotators of one label each, held as a table and not by the driver.
    items, judges = consensus.discover(consensus.votes([df]), driver_annotators=3)
    assert items.count() == len(truth) and judges.count() == len(SKILL) + 1500


def test_latest_vote_counts_and_unusual_rows(spark):
    old, new = datetime(2026, 1, 1), datetime(2026, 1, 2)
    rows = [
        ("a", "0", "j", "PASS", True, new, 1), ("a", "0", "j", "FAIL", True, old, 9), ("a", "0", "j", "FAIL", True, None, 99),
        ("b", "0", "j", "PASS", True, old, 1), ("b", "0", "j", "UNCERTAIN", True, new, 2), ("c", "0", "j", "PASS", True, new, 1), ("c", "0", "j", "FAIL", True, new, 2),
        (None, "0", "j", "FAIL", True, new, 1), ("d", None, "j", "FAIL", True, new, 1), ("d", "0", None, "FAIL", True, new, 1), ("e", "0", "j", None, True, new, 1), ("f", "0", "j", "FAIL", None, new, 1),
    ]
    cast = consensus.votes([spark.createDataFrame(rows, COLUMNS)])
    assert sorted((r.item_a, r.fail) for r in cast.collect()) == [("a", False), ("c", True)]
    items, judges = consensus.discover(cast.limit(0))
    assert items.collect() == [] and judges.collect() == []


def test_changing_consensus_raises_rather_than_end(spark):
    import pytest

    rng = random.Random(8)
    rows = [(str(i), "0", j, rng.choice(["PASS", "FAIL"]), True, datetime(2026, 1, 2), 10 * i + k) for i in range(200) for k, j in enumerate("abcd")]
    cast = consensus.votes([spark.createDataFrame(rows, COLUMNS)])
    with pytest.raises(RuntimeError):
        consensus.discover(cast, most_steps=0)
    assert consensus.discover(cast)[0].count() == 200
