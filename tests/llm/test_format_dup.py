import json
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from mathloom.llm import format_dup


def reduced(t):
    return "".join(c for c in t.lower() if c.isalnum() or c in "+-*/^=<>")


def key(t):
    bare = t.strip()
    try:
        o = json.loads(bare) if bare[:1] == "{" else None
    except ValueError:
        o = None
    if isinstance(o, dict):
        return frozenset(filter(None, (reduced(k + (v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))) for k, v in o.items())))
    lines = [x for x in re.split(r"\r\n|[\r\n]", bare) if x.strip()]
    if lines and all(re.match(r"[ \t]*[A-Za-z][A-Za-z ]*:", x) for x in lines):
        return frozenset(filter(None, map(reduced, lines)))
    return frozenset([reduced(t)])


def variants(rng, fields):
    f = fields[:]
    rng.shuffle(f)
    yield "\n".join(f"{k} : {v}" for k, v in f)
    yield json.dumps(dict(f), indent=rng.choice([None, 1]))
    yield "\r\n\r\n".join(f"{k.upper()}:{v.upper()}" for k, v in f)


def test_groups_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        scope = f"s{i % 7}"
        fields = [(k, f"x = {rng.randrange(9)} + {rng.randrange(9)}, été {i % 4}.") for k in ("Given", "Work", "Final answer")]
        plain = f"We take {rng.randrange(4)} + {rng.randrange(3)} = {i % 5}. Straße {i % 3}!"
        rows += [(scope, t) for t in (*variants(rng, fields), plain, plain.upper(), " " + plain.replace(" ", "  "), plain + "+", plain.replace("+", "-"))]
    rows += [(None, "abc"), ("s1", None), ("s1", ""), ("s1", "..."), ("s1", "=="), ("s1", "=="), ("s2", '{"a": [1, {"b": 2}]}'), ("s2", '{ "a":[1, {"b":2}] }'), ("s2", "{broken"), ("s2", "Broken"), ("s3", "word " * 50000), ("s3", "WORD" * 50000)]
    rows += [("hot", f"{'  ' * (i % 5)}The same, {'SOLUTION' if i % 2 else 'solution'}{'.' * (i % 3)}") for i in range(300)]
    groups = defaultdict(list)
    for n, (s, t) in enumerate(rows):
        if s is not None and t is not None and any(c.isalnum() for c in t):
            groups[s, key(t)].append(n)
    expected = {(min(g), len(g)) for g in groups.values() if len(g) > 1}
    df = spark.createDataFrame([(s, t, n, "x") for n, (s, t) in enumerate(rows)], "id string, solution string, row_no long, first string")
    for limit in (20_000, 7):
        got = format_dup.hidden_duplicates(df, F.col("id"), group_rows=limit).collect()
        assert {(r.row_no, r.copies) for r in got} == expected and len(got) == len(expected)
    assert format_dup.hidden_duplicates(df.limit(0), F.col("id")).collect() == []


def test_exact_comparison_tells_what_hashes_would_not():
    a = format_dup.Folded(["ab c", "a: 1\nb: 2", "xy", "", None])
    b = format_dup.Folded(["A-b c".replace("-", ""), "b 2"[:0] + "B: 2\nA: 1", "xz", "", ""])
    assert a.same(b).tolist() == [True, True, False, True, True]
