import random
import re

from mathloom.llm import kernels, leak

WORD = re.compile(r"[^\W_]+")


def longest(a, b):
    best = (0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[1]:
                best = (i, n)
    return best


def test_automaton_finds_longest_runs():
    rng = random.Random(4)
    for _ in range(40):
        items = [[rng.randrange(4) for _ in range(rng.randrange(0, 25))] for _ in range(4)]
        machine = leak.SuffixAutomaton()
        for i, s in enumerate(items):
            machine.add(s, i)
        text = [rng.choice([0, 1, 2, 3, -1]) for _ in range(60)]
        got = {i: n for i, _, n in machine.matches(text, 3)}
        for i, s in enumerate(items):
            n = longest(text, s)[1]
            assert got.get(i, 0) == (n if n >= 3 else 0)
        for i, first, n in machine.matches(text, 3):
            assert any(items[i][j : j + n] == text[first : first + n] for j in range(len(items[i])))


def test_blocks_and_unusual_rows(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [" ".join(rng.choice(vocabulary) for _ in range(30)) for _ in range(6)]
    items = [(i, t) for i, t in enumerate(passage)] + [(6, None), (7, ""), (8, "too short")]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(15)) + " " + (" ".join(passage[i % 6].split()[5 : 5 + 8 + i]).upper()) + " tail") for i in range(12)]
    docs += [(50, None), (51, ""), (52, passage[0]), (52, passage[0]), (53, "x, " * 20000 + passage[1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as words")
    b = spark.createDataFrame(items, "item_id long, text string")
    expected = []
    for i, t in docs:
        w = WORD.findall((t or "").lower())
        for k, u in items:
            n = longest(w[-60:], WORD.findall((u or "").lower()))[1]
            if n >= 12:
                expected.append((i, k, n))
    for block in (10, 200_000):
        got = leak.leaked_spans(d, b, 12, block_words=block).collect()
        assert sorted((r.doc_id, r.item_id, r.words) for r in got) == sorted(expected)
    # Many blocks, several parts of a block, anchors joined in parts: the same spans.
    for block, texts, sent in ((40, 2, 10), (200_000, 1, 0)):
        got = leak._found(d, b, 12, "doc_id", "text", "item_id", "text", block, False, texts, sent).collect()
        assert sorted((r.doc_id, r.item_id, r.words) for r in got) == sorted(expected)
    assert leak.leaked_spans(d.limit(0), b).collect() == [] and leak.leaked_spans(d, b.limit(0)).collect() == []


def test_every_shared_window_has_a_shared_anchor():
    rng = random.Random(8)
    for least in (1, 2, 5, 12):
        a = [f"w{rng.randrange(6)}" for _ in range(200)]
        b = [f"w{rng.randrange(6)}" for _ in range(60)] + a[70 : 70 + least] + [f"v{rng.randrange(6)}" for _ in range(60)]
        found, offsets = leak.anchors(kernels.words([" ".join(a), "", " ".join(b)]), least)
        assert offsets[1] == offsets[2] and set(found[: offsets[1]].tolist()) & set(found[offsets[2] :].tolist())


def test_corpus_is_read_once_for_any_number_of_items(spark, tmp_path):
    rng = random.Random(9)
    passages = [" ".join(f"w{rng.randrange(90_000)}" for _ in range(30)) for _ in range(10_000)]
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    texts = [(i, f"head {passages[(7 * i) % 10_000]} tail") for i in range(300)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    got = leak.leaked_spans(docs, items)
    plan = got._jdf.queryExecution().toString()
    # The corpus itself isn't in the plan any more: its one pass wrote the texts with anchors.
    assert f"{tmp_path}/docs" not in plan
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == sorted((i, (7 * i) % 10_000) for i in range(300))


def test_spans_are_removed():
    text = "one two, three four five six seven"
    assert leak.without_spans(text, [(1, 2)]) == "one  four five six seven"
    assert leak.without_spans(text, [(0, 6)]) is None
    assert leak.without_spans(None, [(0, 1)]) is None and leak.without_spans(text, []) == text


def test_every_run_is_found():
    rng = random.Random(6)
    for _ in range(40):
        item = [rng.randrange(3) for _ in range(25)]
        machine = leak.SuffixAutomaton()
        machine.add(item, 0)
        text = [rng.choice([0, 1, 2, -1]) for _ in range(60)]
        grams = {tuple(item[j : j + 4]) for j in range(len(item) - 3)}
        covered = {p for i in range(len(text) - 3) if tuple(text[i : i + 4]) in grams for p in range(i, i + 4)}
        assert {p for _, first, n in machine.runs(text, 4) for p in range(first, first + n)} == covered


def test_all_passages_of_an_item_leave_the_text(spark):
    words = [f"w{i}" for i in range(40)]
    own = [" ".join(f"{x}{i}" for i in range(30)) for x in "abc"]
    text = " ".join((own[0], " ".join(words[:15]), own[1], " ".join(words[20:34]), own[2]))
    d = spark.createDataFrame([(1, text), (2, " ".join(words) + " tail"), (3, own[0]), (4, None)], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert sorted((r.doc_id, r.first_word, r.words) for r in leak.leaked_runs(d, b).collect()) == [(1, 30, 15), (1, 75, 14), (2, 0, 40)]
    got = {r.doc_id: r.text for r in leak.without_leaks(d, b).collect()}
    assert {k: t and t.split() for k, t in got.items()} == {1: " ".join(own).split(), 2: None, 3: own[0].split(), 4: None}
