from mathloom.llm import defects

QUESTION = "A rectangle of 71 by 22 folded wheels is framed with 9 stamps. How many stamps does Kelty have once 4 are gone?"
STEPS = "Square 30 to obtain 30 * 30 = 900, then compare with 41. Adding 7 to both sides, g + 7 = 168 turns into g = 161."
GERMAN = "Wir rechnen schrittweise für Jolun. In 66 Reihen liegen je 7 Stühle, das ergibt 66 * 7 = 462 für die Gruppe."

CASES = [
    (None, "empty"), ("", "empty"), (" \t\n", "empty"), ("...", "empty"), ("Final answer:", "empty"), ("\\boxed{}", "empty"), ("N/A", "empty"), ("(none)", "empty"), ("[]", "empty"),
    ("I'm sorry, but I can't help with this problem.", "refusal"), ("Leider darf ich diese Aufgabe nicht lösen.", "refusal"), ("Lo siento, pero no puedo resolver este problema.", "refusal"),
    ("Malheureusement, je ne peux pas répondre à cette question.", "refusal"), ("죄송하지만 이 문제는 도와드릴 수 없습니다.", "refusal"), ("Unfortunately, I can't help with this request.\nFinal answer: 0", "refusal"),
    (QUESTION, "copied_question"), ("Problem: " + QUESTION.upper(), "copied_question"), (QUESTION + "\n" + QUESTION + "\nFinal answer: 5", "copied_question"), (QUESTION.replace("folded", "rather folded"), "copied_question"),
    (GERMAN + "\nFinal answer: 12", "other_language"),
    (STEPS + " Combine both", "truncated"), (STEPS + "\nFinal answer: $", "truncated"), (STEPS + "\n**Result** \\boxed{", "truncated"), (STEPS + " Reducing modulo…", "truncated"), ('{"given": "x", "work": "' + STEPS, "truncated"),
    (STEPS + "\nFinal answer: 161", None), ("So 3 * 4 = 12.\nFinal answer: 12", None), (STEPS + " So the requested number is 161.", None), ("I cannot use the first idea, so here is another.\n" + STEPS + "\nFinal answer: 3", None),
    (QUESTION + "\n" + STEPS + " " + STEPS + "\nFinal answer: 161", None), ("Note y < 64 since Ruvim cannot carry more than 22 plus 42 scarves.\n**Result** \\boxed{64}.", None),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, QUESTION, t, "x") for i, (t, _) in enumerate(CASES)], "row_no long, question string, solution string, defect string")
    got = {r.row_no: r.defect for r in defects.broken_pairs(df).collect()}
    assert got == {i: d for i, (_, d) in enumerate(CASES) if d}


def test_neighbours_show_what_was_cut(spark):
    whole = [STEPS.replace("30", str(30 + i)) + f"\nFinal answer: 63178{i}" for i in range(40)]
    rows = whole + [t[:-3] for t in whole[:20]] + whole[20:30] + [whole[0] + "\nFinal answer: 631780"]
    expected = {40 + i: "truncated" for i in range(20)}
    df = spark.createDataFrame([(i, QUESTION, t) for i, t in enumerate(rows)], "row_no long, question string, solution string")
    for parts in ("1", "7", "61"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.row_no: r.defect for r in defects.broken_pairs(df).collect()}
        assert got == expected
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_length_limit_shows_as_a_spike(spark):
    texts = []
    for i in range(80):
        t = f"Answer: {i}. " + "word " * 40 + f"tail{i}"
        texts.append((t + "x" * 400)[:300])
    others = [f"Answer: {i}. " + "other words " * (10 + i % 40) + f"end{i}" for i in range(200)]
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts + others)], "row_no long, question string, solution string")
    got = {r.row_no for r in defects.broken_pairs(df).where("defect = 'truncated'").collect()}
    assert got == set(range(80))
    assert defects.broken_pairs(df.limit(0)).collect() == []


def test_spikes_count_different_texts(spark):
    others = [f"Answer: {i}. " + "other words " * (10 + i % 40) + f"end{i}" for i in range(200)]
    copies = ["So 6 * 7 = 42.\nFinal answer: 42"] * 60 + [STEPS + "\nAnswer: 7. All in all that is it"] * 60
    numbers = [STEPS + f"\nFinal answer: {i}" for i in range(100, 200)]
    cut = [(f"Answer: {i}. " + "word " * 40 + f"tail{i}" + "x" * 400)[:300] for i in range(30)]
    texts = others + copies + numbers + cut
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "row_no long, question string, solution string")
    got = {r.row_no for r in defects.broken_pairs(df).collect()}
    assert got == set(range(len(texts) - 30, len(texts)))


def test_neighbours_and_recorded_evidence_beside_the_phrases(spark):
    early = "Therefore 3 of 71 wheels stay. " + STEPS
    last = STEPS + " Therefore 12 stay."
    cases = [
        (early, "eos", "truncated"), (early + " Then 5 more come, which makes 8.\nFinal answer: 8", "eos", None),
        ("A" + last, "eos", "truncated"), ("A" + last + " Of those 5 are sold.\nFinal answer: 7", "eos", None),
        ("B" + last, "eos", None), ("B" + last + "\nFinal answer: 12", "eos", None),
        ("C" + STEPS + " Hence x equals 42.", "eos", None), ("D" + STEPS + " Hence x equals 42.", None, None), ("E" + STEPS + " Hence x equals 42.", "max_tokens", None),
        ("F" + STEPS + " Unseen phrase with 4.", "max_tokens", "truncated"), ("G" + STEPS + " Other words with 4.", "eos", None),
        *((f"H{i}" + STEPS + f" Therefore {i} stay.", "eos", None) for i in range(10, 20)),
    ]
    df = spark.createDataFrame([(i, None, t, f) for i, (t, f, _) in enumerate(cases)], "row_no long, question string, solution string, finish_status string")
    assert {r.row_no: r.defect for r in defects.broken_pairs(df).collect()} == {i: d for i, (*_, d) in enumerate(cases) if d}


def test_null_questions_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, None, GERMAN + "\nFinal answer: 1"), (2, None, None), (3, QUESTION, None), (4, QUESTION, GERMAN), (5, QUESTION, GERMAN)], "row_no long, question string, solution string")
    assert {r.row_no: r.defect for r in defects.broken_pairs(df).collect()} == {2: "empty", 3: "empty", 4: "other_language", 5: "other_language"}


def _texts(closings, seed):
    """Texts of shuffled steps in the given closing words, and which of them were cut."""
    import random

    rng = random.Random(seed)
    steps = ["Adding {a} gives {b} in all.", "Each of the {a} boxes holds {b} pens.", "We split {a} into {b} parts.", "Now {a} times {b} is what we need.", "After {a} days {b} remain."]
    out = []
    for i in range(400):
        body = [x.format(a=rng.randrange(10, 900), b=rng.randrange(10, 900)) for x in rng.choices(steps, k=rng.randrange(3, 8))]
        text = " ".join([*body, rng.choice(closings).format(n=rng.randrange(10, 900))])
        cut = i % 10 == 0
        if cut:
            text = text[: rng.randrange(20, len(" ".join(body)))]
        out.append((i, None, text, "max_tokens" if cut and rng.random() < 0.7 else "eos", cut))
    return out


def test_closing_phrases_are_learned_from_the_corpus(spark):
    """Phrases that no list has; marks at the end tell nothing of texts cut between sentences."""
    rows = _texts(["Quantity sought: exactly {n} units.", "Our tally comes to {n} now.", "Derhalben zähle ich {n} Stück."], 5)
    df = spark.createDataFrame([r[:4] for r in rows], "row_no long, question string, solution string, finish_status string")
    found = defects.judged_pairs(df, "row_no", "question", "solution", "finish_status", "parser_method", 8.0, 1e-9).collect()
    got, true = {r.row_no for r in found}, {r[0] for r in rows if r[4]}
    assert len(got & true) >= 0.95 * len(true) and len(got & true) >= 0.95 * len(got)
    assert sum(r.shown_by == "sentence" for r in found) >= 0.6 * len(true)
