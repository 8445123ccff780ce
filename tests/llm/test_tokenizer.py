import os
import random

import pytest

from mathloom.llm import tokenizer

PATH = os.environ.get("MATHLOOM_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
needs_files = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")


def by_merging(word, merges):
    """Brute force: the lowest-ranked adjacent pair is merged until none is left."""
    parts = [bytes([b]) for b in word]
    rank = {m: i for i, m in enumerate(merges)}
    while True:
        found = min(((rank.get(p, len(rank)), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(len(rank), 0))
        if found[0] == len(rank):
            return parts
        pair = merges[found[0]]
        out, i = [], 0
        while i < len(parts):
            if tuple(parts[i : i + 2]) == pair:
                out.append(pair[0] + pair[1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


def test_automaton_equals_merging_on_random_merge_lists():
    rng = random.Random(1)
    for _ in range(60):
        tokens, merges = [b"a", b"b", b"c"], []
        while len(merges) < 14:
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens and len(a + b) < 9:
                tokens.append(a + b)
                merges.append((a, b))
        machine = tokenizer.MergeAutomaton({t: i for i, t in enumerate(tokens)}, merges)
        for _ in range(80):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 16)))
            assert [tokens[i] for i in machine.encode(word)] == by_merging(word, merges)


@needs_files
def test_equals_the_public_library_and_round_trips():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(PATH)
    reference.encode_special_tokens = True
    rng = random.Random(3)
    pool = [chr(i) for i in range(32, 127)] + ["é", "ß", "한", "글", "\n", "\r", "\t", "   ", "😀", "<|endoftext|>", "'ll", " ", "aaaa", "==="]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(600)] + [" the quick brown fox's 12345 tails", "x" * 5000]
    encode = tokenizer.Encoder(PATH)
    assert [encode(t) for t in texts] == [x.ids for x in reference.encode_batch(texts, add_special_tokens=False)]
    assert all(tokenizer.decode(encode(t), PATH) == t for t in texts)


@needs_files
def test_corpus_keeps_every_row(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "  ", "y"), (4, "Hello world", None), (4, "Hello world", None)], "doc_id long, text string, ids string")
    out = sorted((r.doc_id, r.ids) for r in tokenizer.encode_corpus(df, PATH).collect())
    assert out == [(1, []), (2, []), (3, [220, 220]), (4, [15496, 995]), (4, [15496, 995])]
    assert tokenizer.encode_corpus(df.limit(0), PATH).collect() == []
