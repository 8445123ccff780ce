import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mathloom.llm import kernels

WORD = re.compile(r"[^\W_]+")


def words(t):
    return WORD.findall((t or "").lower())


def grams(t, k):
    w = words(t)
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


TEXTS = st.lists(st.one_of(st.none(), st.text(max_size=60), st.text(alphabet="ab C1_-é한", max_size=40)), max_size=12)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words_and_ngrams_agree_with_plain_python(texts):
    w = kernels.words(texts)
    assert w.counts.tolist() == [len(words(t)) for t in texts]
    for k in (1, 3, 5):
        _, offsets = kernels.ngrams(w, k)
        assert np.diff(offsets).tolist() == [len(grams(t, k)) for t in texts]
        _, distinct = kernels.distinct_ngrams(w, k)
        assert np.diff(distinct).tolist() == [len(set(grams(t, k))) for t in texts]
    seq = kernels.sequence_hash(w)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (seq[i] == seq[j]) == (words(a) == words(b))


def test_jaccard_of_pairs():
    rng = random.Random(2)
    a = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 30))) for _ in range(50)]
    b = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(0, 30))) for _ in range(50)]
    shared, united = kernels.jaccard(kernels.words(a), kernels.words(b), 3)
    for x, y, s, u in zip(a, b, shared, united):
        p, q = set(grams(x, 3)), set(grams(y, 3))
        assert (s, u) == (len(p & q), len(p | q))


def test_chunks_cover_everything_and_long_texts_stand_alone():
    texts = ["a" * n for n in (3, 4, 50, 1, 1, 9)] + [None, ""]
    parts = list(kernels.chunks(texts, 10))
    assert [i for lo, hi in parts for i in range(lo, hi)] == list(range(len(texts)))
    assert (2, 3) in parts
    assert list(kernels.chunks([], 10)) == []
