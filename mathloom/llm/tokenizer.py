"""Encode a corpus with a public byte-level BPE vocabulary (problem 7).

The merge list is compiled, merge by merge, into a deterministic automaton over tokens.  The state
a word is in depends on the token before alone: applying the gadget of a merge (a, b), the state
after ``a`` loses its transition for ``b``, because ``a`` followed by ``b`` is from now on the new
token; the new token starts wherever ``a`` did and ends in the state ``b`` led to at that time.  A
token's state is kept as the transitions it lost by merges of its own and a reference to the state
of its last part when it was made, so that a merge adds one entry and copies nothing.

The tokens' bytes are compiled into a table of transitions from node and byte to node.  A word has
exactly one token path through the automaton, and each of its prefixes ends in at most one state:
the path is found from left to right by look-ups in that table, its arcs' labels are the ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "array<int>"
#: Fixed value: how the vocabulary's texts are cut into words before merging.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHED_WORDS = 300_000
_SINGLE = "#text"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in the vocabulary file.

    Printable bytes stand for themselves; the others take the code points from 256 upwards.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in printable}
    out.update((chr(0x100 + i), b) for i, b in enumerate(sorted(set(range(256)) - set(printable))))
    return out


class MergeAutomaton:
    """Token automaton of a merge list.

    ``vocabulary`` maps a token's bytes to its id, ``merges`` lists pairs of byte strings by rank.
    """

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        #: Of a token: the transitions its state lost by merges of its own, and the merges' ranks.
        self.lost: dict[int, dict[int, int]] = {}
        #: Of a merged token: its last part, and the rank up to which that one's losses are its own.
        self.last: dict[int, tuple[int, int]] = {}
        #: Of a token: the first parts it grew from, each with the rank of the merge that made the next.
        self.spine: dict[int, tuple[tuple[int, int], ...]] = {}
        self.never = len(merges) + 1
        self.known: dict[tuple[int, int], bool] = {}
        for b in range(256):
            t = vocabulary.get(bytes([b]))
            if t is not None:
                self.lost[t] = {}
                self.spine[t] = ((t, self.never),)
        for rank, (left, right) in enumerate(merges):
            self._merge(rank, vocabulary[left], vocabulary[right], vocabulary[left + right])
        self.labels = {t: b for b, t in vocabulary.items() if t in self.lost}
        self.nodes: dict[int, int] = {}
        self.token: list[int] = [-1]
        for t, word in self.labels.items():
            node = 0
            for byte in word:
                step = node << 8 | byte
                node = self.nodes.get(step, -1)
                if node < 0:
                    node = self.nodes[step] = len(self.token)
                    self.token.append(-1)
            self.token[node] = t

    def _merge(self, rank: int, a: int, b: int, made: int) -> None:
        if a not in self.lost or b not in self.lost or not self._transition(a, b):
            return  # the pair never stands side by side, so the token is never made
        self.last[made] = (b, rank - 1)
        self.lost[made] = {}
        self.spine[made] = (*self.spine[a][:-1], (a, rank), (made, self.never))
        self.lost[a][b] = rank

    def _when_lost(self, token: int, part: int) -> int:
        """Rank of the merge by which the state after ``token`` lost ``part``."""
        until = self.never
        while True:
            when = self.lost[token].get(part, self.never)
            if when <= until and when < self.never:
                return when
            if token not in self.last:
                return self.never
            token, until = self.last[token]

    def _transition(self, before: int, token: int) -> bool:
        """Whether the state after ``before`` has a transition for the token.

        It is missing if it was lost itself, or if one of the first parts it grew from was lost no
        later than the merge that made the next part.
        """
        for part, grown in self.spine[token]:
            when = self._when_lost(before, part)
            if when < self.never and when <= grown:
                return False
        return True

    def follows(self, before: int, token: int) -> bool:
        key = before, token
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= _CACHED_WORDS:
                self.known.clear()
            found = self.known[key] = self._transition(before, token)
        return found

    def encode(self, word: bytes) -> list[int]:
        """Ids of the word's one token path, read back from its end."""
        n = len(word)
        label, came = [-1] * (n + 1), [0] * (n + 1)
        nodes, tokens, follows = self.nodes, self.token, self.follows
        for i in range(n):
            before = label[i]
            if i and before < 0:
                continue
            node = 0
            for j in range(i, n):
                node = nodes.get(node << 8 | word[j], -1)
                if node < 0:
                    break
                t = tokens[node]
                if t >= 0 and label[j + 1] < 0 and (not i or follows(before, t)):
                    label[j + 1], came[j + 1] = t, i
        out = []
        while n:
            out.append(label[n])
            n = came[n]
        return out[::-1]


@lru_cache(maxsize=2)
def load(path: str) -> MergeAutomaton:
    """Automaton of a byte-level BPE file in the ``tokenizers`` JSON format."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    of = byte_alphabet()
    raw = lambda token: bytes(of[c] for c in token)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    used = {a + b for a, b in merges}
    vocabulary = {raw(t): i for t, i in model["vocab"].items() if len(t) == 1 or t in used}
    return MergeAutomaton(vocabulary, [(raw(a), raw(b)) for a, b in merges])


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(WORD_PATTERN)


class Encoder:
    """Encodes texts; repeated words are looked up.  The table of words has a fixed bound."""

    def __init__(self, path: str):
        self.automaton = load(path)
        self.split = _splitter().findall
        self.known: dict[str, list[int]] = {}

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, encode, out = self.known, self.automaton.encode, []
        for word in self.split(text):
            ids = known.get(word)
            if ids is None:
                ids = encode(word.encode("utf-8", "surrogatepass"))
                if len(known) >= _CACHED_WORDS:
                    known.clear()
                known[word] = ids
            out += ids
        return out


def encode_corpus(df: DataFrame, vocabulary_path: str, text: str = "text", key: str = "doc_id", into: str = "ids") -> DataFrame:
    """``key`` and the text's token ids, one row per input row, without a shuffle.

    A null or an empty text gives an empty list; a blank text is encoded as it stands.  Special
    token strings are ordinary text.  Other columns of ``df`` are not read.
    """
    rows = df.select(df[key].alias("key"), df[text].alias(_SINGLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary_path)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids = [encoder(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, ids {SCHEMA}")
    return out.select(out["key"].alias(key), out["ids"].alias(into))


def decode(ids: list[int], vocabulary_path: str) -> str:
    """Text whose encoding the ids are: the arcs' labels joined."""
    automaton = load(vocabulary_path)
    return b"".join(automaton.labels[i] for i in ids).decode("utf-8", "replace")
