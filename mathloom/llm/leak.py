"""Held-out passages inside a training corpus (problem 8).

The items' word sequences go into generalised suffix automata over words.  A corpus text is
streamed through an automaton word by word; its state is the longest run of words, ending at the
current word, that occurs in some item.  Runs that reach the length limit are leaks.

Items are cut into blocks of bounded total length, one automaton a block, and never pass through
the driver.  A text is sent to the blocks it shares an anchor with: of every window of ``least``
words the run of a few words with the smallest hash, which is the same wherever the window occurs,
so that every shared passage has one.  The corpus is read once, however many items there are; only
texts with an anchor that may be an item's, by a filter of fixed size, are moved at all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathloom.llm import bloom, kernels
from mathloom.scratch import stage

#: Words of all items in one automaton, on average.
BLOCK_WORDS = 50_000
#: Texts that one task streams through the automaton of a block, on average.
BLOCK_TEXTS = 2_000
#: Anchors of items up to this number are broadcast (16 bytes each); more are joined in parts.
BROADCAST_ANCHORS = 1_000_000
SALTS = 16
SPANS = "key_ {kind}, item_ {item}, first_word int, words int"


class SuffixAutomaton:
    """Generalised suffix automaton of integer sequences, remembering the items of each state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.items: list[set[int]] = [set()]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.items[clone] = set(self.items[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: Iterable[int], item: int) -> None:
        last = 0
        for word in sequence:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
            else:
                made = self._state(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = made
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[made] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
                last = made
            state = last
            while state > 0 and item not in self.items[state]:
                self.items[state].add(item)
                state = self.link[state]

    def matches(self, sequence: list[int], least: int) -> list[tuple[int, int, int]]:
        """(item, first place, length) of the longest common run of each item, if ``least`` long.

        Of equally long runs the first counts.
        """
        best: dict[int, tuple[int, int]] = {}
        for item, first, size in sorted(self.runs(sequence, least), key=lambda x: x[1]):
            if best.get(item, (0, 0))[1] < size:
                best[item] = (first, size)
        return [(item, first, size) for item, (first, size) in best.items()]

    def runs(self, sequence: list[int], least: int) -> list[tuple[int, int, int]]:
        """(item, first place, length) of every common run of each item that is at least ``least``
        long and part of no longer one at its place; runs may overlap."""
        nexts, link, length = self.next, self.link, self.length
        out: list[tuple[int, int, int]] = []
        ending: dict[int, tuple[int, int]] = {}
        state = run = 0
        for place, word in enumerate(sequence):
            move = nexts[state].get(word) if word >= 0 else None
            if move is None:
                while word >= 0 and state >= 0 and word not in nexts[state]:
                    state = link[state]
                if word < 0 or state < 0:
                    state = run = 0
                else:
                    run = length[state] + 1
                    state = nexts[state][word]
            else:
                run += 1
                state = move
            now: dict[int, tuple[int, int]] = {}
            at, size = state, run
            while at > 0 and size >= least:
                for item in self.items[at]:
                    if item not in now:
                        now[item] = (place - size + 1, size)
                at = link[at]
                size = length[at] if at >= 0 else 0
            # The longest run that ends here goes on if it still begins where the one before began.
            for item, (first, size) in ending.items():
                if item not in now or now[item][0] != first:
                    out.append((item, first, size))
            ending = now
        return out + [(item, first, size) for item, (first, size) in ending.items()]


def anchors(w: kernels.Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the windows of ``least`` words of each text, and their offsets per text.

    Equal neighbours come once.
    """
    width = max(1, 2 * least // 3)
    grams, offsets = kernels.ngrams(w, width)
    windows = np.maximum(np.diff(offsets) - (least - width), 0)
    out = np.zeros(len(windows) + 1, dtype=np.int64)
    np.cumsum(windows, out=out[1:])
    if not out[-1]:
        return np.zeros(0, dtype=np.uint64), out
    last = len(grams) - (least - width)
    smallest = grams[:last].copy()
    for j in range(1, least - width + 1):
        np.minimum(smallest, grams[j : last + j], out=smallest)
    owner = np.repeat(np.arange(len(windows)), windows)
    found = smallest[np.repeat(offsets[:-1] - out[:-1], windows) + np.arange(out[-1])]
    new = np.concatenate(([True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])))
    out[1:] = np.cumsum(np.bincount(owner[new], minlength=len(windows)))
    return found[new], out


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))


def _anchored_items(items: DataFrame, least: int) -> DataFrame:
    """(item_no, item_key, text, words, anchors) of the items long enough; every row has its own number."""
    kind = items.schema["item_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in kernels.chunks(texts):
                w = kernels.words(texts[lo:hi])
                good = np.flatnonzero(w.counts >= least)
                found = anchors(kernels.take(w, good), least)
                at = pa.array(good + lo)
                numbers = np.arange(number, number + len(good))
                number += len(good)
                yield pa.RecordBatch.from_arrays([pa.array(numbers), batch.column(0).take(at), batch.column(1).take(at), pa.array(w.counts[good]), _lists(*found)], ["item_no", "item_key", "text", "words", "anchors"])

    return items.mapInArrow(run, f"item_no bigint, item_key {kind}, text string, words bigint, anchors array<bigint>")


def _anchored_texts(docs: DataFrame, least: int, among: np.ndarray) -> DataFrame:
    """(text_no, doc_key, text, anchors) of the texts with anchors that may be an item's."""
    sent = docs.sparkSession.sparkContext.broadcast(among)
    kind = docs.schema["doc_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in kernels.chunks(texts):
                found, offsets = anchors(kernels.words(texts[lo:hi]), least)
                use = bloom.contains(sent.value, found)
                if not use.any():
                    continue
                owner = np.repeat(np.arange(hi - lo), np.diff(offsets))[use]
                sizes = np.bincount(owner, minlength=hi - lo)
                good = np.flatnonzero(sizes)
                at = pa.array(good + lo)
                numbers = np.arange(number, number + len(good))
                number += len(good)
                yield pa.RecordBatch.from_arrays([pa.array(numbers), batch.column(0).take(at), batch.column(1).take(at), _lists(found[use], np.concatenate(([0], np.cumsum(sizes[good]))))], ["text_no", "doc_key", "text", "anchors"])

    return docs.mapInArrow(run, f"text_no bigint, doc_key {kind}, text string, anchors array<bigint>")


def _routed(texts: DataFrame, items: DataFrame, broadcast_anchors: int) -> DataFrame:
    """(text_no, block): the blocks of items a text shares an anchor with."""
    hits = texts.select("text_no", F.explode(F.array_distinct("anchors")).alias("anchor"))
    held = stage(items.select("block", F.explode("anchors").alias("anchor")).distinct(), "leak-anchors")
    if held.limit(broadcast_anchors + 1).count() <= broadcast_anchors:
        return hits.join(F.broadcast(held), "anchor").select("text_no", "block").distinct()
    # A passage that many texts have is a frequent anchor: texts are spread, items go to every part.
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return hits.withColumn("salt", F.pmod(F.xxhash64("text_no"), F.lit(SALTS)).cast("int")).join(held, ["anchor", "salt"]).select("text_no", "block").distinct()


def _index(block: list[str]) -> tuple[np.ndarray, SuffixAutomaton]:
    w = kernels.words(block)
    vocabulary, places = np.unique(w.hashes, return_inverse=True)
    automaton = SuffixAutomaton()
    for i in range(len(block)):
        automaton.add(places[w.offsets[i] : w.offsets[i + 1]].tolist(), i)
    return vocabulary, automaton


def _streamed(rows: DataFrame, least: int, every: bool) -> DataFrame:
    """Runs of the texts that follow the items of their block; rows are sorted so.

    A block's automaton is built once for all parts of it that a task has.
    """
    kind, item = (rows.schema[c].dataType.simpleString() for c in ("doc_key", "item_key"))
    item_type = pa.int64() if item == "bigint" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = part = None
        held: list[tuple] = []
        keys: list = []
        vocabulary, automaton = np.zeros(0, dtype=np.uint64), SuffixAutomaton()
        for batch in batches:
            blocks, salts, kinds, item_keys, texts = (batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5))
            ready: list[int] = []
            found: list[tuple] = []

            def search() -> None:
                picked = [texts[i] for i in ready]
                for lo, hi in kernels.chunks(picked):
                    w = kernels.words(picked[lo:hi])
                    at = np.searchsorted(vocabulary, w.hashes)
                    at[at == len(vocabulary)] = 0
                    known = (vocabulary[at] == w.hashes) if len(vocabulary) else np.zeros(len(at), dtype=bool)
                    ids = np.where(known, at, -1)
                    find = automaton.runs if every else automaton.matches
                    for i in range(hi - lo):
                        for one, first, size in find(ids[w.offsets[i] : w.offsets[i + 1]].tolist(), least):
                            found.append((ready[lo + i], keys[one], first, size))
                ready.clear()

            for i, (block, salt, is_text) in enumerate(zip(blocks, salts, kinds)):
                if (block, salt) != part:
                    search()
                    part, held = (block, salt), []
                if not is_text:
                    held.append((item_keys[i], texts[i]))
                    continue
                if built != block:
                    keys = [k for k, _ in held]
                    vocabulary, automaton = _index([t for _, t in held])
                    built, held = block, []
                ready.append(i)
            search()
            if found:
                who, names, first, size = zip(*found)
                yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(who, pa.int64())), pa.array(names, item_type), pa.array(first, pa.int32()), pa.array(size, pa.int32())], ["key_", "item_", "first_word", "words"])

    return rows.mapInArrow(run, SPANS.format(kind=kind, item=item))


def _found(
    docs: DataFrame, items: DataFrame, least: int, doc_key: str, doc_text: str, item_key: str, item_text: str, block_words: int, every: bool, block_texts: int = BLOCK_TEXTS, broadcast_anchors: int = BROADCAST_ANCHORS
) -> DataFrame:
    if least < 1:
        raise ValueError("least must be positive")
    item_kind = "bigint" if items.schema[item_key].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else "string"
    listed = items.select(items[item_key].cast(item_kind).alias("item_key"), items[item_text].alias("text")).where(F.col("text").isNotNull())
    listed = stage(_anchored_items(listed, least), "leak-items")
    blocks = F.ceil((F.lit(listed.agg(F.sum("words")).first()[0] or 0) + 1) / block_words)
    listed = listed.withColumn("block", F.pmod(F.xxhash64("item_no"), blocks))
    rows = docs.select(docs[doc_key].alias("doc_key"), docs[doc_text].alias("text")).where(F.length("text") >= 2 * least - 1)
    among = bloom.build(listed.select(F.explode("anchors").alias("anchor")), "anchor")
    texts = stage(_anchored_texts(rows, least, among), "leak-texts")
    routed = stage(_routed(texts, listed, broadcast_anchors), "leak-routes")
    parts = routed.groupBy("block").agg(F.ceil(F.count("*") / block_texts).cast("int").alias("parts"))
    columns = ["block", "salt", "is_text", "doc_key", "item_key", "text"]
    salt = F.pmod(F.xxhash64("text_no"), F.col("parts")).cast("int").alias("salt")
    sent = routed.join(parts, "block").select("block", salt, "text_no").join(texts.select("text_no", "doc_key", "text"), "text_no")
    sent = sent.select("block", "salt", F.lit(1).alias("is_text"), "doc_key", F.lit(None).cast(item_kind).alias("item_key"), "text")
    salts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")
    held = listed.join(parts, "block").select("block", salts, F.lit(0).alias("is_text"), F.lit(None).cast(rows.schema["doc_key"].dataType).alias("doc_key"), "item_key", "text")
    both = held.select(columns).unionByName(sent.select(columns)).repartition("block", "salt").sortWithinPartitions("block", "salt", "is_text")
    return _streamed(both, least, every).select(F.col("key_").alias(doc_key), F.col("item_").alias(item_key), "first_word", "words")


def leaked_spans(
    docs: DataFrame, items: DataFrame, least: int = 12, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Longest run of at least ``least`` words shared by each document and item.

    Columns: ``doc_key``, ``item_key``, ``first_word`` (place of the run in the document, from 0)
    and ``words`` (its length); one row per document and item.  Null, empty and short texts on
    either side match nothing; repeated rows are each reported; empty tables give no rows.
    """
    return _found(docs, items, least, doc_key, doc_text, item_key, item_text, block_words, False)


def leaked_runs(
    docs: DataFrame, items: DataFrame, least: int = 12, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Every run of at least ``least`` words shared by a document and an item that is part of no longer one.

    Columns: ``doc_key``, ``item_key``, ``first_word`` (place of the run in the document, from 0)
    and ``words`` (its length); runs of one document and item may overlap.  Null, empty and short texts on
    either side match nothing; repeated rows are each reported; empty tables give no rows.
    """
    return _found(docs, items, least, doc_key, doc_text, item_key, item_text, block_words, True)


def without_spans(text: str | None, spans: list[tuple[int, int]], coverage: float = 0.5) -> str | None:
    """The text without the given (first word, number of words) runs; None if they cover too much.

    ``coverage`` is the share of the text's words from which on the whole text is dropped.
    """
    if text is None or not spans:
        return text
    import re

    places = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    gone = np.zeros(len(places), dtype=bool)
    for first, n in spans:
        gone[first : first + n] = True
    if not len(places) or gone.mean() >= coverage:
        return None
    out, at = [], 0
    for i, (a, b) in enumerate(places):
        if gone[i]:
            if i == 0 or not gone[i - 1]:
                out.append(text[at:a])
            at = b
    return "".join(out) + text[at:]


def without_leaks(
    docs: DataFrame, items: DataFrame, least: int = 12, coverage: float = 0.5, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``doc_key`` and ``doc_text`` of all documents, every leaked run removed.

    A text of which the runs cover ``coverage`` or more becomes null.  Rows of one key must have
    the same text; a null key keeps its text.
    """
    spans = leaked_runs(docs, items, least, doc_key, doc_text, item_key, item_text, block_words)
    held = spans.groupBy(F.col(doc_key).alias("key")).agg(F.collect_set(F.struct("first_word", "words")).alias("spans"))
    rows = docs.select(docs[doc_key].alias("key"), docs[doc_text].alias("text"))
    plain = rows.join(held, "key", "left_anti")
    found = rows.join(held, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            left = [without_spans(t, [(x["first_word"], x["words"]) for x in spans], coverage) for t, spans in zip(texts, lists)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string())], ["key", "text"])

    cleaned = found.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, text string")
    return plain.unionByName(cleaned).withColumnsRenamed({"key": doc_key, "text": doc_text})
