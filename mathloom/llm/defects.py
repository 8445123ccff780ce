"""Broken prompt and response pairs (problem 4).

Responses are sorted by their text.  A shortened version of another response is a prefix of the
next different text in that order, so each response is compared with one neighbour only.  A spike
in the number of different responses of exactly one length shows a length limit.

Where a response states no labelled answer, its sentences are compared with those that begin alike:
an opening that mostly stands last in such responses closes a text (no phrase is listed, the corpus
tells), and a text whose last sentence has an opening that elsewhere goes on was cut.  Rules find
the other defects: no content, refusal, the question copied, another language.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathloom.scratch import stage

EMPTY, REFUSAL, COPIED, LANGUAGE, TRUNCATED = "empty", "refusal", "copied_question", "other_language", "truncated"
#: The text is complete; open at its end, so that a neighbour or a spike may show it cut; the same,
#: but it ends in its answer, so that it doesn't count towards a spike; no answer is labelled, so
#: that its sentences decide.
COMPLETE, OPEN, ENDED, UNSTATED = "complete", "open", "ended", "unstated"
#: What the next text shows: a cut within a sentence; the text goes on to another value; it goes on.
CUT, OTHER_VALUE, GOES_ON = 1, 2, 3
#: An opening closes texts if it stands last in this share of its uses, and in so many different
#: texts: at least two, and one in ``CLOSING_TEXTS``, so that there are never more closing openings.
CLOSING_SHARE, CLOSING_TEXTS = 0.5, 10_000
#: Openings of fewer uses tell nothing; their first word does.
KNOWN_USES = 3
#: Words at the end of a text that may be openings.
NEAR_END = 12

WORD = re.compile(r"[^\W_]+")
_ASCII_WORDS = bytes(i if chr(i).isalnum() and i < 128 else 32 for i in range(256))


def words_of(lowered: str) -> list[str]:
    """Words of a lower-cased text."""
    if lowered.isascii():
        return lowered.encode("ascii").translate(_ASCII_WORDS).decode("ascii").split()
    return WORD.findall(lowered)


_MARKERS = frozenset("final answer result solution response boxed text the is a to problem question respuesta solución antwort lösung réponse 답 정답 풀이".split())
_FILLERS = frozenset("n a na none null nil nan tbd todo unknown undefined empty blank missing no not available applicable content data value given provided pending placeholder".split())

_NO_HELP = "help|assist|answer|solv|provid|complet|work on|comply|respond|continu|fulfil|process|do (?:that|this|it)"
REFUSALS = tuple(
    re.compile(p, re.IGNORECASE)
    for p in (
        rf"\b(?:can(?:'|’)?t|cannot|can not|could(?:n(?:'|’)t| not)|won(?:'|’)t|will not|unable to|not able to|not possible|impossible|declin\w*|refus\w*|not allowed to|not going to)\b[^.!?\n]{{0,60}}?\b(?:{_NO_HELP})",
        r"\b(?:kann|darf|möchte|werde|konnte|will)\b[^.!?\n]{0,70}\bnicht\b[^.!?\n]{0,40}(?:helfen|lösen|beantworten|bearbeiten|antworten|unterstützen|liefern)",
        r"\bnicht\b[^.!?\n]{0,20}(?:möglich|imstande|in der lage)|(?:lehne|verweigere)\b",
        r"(?:ne (?:peux|puis|saurais|pourrai) pas|n['’]est pas possible|impossible de|pas en mesure|refuse de|dois refuser)[^.!?\n]{0,40}(?:répondre|résoudre|traiter|aider|fournir|compléter|donner)",
        r"(?:no puedo|no podré|no me es posible|no es posible|imposible|no soy capaz|me niego|debo rechazar|incapaz de)[^.!?\n]{0,40}(?:responder|resolver|ayudar|contestar|proporcionar|completar|dar)",
        r"(?:답변|도와|풀어|풀|해결|제공|처리|응답)\S*\s*(?:드리|드릴|할)?\S*\s*(?:수\s*없|어렵|불가|못)|거절|응할 수 없",
    )
)

_VALUE = re.compile(r"answer\W{0,12}\d")
_BOX = re.compile(r"boxed\s*\{\s*\W{0,3}\d[^{}]*\}")
BARE_FINAL = re.compile(r"(?:\*\*\s*)?(?:\b(?:the\s+)?final\s+answer\b|\bresult\b|\banswer\b|\\boxed)[^\n]{0,40}\s*$", re.IGNORECASE)
_LEAD = re.compile(r"^\s*(?:[*#•\-]\s*)*(?:problem|question|task|exercise|aufgabe|frage|problème|problema|pregunta|문제|질문)\s*[:.]\s*", re.IGNORECASE)
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\s;\s+|\n")
_FIELD = re.compile(r"^\W*[^\W\d_][^:\n.!?]{0,30}\"?\s*:\s*\"?")
_DIGITS = re.compile(r"\d[\d.,/]*")
_SAID_VALUE = re.compile(r"(?:answer\W{0,12}|boxed\s*\{\s*\W{0,3})(\d[\d.,]*)")
_NUMBER = re.compile(r"\d[\d.,]*")
_CLOSING_MARKS = "”\"')}]*$ "
_LAST_VALUE = re.compile(r"(?:answer\W{0,12}|boxed\s*\{\s*\W{0,3})\d[\d.,/ ]*\W*$")
_ELLIPSIS = re.compile(r"(?:\.\.\.|…)\W*$")
_LABELLED = re.compile(r"[ \t]*[A-Za-z][A-Za-z ]*:")
_TERMINAL = frozenset(".!?。”\"')}]*$”")

#: Function words by which the languages are told apart.
FUNCTION_WORDS = {
    "en": "the of and to in is for on with by from has how many what that have each after more than into if are so then as its at when which we let out only once every".split(),
    "de": "der die das und von mit ist für sind den dem ein eine nicht auf bei zu zur jede jedes wie viele sich so wir aus nach je nun im also werden ihr".split(),
    "fr": "le les des du et est dans un une que qui sur chaque combien pour reste donc on au aux par il en ce avec à cette ont deux".split(),
    "es": "el los las y es para un una que se por con cada cuántos cuántas del son lo tras da como más al sobre hay su entre si".split(),
}
_OF_WORD: dict[str, list[str]] = {}
for _lang, _list in FUNCTION_WORDS.items():
    for _w in _list:
        _OF_WORD.setdefault(_w, []).append(_lang)
_SETS = {x: (frozenset(FUNCTION_WORDS.get(x, ())), frozenset(w for w in _OF_WORD if w not in FUNCTION_WORDS.get(x, ()))) for x in (*FUNCTION_WORDS, "ko", None)}
_HANGUL = re.compile(r"[ᄀ-ᇿ㄰-㆏가-힯]")


def language_scores(words: list[str]) -> Counter:
    """Words that speak for each language; a word of two languages counts half for each."""
    scores: Counter = Counter()
    for w in words:
        of = _OF_WORD.get(w)
        if of:
            for lang in of:
                scores[lang] += 1.0 / len(of)
    korean = sum(1 for w in words if _HANGUL.match(w[-1]))
    if korean:
        scores["ko"] = korean
    return scores


def _stated(lowered: str) -> bool:
    """Whether a labelled or boxed answer with a value occurs in the lower-cased text.

    The label is ``final answer``, or ``answer`` where only marks precede it on its line.
    """
    at = lowered.find("answer")
    while at >= 0:
        if _VALUE.match(lowered, at):
            before = lowered[lowered.rfind("\n", 0, at) + 1 : at].rstrip()
            if before.endswith("final") or not any(map(str.isalnum, before)):
                return True
        at = lowered.find("answer", at + 6)
    at = lowered.find("boxed")
    while at >= 0:
        if _BOX.match(lowered, at):
            return True
        at = lowered.find("boxed", at + 5)
    return False


def opening(sentence: str) -> tuple[str, str]:
    """The first two words, and the first, of a lower-cased sentence without its label, numbers as 0."""
    words = words_of(_DIGITS.sub("0", _FIELD.sub("", sentence)[:60]))
    return " ".join(words[:2]), words[0] if words else ""


def sentences(lowered: str) -> list[str]:
    """Sentences with a letter or digit."""
    return [x for x in _SENTENCE.split(lowered) if any(map(str.isalnum, x))]


def code(text: str) -> int:
    """64 bits for an opening."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Question:
    """What is compared of a question: its words, their pairs and its language."""

    __slots__ = ("words", "known", "pairs", "home", "same", "other")

    def __init__(self, text: str):
        self.words = words_of(text.lower())
        self.known = frozenset(self.words)
        self.pairs = frozenset(zip(self.words, self.words[1:]))
        scores = language_scores(self.words)
        self.home = scores.most_common(1)[0][0] if scores else None
        self.same, self.other = _SETS[self.home]

    def foreign(self, words: list[str], ascii_only: bool) -> bool:
        """Whether the words are mainly of another language than the question."""
        if self.home is None:
            return False
        # Cheap counts first: few words of other languages settle it for nearly all texts.
        if self.home == "ko":
            if sum(map(_OF_WORD.__contains__, words)) < 2:
                return False
        elif 4 * sum(map(self.other.__contains__, words)) <= sum(map(self.same.__contains__, words)) and (ascii_only or not _HANGUL.search(" ".join(words))):
            return False
        own = language_scores(words)
        if not own:
            return False
        lang, best = own.most_common(1)[0]
        return lang != self.home and best >= 2 and best > 1.5 * own[self.home]

    def copied(self, text: str, words: list[str]) -> bool:
        """Whether the text is the question again."""
        if len(self.words) < 4 or sum(map(self.known.__contains__, words)) < 0.6 * len(words):
            return False
        said = words_of(without_answer(text).lower())
        if len(said) < max(2, 0.5 * len(self.words)) or sum(map(self.known.__contains__, said)) < 0.8 * len(said):
            return False
        return sum(map(self.pairs.__contains__, zip(said, said[1:]))) >= 0.55 * (len(said) - 1)


def without_answer(text: str) -> str:
    """The text without the final answer at its end and the label at its beginning."""
    bare = text.strip()
    last = bare.rfind("\n")
    tail = BARE_FINAL.search(bare, max(last, 0))
    if tail:
        bare = bare[: tail.start()]
    return _LEAD.sub("", bare)


class Judge:
    """Finds the defect of responses by the rules.  Questions met before are kept, up to a bound."""

    def __init__(self, bound: int = 20_000):
        self.bound = bound
        self.questions: dict[str, Question] = {}

    def _question(self, text: str) -> Question:
        found = self.questions.get(text)
        if found is None:
            if len(self.questions) >= self.bound:
                self.questions.clear()
            found = self.questions[text] = Question(text)
        return found

    def __call__(self, question: str | None, text: str | None, finish: str | None = None, method: str | None = None) -> str:
        """A defect, or COMPLETE, OPEN or ENDED."""
        bare = text.strip() if text else ""
        if not bare:
            return EMPTY
        lowered = bare.lower()
        words = words_of(lowered)
        if len(words) <= 24:
            rest = [w for w in words if w not in _MARKERS]
            if len(rest) <= 4 and _FILLERS.issuperset(rest):
                return EMPTY
        if len(words) <= 80 and "=" not in bare and any(p.search(bare) for p in REFUSALS):
            return REFUSAL
        if question:
            asked = self._question(question)
            if asked.copied(bare, words):
                return COPIED
            if asked.foreign(words, bare.isascii()):
                return LANGUAGE
        if _ELLIPSIS.search(bare, max(0, len(bare) - 40)):
            return TRUNCATED
        if bare[0] == "{" and '"' in bare[:20] and bare[-1] != "}" and not re.search(r"}\W*$", bare[-40:]):
            return TRUNCATED
        if not _stated(lowered):
            # The parser's answer counts where the text ends in a full stop and met no limit.
            return COMPLETE if _ends(bare) and finish != "max_tokens" and method in ("final_answer", "boxed") else UNSTATED
        if bare[-1] not in _TERMINAL:
            lines = [x.rstrip() for x in bare.splitlines() if x.strip()]
            last = lines[-1]
            if not _stated(last.lower()) and len(lines) > 2 and not last[-1].isdigit() and all(map(_LABELLED.match, lines)):
                # Fields in any order: the last one is cut if it alone lacks the mark at its end.
                others = [x for x in lines[:-1] if len(x) > 40]
                if others and all(x[-1] in _TERMINAL for x in others):
                    return TRUNCATED
            if not _LAST_VALUE.search(lowered[lowered.rfind("\n") + 1 :]):
                return OPEN
            return COMPLETE if finish == "eos" else ENDED
        return COMPLETE


def _ends(bare: str) -> bool:
    """Whether a stripped text ends in a full stop, perhaps within closing marks."""
    return bare.rstrip(_CLOSING_MARKS)[-1:] in (".", "!", "。")


def shortened(text: str, longer: str) -> int:
    """How ``longer`` shows that ``text`` was cut: CUT, OTHER_VALUE, GOES_ON or 0."""
    bare = text.rstrip()
    if len(longer) <= len(bare) or not longer.startswith(bare):
        return 0
    rest = longer[len(bare) :]
    if bare[-1:].isalnum() and (rest[0].isalnum() or rest[0] in ",." and rest[1:2].isdigit()):
        return CUT
    if rest[0] not in "\r\n" and bare[-1:] not in _TERMINAL and bare[-1:] not in ".!?。" and not _stated(bare.splitlines()[-1].lower()) and any(map(str.isalnum, rest)):
        return CUT
    lowered = bare.lower()
    if _stated(lowered):
        return 0
    said = _SAID_VALUE.search(rest.lower())
    plain = lambda x: x.replace(",", "").rstrip(".")
    if said and plain(said[1]) not in map(plain, _NUMBER.findall((sentences(lowered) or [""])[-1])):
        return OTHER_VALUE
    return GOES_ON if any(map(str.isalnum, without_answer(rest))) else 0


_SORTED = (
    "part int, row bigint, defect string, size int, hash bigint, shown int, waits boolean, ends boolean, finish string, closing array<bigint>, last2 bigint, last1 bigint, "
    "first string, second string, last string, opening bigint, uses bigint, final bigint"
)
_NAMES, _KINDS = zip(*(x.split() for x in _SORTED.split(", ")))
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
#: Openings a task counts before it sends them on.
_COUNTED = 50_000


def _records(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _TYPES[k]) for n, k in zip(_NAMES, _KINDS)], list(_NAMES))


def _evidence(bare: str) -> dict:
    """What decides an unstated text: openings of its sentences with a number, the last one's, its end.

    Words near the end count as openings too if a number follows: marks between sentences are
    sometimes lost.
    """
    found = sentences(bare.lower())
    numbers = [x for x in found if any(map(str.isdigit, x)) and not x.rstrip().endswith("?")]
    closing = [x for s in numbers for x in opening(s)]
    tail = WORD.findall(_DIGITS.sub("0", bare[-160:]))[-NEAR_END:]
    words = [w.lower() for w in tail]
    last = max((i for i, w in enumerate(words) if any(map(str.isdigit, w))), default=0)
    # It must look like a sentence's first word, for within one the same words may go on; in a text
    # without capitals any two words of a finished one may.
    plain = bare.islower() and _ends(bare)
    for i in range(last):
        first = tail[i][0]
        if first.isupper() or not first.isdigit() and (plain or first.lower() == first.upper()):
            closing += [" ".join(words[i : i + 2]), *words[i : i + 1] * first.isupper()]
    two, one = opening(found[-1]) if found else ("", "")
    return {"closing": list(dict.fromkeys(map(code, filter(None, closing)))), "last2": code(two), "last1": code(one), "ends": _ends(bare)}


def _neighbours(rows: DataFrame) -> DataFrame:
    """Judged rows, and what the next text shows of them; rows of a part's last text wait for the
    next part's.  Further rows have a part's edge texts, and the uses of openings in different texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        judge = Judge()
        edges: list[str] = []
        current: str | None = None
        waiting: list[dict] = []
        uses: Counter = Counter()
        final: Counter = Counter()
        codes: dict[str, int] = {}
        new = False

        def count(text: str, verdict: str) -> None:
            found = [opening(x) for x in sentences(text.lower())]
            for x in found:
                uses.update(x)
            if verdict == UNSTATED and found:
                final.update(found[-1])

        def counted() -> pa.RecordBatch:
            out = _records([{"opening": code(x), "uses": n, "final": final[x]} for x, n in uses.items()])
            uses.clear()
            final.clear()
            return out

        for batch in batches:
            out: list[dict] = []
            for row, question, text, finish, method, own in zip(*(c.to_pylist() for c in batch.columns)):
                if text is not None and text != current:
                    if waiting:
                        shown = shortened(current, text)
                        out += [w | {"shown": shown} for w in waiting if shown or w["defect"] != COMPLETE]
                        waiting = []
                    current, new = text, True
                    if len(edges) < 2:
                        edges.append(text)
                verdict = judge(question, text, finish, method)
                kept = {"part": part, "row": row, "defect": verdict, "size": len(text or ""), "hash": own, "finish": finish, "shown": 0, "waits": False}
                if verdict not in (COMPLETE, OPEN, ENDED, UNSTATED, TRUNCATED):
                    out.append(kept)
                    continue
                if new:
                    count(text, verdict)
                    new = False
                waiting.append(kept | _evidence(text.strip()) if verdict == UNSTATED else kept)
            if len(uses) > _COUNTED:
                yield counted()
            if out:
                yield _records(out)
        if edges:
            yield _records([{"part": part, "first": edges[0], "second": edges[1] if len(edges) > 1 else None, "last": current}])
        if waiting:
            yield _records([w | {"waits": True} for w in waiting])
        if uses:
            yield counted()

    return rows.mapInArrow(run, _SORTED)


def _edges(parts: DataFrame) -> DataFrame:
    """Parts whose last text the next different text shows to be cut, and how.

    One row per part of the sort arrives here, in order; only the texts at the edges are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_parts, cut = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                other = next((x for x in (r["first"], r["second"]) if x is not None and x != last), None)
                if other is not None and last is not None:
                    shown = shortened(last, other)
                    cut += [(p, shown) for p in open_parts if shown]
                    open_parts = []
                open_parts.append(r["part"])
                last = r["last"]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in cut], pa.int32()), pa.array([x for _, x in cut], pa.int32())], ["part", "edge"])

    return parts.select("part", "first", "second", "last").repartition(1).sortWithinPartitions("part").mapInArrow(run, "part int, edge int")


def _spikes(lengths: DataFrame, times: float, chance: float, around: int) -> DataFrame:
    """Lengths that more different texts have than chance allows, and ``times`` as many as those around.

    If a text were as likely to have this length as one of the lengths around, the share of this
    one among all would be binomial; the limit is Chernoff's bound of its tail.  Both limits are
    relative to the neighbours, and copies of a text count once.
    """
    bars = lengths.groupBy("size").agg(F.count_distinct("hash").alias("n"))
    shifts = F.explode(F.sequence(F.lit(-around), F.lit(around))).alias("shift")
    near = bars.select("size", "n", shifts).groupBy((F.col("size") + F.col("shift")).alias("size")).agg(F.sum("n").alias("all"))
    places = F.least(F.lit(around), F.col("size") - 1) + F.lit(around)
    share, own = 1.0 / (places + 1), F.col("n") / F.col("all")
    rest = F.when(own < 1, (1 - own) * F.log((1 - own) / (1 - share))).otherwise(F.lit(0.0))
    tail = F.col("all") * (own * F.log(own / share) + rest)
    return bars.join(near, "size").where((F.col("n") * places > times * (F.col("all") - F.col("n"))) & (tail >= -math.log(chance))).select("size")


def judged_pairs(df: DataFrame, row: str, question: str, text: str, finish: str, method: str, spike_times: float, spike_chance: float) -> DataFrame:
    """``row``, ``defect`` and ``shown_by`` of each defective row: the first that applies of neighbour,
    spike, sentence (its last one's opening goes on elsewhere) and rule."""
    recorded = [(df[c] if c in df.columns else F.lit(None)).cast("string").alias(n) for n, c in (("finish", finish), ("method", method))]
    rows = df.select(df[row].alias("row"), df[question].alias("question"), df[text].alias("text"), *recorded)
    ordered = rows.repartitionByRange("text", "row").sortWithinPartitions("text", "row").withColumn("hash", F.xxhash64("text"))
    judged = stage(_neighbours(ordered), "defect-rows")
    cut = _edges(judged.where("last is not null"))
    # Parts are as many as tasks of the sort: a table of a few bytes each.
    found = judged.where("row is not null").join(F.broadcast(cut), "part", "left")
    found = found.withColumn("shown", F.when(F.col("waits"), F.coalesce("edge", F.lit(0))).otherwise(F.col("shown")))
    settled = stage(_settled(found, judged.where("opening is not null"), rows.count()), "defect-settled")
    spikes = _spikes(settled.where("open"), spike_times, spike_chance, 16)
    at_limit = settled.join(F.broadcast(spikes.withColumn("spike", F.lit(True))), "size", "left")
    truncated = F.col("cut") | (F.col("defect") == TRUNCATED) | (F.col("spike").isNotNull() & (F.col("open") | F.col("near_end")))
    by = F.when(F.col("shown") > 0, "neighbour").when(F.col("spike").isNotNull() & F.col("open"), "spike").when(F.col("sentence"), "sentence")
    out = at_limit.withColumn("defect", F.when(truncated, TRUNCATED).when(F.col("defect").isin(COMPLETE, OPEN, ENDED, UNSTATED), F.lit(None)).otherwise(F.col("defect")))
    return out.where("defect is not null").select("row", "defect", F.when(truncated, F.coalesce(by, F.lit("rule"))).otherwise("rule").alias("shown_by")).withColumnRenamed("row", row)


def _settled(found: DataFrame, counted: DataFrame, rows: int) -> DataFrame:
    """Judged rows with what their sentences tell.

    ``cut``: truncated, whatever the lengths say; ``sentence``: so its last sentence shows; ``open``:
    counts towards a spike; ``near_end``: doesn't, but may lie on one.
    """
    openings = counted.groupBy("opening").agg(F.sum("uses").alias("uses"), F.sum("final").alias("final"))
    openings = stage(openings.withColumn("closing", F.col("final") >= CLOSING_SHARE * F.col("uses")), "defect-openings")
    support = max(2, rows // CLOSING_TEXTS)
    # Every closing opening stands last in ``support`` texts of its own: at most CLOSING_TEXTS of
    # two words and as many of one.
    closers = openings.where(F.col("closing") & (F.col("final") >= support)).select(F.col("opening").alias("closer"))
    unstated = found.where(F.col("defect") == UNSTATED)
    closed = unstated.select("row", F.explode("closing").alias("closer")).join(F.broadcast(closers), "closer", "left_semi").groupBy("row").agg(F.collect_set("closer").alias("closed_by"))
    known = [openings.select(F.col("opening").alias(f"last{i}"), F.col("uses").alias(f"uses{i}"), F.col("closing").alias(f"closing{i}")) for i in (1, 2)]
    told = unstated.select("row", "last1", "last2").join(known[1], "last2", "left").join(known[0], "last1", "left")
    # Uses of the text itself tell nothing of others.
    told = told.join(closed, "row", "left").select(
        "row", F.coalesce(F.size("closed_by") > 0, F.lit(False)).alias("closed"), F.coalesce(F.array_contains("closed_by", F.col("last2")) | F.array_contains("closed_by", F.col("last1")), F.lit(False)).alias("last_closes"),
        F.when(F.col("uses2") >= KNOWN_USES, ~F.col("closing2") & ~F.coalesce("closing1", F.lit(False))).when(F.col("uses1") >= KNOWN_USES, ~F.col("closing1")).otherwise(False).alias("goes_on"),
    )
    both = found.join(told, "row", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("closed", "last_closes", "goes_on", "ends")})
    unstated, shown = F.col("defect") == UNSTATED, F.col("shown")
    unfinished = unstated & ~F.col("closed") & (~F.col("ends") | F.col("goes_on") | (F.coalesce("finish", F.lit("")) == "max_tokens"))
    goes_on = (shown > 0) & ~(unstated & F.col("closed") & F.col("last_closes") & (shown == GOES_ON))
    tail = unstated & F.col("closed") & ~F.col("ends")
    both = both.withColumns({
        "cut": F.col("defect").isin(COMPLETE, OPEN, ENDED, UNSTATED) & (goes_on | unfinished), "sentence": unfinished & F.col("goes_on"),
        "open": (F.col("defect") == OPEN) | unfinished | (tail & ~F.col("last_closes")), "near_end": (F.col("defect") == ENDED) | (tail & F.col("last_closes") & ~F.coalesce(F.col("finish") == "eos", F.lit(False))),
    })
    return both.select("row", "defect", "size", "hash", "shown", "cut", "sentence", "open", "near_end")


def broken_pairs(
    df: DataFrame, row: str = "row_no", question: str = "question", text: str = "solution", spike_times: float = 8.0, spike_chance: float = 1e-9, finish: str = "finish_status", method: str = "parser_method"
) -> DataFrame:
    """``row`` and ``defect`` of each defective row, the first that applies of empty, refusal,
    copied_question, other_language and truncated.

    A null text is empty.  With a null question a text is neither copied nor in another language.
    A short but complete text isn't defective.  ``row`` must be unique; repeated texts are judged
    each with its own question; ``finish`` and ``method`` may be null or missing; other columns
    aren't read; an empty table gives no rows.
    """
    return judged_pairs(df, row, question, text, finish, method, spike_times, spike_chance).select(row, "defect")
