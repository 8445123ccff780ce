"""Text functions as column expressions; no Python runs on the rows.

The patterns name white space by an explicit class, because the JVM's ``\\s`` and Python's differ
(no-break spaces, U+001C to U+001F).  Multi-line patterns carry the ``d`` flag: only a line feed
ends a line.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define answers, tokens and cues.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_CHARACTERS = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
VALUE = r"([+-]?[0-9][0-9,]*(?:\.0+)?)"
FINAL_LABEL = rf"^{WS}*final{WS}+answer{WS}*:"
FINAL_ANSWER = rf"{FINAL_LABEL}{WS}*\$?{WS}*{VALUE}{WS}*\$?{WS}*[.!]?{WS}*$"
BOXED = rf"\\boxed{WS}*\{{{WS}*{VALUE}{WS}*\}}"
LAST_INTEGER = r"(?<![\w.])[+-]?\d[\d,]*(?:\.0+)?(?![\w.])"
LAST_NUMBER = r"(?<![\w.])[+-]?\d[\d,]*(?:\.\d+)?(?!\w)"
CUES = r"[=+*/^]|\\(?:frac|sqrt|times|cdot)"
TOKENS = r"[a-z0-9가-힣]+|[=+*/^-]"
KEPT = r"[^a-z0-9가-힣+*/^=().-]+"
DROPPED = r"[^a-z0-9가-힣+*/^=(). -]+"
CUE_CAP, LENGTH_SPAN, LENGTH_AIM = 20, 1500, 700


def strip(c: Column) -> Column:
    """Without white space at both ends, of any script."""
    return F.btrim(c, F.lit(WS_CHARACTERS))


def normalize_integer(c: Column) -> Column:
    """Canonical decimal string of any size, or ``''`` for anything but an integer; null stays null."""
    bare = F.replace(strip(c), F.lit(","), F.lit(""))
    shape = r"^([+-]?)0*([0-9]+?)(?:\.0+)?\z"
    core = F.regexp_extract(bare, shape, 2)
    sign = F.when(bare.startswith("-") & (core != "0"), F.lit("-")).otherwise(F.lit(""))
    return F.when(bare.isNull(), F.lit(None)).when(core != "", F.concat(sign, core)).otherwise(F.lit(""))


def _last(text: Column, pattern: str, group: int) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def final_answer(text: Column, fallback: bool = False) -> Column:
    """Struct (value, method): last labelled line, else last box, else (``fallback``) last integer.

    A match decides the method even if its value doesn't normalise.  A null text gives ``('', 'none')``.
    """
    found = [(_last(text, f"(?imd){FINAL_ANSWER}", 1), "final_answer"), (_last(text, BOXED, 1), "boxed")]
    if fallback:
        found.append((_last(text, f"(?dU){LAST_INTEGER}", 0), "last_integer"))
    out = F.struct(F.lit("").alias("value"), F.lit("none").alias("method"))
    for value, method in reversed(found):
        out = F.when(value.isNotNull(), F.struct(normalize_integer(value).alias("value"), F.lit(method).alias("method"))).otherwise(out)
    return out


def last_number(text: Column) -> Column:
    """The last number as an integer string; ``''`` if there is none or it has decimals."""
    return F.coalesce(normalize_integer(_last(text, f"(?dU){LAST_NUMBER}", 0)), F.lit(""))


@lru_cache(maxsize=1)
def _folding() -> tuple[dict[str, str], str, dict[str, str]]:
    """What full case folding still changes of a lower-cased text.

    First characters of the foldings; a class of few ranges that has all these characters; and the
    rest of longer foldings, each with the class of the characters it follows.
    """
    first, rest = {}, {}
    for c in map(chr, range(0x80, 0x1E944)):
        low, full = c.lower(), c.casefold()
        if len(low) == 1 and low != full:
            first[low] = full[0]
            if len(full) > 1:
                rest.setdefault(full[1:], []).append(low)
    codes = sorted(map(ord, first))
    edges = [codes[0], *(x for a, b in zip(codes, codes[1:]) if b - a > 16 for x in (a, b)), codes[-1]]
    ranges = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(edges[::2], edges[1::2])) + "]"
    return first, ranges, {tail: f"[{''.join(own)}]" for tail, own in rest.items()}


def casefold(text: Column) -> Column:
    """Full case folding: ``ß`` becomes ``ss``, ``ς`` becomes ``σ``, ligatures their letters.

    Lower-casing is all for nearly all texts; only those with a character it may leave over are
    changed further.
    """
    first, ranges, rest = _folding()
    low = full = F.lower(text)
    for tail, own in rest.items():
        full = F.regexp_replace(full, own, f"$0{tail}")
    full = F.translate(full, "".join(first), "".join(first.values()))
    return F.when(F.octet_length(text) == F.length(text), low).when(F.rlike(low, F.lit(ranges)), full).otherwise(low)


def _single_spaces(text: Column) -> Column:
    return F.regexp_replace(text, " {2,}", " ")


def collapse(text: Column) -> Column:
    """One space for each run of white space, stripped, case folded."""
    return casefold(F.trim(_single_spaces(F.translate(text, WS_CHARACTERS, " " * len(WS_CHARACTERS)))))


def normalize_solution(text: Column) -> Column:
    """Without final-answer lines, case folded, products as ``*``, other characters as one space."""
    body = casefold(F.regexp_replace(text, rf"(?imd){FINAL_LABEL}[^\n]*$", ""))
    body = F.replace(F.replace(body, F.lit("\\cdot"), F.lit("*")), F.lit("\\times"), F.lit("*"))
    # Spaces stand outside the pattern, so that it matches only where something else goes.
    return F.trim(_single_spaces(F.regexp_replace(body, DROPPED, " ")))


def tokens(normalized: Column) -> Column:
    """Distinct words and operators of a normalised text."""
    return F.array_distinct(F.regexp_extract_all(normalized, F.lit(TOKENS), F.lit(0)))


def equations(normalized: Column) -> Column:
    """The parts between full stops that have an equals sign, joined."""
    parts = F.filter(F.split(normalized, r"[.!?\n]"), lambda x: F.contains(x, F.lit("=")))
    return F.array_join(F.transform(parts, lambda x: F.trim(x)), "|")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def equation_cues(text: Column) -> Column:
    """Operators and TeX commands before the first final-answer label."""
    body = F.element_at(F.split(strip(text), f"(?imd){FINAL_LABEL}", 2), 1)
    return F.regexp_count(body, F.lit(CUES))


def length_score(text: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(LENGTH_SPAN) - F.abs(F.length(strip(text)) - LENGTH_AIM))


def final_markers(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"(?imd){FINAL_LABEL}"))


def selection_score(text: Column, index: Column) -> Column:
    """What the best solution of a question is the maximum of."""
    cues = F.when(equation_cues(text) > CUE_CAP, CUE_CAP).otherwise(equation_cues(text))
    return F.struct(cues.alias("cues"), length_score(text).alias("fit"), (-index).alias("index"))
