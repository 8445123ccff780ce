"""Prompts and training examples as arrays of (role, content)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The system texts models were prompted with.
TEACHER = (
    "You are a precise mathematics teacher. Solve the problem independently. "
    "Write a concise, logically valid derivation using equations where useful. "
    "End with exactly one line in the form 'Final answer: <integer>'."
)
STUDENT = "You are a precise math solver. Give a concise step-by-step solution. End with exactly one line in the form 'Final answer: <integer>'."
ANSWER_ONLY = "You are a precise math solver. Solve the problem internally and return only the final integer. Do not include an explanation or extra text."
JUDGE = (
    "You are a strict verifier of mathematical solutions. Check whether every "
    "important step is logically valid and whether the solution reaches the "
    "provided reference integer. Return one JSON object only, with keys "
    "verdict and reason. verdict must be PASS or FAIL. Do not use LaTeX in reason."
)

INDEPENDENT = (
    "Solve the mathematics problem independently. You are not given a reference answer or "
    "another solution. Check the interpretation and calculations. Keep the derivation concise "
    "and end with exactly one line 'Final answer: <integer>'."
)

VERIFIER = (
    "You are a strict verifier of mathematical training solutions. An independent solution "
    "was produced before seeing the candidates. Check each candidate for interpretation errors, "
    "unsupported steps, arithmetic errors, circular use of the reference answer, and whether its "
    "final integer follows from its work. Return exactly one JSON object with key 'judgments'. "
    "Each item must contain candidate_index, verdict (PASS, FAIL, or UNCERTAIN), failure_type "
    "(NONE, INTERPRETATION, REASONING, CALCULATION, FINAL_ANSWER, INCOMPLETE, or OTHER), and a "
    "short plain-text reason. Do not omit any candidate."
)
#: What a reasoning model's answer is begun with, after its own template.
OPENING = "<think>\n"

# Fixed values too: the labels in the prompts below.


def opened(user: Column, template: Callable[[Column], Column] | None = None) -> Column:
    """A user turn in the model's template (the bare text unless given), its answer begun."""
    return F.concat(template(user) if template else user, F.lit(OPENING))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def ask(system: str, question: Column) -> Column:
    return F.array(message("system", F.lit(system)), message("user", question))


def judge(question: Column, answer: Column, solution: Column) -> Column:
    user = F.concat(F.lit("Problem:\n"), question, F.lit("\n\nReference final answer:\n"), answer, F.lit("\n\nCandidate solution:\n"), solution)
    return ask(JUDGE, user)


def independent(question: Column) -> Column:
    """The one user turn of an independent solution; the model's own template goes around it."""
    return F.concat(F.lit(INDEPENDENT), F.lit("\n\nProblem:\n"), question)


def training_example(system: str, question: Column, completion: Column) -> Column:
    return F.struct(ask(system, question).alias("prompt"), F.array(message("assistant", completion)).alias("completion"))


def bundle(question: Column, answer: Column, independent: Column, candidates: Column) -> Column:
    """The one user turn about all candidates of a question; ``candidates``: sorted array of (index, solution)."""
    blocks = F.transform(candidates, lambda x: F.concat(F.lit("[Candidate "), x["index"], F.lit("]\n"), x["solution"]))
    return F.concat(
        F.lit(VERIFIER), F.lit("\n\nProblem:\n"), question, F.lit("\n\nReference integer label:\n"), answer,
        F.lit("\n\nIndependent solution (created without the label or candidates):\n"), independent,
        F.lit("\n\nCandidates:\n"), F.array_join(blocks, "\n\n"),
    )
