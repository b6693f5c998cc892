"""Braces of wiki markup: nested groups found from the innermost outwards, at any depth.

While a text is worked on, braces that are settled are held: each stands as the mark U+E000 and a
digit. Marks that a text brings itself are held as well, so every text comes back as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, replaced, spliced

MARK = "\ue000"
#: A mark of the text itself; begin and end of an outermost call, of an inner call; single braces.
OWN, BEGIN, END, _IN_BEGIN, _IN_END, LEFT, RIGHT = (MARK + digit for digit in "0123456")
ARGUMENT = r"\{\{\{[^{}]*\}\}\}"
CALL = r"\{\{[^{}]*\}\}"
#: Innermost groups; an argument counts before a call, a call before a pair of single braces.
GROUP = rf"{ARGUMENT}|{CALL}|\{{[^{{}}]*\}}"
#: What holds braces that mean nothing.
LITERAL = r"(?s:<!--.*?(?:-->|\z))|(?is:<nowiki>.*?</nowiki>)|(?is:<pre\b[^>]*>.*?(?:</pre\s*>|\z))"


def guarded(text: Column) -> Column:
    """The text with its own marks held."""
    return F.replace(text, F.lit(MARK), F.lit(OWN))


def released(text: Column) -> Column:
    """The text with everything that was held put back."""
    marks = replaced(text, (BEGIN, ""), (END, ""), (_IN_BEGIN, ""), (_IN_END, ""), (LEFT, "{"), (RIGHT, "}"), (MARK + "7", "|"), (OWN, MARK))
    return F.when(F.contains(text, F.lit(MARK)), marks).otherwise(text)


def held(text: Column) -> Column:
    """The text with all its braces held."""
    return replaced(text, ("{", LEFT), ("}", RIGHT))


def is_argument(group: Column) -> Column:
    return group.startswith("{{{")


def is_call(group: Column) -> Column:
    return group.startswith("{{") & ~is_argument(group)


def while_open(text: Column, is_open: Callable[[Column], Column], step: Callable[[Column], Column]) -> Column:
    """step(text), again and again until is_open(text) is false; each step must settle a closing brace.

    The fold has as many places as there are closing braces, but after the last step that is needed
    the others only hand the state on.
    """
    state = lambda t: let(t, lambda x: F.struct(x.alias("x"), is_open(x).alias("more")))
    turns = F.sequence(F.lit(1), F.regexp_count(text, F.lit(r"\}")) + 1)
    return F.aggregate(turns, state(text), lambda s, _: F.when(s["more"], state(step(s["x"]))).otherwise(s), lambda s: s["x"])


def calls_held(text: Column) -> Column:
    """The text with every balanced call and argument between BEGIN and END, its braces held.

    Braces in comments, nowiki and pre are held first. Braces that have no partner stay.
    """

    def hold(group: Column) -> Column:
        inner = held(replaced(group, (BEGIN, _IN_BEGIN), (END, _IN_END)))
        return F.when(group.startswith("{{"), F.concat(F.lit(BEGIN), inner, F.lit(END))).otherwise(held(group))

    plain = spliced(guarded(text), LITERAL, held)
    settled = while_open(plain, lambda t: t.rlike(GROUP), lambda t: spliced(t, GROUP, hold))
    return F.when(F.contains(text, F.lit("{")) | F.contains(text, F.lit(MARK)), settled).otherwise(text)
