"""Filters that leave only problems without figures."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from itertools import chain
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import DRAWING_MARKS, EMOTIONS, FIGURE_PATTERNS_EN, FIGURE_PATTERNS_JA, PROBLEM_COLUMNS
from ..functions.text import is_blank


def first_to_last(pattern: str) -> str:
    """``a.*b`` so that a search costs time in proportion to the text: after the first ``a``, the last ``b``.

    Where no ``b`` follows the first ``a``, none follows a later one, so no other ``a`` is tried."""
    first, last = pattern.split(".*")
    return f"\\A(?>.*?{first}).*{last}"


def needed_literals(patterns: list[str]) -> list[str]:
    """Few literals of which a text holds one wherever it matches one of the patterns ``a.*b``: of each pattern, the one
    that most patterns have."""
    parts = [p.split(".*") for p in patterns]
    often = Counter(chain.from_iterable(parts))
    return sorted({max(both, key=often.__getitem__) for both in parts})


def _holds(text: Column, literal: str) -> Column:
    """Whether a text holds what a pattern's literal needs; cheap, and true wherever a pattern finds it.

    Letters are compared in upper case, where the long s is S; of the literal, the longest part without ``i`` and ``k``,
    since to a pattern the dotted capital I and the Kelvin sign are such letters, but they are their own upper case."""
    part = max(re.split("[ik]", literal), key=len)
    return text.contains(part) if part.upper() == part.lower() else F.upper(text).contains(part.upper())


def _figure(text: Column, patterns: list[str]) -> Column:
    possible = reduce(or_, (_holds(text, literal) for literal in needed_literals(patterns)))
    # u: case folding beyond ASCII
    found = possible & text.rlike("(?isu)(?:" + "|".join(map(first_to_last, patterns)) + ")")
    for mark in DRAWING_MARKS:
        found = found | text.contains(mark)
    return F.coalesce(found, F.lit(False))


def is_text_only(text: Column) -> Column:
    """True for a problem text that refers to no figure. Null and empty texts pass."""
    return ~_figure(text, FIGURE_PATTERNS_EN)


def is_text_only_record(columns: list[str], present: list[str] | None = None) -> Column:
    """The bilingual filter over a record's problem columns, joined by line ends; a match may span columns.

    Null counts as empty; columns that the record does not have (``present``) too. A
    blank record passes.
    """
    use = [c for c in columns if present is None or c in present]
    parts = [F.coalesce(F.col(c), F.lit("")) if c in use else F.lit("") for c in columns]
    joined = F.concat_ws("\n", *parts)
    return is_blank(joined) | ~_figure(joined, FIGURE_PATTERNS_JA + FIGURE_PATTERNS_EN)


def is_known_emotion(label: Column) -> Column:
    return F.coalesce(label.isin(EMOTIONS), F.lit(False))


def is_completed(flag: Column) -> Column:
    """A session without the flag is not completed."""
    return F.coalesce(flag, F.lit(False))


def has_text(text: Column) -> Column:
    """Not null and not empty."""
    return F.coalesce(text, F.lit("")) != ""


__all__ = ["PROBLEM_COLUMNS", "has_text", "is_completed", "is_known_emotion", "is_text_only", "is_text_only_record"]
