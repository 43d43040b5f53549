"""Predicates and cell edits as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from patternflow.functions.columns import as_text, null_as_empty, ref
from patternflow.functions.entities import BY_PATTERN
from patternflow.functions.patterns import quote_replacement
from patternflow.model import Predicate

#: Characters looked at first for a match that most cells have near their start.
EARLY = 200
# "^" followed by characters with no meaning in a regex: a plain prefix.
_PREFIX = re.compile(r"\^([A-Za-z0-9_ ]+)(\$?)\Z")


def text_matches(text: Column, pattern: str, digit: Column | None = None) -> Column:
    """``text`` (never null) contains a match, with the cheapest exact test first.

    ``digit`` tells whether the text holds a digit, where several patterns share that.
    """
    test = text.rlike(pattern)
    entity = BY_PATTERN.get(pattern)
    if entity is not None:
        if entity.early:
            # Decoding a cell for the regex costs more than finding the first match in it.
            test = F.substring(text, 1, EARLY).rlike(pattern) | test
        gate = entity.gate(text, digit)
        if gate is None or entity.exact:
            return test if gate is None else gate
        return gate & test
    prefix = _PREFIX.match(pattern)
    if prefix:
        starts = text.startswith(prefix.group(1))
        # "$" also matches before a final newline, so only the prefix is a plain test.
        return starts & test if prefix.group(2) else starts
    return test


def hit(predicate: Predicate) -> Column:
    """One predicate; a null cell reads as empty text, so this is never null."""
    return text_matches(null_as_empty(as_text(predicate.column)), predicate.pattern)


def combine(conditions: Iterable[Column], combinator: str) -> Column:
    return reduce(and_ if combinator == "all" else or_, conditions)


def match_condition(predicates: Iterable[Predicate], combinator: str = "all") -> Column:
    """The row test: predicates folded left to right with AND ("all") or OR."""
    return combine([hit(p) for p in predicates], combinator)


def pushable_condition(
    predicates: Iterable[Predicate], combinator: str, string_columns: set[str]
) -> Column | None:
    """A weaker row test that a Parquet scan can use to skip row groups, if there is one.

    Regexes never reach the scan, but a prefix test on the bare column does.
    Every row passing the full test passes this one.
    """
    tests = []
    for p in predicates:
        prefix = _PREFIX.match(p.pattern)
        usable = prefix is not None and p.column in string_columns
        if usable:
            tests.append(ref(p.column).startswith(prefix.group(1)))
        elif combinator != "all":
            return None
    return combine(tests, combinator) if tests else None


def substitute_all(original: Column, patterns: list[str], text: str) -> Column:
    """Every match of each pattern in turn replaced by literal ``text``; null reads as empty."""
    literal = quote_replacement(text)
    cell = null_as_empty(original)
    for pattern in patterns:
        cell = F.regexp_replace(cell, F.lit(pattern), F.lit(literal))
    return cell


def first_match(original: Column, pattern: str) -> Column:
    return F.regexp_extract(null_as_empty(original), pattern, 0)
