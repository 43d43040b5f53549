"""Building regexes from literal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters with a meaning in a regex, plus whitespace. Fixed value.
META = "()[]{}?*+-|^$\\.&~# \t\n\r\v\f"
_META_CLASS = r"([()\[\]{}?*+\-|^$\\.&~# \t\n\r\x0B\f])"


def quote_regex(text: str) -> str:
    """``text`` as a regex that matches it literally."""
    return "".join("\\" + ch if ch in META else ch for ch in text)


def quote_regex_col(text: Column) -> Column:
    """:func:`quote_regex` for a column."""
    return F.regexp_replace(text, _META_CLASS, r"\\$1")


def quote_replacement(text: str) -> str:
    """Replacement text with no group references: ``$`` and ``\\`` stay themselves."""
    return "".join("\\" + ch if ch in "\\$" else ch for ch in text)


def starts_with(text: str) -> str:
    return "^" + quote_regex(text)


def ends_with(text: str) -> str:
    return quote_regex(text) + "$"


def equals(text: str) -> str:
    return "^" + quote_regex(text) + "$"


def whole_word(text: str) -> str:
    return r"\b" + quote_regex(text) + r"\b"


BLANK = r"^\s*$"
WHOLE_LINE = r"^.+$"
