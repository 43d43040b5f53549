"""Column references that survive odd names, types and nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python counts as whitespace: as a Java class, and one by one.
SPACE_CLASS = r"[\p{Z}\s\x0B\x1c-\x1f\x85]"
NON_SPACE_CLASS = "[^" + SPACE_CLASS[1:]
SPACES = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def ref(name: str) -> Column:
    """The column called exactly ``name``, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(name: str) -> Column:
    """The column as a string, nulls kept."""
    return ref(name).cast("string")


def null_as_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Trim any Unicode whitespace from both ends, looking at the ends only."""
    return F.trim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    """Nothing but whitespace; settled by the first other character."""
    return ~text.rlike(NON_SPACE_CLASS)
