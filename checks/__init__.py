"""The queries behind ``__spark_entry__`` and the SQL they are checked against."""

from checks import prompts, rules, tables  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
