"""Rules as plain values: what to match, how to combine it, what to do with it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

# Boolean column added to every result: true where the rule selected the row.
FLAG = "__matched__"
# 1-based position of a row in a written table.
ROW_NUMBER = "__rownum"
# Where a row of a table over several files was read: the file, then the stretch of it, a line each.
PLACE = "__place__"

CELL_ACTIONS = frozenset({"replace", "mask", "extract"})
ROW_ACTIONS = frozenset({"keep", "drop"})
ACTIONS = ("find", "replace", "mask", "extract", "keep", "drop")
COMBINATORS = ("all", "any")
DEFAULT_MASK = "••••"


class RuleError(ValueError):
    """A rule that cannot be run as given."""


class MissingColumnsError(RuleError):
    def __init__(self, missing: list[str]):
        self.missing = missing
        super().__init__("Columns not in the table: " + ", ".join(missing))


@dataclass(frozen=True)
class Predicate:
    """One regex test (Java syntax, unanchored) on one column."""

    column: str
    pattern: str
    explanation: str = ""


@dataclass(frozen=True)
class Rule:
    predicates: tuple[Predicate, ...]
    combinator: str = "all"
    action: str = "find"
    value: str = ""

    def __post_init__(self):
        object.__setattr__(self, "predicates", tuple(self.predicates))
        if not self.predicates:
            raise RuleError("A rule needs at least one predicate")
        if self.action not in ACTIONS:
            raise RuleError(f"Unknown action {self.action!r}; expected one of {', '.join(ACTIONS)}")
        # Anything but a known combinator means "all".
        if self.combinator not in COMBINATORS:
            object.__setattr__(self, "combinator", "all")

    @property
    def substitute(self) -> str:
        """Text written over each match by replace or mask."""
        return (self.value or DEFAULT_MASK) if self.action == "mask" else self.value

    @classmethod
    def on(cls, column: str, pattern: str, action: str = "find", value: str = "") -> Rule:
        return cls((Predicate(column, pattern),), "all", action, value)

    @classmethod
    def fan_out(
        cls, columns: Iterable[str], pattern: str, action: str = "find", value: str = ""
    ) -> Rule:
        """The same pattern over several columns; a hit in any of them selects the row."""
        return cls(tuple(Predicate(c, pattern) for c in columns), "any", action, value)

    @classmethod
    def from_dict(cls, d: Mapping) -> Rule:
        preds = tuple(
            Predicate(p["column"], p["pattern"], p.get("explanation") or "")
            for p in d["predicates"]
        )
        return cls(
            preds, d.get("combinator", "all"), d.get("action", "find"), d.get("value") or ""
        )

    def check_columns(self, available: Iterable[str]) -> None:
        """Raise once, naming every column the table lacks."""
        present = set(available)
        missing = [c for c in dict.fromkeys(p.column for p in self.predicates) if c not in present]
        if missing:
            raise MissingColumnsError(missing)
