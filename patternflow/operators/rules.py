"""Applying rules to a table.

Everything here is a map-only plan of built-in expressions: no shuffle, no
Python per row. Each regex runs at most once per cell for the match flag, and
rewriting touches flagged cells only. Row order is the scan's.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternflow.functions.columns import as_text, null_as_empty, ref
from patternflow.functions.entities import BY_PATTERN, has_digit
from patternflow.functions.matching import (
    combine,
    first_match,
    hit,
    match_condition,
    pushable_condition,
    substitute_all,
    text_matches,
)
from patternflow.model import CELL_ACTIONS, FLAG, ROW_ACTIONS, Rule, RuleError

#: Which rule a row of several rules' results belongs to.
RULE = "__rule__"


def _free_names(df: DataFrame, count: int) -> list[str]:
    """Names for helper columns that no column of the table has."""
    stem = "__hit"
    while any(c.lower().startswith(stem) for c in df.columns):
        stem = "_" + stem
    return [f"{stem}_{i}" for i in range(count)]


def _check(df: DataFrame, rule: Rule, flag: str) -> None:
    rule.check_columns(df.columns)
    if flag.lower() in {c.lower() for c in df.columns}:
        raise RuleError(f"The table already has a column named {flag}")


def input_counts(flag: str = FLAG) -> tuple[Column, Column]:
    """Aggregates describing the input of a rule: all rows and selected rows."""
    return (
        F.count(F.lit(1)).alias("total_rows"),
        F.coalesce(F.sum(ref(flag).cast("long")), F.lit(0)).alias("matched_rows"),
    )


def apply_rule(
    df: DataFrame, rule: Rule, *, flag: str = FLAG, observe: Observation | str | None = None
) -> DataFrame:
    """The table after ``rule``: source columns in order, then the match flag.

    The flag describes the original cells. ``observe`` collects the input counts
    (``total_rows``, ``matched_rows``) while the result is computed, so no second
    pass and no cache is needed.
    """
    _check(df, rule, flag)
    if rule.action in ROW_ACTIONS:
        return _filter_rows(df, rule, flag, observe)

    # Cell edits under "any" need to know which predicate hit, so those tests are
    # kept as columns; otherwise the flag alone is enough.
    keep_hits = rule.action in CELL_ACTIONS and rule.combinator == "any"
    keep_hits = keep_hits and len(rule.predicates) > 1
    if keep_hits:
        hits = _free_names(df, len(rule.predicates))
        flagged = df.select("*", *(hit(p).alias(h) for p, h in zip(rule.predicates, hits)))
        flagged = flagged.select("*", combine([ref(h) for h in hits], "any").alias(flag))
    else:
        hits = []
        flagged = df.select("*", match_condition(rule.predicates, rule.combinator).alias(flag))
    if observe is not None:
        flagged = flagged.observe(observe, *input_counts(flag))
    if rule.action in CELL_ACTIONS:
        flagged = _edit_cells(flagged, rule, flag, hits)
    return flagged.select(*(ref(c) for c in df.columns), ref(flag))


def _filter_rows(df: DataFrame, rule: Rule, flag: str, observe) -> DataFrame:
    condition = match_condition(rule.predicates, rule.combinator)
    keep = rule.action == "keep"
    if observe is not None:
        # The counts cover every input row, so the filter has to come after them.
        seen = df.select("*", condition.alias(flag)).observe(observe, *input_counts(flag))
        return seen.filter(ref(flag) if keep else ~ref(flag))
    if keep:
        strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
        early = pushable_condition(rule.predicates, rule.combinator, strings)
        if early is not None:
            df = df.filter(early)
    # The flag of what is left is known, which spares testing each row twice.
    return df.filter(condition if keep else ~condition).withColumn(flag, F.lit(keep))


def _edit_cells(flagged: DataFrame, rule: Rule, flag: str, hits: list[str]) -> DataFrame:
    by_column: dict[str, list[int]] = {}
    for i, p in enumerate(rule.predicates):
        by_column.setdefault(p.column, []).append(i)

    if rule.action != "extract":
        edits = {}
        for column, idx in by_column.items():
            cell = as_text(column)
            edited = substitute_all(
                cell, [rule.predicates[i].pattern for i in idx], rule.substitute
            )
            if hits and len(idx) == 1:
                edited = F.when(ref(hits[idx[0]]), edited).otherwise(null_as_empty(cell))
            edits[column] = F.when(ref(flag), edited).otherwise(cell)
        return _replace_columns(flagged, edits)

    # Extract: one projection per position in a column's predicate list, because
    # each step tests what the step before left behind.
    for step in range(max(len(idx) for idx in by_column.values())):
        edits = {}
        for column, idx in by_column.items():
            if step >= len(idx):
                continue
            i = idx[step]
            cell, pattern = as_text(column), rule.predicates[i].pattern
            if step == 0:
                # Original cells: own hit implies the flag under "any", and the
                # flag implies own hit under "all".
                fires = ref(hits[i]) if hits else ref(flag)
            else:
                fires = ref(flag) & text_matches(null_as_empty(cell), pattern)
            edits[column] = F.when(fires, first_match(cell, pattern)).otherwise(cell)
        flagged = _replace_columns(flagged, edits)
    return flagged


def _replace_columns(df: DataFrame, edits: Mapping[str, Column]) -> DataFrame:
    return df.select(*(edits[c].alias(c) if c in edits else ref(c) for c in df.columns))


def apply_rules(df: DataFrame, rules: Mapping[str, Rule], *, flag: str = FLAG) -> dict:
    """One result per rule, each from the ORIGINAL table; runs do not chain."""
    return {name: apply_rule(df, rule, flag=flag) for name, rule in rules.items()}


def edited_columns(rule: Rule) -> list[str]:
    """The columns that a rule's result has new cells in, as text."""
    return list(dict.fromkeys(p.column for p in rule.predicates)) if rule.action in CELL_ACTIONS else []


def apply_rules_at_once(
    df: DataFrame, rules: Mapping[str, Rule], *, flag: str = FLAG, observe: Observation | None = None
) -> DataFrame:
    """The results of several rules in one frame, from one read of the table: ``RULE``, source columns, flag.

    A row comes once for each rule whose result holds it, next to its other copies. Each rule sees the original cells. ``observe``
    collects ``total_rows`` and, for the i-th rule, ``matched_i``. All results must have the same column types:
    rules that turn a column into text go with columns that are text already.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    stem = "__rule"
    while any(c.lower().startswith(stem) for c in df.columns):
        stem = "_" + stem
    wide, shown = df, []
    for i, (name, rule) in enumerate(rules.items()):
        _check(df, rule, flag)
        edited = edited_columns(rule)
        if any(not isinstance(kinds[c], T.StringType) for c in edited):
            raise RuleError(f"{name} edits a column that is not text")
        # A rule works on copies of the cells that it edits, so the next one finds them as they were.
        own = {c: f"{stem}{i}_{j}" for j, c in enumerate(edited)}
        wide = wide.select("*", *(ref(c).alias(copy) for c, copy in own.items()))
        moved = replace(
            rule,
            predicates=tuple(replace(p, column=own.get(p.column, p.column)) for p in rule.predicates),
            action=rule.action if edited else "find",
        )
        own_flag = f"{stem}{i}_flag"
        wide = apply_rule(wide, moved, flag=own_flag)
        written = {"keep": ref(own_flag), "drop": ~ref(own_flag)}.get(rule.action, F.lit(True))
        cells = [ref(own.get(c, c)).alias(c) for c in df.columns]
        shown.append(F.struct(written.alias(f"{stem}_written"), F.lit(name).alias(RULE), *cells, ref(own_flag).alias(flag)))
    if observe is not None:
        flags = (ref(f"{stem}{i}_flag").cast("long") for i in range(len(rules)))
        matched = (F.coalesce(F.sum(f), F.lit(0)).alias(f"matched_{i}") for i, f in enumerate(flags))
        wide = wide.observe(observe, F.count(F.lit(1)).alias("total_rows"), *matched)
    return wide.select(F.inline(F.array(*shown))).filter(ref(f"{stem}_written")).drop(f"{stem}_written")


def rule_counts(df: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """``(rule, total_rows, matched_rows)`` for many rules from one scan of the table."""
    for rule in rules.values():
        rule.check_columns(df.columns)
    used = list(dict.fromkeys(p.column for r in rules.values() for p in r.predicates))
    # Each column once as text; whether it holds a digit too, where several patterns start from that.
    names = {c: f"c{i}" for i, c in enumerate(used)}
    source = df.select(*(null_as_empty(as_text(c)).alias(n) for c, n in names.items()))
    tests = {(p.column, p.pattern): None for r in rules.values() for p in r.predicates}
    asked = Counter(column for column, pattern in tests if pattern in BY_PATTERN and BY_PATTERN[pattern].digits)
    digits = [n for c, n in names.items() if asked[c] > 1]
    source = source.select("*", *(has_digit(F.col(n)).alias(f"{n}_digit") for n in digits))
    # A pattern runs once on a column, however many rules ask for it.
    repeated = Counter((p.column, p.pattern) for r in rules.values() for p in set(r.predicates))
    shared = {test: f"t{i}" for i, (test, n) in enumerate(repeated.items()) if n > 1}

    def found(column: str, pattern: str) -> Column:
        n = names[column]
        return text_matches(F.col(n), pattern, F.col(f"{n}_digit") if n in digits else None)

    source = source.select("*", *(found(*test).alias(name) for test, name in shared.items()))

    def condition(rule: Rule) -> Column:
        hits = ((p.column, p.pattern) for p in rule.predicates)
        return combine([F.col(shared[t]) if t in shared else found(*t) for t in hits], rule.combinator)

    aggs = [F.count(F.lit(1)).alias("total")] + [F.count(F.when(condition(r), 1)).alias(f"m{i}") for i, r in enumerate(rules.values())]
    return source.agg(*aggs).select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(name).alias("rule"),
                        F.col("total").alias("total_rows"),
                        F.col(f"m{i}").alias("matched_rows"),
                    )
                    for i, name in enumerate(rules)
                )
            )
        )
    )
