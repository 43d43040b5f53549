"""Queries with their SQL counterparts, and small helpers to write the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patternflow.model import Rule

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    assert name not in QUERIES, name
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def checked(oracle: str | None = None):
    """Register the decorated function under its own name."""

    def wrap(fn: Query) -> Query:
        register(fn.__name__, fn, oracle)
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def sql_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def sql_hit(cell: str, pattern: str) -> str:
    return f"regexp_matches(coalesce(CAST({cell} AS VARCHAR), ''), {lit(pattern)})"


def sql_flag(rule: Rule) -> str:
    joiner = " AND " if rule.combinator == "all" else " OR "
    return "(" + joiner.join(sql_hit(ident(p.column), p.pattern) for p in rule.predicates) + ")"


def rule_sql(rule: Rule, columns: list[str], source: str) -> str:
    """The rule over ``source`` (a table or a subquery in brackets), written out in SQL."""
    cells = {c: ident(c) for c in columns}
    if rule.action in ("replace", "mask"):
        text = rule.value or ("••••" if rule.action == "mask" else "")
        text = lit(text.replace("\\", "\\\\"))
        for c in columns:
            patterns = [p.pattern for p in rule.predicates if p.column == c]
            if patterns:
                new = f"coalesce(CAST({ident(c)} AS VARCHAR), '')"
                for p in patterns:
                    new = f"regexp_replace({new}, {lit(p)}, {text}, 'g')"
                cells[c] = f"CASE WHEN {sql_flag(rule)} THEN {new} ELSE CAST({ident(c)} AS VARCHAR) END"
    elif rule.action == "extract":
        for p in rule.predicates:
            old = f"CAST({cells[p.column]} AS VARCHAR)"
            cells[p.column] = (
                f"CASE WHEN {sql_flag(rule)} AND {sql_hit(old, p.pattern)} "
                f"THEN regexp_extract(coalesce({old}, ''), {lit(p.pattern)}) ELSE {old} END"
            )
    where = {"keep": f" WHERE {sql_flag(rule)}", "drop": f" WHERE NOT {sql_flag(rule)}"}
    shown = ", ".join(f"{sql} AS {ident(c)}" for c, sql in cells.items())
    return (
        f'SELECT {shown}, {sql_flag(rule)} AS "__matched__" FROM {source} AS src'
        + where.get(rule.action, "")
    )
