"""Running the entity catalogue over a table."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternflow.functions.columns import as_text, null_as_empty, ref
from patternflow.functions.entities import BY_NAME, CATALOGUE, Entity, has_digit
from patternflow.functions.matching import text_matches
from patternflow.model import Predicate, Rule


def entity_scan(
    df: DataFrame, columns: Iterable[str], entities: Iterable[str] | None = None
) -> DataFrame:
    """``(column, entity, total_rows, matched_rows)`` for every pair, in one pass.

    A single aggregate over one scan of just these columns; each task sends a row of
    counters per column, whatever the size of the table.
    """
    columns = list(columns)
    chosen = [BY_NAME[e] for e in entities] if entities is not None else list(CATALOGUE)
    Rule(tuple(Predicate(c, "") for c in columns)).check_columns(df.columns)
    # Cells on end: the plan has one set of counters, however many columns there are.
    if len(columns) == 1:
        cells = df.select(F.lit(0).alias("place"), null_as_empty(as_text(columns[0])).alias("cell"))
    else:
        cells = df.select(F.posexplode(F.array(*(null_as_empty(as_text(c)) for c in columns))).alias("place", "cell"))
    # Tests that others build on run once per cell: most entities need a digit, and
    # some match just when one of two or three simpler ones does.
    cells = cells.select("*", has_digit(F.col("cell")).alias("digit"))
    shared = {n for e in chosen for n in e.either}
    cells = cells.select("*", *(text_matches(F.col("cell"), BY_NAME[n].pattern, F.col("digit")).alias(n) for n in sorted(shared)))

    def test(e: Entity) -> Column:
        if e.name in shared:
            return F.col(e.name)
        if e.either:
            return reduce(or_, (F.col(n) for n in e.either))
        return text_matches(F.col("cell"), e.pattern, F.col("digit"))

    counters = [F.count(F.when(test(e), 1)).alias(f"n{j}") for j, e in enumerate(chosen)]
    counted = cells.groupBy("place").agg(F.count(F.lit(1)).alias("total"), *counters)
    # A row per column even where the table has none.
    names = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, columns))).alias("place", "column"))
    return names.join(counted, "place", "left").select(
        "column",
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(e.name).alias("entity"),
                        F.coalesce("total", F.lit(0)).alias("total_rows"),
                        F.coalesce(f"n{j}", F.lit(0)).alias("matched_rows"),
                    )
                    for j, e in enumerate(chosen)
                )
            )
        ),
    )


def entity_rule(name: str, columns: Iterable[str], action: str = "find", value: str = "") -> Rule:
    """A rule for one catalogue entity over the given columns."""
    e = BY_NAME[name]
    preds = tuple(Predicate(c, e.pattern, e.explanation) for c in columns)
    return Rule(preds, "any", action, value)
