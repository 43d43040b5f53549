"""Exact deduplication by sorting contents.

The normalised texts are range-partitioned by sampled splitters and sorted
externally, so equal texts lie next to each other; each row is compared in full
with its neighbours. Copies of one text are dealt to ``SALTS`` runs, so that
no task sorts more than a fraction of even the largest group; the runs' keepers
are then merged by the text's SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patternflow.llm.common import lower_ascii, narrowed, ref, staged, whole_text

#: Runs that the copies of one text are dealt to.
SALTS = 64
#: Leading characters by which the splitters cut. They only place rows; texts
#: are compared in full. Bounds what sampling sends to the driver.
SPLIT_CHARS = 32


def mark_copies(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    keep: str = "smallest",
    normalise=lower_ascii,
    salts: int = SALTS,
) -> DataFrame:
    """One row per input row: identifier, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are identical; null counts as
    empty text. Of each group the row with the ``keep`` ("smallest" or "largest")
    identifier has ``kept`` set: exactly one row, also where rows repeat.
    A null identifier loses to any other. An empty table gives an empty result;
    other columns of the input are ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    best = F.max if keep == "largest" else F.min
    first = (lambda c: c.desc_nulls_last()) if keep == "largest" else (lambda c: c.asc_nulls_last())

    rows = narrowed(df, id_col, text_col).select(
        ref(id_col).alias("id"), normalise(whole_text(text_col)).alias("body")
    )
    keyed = rows.select(
        "id",
        "body",
        F.substring("body", 1, SPLIT_CHARS).alias("head"),
        F.xxhash64("body").alias("digest"),
        F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"),
    )
    # The window's keys begin with the range keys, so this one exchange serves both.
    places = ["head", "digest", "salt"]
    run = Window.partitionBy(*places, "body").orderBy(first(F.col("id")))
    marked = staged(
        keyed.repartitionByRange(*places).select(
            "id",
            "salt",
            F.unhex(F.sha2(F.col("body"), 256)).alias("sha"),
            F.row_number().over(run).alias("place"),
        ),
        "content-sort",
    )

    runs = marked.groupBy("sha", "salt").agg(best("id").alias("id"), F.count(F.lit(1)).alias("n"))
    groups = runs.groupBy("sha").agg(
        best("id").alias("keep_id"),
        F.sum("n").alias("group_size"),
        F.collect_set("salt").alias("salt"),  # at most `salts` numbers
    )
    spread = groups.select("sha", "keep_id", "group_size", F.explode("salt").alias("salt"))
    is_kept: Column = (F.col("place") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))
    return marked.join(spread, ["sha", "salt"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        is_kept.alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "smallest") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; of rows repeated in full one stays."""
    marked = mark_copies(df, id_col, text_col, keep=keep)

    def name_of(column: Column) -> Column:
        return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), column.cast("string")))

    keepers = marked.filter("kept").select(
        name_of(F.col(id_col)).alias("_row_id"), F.unhex("text_sha256").alias("_row_sha")
    )
    sha = F.unhex(F.sha2(lower_ascii(whole_text(text_col)), 256))
    met = df.withColumns({"_row_id": name_of(ref(id_col)), "_row_sha": sha}).join(
        keepers, ["_row_id", "_row_sha"], "left_semi"
    )
    same = Window.partitionBy("_row_id", "_row_sha").orderBy("_row_id")
    once = met.withColumn("_row_copy", F.row_number().over(same)).filter("_row_copy = 1")
    return once.select(*[ref(c) for c in df.columns])
