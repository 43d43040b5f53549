"""The row order of tables that lie in several files.

Spark deals files to tasks by size, so reading several of them says nothing about
their order. A row's place is its file's, then that of its stretch of the file, then its
place in that stretch. A task reads the rows of a stretch one after the other, so file and stretch, carried along as
a column that hardly ever changes, keep the order of what is written without moving a row.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternflow.functions.columns import ref
from patternflow.model import PLACE
from patternflow.operators.numbering import file_order, place_order

_STRETCH_DIGITS = 19
#: A plan's node that deals rows anew.
_MOVES_ROWS = re.compile(r"^[ :+*()\d-]*\w*Exchange\b", re.MULTILINE)
_ROW, _FILE_KEY = "__row_place", "__file_place"


def place(stretch_start: Column, file: Column) -> Column:
    return F.concat(file, F.lit("\n"), F.lpad(stretch_start.cast("string"), _STRETCH_DIGITS, "0"))


def place_of_read() -> Column:
    """The place of a row that is read straight from a file."""
    return place(F.col("_metadata.file_block_start"), F.col("_metadata.file_path"))


def _several_files(df: DataFrame) -> bool:
    """Whether ``df`` is a plain read of several files: nothing between its rows and theirs moves or merges rows."""
    try:
        df.select("_metadata.file_path").schema  # noqa: B018  analysis may wait until here
    except AnalysisException:
        return False
    if len(df.inputFiles()) < 2:
        return False
    return not _MOVES_ROWS.search(df._jdf.queryExecution().executedPlan().toString())


def carries_places(df: DataFrame) -> bool:
    return PLACE in df.columns


def with_places(df: DataFrame) -> DataFrame:
    """``df`` with its rows' places as a last column ``PLACE``; a single file needs none and gets none.

    Rows of a result that has places already get longer ones, by the stretch of the result's file. A frame that
    is not read straight from files keeps whatever order it has.
    """
    known = placed_rows(df)
    if known is not None:
        return known
    if not _several_files(df):
        return df
    stretch = F.col("_metadata.file_block_start")
    if carries_places(df):
        longer = F.concat(ref(PLACE), F.lit("\n"), F.lpad(stretch.cast("string"), _STRETCH_DIGITS, "0"))
        return df.withColumn(PLACE, longer)
    return df.withColumn(PLACE, place_of_read())


def remember_places(df: DataFrame, placed: DataFrame) -> DataFrame:
    """``df``, with ``placed`` as what :func:`with_places` makes of it: for frames put together from several reads."""
    df._rows_with_places = placed
    return df


def placed_rows(df: DataFrame) -> DataFrame | None:
    return getattr(df, "_rows_with_places", None)


def _local(path: Column) -> Column:
    """Local files are named with one slash or with three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _with_keys(placed: DataFrame) -> DataFrame:
    """``placed`` with all that orders its rows; the number of a row only counts within one stretch."""
    file = F.col("_metadata.file_path") if placed_from_files(placed) else F.lit("")
    return placed.select(
        "*", place_order(ref(PLACE)).alias("__stretch_place"), file_order(file).alias(_FILE_KEY), F.monotonically_increasing_id().alias(_ROW)
    )


def placed_from_files(placed: DataFrame) -> bool:
    try:
        placed.select("_metadata.file_path").schema  # noqa: B018
    except AnalysisException:
        return False
    return True


_KEYS = ("__stretch_place", _FILE_KEY, _ROW)


def in_source_order(df: DataFrame) -> DataFrame:
    """The same rows in the order of the files that ``df`` reads: what an export needs.

    Several files cost one range exchange; a single file is in order as it is, and
    a frame that is not read straight from files keeps whatever order it has.
    """
    placed = with_places(df)
    if not carries_places(placed):
        return df
    ordered = _with_keys(placed).repartitionByRange(*_KEYS).sortWithinPartitions(*_KEYS)
    return ordered.select(*(ref(c) for c in df.columns))


def first_rows(df: DataFrame, rows: int) -> DataFrame:
    """The first rows of the files that ``df`` reads.

    A table that carries places is asked for these first; of a plain read no file behind the rows is opened.
    """
    placed = with_places(df)
    if not carries_places(placed):
        return df.limit(rows)
    if carries_places(df) or placed_rows(df) is not None:
        firsts, found = [], 0
        stretches = placed.groupBy(PLACE).count().orderBy(place_order(ref(PLACE)))
        for stretch, n in stretches.toLocalIterator():
            firsts.append(stretch)
            found += n
            if found >= rows:
                break
        early = _with_keys(placed.filter(ref(PLACE).isin(firsts)))
        return early.orderBy(*_KEYS).limit(rows).select(*(ref(c) for c in df.columns))
    spark = df.sparkSession
    files = spark.createDataFrame([(f,) for f in df.inputFiles()], "file string").orderBy(file_order(F.col("file")))
    parts, found = None, 0
    for (file,) in files.toLocalIterator():
        part = df.filter(_local(F.col("_metadata.file_path")) == _local(F.lit(file))).limit(rows - found)
        n = part.count()
        if n:
            parts = part if parts is None else parts.union(part)
            found += n
        if found >= rows:
            break
    return df.limit(0) if parts is None else parts
