"""Reading tables: CSV, spreadsheets and Parquet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternflow.functions.columns import ref
from patternflow.model import PLACE, RuleError
from patternflow.operators.results import open_result
from patternflow.sources.csv_layout import CsvLayout, inspect_csv, leaves_no_cell_open, read_spanning
from patternflow.sources.order import first_rows, place_of_read, remember_places
from patternflow.sources.workbook import read_workbooks

PREVIEW_ROWS = 20
EXCEL_SUFFIXES = (".xlsx", ".xlsm", ".xls")


class EmptyTableError(RuleError):
    """A source without a header row."""


class DifferentHeadersError(RuleError):
    """Files of one table that disagree on its columns."""


def detect_kind(name: str) -> str:
    """``excel`` for spreadsheet suffixes, ``csv`` for everything else."""
    return "excel" if name.lower().endswith(EXCEL_SUFFIXES) else "csv"


def read_table(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """Read by kind (``csv``, ``excel`` or ``parquet``).

    By default the name tells; a folder whose name tells nothing is Parquet if a file in it is.
    """
    kind = kind or ("parquet" if _is_parquet(spark, path) else detect_kind(path))
    if kind == "parquet":
        df = open_result(spark, path)
    elif kind == "excel":
        df = read_workbooks(spark, path)
    elif kind == "csv":
        return read_csv(spark, path, **options)
    else:
        raise ValueError(f"Unknown table kind {kind!r}")
    return _require_header(df, path)


def _is_parquet(spark: SparkSession, path: str) -> bool:
    if path.rstrip("/").endswith(".parquet"):
        return True
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder) or not fs.getFileStatus(folder).isDirectory():
        return False
    files = fs.listFiles(folder, True)
    while files.hasNext():
        name = files.next().getPath().getName()
        if not name.startswith(("_", ".")):
            return name.endswith(".parquet")
    return False


def read_csv(
    spark: SparkSession,
    path: str,
    *,
    multi_line: bool | None = None,
    schema: T.StructType | None = None,
    layout: CsvLayout | None = None,
) -> DataFrame:
    """CSV with a header, every cell a string, quotes doubled inside quoted cells.

    How a file may be cut depends on whether its quoted cells span lines. By default that is found out first for
    each file, in one parallel pass over the lines (see :func:`~patternflow.sources.csv_layout.inspect_csv`, whose
    ``layout`` can be passed in to read again without the pass). Pass ``multi_line`` when you know:
    False cuts every file at lines, True reads every file in one task. Header names lose surrounding
    spaces; other renamings are Spark's (duplicate or blank names get a suffix).
    Files of a folder must agree on the header, or reading them fails.
    """
    if multi_line is None:
        layout = inspect_csv(spark, path) if layout is None else layout
    else:
        layout = CsvLayout(path)
    many = has_many_files(spark, path)

    def reader(lines_span: bool, header: bool = True) -> DataFrameReader:
        return spark.read.options(header=header, multiLine=lines_span, escape='"', enforceSchema=not many)

    heads_span = bool(multi_line or layout.whole)
    if schema is None:
        schema = _require_header(reader(heads_span).csv(path), path).schema
        # A name that occurs twice gets its position as a suffix, a blank one is made from it.
        changed = many and any(n.endswith(str(i)) for i, n in enumerate(schema.names))
        head = reader(heads_span, header=False).csv(path).first() if changed else None
        if head is not None and [(x or "").lower() for x in head] != [n.lower() for n in schema.names]:
            # Spark compares each file's header with names that it has changed, so all of them would differ.
            _require_one_header(spark, path)
            many = False
    if not many and not layout.spanning and len(layout.whole) == 1:
        multi_line, layout = True, CsvLayout(path)
    if not layout.odd:
        return _trim_header(_require_header(reader(bool(multi_line)).schema(schema).csv(path), path))
    plain = reader(False).schema(schema).csv(path).filter(~F.col("_metadata.file_path").isin(list(layout.odd)))
    parts = [plain.withColumn(PLACE, place_of_read())]
    if layout.whole:
        parts.append(reader(True).schema(schema).csv(list(layout.whole)).withColumn(PLACE, place_of_read()))
    if layout.spanning:
        parts.append(read_spanning(spark, layout, schema))
    placed = reduce(DataFrame.unionByName, parts)
    df = _trim_header(placed.drop(PLACE))
    return remember_places(df, placed.toDF(*df.columns, PLACE))


def has_multi_line_cells(spark: SparkSession, path: str) -> bool:
    """Whether some quoted cell might hold a line break.

    A line is plain if its quotes, doubled ones aside, come in pairs that enclose
    whole cells: then no cell is left open at its end. If all lines are plain,
    splitting at lines is exact; one other line settles it the other way.
    """
    odd = spark.read.text(path).filter(~leaves_no_cell_open(F.col("value")))
    return bool(odd.select(F.lit(1)).take(1))


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """The first line of each file.

    Numbers alone are aggregated: to aggregate texts, a task would sort all lines of its files.
    """
    lines = spark.read.text(path).filter("_metadata.file_block_start = 0")
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"))
    ids = lines.groupBy("file").agg(F.min("id").alias("id")).select("id")
    return lines.join(F.broadcast(ids), "id").select(F.regexp_replace("value", "^\ufeff", "").alias("head"))


def _require_one_header(spark: SparkSession, path: str) -> None:
    heads = first_lines(spark, path).distinct().take(2)
    if len(heads) > 1:
        raise DifferentHeadersError(f"Files of {path} have different headers: {heads[0]['head']!r} and {heads[1]['head']!r}")


def has_many_files(spark: SparkSession, path: str) -> bool:
    # The listing only; no content is read.
    return len(spark.read.text(path).inputFiles()) > 1


def _require_header(df: DataFrame, path: str) -> DataFrame:
    if not df.columns:
        raise EmptyTableError(f"No columns found in {path}")
    return df


def _trim_header(df: DataFrame) -> DataFrame:
    trimmed = [c.strip().lstrip("﻿") for c in df.columns]
    if trimmed == df.columns:
        return df
    taken = [c.lower() for c in trimmed]
    # A name keeps its spaces where dropping them would make it ambiguous or empty.
    names = [
        new if new and taken.count(new.lower()) == 1 else old
        for old, new in zip(df.columns, trimmed)
    ]
    return df.toDF(*names)


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows, in the order of the table's files, as text; null cells shown empty."""
    shown = (F.coalesce(ref(c).cast("string"), F.lit("")).alias(c) for c in df.columns if c != PLACE)
    return first_rows(df, rows).select(*shown)
