"""Writing results: Parquet, CSV and spreadsheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternflow.functions.cells import MAX_COLUMNS, MAX_ROWS, excel_safe
from patternflow.functions.columns import ref
from patternflow.model import FLAG
from patternflow.operators.paging import display, matched_view
from patternflow.operators.results import write_version
from patternflow.session import ensure_on_executors
from patternflow.sources.order import in_source_order, with_places
from patternflow.sources.workbook_sink import WorkbookSink


class TooLargeForExcel(ValueError):
    """The result does not fit one worksheet."""


def write_result(df: DataFrame, path: str) -> None:
    """The whole result, match flag included, as Parquet; replaces what was there."""
    df.write.mode("overwrite").parquet(path)


def stage_table(df: DataFrame, path: str) -> str:
    """Any table as Parquet that keeps its row order, ready for windows, pages and samples; no row is moved."""
    write_result(with_places(df), path)
    return path


def replace_result(df: DataFrame, path: str) -> None:
    """Write the result as the new version at ``path``; a failed write leaves the old one alone.

    See :mod:`~patternflow.operators.results` for what a reader sees meanwhile.
    """
    write_version(df, path)


def exported(df: DataFrame, matched_only: bool = False, flag: str = FLAG) -> DataFrame:
    """What an export holds: no flag column, selected rows only if asked."""
    return display(matched_view(df, flag) if matched_only else df, flag)


def export_csv(df: DataFrame, path: str, matched_only: bool = False, flag: str = FLAG) -> None:
    """A folder of CSV parts, each with the header, in the table's row order.

    Cells keep their spaces; an empty text is written as ``""``, a null as nothing.
    """
    out = exported(in_source_order(df), matched_only, flag)
    if len(out.columns) == 1:
        # A lone null would make an empty line, which CSV writers and readers skip.
        cell = ref(out.columns[0]).cast("string")
        out = out.select(F.coalesce(cell, F.lit("")).alias(out.columns[0]))
    out.write.mode("overwrite").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def check_fits_excel(df: DataFrame, max_rows: int = MAX_ROWS, max_columns: int = MAX_COLUMNS) -> int:
    """The row count, or an error if a worksheet cannot hold the table.

    Columns are checked before any row is read. The count is a parallel one,
    answered by file footers unless rows are filtered.
    """
    if len(df.columns) > max_columns:
        raise TooLargeForExcel(
            f"{len(df.columns):,} columns do not fit a worksheet ({max_columns:,}); export CSV instead"
        )
    rows = df.count()
    if rows > max_rows - 1:
        raise TooLargeForExcel(
            f"{rows:,} rows do not fit a worksheet ({max_rows - 1:,}); export CSV instead"
        )
    return rows


def export_excel(df: DataFrame, path: str, matched_only: bool = False, flag: str = FLAG) -> int:
    """One workbook at ``path``, a place all executors can write; returns its row count.

    A workbook is a single file by nature. The size check comes first, so the
    one task that writes it never sees more than a worksheet's worth of rows;
    scanning and filtering the table stay parallel.
    """
    out = exported(in_source_order(df), matched_only, flag)
    rows = check_fits_excel(out)
    df.sparkSession.dataSource.register(WorkbookSink)
    ensure_on_executors(df.sparkSession)
    placed = excel_safe(_wall_clock(out)).withColumn("__place", F.monotonically_increasing_id())
    sheet = placed.repartition(1).sortWithinPartitions("__place").drop("__place")
    sheet.write.format(WorkbookSink.name()).mode("overwrite").save(path)
    return rows


def _wall_clock(df: DataFrame) -> DataFrame:
    """Timestamps as the session shows them, whatever the executors' own time zone."""
    shown = {
        f.name: ref(f.name).cast("timestamp_ntz")
        for f in df.schema.fields
        if isinstance(f.dataType, T.TimestampType)
    }
    return df.select(*(shown.get(c, ref(c)).alias(c) for c in df.columns))


def export(df: DataFrame, path: str, fmt: str = "csv", matched_only: bool = False) -> None:
    if fmt == "csv":
        export_csv(df, path, matched_only)
    elif fmt in ("xlsx", "excel"):
        export_excel(df, path, matched_only)
    else:
        raise ValueError(f"Unknown export format {fmt!r}")
