"""Reading a page, a window or a single row of a written table.

A page is located through the per-file totals and read from the files it lies
in, at most one file per row, so its cost does not depend on the table's size
beyond the footers. Save the totals once with :func:`write_page_index` to skip
even those.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternflow.functions.columns import ref
from patternflow.model import FLAG, PLACE, ROW_NUMBER
from patternflow.operators.numbering import FILE, STRETCH, file_spans, stretch_of
from patternflow.operators.results import note_version, noted_versions, open_result, result_version

MAX_PAGE_SIZE = 500
DEFAULT_PAGE_SIZE = 50
JUMP_PAGE_SIZE = 100
WINDOW_SIZE = 100


@dataclass(frozen=True)
class Page:
    """``rows`` in order: display columns, ``__matched__``, ``__rownum``."""

    rows: DataFrame
    columns: list[str] = field(default_factory=list)
    total: int = 0
    total_all: int = 0
    matched_total: int = 0
    has_match_flag: bool = False
    matched_only: bool = False
    page: int = 1
    page_size: int = DEFAULT_PAGE_SIZE
    num_pages: int = 1


@dataclass(frozen=True)
class RowWindow:
    rows: DataFrame
    eof: bool
    cursor: int | None


def page_count(total: int, page_size: int) -> int:
    return max(1, -(-total // page_size))


def jump_target(row: int, total: int, page_size: int = JUMP_PAGE_SIZE) -> tuple[int, int, int]:
    """``(row, page, index on page)`` for a jump, the row clamped to 1..total."""
    row = max(1, min(total, row))
    return row, (row - 1) // page_size + 1, (row - 1) % page_size


def result_totals(df: DataFrame, flag: str = FLAG) -> DataFrame:
    """One row ``(total_rows, matched_rows)``; nothing is matched without a flag."""
    matched = F.count_if(ref(flag)) if flag in df.columns else F.lit(0).cast("long")
    return df.agg(F.count(F.lit(1)).alias("total_rows"), matched.alias("matched_rows"))


def display(df: DataFrame, flag: str = FLAG) -> DataFrame:
    """The table as users see it, without the match flag and the places rows were read from."""
    return df.select(*(ref(c) for c in df.columns if c not in (flag, PLACE)))


def matched_view(df: DataFrame, flag: str = FLAG) -> DataFrame:
    """Selected rows only; the whole table when it has no flag."""
    return df.filter(ref(flag)) if flag in df.columns else df


def write_page_index(spark: SparkSession, path: str, index_path: str, flag: str = FLAG) -> str:
    """Save the per-file totals of a finished table, and which version of the table they are of."""
    version = result_version(spark, path)
    file_spans(spark, path, flag).write.mode("overwrite").parquet(index_path)
    note_version(spark, index_path, version)
    return index_path


def index_is_current(spark: SparkSession, path: str, index_path: str, table: DataFrame | None = None) -> bool:
    """Whether an index is of the table that is at ``path`` now, and not of one that it replaced."""
    return noted_versions(spark, index_path) == [result_version(spark, path, table)]


def table_spans(spark: SparkSession, path: str, index_path: str | None, flag: str, table: DataFrame | None = None) -> DataFrame:
    """The totals: those of the index while it is current, else worked out from the table."""
    if index_path and index_is_current(spark, path, index_path, table):
        return spark.read.parquet(index_path)
    return file_spans(spark, path, flag)


def rows_of(spark: SparkSession, path: str, spans: list, low: int, high: int) -> DataFrame:
    """Rows numbered ``low``..``high`` out of the few files in ``spans``."""
    table = open_result(spark, path)
    if not spans:
        empty = F.lit(None).cast("long").alias(ROW_NUMBER)
        return table.limit(0).select("*", empty)
    offsets = F.create_map(
        *(x for s in spans for x in (F.lit(f"{s[FILE]}\n{s[STRETCH]}"), F.lit(s["rows_before"] - s["first_row"])))
    )
    span = F.concat(F.col("_metadata.file_path"), F.lit("\n"), stretch_of(table))
    number = F.element_at(offsets, span) + F.col("_metadata.row_index") + 1
    # The first filter is answered by the file listing: other files are not opened.
    return (
        table.filter(F.col("_metadata.file_path").isin(sorted({s[FILE] for s in spans})))
        .select("*", number.alias(ROW_NUMBER))
        .filter(F.col(ROW_NUMBER).between(low, high))
    )


def _between(low: int, high: int) -> Column:
    """Files holding rows numbered ``low``..``high``: at most one per row."""
    return (F.col("rows_before") < high) & (F.col("rows_before") + F.col("n_rows") >= low)


def rows_between(
    spark: SparkSession, path: str, spans: DataFrame, low: int, high: int
) -> DataFrame:
    return rows_of(spark, path, spans.filter(_between(low, high)).collect(), low, high)


def _locate(spans: DataFrame, wanted: Column) -> tuple[list, int, int]:
    """The wanted files in order, and the totals over all files, from one pass.

    What is collected is a page's worth of file entries at most.
    """
    entry = F.struct("file_key", *(c for c in spans.columns if c != "file_key"))
    row = spans.agg(
        F.array_sort(F.collect_list(F.when(wanted, entry))).alias("found"),
        F.sum("n_rows").alias("rows"),
        F.sum("n_matched").alias("matched"),
    ).first()
    return row["found"], int(row["rows"] or 0), int(row["matched"] or 0)


def _shape(df: DataFrame, flag: str) -> DataFrame:
    """Display columns, the match state under its public name, the row number; in order."""
    has_flag = flag in df.columns
    matched = F.coalesce(ref(flag), F.lit(False)) if has_flag else F.lit(False)
    names = [c for c in df.columns if c not in (flag, PLACE, ROW_NUMBER)]
    return df.select(
        *(ref(c) for c in names), matched.alias(FLAG), ref(ROW_NUMBER)
    ).orderBy(ROW_NUMBER)


def read_page(
    spark: SparkSession,
    path: str,
    page: int = 1,
    page_size: int = DEFAULT_PAGE_SIZE,
    matched_only: bool = False,
    *,
    total_all: int | None = None,
    matched_total: int | None = None,
    index_path: str | None = None,
    flag: str = FLAG,
) -> Page:
    """One page of a result. Row numbers always count the FULL result.

    Counts already known (from the run's stats) can be passed in; note that they
    must be counts of the written rows. A page holds at most ``MAX_PAGE_SIZE`` rows.
    Without an index, or with one of a table that was replaced since, every file's footer is read for the row totals.
    """
    page = max(1, page)
    page_size = max(1, min(page_size, MAX_PAGE_SIZE))
    offset = (page - 1) * page_size
    table = open_result(spark, path)
    columns = table.columns
    has_flag = flag in columns
    filtered = matched_only and has_flag
    spans = table_spans(spark, path, index_path, flag, table)

    if filtered:
        wanted = (
            (F.col("n_matched") > 0)
            & (F.col("matched_before") < offset + page_size)
            & (F.col("matched_before") + F.col("n_matched") > offset)
        )
    else:
        wanted = _between(offset + 1, offset + page_size)
    found, all_rows, all_matched = _locate(spans, wanted)
    total_all = all_rows if total_all is None else total_all
    matched_total = all_matched if matched_total is None else matched_total

    if filtered:
        rows = _matched_rows(spark, path, found, offset, page_size, flag)
    else:
        rows = rows_of(spark, path, found, offset + 1, offset + page_size)
    total = matched_total if filtered else total_all
    return Page(
        rows=_shape(rows, flag),
        columns=[c for c in columns if c not in (flag, PLACE)],
        total=total,
        total_all=total_all,
        matched_total=matched_total,
        has_match_flag=has_flag,
        matched_only=filtered,
        page=page,
        page_size=page_size,
        num_pages=page_count(total, page_size),
    )


def _matched_rows(
    spark: SparkSession, path: str, found: list, offset: int, size: int, flag: str
) -> DataFrame:
    """Selected rows ``offset``..``offset + size`` with their numbers in the full table."""
    if not found:
        return rows_of(spark, path, [], 0, 0)
    low = found[0]["rows_before"] + 1
    high = found[-1]["rows_before"] + found[-1]["n_rows"]
    candidates = rows_of(spark, path, found, low, high).filter(ref(flag))
    # Where the page starts and ends, from the row numbers alone.
    ends = (
        candidates.select(ROW_NUMBER)
        .orderBy(ROW_NUMBER)
        .offset(offset - found[0]["matched_before"])
        .limit(size)
        .agg(F.min(ROW_NUMBER), F.max(ROW_NUMBER))
        .first()
    )
    return candidates.filter(F.col(ROW_NUMBER).between(ends[0], ends[1]))


def jump_to_row(
    spark: SparkSession,
    path: str,
    row: int,
    page_size: int = JUMP_PAGE_SIZE,
    *,
    total_all: int | None = None,
    index_path: str | None = None,
    flag: str = FLAG,
) -> tuple[Page, int]:
    """The page holding ``row`` (clamped to the table) and the row's index on it."""
    if total_all is None:
        if index_path:
            total_all = table_spans(spark, path, index_path, flag).agg(F.sum("n_rows")).first()[0] or 0
        else:
            total_all = open_result(spark, path).count()
    _, page, index = jump_target(row, total_all, page_size)
    found = read_page(
        spark, path, page, page_size, total_all=total_all, index_path=index_path, flag=flag
    )
    return found, index


def read_window(
    spark: SparkSession,
    path: str,
    cursor: int | None = None,
    limit: int = WINDOW_SIZE,
    *,
    index_path: str | None = None,
) -> RowWindow:
    """The next rows after ``cursor`` (the last row number seen), null cells as empty text.

    Follow the returned cursor until ``eof``; no count of the table is needed. A window holds at
    most ``MAX_PAGE_SIZE`` rows whatever ``limit`` says: the cursor says where it ended.
    """
    if cursor is not None and (not isinstance(cursor, int) or cursor < 0):
        raise ValueError("cursor must be a row number returned by an earlier window")
    limit = max(1, min(limit, MAX_PAGE_SIZE))
    start = cursor or 0
    spans = table_spans(spark, path, index_path, FLAG)
    rows = rows_between(spark, path, spans, start + 1, start + limit)
    more = spans.filter(F.col("rows_before") + F.col("n_rows") > start + limit).limit(1).count()
    shown = rows.select(
        *(
            F.coalesce(ref(c).cast("string"), F.lit("")).alias(c)
            for c in rows.columns
            if c not in (PLACE, ROW_NUMBER)
        ),
        ROW_NUMBER,
    ).orderBy(ROW_NUMBER)
    return RowWindow(shown, eof=not more, cursor=start + limit if more else None)


def inspect_row(
    spark: SparkSession,
    path: str,
    row: int,
    kinds: dict[str, str],
    *,
    index_path: str | None = None,
    flag: str = FLAG,
) -> DataFrame:
    """One row stood on end: ``(pos, column, kind, value)`` with every value in full."""
    found = rows_between(spark, path, table_spans(spark, path, index_path, flag), row, row)
    names = [c for c in found.columns if c not in (flag, PLACE, ROW_NUMBER)]
    return found.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(i + 1).alias("pos"),
                        F.lit(c).alias("column"),
                        F.lit(kinds.get(c, "Text")).alias("kind"),
                        F.coalesce(ref(c).cast("string"), F.lit("")).alias("value"),
                    )
                    for i, c in enumerate(names)
                )
            )
        )
    )


def page_counts(df: DataFrame, page_size: int = DEFAULT_PAGE_SIZE, flag: str = FLAG) -> DataFrame:
    """Totals with the number of pages of the full and of the selected-only view."""

    def pages(rows: str):
        return F.greatest(F.lit(1), F.ceil(F.col(rows) / page_size)).cast("long")

    return result_totals(df, flag).select(
        "*", pages("total_rows").alias("num_pages"), pages("matched_rows").alias("matched_pages")
    )
