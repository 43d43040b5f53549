"""Column samples and column kinds of a numbered table.

Both need "the first k per column" under some visiting order. An early slice
of the order (a bounded number of rows) answers most columns; only columns it
leaves short are worked out over the whole table, where the ranking is cut to k
per task before it is settled.

Of a written table (:func:`sample_table`, :func:`table_kinds`) the early slice is found by position: the per-file totals tell
which files hold the wanted rows, and no other file is opened.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patternflow.functions.columns import ref, strip
from patternflow.model import FLAG, PLACE, ROW_NUMBER, MissingColumnsError
from patternflow.operators.numbering import with_row_numbers
from patternflow.operators.paging import rows_between, rows_of, table_spans
from patternflow.operators.results import open_result

# Defaults of the sampler: values per column, characters per value.
PER_COLUMN = 10
MAX_LEN = 80
# Passes over the table's strides, and leading rows, tried before the full scan.
EARLY_PASSES = 8
EARLY_ROWS = 1000
KIND_SAMPLE = 8
# Spark itself cuts a ranking before the shuffle for up to this many rows a group; above, parts of a group are ranked first.
CUT_BY_SPARK, PARTS = 1000, 64

# Value shapes and titles of the column kinds.
EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
URL_SHAPE = r"(?i)^https?://|^www\."
NUMBER_SHAPE = r"^-?\$?\d[\d,]*\.?\d*%?$"
DATE_SHAPE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}|^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"
EMAIL, URL, DATE_TIME = "Email", "URL", "Date / time"
IDENTIFIER, NUMBER, TEXT = "Identifier / number", "Number", "Text"


def _cells(df: DataFrame, columns: list[str], order: Column, max_len: int | None) -> DataFrame:
    """Non-blank cells in long form: ``(column, rank, value)``."""

    def value(c: str) -> Column:
        text = strip(ref(c).cast("string"))
        return F.substring(text, 1, max_len) if max_len else text

    cells = F.array(*(F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns))
    return df.select(order.alias("rank"), F.inline(cells)).filter(F.col("value") != "")


def _first_k(ranked: DataFrame, k: int) -> DataFrame:
    """The k lowest ranks per column with their 1-based position."""
    if k > CUT_BY_SPARK:
        part = Window.partitionBy("column", F.pmod(F.xxhash64("rank"), F.lit(PARTS))).orderBy("rank")
        ranked = ranked.withColumn("pos", F.row_number().over(part)).filter(F.col("pos") <= k).drop("pos")
    w = Window.partitionBy("column").orderBy("rank")
    return ranked.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def _early_then_rest(columns: list[str], k: int, early: DataFrame, whole) -> DataFrame:
    """``early`` for the columns it fills up to k values, ``whole(columns)`` for the others.

    The early answer is k small rows per column, so it is fetched and not worked
    out a second time.
    """
    found = early.collect()
    counts = Counter(r["column"] for r in found)
    rest = [c for c in columns if counts[c] < k]
    kept = [r for r in found if counts[r["column"]] >= k]
    if not kept:
        return whole(rest)
    done = early.sparkSession.createDataFrame(kept, early.schema)
    return done.unionByName(whole(rest)) if rest else done


def _require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumnsError(missing)


def sample_values(
    df: DataFrame,
    columns: Iterable[str],
    per_column: int = PER_COLUMN,
    max_len: int = MAX_LEN,
    *,
    total: int | None = None,
    row_number: str = ROW_NUMBER,
) -> DataFrame:
    """Distinct non-blank values of each column, spread across the table.

    Rows are visited every ``total // per_column`` apart, then the rows one
    later, and so on; a value counts when first met. Returns ``(column, pos,
    value)``; a column without values has no rows. ``df`` carries 1-based row
    numbers (see :func:`~patternflow.operators.numbering.with_row_numbers`).
    """
    columns = list(columns)
    _require(df, columns)
    if total is None:
        total = df.count()
    k = max(0, per_column)
    stride = max(1, total // k) if k else 1
    lap = (F.col(row_number) - 1) % stride

    def whole(names: list[str]) -> DataFrame:
        return _distinct_first(df, names, stride, k, max_len, row_number)

    if not k or stride <= EARLY_PASSES:
        return whole(columns)
    # At most EARLY_PASSES * 2k rows: the first laps visit every stride-th row.
    early = _distinct_first(df.filter(lap < EARLY_PASSES), columns, stride, k, max_len, row_number)
    return _early_then_rest(columns, k, early, whole)


def _distinct_first(df: DataFrame, names: list[str], stride: int, k: int, max_len: int, row_number: str) -> DataFrame:
    """The k values of each column that are met first when rows are visited lap by lap."""
    index = F.col(row_number) - 1
    rank = F.struct((index % stride).alias("lap"), index.alias("i"))
    first_met = _cells(df, names, rank, max_len).groupBy("column", "value").agg(F.min("rank").alias("rank"))
    return _first_k(first_met, k).select("column", "pos", "value")


def sample_table(
    spark: SparkSession,
    path: str,
    columns: Iterable[str],
    per_column: int = PER_COLUMN,
    max_len: int = MAX_LEN,
    *,
    index_path: str | None = None,
) -> DataFrame:
    """:func:`sample_values` of the written table at ``path``, which needs no pass over it.

    The total comes from the per-file totals (of ``index_path``, or else the footers), and the early laps
    from the files that they visit: at most one for each of their rows. Columns that these leave short
    are worked out over the whole table, as far as that goes.
    """
    columns = list(columns)
    table = open_result(spark, path)
    _require(table, columns)
    spans = table_spans(spark, path, index_path, FLAG, table)
    total = int(spans.agg(F.sum("n_rows")).first()[0] or 0)
    k = max(0, per_column)
    stride = max(1, total // k) if k else 1

    def whole(names: list[str]) -> DataFrame:
        return _distinct_first(with_row_numbers(spark, path, spans=spans), names, stride, k, max_len, ROW_NUMBER)

    if not k or stride <= EARLY_PASSES:
        return whole(columns)
    first = F.col("rows_before")
    into = first % stride
    # The first row of a file, counted from 0, that an early lap visits.
    visited = F.when(into < EARLY_PASSES, first).otherwise(first + stride - into)
    found = spans.filter(visited < first + F.col("n_rows")).collect()  # a file for each visited row at most
    rows = rows_of(spark, path, found, 1, total).filter((F.col(ROW_NUMBER) - 1) % stride < EARLY_PASSES)
    early = _distinct_first(rows, columns, stride, k, max_len, ROW_NUMBER)
    return _early_then_rest(columns, k, early, whole)


def samples_map(samples: DataFrame) -> DataFrame:
    """Samples as one row holding ``{column: [values in order]}``."""
    per_column = samples.groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"])
        .alias("values")
    )
    return per_column.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "values")))).alias("samples")
    )


def column_kinds(
    df: DataFrame, columns: Iterable[str] | None = None, *, row_number: str = ROW_NUMBER
) -> DataFrame:
    """``(column, kind)`` from each column's name and its first 8 non-blank values."""
    columns = [c for c in df.columns if c != row_number] if columns is None else list(columns)
    _require(df, columns)
    early = _heads(df.filter(F.col(row_number) <= EARLY_ROWS), columns, row_number)
    return _kinds(columns, _early_then_rest(columns, KIND_SAMPLE, early, lambda names: _heads(df, names, row_number)))


def table_kinds(
    spark: SparkSession, path: str, columns: Iterable[str] | None = None, *, index_path: str | None = None
) -> DataFrame:
    """:func:`column_kinds` of the written table at ``path``, from the files that hold its first rows.

    Columns that are mostly blank there are looked up in the whole table.
    """
    table = open_result(spark, path)
    columns = [c for c in table.columns if c not in (FLAG, PLACE)] if columns is None else list(columns)
    _require(table, columns)
    spans = table_spans(spark, path, index_path, FLAG, table)
    early = _heads(rows_between(spark, path, spans, 1, EARLY_ROWS), columns, ROW_NUMBER)

    def whole(names: list[str]) -> DataFrame:
        return _heads(with_row_numbers(spark, path, spans=spans), names, ROW_NUMBER)

    return _kinds(columns, _early_then_rest(columns, KIND_SAMPLE, early, whole))


_SHAPES = {"email": EMAIL_SHAPE, "url": URL_SHAPE, "date": DATE_SHAPE, "number": NUMBER_SHAPE}


def _heads(df: DataFrame, names: list[str], row_number: str) -> DataFrame:
    """Which shapes the first non-blank values of each column have."""
    first = _first_k(_cells(df, names, F.col(row_number), None), KIND_SAMPLE)
    return first.select("column", "pos", *(F.col("value").rlike(p).alias(n) for n, p in _SHAPES.items()))


def _kinds(columns: list[str], values: DataFrame) -> DataFrame:
    shapes = _SHAPES
    shaped = values.groupBy("column").agg(*(F.every(n).alias(n) for n in shapes))
    # One row per column even if it holds no value; both sides have one row per column.
    names = values.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, columns))).alias("column"))
    found = names.join(shaped, "column", "left")
    low = F.lower("column")
    all_match = {n: F.coalesce(F.col(n), F.lit(False)) for n in shapes}
    return found.select(
        "column",
        F.when(low.contains("email") | all_match["email"], EMAIL)
        .when(low.contains("url") | low.contains("link") | all_match["url"], URL)
        .when(
            low.contains("date") | low.contains("time") | low.endswith("_at") | all_match["date"],
            DATE_TIME,
        )
        .when((low == "id") | low.endswith("_id") | low.contains("phone"), IDENTIFIER)
        .when(all_match["number"], NUMBER)
        .otherwise(TEXT)
        .alias("kind"),
    )
