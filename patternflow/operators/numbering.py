"""Stable row numbers for written tables, without a global sort.

A row's number is its position in (file, row in file) order. Parquet readers
expose both parts as metadata, so numbering needs only a running total of rows
per FILE: one small aggregate over the footers. Rows themselves never move.

A table that carries the places its rows were read from (``PLACE``) is numbered in their order. A task writes
the rows of one stretch of a source one after the other, so there the totals are per (file, stretch).
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternflow.functions.columns import ref
from patternflow.model import FLAG, PLACE, ROW_NUMBER
from patternflow.operators.results import open_result
from patternflow.session import scratch_path

FILE = "__file"
# The stretch's place, empty in tables that carry none.
STRETCH = "__stretch"

# One broadcast carries at most this many file offsets (some 50 MB); a table of
# more files is numbered in several branches, each reading only its own files.
FILES_PER_BROADCAST = 200_000
# Offsets of this many files (about 2 MB) are simply fetched, to be worked out once.
FILES_FETCHED = 10_000

# A range of ``write_ordered`` holds about this many bytes of cells.
RANGE_BYTES = 1 << 26

_TASK_DIGITS = 18
_PIECE_DIGITS = 9
# Leading digits of the task number shared by the files one task sums up:
# a thousand writer tasks at a time.
_GROUP_DIGITS = _TASK_DIGITS - 3


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)[^/]*$", 1)


def file_order(path: Column) -> Column:
    """A string that sorts files by folder, then writer task, then piece, then name.

    Plain name order goes wrong past 100,000 part files, where the task number
    outgrows its five digits; below that the two orders agree.
    """
    name = F.element_at(F.split(path, "/"), -1)
    task = F.regexp_extract(name, r"^part-(\d{1,18})", 1)
    piece = F.regexp_extract(name, r"[.-]c(\d{1,9})\.", 1)
    return F.concat(
        _folder(path),
        F.lpad(task, _TASK_DIGITS, "0"),
        F.lpad(piece, _PIECE_DIGITS, "0"),
        F.lit("/"),
        name,
    )


def place_order(place: Column) -> Column:
    """A string that sorts places: the file as :func:`file_order` has it, then the stretches."""
    return F.concat(file_order(F.substring_index(place, "\n", 1)), F.regexp_extract(place, r"\n.*$", 0))


def file_spans(spark: SparkSession, path: str, flag: str = FLAG) -> DataFrame:
    """One row per file, or per stretch in it: rows and selected rows in it, and how many come before it.

    Columns: ``__file, __stretch, first_row, file_key, file_no, n_rows, n_matched, rows_before,
    matched_before``, where ``first_row`` counts from 0 within the file. Without a flag column nothing counts as
    selected and only footers are read; with one, that column alone is read besides, and the places if there are any.
    """
    table = open_result(spark, path)
    matched = F.count_if(ref(flag)) if flag in table.columns else F.lit(0).cast("long")
    placed = PLACE in table.columns
    first_row = F.min("_metadata.row_index") if placed else F.lit(0).cast("long")
    file_key, leader = file_order(F.col(FILE)), F.col(FILE)
    if placed:
        file_key, leader = F.concat(place_order(F.col(STRETCH)), F.lit("\n"), file_key), F.substring_index(STRETCH, "\n", 1)
    per_file = (
        table.groupBy(F.col("_metadata.file_path").alias(FILE), stretch_of(table).alias(STRETCH))
        .agg(F.count(F.lit(1)).alias("n_rows"), matched.alias("n_matched"), first_row.alias("first_row"))
        .withColumn("file_key", file_key)
        .withColumn(
            "grp", F.substring("file_key", F.lit(1), F.length(_folder(leader)) + _GROUP_DIGITS)
        )
        # Never null, said so: the self-join below then reuses this aggregate as it is.
        .withColumn("grp", F.coalesce("grp", F.lit("")))
    )
    return _running_totals(per_file)


def stretch_of(table: DataFrame) -> Column:
    return F.coalesce(ref(PLACE), F.lit("")) if PLACE in table.columns else F.lit("")


def _running_totals(per_file: DataFrame) -> DataFrame:
    """Exclusive prefix sums in ``file_key`` order, in two levels.

    Totals of file groups (about a thousandth of the files) go through one
    ordered window; within a group each task sums its own files. All of this is
    one short row per FILE, never a row of the table.
    """
    sums = {"file_no": F.lit(1), "rows_before": F.col("n_rows"), "matched_before": F.col("n_matched")}

    def before(value: Column, window) -> Column:
        return F.coalesce(F.sum(value).over(window), F.lit(0)).cast("long")

    across = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = (
        per_file.groupBy("grp")
        .agg(*(F.sum(v).alias("g_" + k) for k, v in sums.items()))
        .select("grp", *(before(F.col("g_" + k), across).alias("g_" + k) for k in sums))
    )
    within = Window.partitionBy("grp").orderBy("file_key").rowsBetween(
        Window.unboundedPreceding, -1
    )
    local = per_file.select("*", *(before(v, within).alias("l_" + k) for k, v in sums.items()))
    return local.join(groups, "grp").select(
        FILE,
        STRETCH,
        "first_row",
        "file_key",
        "n_rows",
        "n_matched",
        *((F.col("l_" + k) + F.col("g_" + k)).alias(k) for k in sums),
    )


def with_row_numbers(
    spark: SparkSession,
    path: str,
    *,
    column: str = ROW_NUMBER,
    spans: DataFrame | None = None,
    files_per_broadcast: int = FILES_PER_BROADCAST,
    files_fetched: int = FILES_FETCHED,
) -> DataFrame:
    """The table at ``path`` plus each row's 1-based number, filter-independent.

    The file offsets are broadcast in slices of at most ``files_per_broadcast``
    files, so the broadcast stays bounded however large the table gets. Offsets of
    more than ``files_fetched`` files are worked out once, into the scratch folder.
    """
    table = open_result(spark, path)
    spans = file_spans(spark, path) if spans is None else spans
    few = spans.limit(files_fetched + 1).collect()
    if few and len(few) <= files_fetched:
        spans, n_files = spark.createDataFrame(few, spans.schema), len(few)
    else:
        once = scratch_path(spark, "spans")
        spans.write.parquet(once)
        spans = spark.read.schema(spans.schema).parquet(once)
        n_files = spans.count()
    rows = table.select(
        "*",
        F.col("_metadata.file_path").alias(FILE),
        stretch_of(table).alias(STRETCH),
        F.col("_metadata.row_index").alias("__file_row"),
    )
    keys = [FILE, STRETCH] if PLACE in table.columns else [FILE]

    def number(part: DataFrame, offsets: DataFrame) -> DataFrame:
        offsets = offsets.select(*keys, (F.col("rows_before") - F.col("first_row")).alias("__offset"))
        return part.join(F.broadcast(offsets), keys).select(
            *(ref(c) for c in table.columns if c != PLACE),
            (F.col("__offset") + F.col("__file_row") + 1).alias(column),
        )

    if n_files <= files_per_broadcast:
        return number(rows, spans)
    branches = []
    if PLACE in table.columns:
        # Stretches in order lie all over the files, so files are dealt to branches by their names.
        slices = -(-n_files // files_per_broadcast)
        for i in range(slices):
            own = F.pmod(F.xxhash64(FILE), F.lit(slices)) == i
            branches.append(number(rows.filter(own), spans.filter(own)))
        return reduce(DataFrame.unionByName, branches)
    for first in range(0, n_files, files_per_broadcast):
        piece = spans.filter(F.col("file_no").between(first, first + files_per_broadcast - 1))
        low, high = piece.agg(F.min("file_key"), F.max("file_key")).first()
        # A filter on file metadata alone is applied while listing files.
        own = rows.filter(file_order(F.col(FILE)).between(F.lit(low), F.lit(high)))
        branches.append(number(own, piece))
    return reduce(DataFrame.unionByName, branches)


def _bytes_held(df: DataFrame) -> int:
    """About how many bytes the cells of ``df`` have; file sizes don't tell, as repeats hardly count there."""

    def size(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.octet_length(ref(field.name))
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.octet_length(ref(field.name).cast("string"))
        return F.lit(8)

    row = reduce(add, (F.coalesce(size(f), F.lit(0)).cast("long") for f in df.schema.fields), F.lit(0).cast("long"))
    return df.agg(F.sum(row)).first()[0] or 0


def write_ordered(
    df: DataFrame, order_by: list[str], path: str, partitions: int | None = None
) -> str:
    """Write ``df`` so that file order is ``order_by`` order, ready for numbering.

    Rows are range-partitioned on the keys AND their place in the input, so a
    run of equal keys, however long, is cut across tasks and keeps its order. ``partitions`` says into how many
    ranges at least: a large input gets more, so that no task's share grows with it.
    """
    if partitions:
        partitions = max(partitions, -(-_bytes_held(df) // RANGE_BYTES))
    keys = [ref(c) for c in order_by] + [F.col("__place")]
    placed = df.withColumn("__place", F.monotonically_increasing_id())
    ranged = (
        placed.repartitionByRange(partitions, *keys)
        if partitions
        else placed.repartitionByRange(*keys)
    )
    ranged.sortWithinPartitions(*keys).drop("__place").write.mode("overwrite").parquet(path)
    return path
