"""How the files of a CSV table can be read, file by file, and reading those whose cells span lines in stretches.

Most files are *plain*: no quoted cell spans lines, and Spark may cut them at any line. In a *spanning* file a stretch may
start inside a cell. Whether it does follows from the number of quotes before it: a stretch changes the state if it
holds an odd number of them, so one bit per stretch, added up over the stretches before, tells the state every stretch starts
in. From there its lines fall into records by counting on, and a record that ends in a later stretch is put
together where it began. What does not follow that grammar, such as a lone quote in the middle of a cell, is left to
Spark's own reader, in one task for that file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternflow.model import PLACE
from patternflow.sources.order import place

#: A quoted cell that is complete within its line, once doubled quotes are gone.
_COMPLETE = r'(^|,)"[^"]*"(?=,|$)'
#: What is left of a line that ends within a quoted cell.
_OPEN_AT_END = r'^([^"]*,)?"[^"]*$'


@dataclass(frozen=True)
class CsvLayout:
    """Verdicts on the files at ``path``; those that are neither spanning nor to be read whole are plain.

    ``crlf`` names the spanning files whose lines end with a carriage return, which such files don't keep within cells either.
    """

    path: str
    spanning: tuple[str, ...] = ()
    whole: tuple[str, ...] = ()
    crlf: tuple[str, ...] = ()

    @property
    def odd(self) -> tuple[str, ...]:
        return self.spanning + self.whole


def _left_over(line: Column) -> Column:
    """``line`` without doubled quotes and complete quoted cells."""
    return F.regexp_replace(F.replace(line, F.lit('""'), F.lit("")), _COMPLETE, "$1")


def leaves_no_cell_open(line: Column) -> Column:
    """Whether a line that starts outside cells ends outside them, with quotes around whole cells only."""
    return ~line.contains('"') | ~_left_over(line).contains('"')


def inspect_csv(spark: SparkSession, path: str, cut_above: int | None = None) -> CsvLayout:
    """The verdict on each file, from one parallel pass over all lines and a second one over the odd files' lines.

    An odd file of up to ``cut_above`` bytes, by default what Spark reads in one task, is left whole without
    another look. Only file names reach the driver, which holds them for the listing anyway.
    """
    if cut_above is None:
        cut_above = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    odd = lines.filter(~leaves_no_cell_open(F.col("value"))).select("file", "size")
    if len(lines.inputFiles()) == 1:
        odd = odd.take(1)  # one line settles it
    else:
        odd = odd.distinct().collect()
    large = sorted(r["file"] for r in odd if r["size"] > cut_above)
    found = _verdicts(_quoted_lines(spark, large)).collect() if large else []
    whole = {r["file"] for r in found if r["unclear"]} | {r["file"] for r in odd if r["size"] <= cut_above}
    crlf = tuple(sorted(r["file"] for r in found if r["crlf"] and not r["unclear"]))
    return CsvLayout(path, tuple(f for f in large if f not in whole), tuple(sorted(whole)), crlf)


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """file, start, id, line: cut at line feeds only, as a carriage return may be part of a cell."""
    text = spark.read.option("lineSep", "\n").text(files)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("id"),
        F.col("value").alias("line"),
    )


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _quoted_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """The lines that may matter for the verdict; a file's first line always does."""
    lines = _lines(spark, files)
    ids = lines.filter("start = 0").groupBy("file").agg(F.min("id").alias("head"))
    lines = lines.filter(F.col("line").contains('"') | F.col("line").contains("\r") | (F.col("start") == 0))
    return lines.join(ids, "file", "left")


def _states(lines: DataFrame) -> DataFrame:
    """``lines`` with ``inside``: whether a line starts within a cell.

    Within a stretch by a running count of quotes; the state it starts in from one number per stretch.
    """
    stretch = Window.partitionBy("file", "start").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    odd = _quotes(F.col("line")) % 2
    counted = lines.withColumn("before", F.coalesce(F.sum(odd).over(stretch), F.lit(0)))
    per_stretch = lines.groupBy("file", "start").agg((F.sum(odd) % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    first = per_stretch.select("file", "start", F.coalesce(F.sum("odd").over(earlier), F.lit(0)).alias("first"))
    return counted.join(first, ["file", "start"]).withColumn("inside", (F.col("first") + F.col("before")) % 2 == 1)


def _verdicts(lines: DataFrame) -> DataFrame:
    """file, unclear, crlf.

    Unclear are files with a line that the counting of quotes might get wrong, a header that spans lines, or
    a cell that is never closed.
    """
    stated = _states(lines)
    line = F.regexp_replace("line", "\r$", "")
    plain = F.replace(line, F.lit('""'), F.lit(""))
    # A line within a cell reads like one that opens the cell itself.
    left = _left_over(F.when(F.col("inside"), F.concat(F.lit('"'), plain)).otherwise(plain))
    clear = (~left.contains('"') | left.rlike(_OPEN_AT_END)) & ~line.contains("\r")
    head, quotes = F.coalesce(F.col("id") == F.col("head"), F.lit(False)), _quotes(F.col("line"))
    odd_line = ~clear | (head & (quotes % 2 == 1))
    return stated.groupBy("file").agg(
        (F.max(odd_line) | (F.sum(quotes) % 2 == 1)).alias("unclear"),
        F.max(head & F.col("line").endswith("\r")).alias("crlf"),
    )


def read_spanning(spark: SparkSession, layout: CsvLayout, schema: T.StructType) -> DataFrame:
    """The rows of spanning files, with their places, cut into stretches like any other file.

    The lines of these files are shuffled by stretch and once more by the stretch their record began in, so a
    task holds some stretches, in order. A single record is held whole.
    """
    lines = _lines(spark, list(layout.spanning))
    if layout.crlf:
        bare = F.when(F.col("file").isin(list(layout.crlf)), F.regexp_replace("line", "\r$", "")).otherwise(F.col("line"))
        lines = lines.withColumn("line", bare)
    stated = _states(lines).withColumn("opens", (~F.col("inside")).cast("long"))
    upto = Window.partitionBy("file", "start").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    numbered = stated.withColumn("record", F.sum("opens").over(upto))
    # Lines before a stretch's first record continue the last record of the nearest stretch before that has one.
    per_stretch = stated.groupBy("file", "start").agg(F.sum("opens").alias("records"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("records") > 0, F.struct("start", "records")), ignorenulls=True).over(earlier)
    owners = per_stretch.select("file", "start", last.alias("last"))
    own = numbered.join(owners, ["file", "start"]).select(
        "file",
        F.when(F.col("record") > 0, F.col("start")).otherwise(F.col("last.start")).alias("owner"),
        F.when(F.col("record") > 0, F.col("record")).otherwise(F.col("last.records")).alias("record"),
        F.struct("start", "id", "line").alias("part"),
    )
    records = (
        own.repartition("file", "owner")
        .groupBy("file", "owner", "record")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["line"]), "\n").alias("text"))
        .sortWithinPartitions("file", "owner", "record")
    )
    header = (F.col("owner") == 0) & (F.col("record") == 1)
    text = F.regexp_replace("text", "\r$", "")
    rows = records.filter(~header).withColumn("text", text).filter("text <> ''")
    names = [f"c{i}" for i in range(len(schema.fields))]
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, schema.fields, strict=True))
    cells = F.from_csv("text", kinds, {"escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
    parsed = rows.select(cells.alias("cells"), place(F.col("owner"), F.col("file")).alias(PLACE))
    return parsed.select(*(F.col("cells")[n].alias(f.name) for n, f in zip(names, schema.fields, strict=True)), PLACE)
