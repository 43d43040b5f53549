"""Applying a rule to files as they arrive in a folder.

Same stateless expressions as a batch run, so no watermark and no state; the
checkpoint and the file sink together process each file exactly once.

:func:`run_rule_drops` goes by batches of files: each is read as its files allow, written to a folder of its own and recorded
as a run. A batch that is worked on again after a failure writes the same folder and leaves one record.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from patternflow.model import Rule
from patternflow.operators.rules import apply_rule
from patternflow.plans import runs
from patternflow.plans.runs import check_rule
from patternflow.sources.order import with_places
from patternflow.sources.readers import DifferentHeadersError, read_csv

COUNTS = "rule_counts"
#: The folder of a batch's result below the destination, and the column that tells it when all are read.
BATCH = "__batch__"
FILES_PER_BATCH = 1000


def read_drops(
    spark: SparkSession,
    folder: str,
    columns: list[str],
    *,
    multi_line: bool = True,
    files_per_batch: int | None = None,
) -> DataFrame:
    """CSV files dropped into ``folder``, all cells strings.

    Quoted line breaks are allowed for by default: arriving files cannot be
    checked ahead, and files of a drop are read in parallel anyway. A file whose
    header differs from ``columns`` stops the query rather than shifting cells.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.readStream.schema(schema).options(
        header=True, multiLine=multi_line, escape='"', enforceSchema=False
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(folder)


def apply_rule_stream(
    stream: DataFrame,
    rule: Rule,
    dest: str,
    checkpoint: str,
    *,
    drain: bool = True,
) -> StreamingQuery:
    """Start writing flagged (and edited or filtered) rows to Parquet under ``dest``.

    ``drain`` works off what has arrived and stops; otherwise the query keeps
    watching. Input counts of every batch travel in its progress report.
    """
    check_rule(rule)
    out = apply_rule(stream, rule, observe=COUNTS)
    writer = (
        out.writeStream.format("parquet")
        .outputMode("append")
        .option("path", dest)
        .option("checkpointLocation", checkpoint)
    )
    if drain:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def run_rule_drops(
    spark: SparkSession,
    folder: str,
    columns: list[str],
    rule: Rule,
    dest: str,
    checkpoint: str,
    runs_path: str,
    *,
    stream_id: str,
    files_per_batch: int = FILES_PER_BATCH,
    drain: bool = True,
) -> StreamingQuery:
    """Start running ``rule`` over the CSV files dropped into ``folder``, batch by batch, with a run record for each.

    The stream carries file names only; a batch holds at most ``files_per_batch`` of them. Its files are checked and cut as
    :func:`~patternflow.sources.readers.read_csv` does it, each file by itself. Results go to ``dest`` (a folder ``BATCH`` each), records to
    ``runs_path`` under the run identifier ``stream_id/batch``. A failed batch stops the query and is not recorded; started again
    from the same checkpoint it is worked on anew. A file whose header differs from ``columns`` is such a failure.
    """
    check_rule(rule)
    rule.check_columns(columns)
    schema = "path string, modificationTime timestamp, length long, content binary"
    names = (
        spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)
        .select("path")  # contents are not read
    )

    def one_batch(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        started = datetime.now(timezone.utc)
        files = sorted(r["path"] for r in batch.collect())
        df = read_csv(session, files)
        if df.columns != columns:
            raise DifferentHeadersError(f"Files of batch {number} have the header {df.columns}, not {columns}")
        df = with_places(df)
        counts = Observation(f"{stream_id}-{number}-{started.timestamp()}")
        result = f"{dest.rstrip('/')}/{BATCH}={number}"
        apply_rule(df, rule, observe=counts).write.mode("overwrite").parquet(result)
        run_id = f"{stream_id}/{number}"
        if not runs.is_recorded(session, runs_path, run_id):
            total, matched = (int(counts.get.get(k) or 0) for k in ("total_rows", "matched_rows"))
            stats = runs.stats_of(run_id, rule, total, matched, df, result)
            seconds = (datetime.now(timezone.utc) - started).total_seconds()
            runs.record_runs(session, runs_path, [runs.run_row(run_id, folder, f"{len(files)} files", rule, stats, None, started, seconds)])

    writer = names.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    if drain:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def dropped_results(spark: SparkSession, dest: str) -> DataFrame:
    """The results of all batches with the batch's number in ``BATCH``."""
    return spark.read.option("basePath", dest).option("mergeSchema", True).parquet(dest).withColumn(BATCH, F.col(BATCH).cast("long"))


class StreamCounts(StreamingQueryListener):
    """Adds up the input counts of all batches seen since it was registered."""

    def __init__(self):
        self.total_rows = 0
        self.matched_rows = 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        seen = event.progress.observedMetrics.get(COUNTS)
        if seen is not None:
            self.total_rows += seen["total_rows"]
            self.matched_rows += seen["matched_rows"]

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
