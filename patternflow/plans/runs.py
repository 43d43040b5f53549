"""Runs: read, check, apply, write, record."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternflow.functions.columns import ref
from patternflow.model import PLACE, Rule, RuleError
from patternflow.operators.paging import write_page_index
from patternflow.operators.results import begin_version, finish_version, has_new_files
from patternflow.operators.rules import RULE, apply_rule, apply_rules_at_once, edited_columns
from patternflow.plans.lint import check_pattern
from patternflow.plans.prompts import rule_from_prompt
from patternflow.plans.requests import resolve_with_reuse
from patternflow.sources.order import with_places
from patternflow.sources.readers import read_table
from patternflow.sources.writers import replace_result

PAGE_SIZE = 50
MAX_PAGE_SIZE = 500
#: Results written by one job of :func:`run_rules`; a task holds a row group of each in memory.
RULES_AT_ONCE = 32
_ROW_GROUP, _LEAST_ROW_GROUP = 128 << 20, 16 << 20
_GROUP_PROPERTIES = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")

RUNS_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("request", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("combinator", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField(
            "predicates",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("column", T.StringType()),
                        T.StructField("pattern", T.StringType()),
                        T.StructField("explanation", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("total_rows", T.LongType()),
        T.StructField("matched_rows", T.LongType()),
        T.StructField("output_rows", T.LongType()),
        T.StructField("result_columns", T.ArrayType(T.StringType())),
        T.StructField("result_path", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("seconds", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class RunStats:
    """``total_rows`` and ``matched_rows`` describe the input, ``output_rows`` the result."""

    run_id: str
    total_rows: int
    matched_rows: int
    output_rows: int
    columns: list[str]
    result_path: str


class UnsafePatternError(RuleError):
    pass


def check_rule(rule: Rule) -> None:
    for p in rule.predicates:
        reason = check_pattern(p.pattern)
        if reason:
            raise UnsafePatternError(f"{p.column}: {reason}")


def run_rule(
    spark: SparkSession,
    source: str | DataFrame,
    rule: Rule,
    dest: str,
    *,
    run_id: str | None = None,
    runs_path: str | None = None,
    index_path: str | None = None,
    dataset: str | None = None,
    request: str = "",
    keep_order: bool = True,
    **read_options,
) -> RunStats:
    """Apply a rule to a table and write the result, reading the source once.

    Rows keep their order, so a row has the same number in source and result: the result of a source of
    several files carries the rows' places in a column (``PLACE``), and no row is moved; ``keep_order=False``
    leaves it out. The counts are observed while the one, map-only, stage writes. Its tasks are
    result tasks, whose metrics Spark takes in once per partition whatever gets
    retried, so the counts are exact even when executors are lost. With
    ``runs_path`` a record is appended, for failed runs too; with ``index_path``
    the result's page index is written for quick paging. An earlier result at
    ``dest`` is read until the new one is complete.
    """
    run_id = run_id or uuid.uuid4().hex
    dataset = dataset or (source if isinstance(source, str) else "")
    started, clock = datetime.now(timezone.utc), time.monotonic()

    def record(stats: RunStats | None, error: str | None) -> None:
        row = run_row(run_id, dataset, request, rule, stats, error, started, time.monotonic() - clock)
        record_runs(spark, runs_path, [row])

    try:
        check_rule(rule)
        with _job_group(spark, run_id, f"{rule.action} rule"):
            df = read_table(spark, source, **read_options) if isinstance(source, str) else source
            df = with_places(df) if keep_order else df
            counts = Observation(f"run-{run_id}")
            replace_result(apply_rule(df, rule, observe=counts), dest)
            if index_path:
                write_page_index(spark, dest, index_path)
        total, matched = (int(counts.get.get(k) or 0) for k in ("total_rows", "matched_rows"))
        stats = stats_of(run_id, rule, total, matched, df, dest)
    except Exception as exc:
        record(None, _first_line(exc))
        raise
    record(stats, None)
    return stats


def stats_of(run_id: str, rule: Rule, total: int, matched: int, df: DataFrame, dest: str) -> RunStats:
    left = {"keep": matched, "drop": total - matched}.get(rule.action, total)
    return RunStats(run_id, total, matched, left, [c for c in df.columns if c != PLACE], dest)


def _first_line(exc: Exception) -> str:
    return str(exc).splitlines()[0] if str(exc) else type(exc).__name__


def run_row(
    run_id: str, dataset: str, request: str, rule: Rule, stats: RunStats | None, error: str | None, started: datetime, seconds: float
) -> tuple:
    return (
        run_id, dataset, request, "FAILURE" if stats is None else "SUCCESS", error, rule.combinator, rule.action, rule.value,
        [(p.column, p.pattern, p.explanation) for p in rule.predicates],
        stats and stats.total_rows, stats and stats.matched_rows, stats and stats.output_rows,
        stats and stats.columns, stats and stats.result_path, started, seconds,
    )


def is_recorded(spark: SparkSession, runs_path: str, run_id: str) -> bool:
    """Whether ``runs_path`` has a record of the run."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(runs_path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return False
    found = spark.read.schema(RUNS_SCHEMA).parquet(runs_path).filter(F.col("run_id") == run_id)
    return bool(found.select("run_id").take(1))


def record_runs(spark: SparkSession, runs_path: str | None, rows: list[tuple]) -> None:
    if runs_path and rows:
        spark.createDataFrame(rows, RUNS_SCHEMA).coalesce(1).write.mode("append").parquet(runs_path)


@contextmanager
def _job_group(spark: SparkSession, group: str, description: str):
    """Spark jobs of the block belong to ``group``; the caller's own group comes back afterwards."""
    sc = spark.sparkContext
    callers = {k: sc.getLocalProperty(k) for k in _GROUP_PROPERTIES}
    sc.setJobGroup(group, description, interruptOnCancel=True)
    try:
        yield
    finally:
        for k, v in callers.items():
            sc.setLocalProperty(k, v)


def run_request(
    spark: SparkSession,
    source: str,
    request: str,
    columns: list[str],
    dest: str,
    *,
    action: str = "auto",
    value: str = "",
    store: str | None = None,
    **options,
) -> RunStats:
    """A run from a plain-English request: resolve it for ``columns``, then :func:`run_rule`.

    With ``store`` (see :func:`~patternflow.plans.requests.create_store`) a request
    resolved before is taken from there, and a new one is added.
    """
    if store is None:
        rule = rule_from_prompt(spark, request, columns, action, value)
    else:
        asked = spark.createDataFrame(
            [(request, columns, action, value)], "prompt string, columns array<string>, ask string, typed string"
        )
        found = resolve_with_reuse(spark, asked, store, action="ask", value="typed").first()
        if found["error"]:
            raise RuleError(found["error"])
        rule = Rule.from_dict(found.asDict(recursive=True))
    return run_rule(spark, source, rule, dest, request=request, **options)


def run_rules(
    spark: SparkSession,
    source: str | DataFrame,
    rules: dict[str, Rule],
    dest: str,
    *,
    run_id: str | None = None,
    runs_path: str | None = None,
    dataset: str | None = None,
    request: str = "",
    keep_order: bool = True,
    **read_options,
) -> dict[str, RunStats]:
    """Several runs over one dataset, each from the original, in one read of it.

    A rule's result is the same as that of :func:`run_rule`; its folder below ``dest`` is in its stats, with the run's
    identifier, ``run_id`` and the rule's name. All patterns and columns are checked before anything is read. The results are written by one map-only
    job, ``RULES_AT_ONCE`` of them at a time. Rules that turn columns of other types into text need a job of their own
    for each such set of columns, as their results differ in type.
    """
    if any(not name for name in rules):
        raise RuleError("Every rule needs a name")
    run_id = run_id or uuid.uuid4().hex
    dataset = dataset or (source if isinstance(source, str) else "")
    started, clock = datetime.now(timezone.utc), time.monotonic()
    stats: dict[str, RunStats] = {}
    failed = dict(rules)  # those to be recorded if something goes wrong
    try:
        for name, rule in rules.items():
            failed = {name: rule}
            check_rule(rule)
        failed = dict(rules)
        with _job_group(spark, run_id, f"{len(rules)} rules"):
            df = read_table(spark, source, **read_options) if isinstance(source, str) else source
            for name, rule in rules.items():
                failed = {name: rule}
                rule.check_columns(df.columns)
            df = with_places(df) if keep_order else df
            for batch in _batches(df, rules):
                failed = batch
                stats.update(_run_batch(spark, df, batch, dest, run_id))
    except Exception as exc:
        seconds = time.monotonic() - clock
        rows = [run_row(f"{run_id}/{n}", dataset, request, r, None, _first_line(exc), started, seconds) for n, r in failed.items()]
        done = [run_row(s.run_id, dataset, request, rules[n], s, None, started, seconds) for n, s in stats.items()]
        record_runs(spark, runs_path, done + rows)
        raise
    seconds = time.monotonic() - clock
    record_runs(spark, runs_path, [run_row(s.run_id, dataset, request, rules[n], s, None, started, seconds) for n, s in stats.items()])
    return {name: stats[name] for name in rules}


def _batches(df: DataFrame, rules: dict[str, Rule]) -> list[dict[str, Rule]]:
    """Rules whose results have the same types, at most ``RULES_AT_ONCE`` together."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    alike: dict[frozenset, list[str]] = {}
    for name, rule in rules.items():
        alike.setdefault(frozenset(edited_columns(rule)) - text, []).append(name)
    return [
        {n: rules[n] for n in names[i : i + RULES_AT_ONCE]} for names in alike.values() for i in range(0, len(names), RULES_AT_ONCE)
    ]


def _run_batch(spark: SparkSession, df: DataFrame, rules: dict[str, Rule], dest: str, run_id: str) -> dict[str, RunStats]:
    turned = {c for rule in rules.values() for c in edited_columns(rule)}
    texts = df.select(*(ref(c).cast("string").alias(c) if c in turned else ref(c) for c in df.columns))
    counts = Observation(f"runs-{uuid.uuid4().hex}")
    results = apply_rules_at_once(texts, rules, observe=counts)
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    paths = {name: f"{dest.rstrip('/')}/{RULE}={escaped(name)}" for name in rules}
    for name, path in paths.items():
        if not begin_version(spark, path):
            raise RuleError(f"{path} holds something else than a result of {name}")
    # With a writer for each rule open at a time, no task has to sort its rows by rule.
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers, None)
    spark.conf.set(writers, str(len(rules)))
    try:
        row_group = max(_LEAST_ROW_GROUP, _ROW_GROUP // len(rules))
        results.write.mode("append").partitionBy(RULE).option("parquet.block.size", row_group).parquet(dest)
    finally:
        spark.conf.unset(writers) if before is None else spark.conf.set(writers, before)
    for path in paths.values():
        if not has_new_files(spark, path):  # a rule that leaves no row
            results.drop(RULE).limit(0).write.mode("append").parquet(path)
        finish_version(spark, path)
    seen = counts.get
    return {
        name: stats_of(f"{run_id}/{name}", rule, int(seen.get("total_rows") or 0), int(seen.get(f"matched_{i}") or 0), df, paths[name])
        for i, (name, rule) in enumerate(rules.items())
    }


def cancel_run(spark: SparkSession, run_id: str) -> None:
    """Stop a run's jobs from another thread; the run raises and is recorded as failed. Several rules' run is one."""
    spark.sparkContext.cancelJobGroup(run_id)


def run_progress(spark: SparkSession, run_id: str) -> float:
    """Share of finished tasks among those of the run's stages known so far."""
    tracker = spark.sparkContext.statusTracker()
    done = total = 0
    for job_id in tracker.getJobIdsForGroup(run_id):
        job = tracker.getJobInfo(job_id)
        for stage_id in job.stageIds if job else ():
            stage = tracker.getStageInfo(stage_id)
            if stage:
                done, total = done + stage.numCompletedTasks, total + stage.numTasks
    return done / total if total else 0.0


def run_history(
    runs: DataFrame, dataset: str | None = None, page: int = 1, page_size: int = PAGE_SIZE
) -> DataFrame:
    """One page of run records, newest first, optionally of a single dataset.

    A page holds at most ``MAX_PAGE_SIZE`` records.
    """
    page, page_size = max(1, page), max(1, min(page_size, MAX_PAGE_SIZE))
    if dataset is not None:
        runs = runs.filter(ref("dataset") == dataset)
    newest = runs.orderBy(F.desc("created_at"), F.asc("run_id"))
    return newest.offset((page - 1) * page_size).limit(page_size)
