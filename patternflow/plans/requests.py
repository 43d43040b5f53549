"""Request keys, and reuse of requests resolved before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternflow.functions.columns import SPACE_CLASS, null_as_empty, ref, strip
from patternflow.operators.lookup import attach
from patternflow.plans.prompts import resolve_action, resolve_prompts
from patternflow.session import scratch_path

MODEL = "heuristic:v1"
TTL_DAYS = 30

STORE_SCHEMA = (
    "key string, predicates array<struct<column:string,pattern:string,explanation:string>>, "
    "combinator string, explanation string, action string, value string, created_at timestamp"
)
#: What a store is laid out by: the first digits of the key, which is a hash. A lookup reads the buckets of its keys.
BUCKET, _BUCKET_DIGITS = "bucket", 2
_PAYLOAD = ("predicates", "combinator", "explanation", "action", "value")


def normalised_prompt(prompt: Column) -> Column:
    """Lower case, runs of whitespace as one space, none at the ends."""
    return F.regexp_replace(strip(F.lower(prompt)), f"{SPACE_CLASS}+", " ")


def context_signature(
    columns: Column | None = None, samples: Column | None = None, action: Column | None = None
) -> Column:
    """Canonical JSON of what a request was asked about; empty if nothing was given.

    Column order counts, the order of the sample map does not.
    """
    if columns is None and samples is None and action is None:
        return F.lit("")
    parts = []
    if action is not None:
        parts.append(F.nullif(action, F.lit("")).alias("action"))
    parts.append((F.array() if columns is None else columns).alias("columns"))
    if samples is not None:
        ordered = F.map_from_entries(F.array_sort(F.map_entries(samples)))
        parts.append(ordered.alias("samples"))
    return F.to_json(F.struct(*parts))


def request_key(prompt: Column, model: Column | str = MODEL, context: Column | None = None) -> Column:
    """SHA-256 over model, normalised prompt and context."""
    model = F.lit(model) if isinstance(model, str) else model
    context = F.lit("") if context is None else null_as_empty(context)
    return F.sha2(F.concat_ws("::", model, normalised_prompt(null_as_empty(prompt)), context), 256)


def fresh_entries(store: DataFrame, now: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    """The newest entry per key among those not yet expired."""
    live = store.filter(F.col("created_at") > now - F.make_dt_interval(F.lit(ttl_days)))
    newest = live.groupBy("key").agg(
        F.max_by(F.struct(*_PAYLOAD), F.struct("created_at", F.to_json(F.struct(*_PAYLOAD))))
        .alias("entry")
    )
    return newest.select("key", "entry.*")


def with_keys(requests: DataFrame, prompt: str = "prompt", columns: str = "columns") -> DataFrame:
    """Add ``key``. Target columns are part of it: a rule names the columns it was made for."""
    context = context_signature(columns=ref(columns))
    return requests.withColumn("key", request_key(ref(prompt), MODEL, context))


def new_requests(
    keyed: DataFrame, known: DataFrame, prompt: str = "prompt", columns: str = "columns"
) -> DataFrame:
    """One request per key that is not known yet.

    Repeats collapse before the anti-join (map-side first), so a request asked a
    billion times is one row by then.
    """
    once = keyed.groupBy("key").agg(F.min(F.struct(ref(prompt), ref(columns))).alias("r"))
    return once.select("key", "r.*").join(known, "key", "left_anti")


def resolve_with_reuse(
    spark: SparkSession,
    requests: DataFrame,
    store_path: str,
    *,
    prompt: str = "prompt",
    columns: str = "columns",
    action: str | None = None,
    value: str | None = None,
    now: Column | None = None,
    ttl_days: int = TTL_DAYS,
) -> DataFrame:
    """Resolve requests, taking known ones from the store and adding new ones to it.

    Output is that of :func:`resolve_prompts` plus ``key``; ``source`` says
    "cache" for requests the store already held. The store is an append-only
    Parquet table; it must exist (see :func:`create_store`). The requests are read once, with their keys, into the
    scratch folder; of the store only buckets that their keys are in.
    """
    # One literal instant: an entry alive now must still be when the answers are computed.
    asked_at = F.unix_micros((F.current_timestamp() if now is None else now).cast("timestamp"))
    now = F.timestamp_micros(F.lit(spark.range(1).select(asked_at).first()[0]))
    # The entries seen at the start decide what counts as known.
    keyed = with_keys(requests, prompt, columns)
    once = scratch_path(spark, "requests")
    keyed.write.parquet(once)
    keyed = spark.read.schema(keyed.schema).parquet(once)
    known = fresh_entries(_entries(spark, store_path, keyed), now, ttl_days)
    new = resolve_prompts(new_requests(keyed, known, prompt, columns), prompt=prompt, columns=columns)
    # Worked out once, for the store as well as for the answers.
    staged = scratch_path(spark, "resolved")
    new.select("key", *_PAYLOAD, "source", "error").write.parquet(staged)
    missing = spark.read.parquet(staged)
    answers = known.select(
        "key", *_PAYLOAD, F.lit("cache").alias("source"), F.lit(None).cast("string").alias("error")
    ).unionByName(missing.select("key", *_PAYLOAD, "source", "error"))

    taken = ("key", *_PAYLOAD, "source", "error")
    own = [c for c in keyed.columns if c not in taken or c in (action, value)]
    asked = keyed.select(
        "key",
        *(ref(c) for c in own if c not in (action, value)),
        (ref(action) if action else F.lit("auto")).alias("__ask"),
        (ref(value) if value else F.lit("")).alias("__typed"),
    )
    joined = attach(asked, answers, "key")
    act, val = resolve_action(F.col("__ask"), F.col("__typed"), F.col("action"), F.col("value"))
    # Both come from the stored inference, so neither may see the other's result.
    resolved = joined.select(
        *(ref(c) for c in own if c not in (action, value)),
        "key", "predicates", "combinator", "explanation",
        act.alias("action"), val.alias("value"), "source", "error",
    )
    fresh = missing.filter(F.col("error").isNull()).select("key", *_PAYLOAD).withColumn("created_at", now)
    if _in_buckets(spark, store_path):
        _write_buckets(fresh, store_path)
    else:
        fresh.write.mode("append").parquet(store_path)
    return resolved


def _bucket() -> Column:
    return F.substring("key", 1, _BUCKET_DIGITS)


def _in_buckets(spark: SparkSession, store_path: str) -> bool:
    """Whether a store is laid out by key; one that holds entries beside the buckets is read and written as it stands."""
    parts = spark._jvm.org.apache.hadoop.fs.Path(f"{store_path.rstrip('/')}/part-*")
    return not parts.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(parts)


def _entries(spark: SparkSession, store_path: str, keyed: DataFrame) -> DataFrame:
    """The entries that may answer for keys of ``keyed``."""
    if not _in_buckets(spark, store_path):
        return spark.read.schema(STORE_SCHEMA).parquet(store_path)
    buckets = [r[0] for r in keyed.select(_bucket()).distinct().collect()]  # 256 at most
    entries = spark.read.schema(f"{STORE_SCHEMA}, {BUCKET} string").parquet(store_path)
    return entries.filter(F.col(BUCKET).isin(buckets)).drop(BUCKET)


def _write_buckets(entries: DataFrame, path: str) -> None:
    # A bucket's entries meet in one task, which writes one file for it.
    dealt = entries.withColumn(BUCKET, _bucket()).repartition(BUCKET)
    dealt.sortWithinPartitions(BUCKET, "key").write.mode("append").partitionBy(BUCKET).parquet(path)


def create_store(spark: SparkSession, store_path: str) -> str:
    """An empty store."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(store_path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    return store_path


def compact_store(
    spark: SparkSession, store_path: str, dest: str, *, now: Column | None = None, ttl_days: int = TTL_DAYS
) -> str:
    """A store at ``dest`` with the newest entry of each key that has not expired, a file for each bucket.

    ``store_path`` stays as it is; use ``dest`` from then on. A store that is not laid out in buckets becomes one that is.
    """
    instant = (F.current_timestamp() if now is None else now).cast("timestamp")
    entries = spark.read.schema(STORE_SCHEMA).parquet(store_path).select("key", *_PAYLOAD, "created_at")
    newest = entries.groupBy("key").agg(F.max_by(F.struct("*"), F.struct("created_at", F.to_json(F.struct(*_PAYLOAD)))).alias("entry"))
    live = newest.select("entry.*").filter(F.col("created_at") > instant - F.make_dt_interval(F.lit(ttl_days)))
    _write_buckets(live, create_store(spark, dest))
    return dest
