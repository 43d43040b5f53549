"""Secret scans over every historical version of a file, by an incremental blob ledger.

Contents are addressed by their SHA-256: a blob is scanned once however many paths
and versions hold it, and a ledger of (blob, rule version) pairs keeps later runs to
what they have not seen. Findings are joined back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patternflow.llm.common import ref, scratch_path, whole_text


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` finds leftmost non-overlapping spans; those whose ``part`` is shorter than ``least`` go.

    ``gate`` is a cheap pattern that any text with a span must match. A change to a rule
    needs a new ``version``.
    """

    kind: str
    pattern: str
    gate: str
    part: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + (
    _either_case("api") + "_?" + _either_case("key")
)
_ASSIGN = rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: The base kinds first, in the order in which equal starts are listed; then what the method adds.
RULES = (
    SecretRule("assign", _ASSIGN, rf"""({_KEYWORDS})["']?\x20*[:=]""", part=2, least=6),
    SecretRule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16}", least=20),
    SecretRule("hex", r"[0-9a-f]+", r"[0-9a-f]{24}", least=24),
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"PRIVATE KEY-----"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8}"),
    SecretRule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}", r"gh[opsu]_[A-Za-z0-9]{36}"),
    SecretRule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-"),
    SecretRule("userinfo", r"[a-z]{2,12}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@", r"://[^\x20\x09-\x0D/:@]+:"),
)
BASE = 3
#: Copies of a blob's findings, so that the paths of a much copied blob are joined by several tasks.
SALTS = 32


def _found(rule: SecretRule, order: int, body: Column, todo: Column) -> Column:
    """(kind, order, gaps, lengths, ok): spans as lengths between and inside matches, or null."""
    applies = F.array_contains(todo, rule.key) & body.rlike(rule.gate)
    part = (lambda hit: F.regexp_extract(hit, rule.pattern, rule.part)) if rule.part else (lambda hit: hit)
    gaps = F.transform(F.split(body, rule.pattern, -1), F.char_length)
    inner = F.transform(
        F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(0)),
        lambda hit: F.struct(
            F.char_length(hit).alias("length"), (F.char_length(part(hit)) >= rule.least).alias("ok")
        ),
    )
    return F.when(
        applies,
        F.struct(F.lit(rule.kind).alias("kind"), F.lit(order).alias("order"), F.arrays_zip(gaps.alias("gap"), inner.alias("hit")).alias("steps")),
    )


def scan_blobs(blobs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(sha, kind, order, start, end): the spans of each blob's rules in ``todo``, in code points.

    A match's start is the length of everything before it: a running sum over the gaps
    and matches of its blob and kind, taken over rows that hold numbers only.
    """
    found = F.array_compact(F.array(*[_found(r, i, F.col("body"), F.col("todo")) for i, r in enumerate(rules)]))
    kinds = blobs.select("sha", F.explode(found).alias("f")).select("sha", "f.kind", "f.order", "f.steps")
    steps = kinds.select("sha", "kind", "order", F.posexplode("steps").alias("place", "step"))
    so_far = Window.partitionBy("sha", "order").orderBy("place")
    return (
        steps.withColumn("length", F.col("step.hit.length"))
        .withColumn("end", F.sum(F.col("step.gap") + F.coalesce("length", F.lit(0))).over(so_far))
        .filter("step.hit.ok")
        .select("sha", "kind", "order", (F.col("end") - F.col("length")).alias("start"), "end")
    )


def scan_versions(
    versions: DataFrame,
    path_col: str = "doc_id",
    text_col: str = "text",
    *,
    ledger: str | None = None,
    rules: tuple[SecretRule, ...] = RULES,
) -> DataFrame:
    """One row per input row: path, blob_sha256, findings (an array of kind, order, start, end).

    Null text is an empty blob; findings run by start, then by the rules' order. ``ledger``
    is a folder that outlives the run, with the tables ``seen`` (blob, rule key) and
    ``findings``; only pairs not in it are scanned, then added. Without it everything
    counts as unseen. An empty input scans nothing; other columns are ignored.
    """
    spark = versions.sparkSession
    body = whole_text(text_col)
    paths = versions.select(ref(path_col).alias("path"), F.unhex(F.sha2(body, 256)).alias("sha"), body.alias("body"))
    # Copies meet in the map-side half of this aggregate, so a blob held by a third of
    # all rows moves once per task.
    blobs = paths.groupBy("sha").agg(F.first("body").alias("body"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    root = ledger or scratch_path(spark, "blob-ledger")
    seen = _read(spark, f"{root}/seen", "sha binary, rule string")
    if seen is None:
        todo = blobs.withColumn("todo", keys)
    else:
        known = seen.groupBy("sha").agg(F.collect_set("rule").alias("known"))
        todo = (
            blobs.join(known, "sha", "left")
            .withColumn("todo", F.array_except(keys, F.coalesce("known", F.array().cast("array<string>"))))
            .filter(F.size("todo") > 0)
        )
    rule_of = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.key)]), F.col("kind"))
    # Findings first: a run that fails between the two writes scans those blobs again, and
    # findings are read as a set.
    scan_blobs(todo, rules).withColumn("rule", rule_of).write.mode("append").parquet(f"{root}/findings")
    if ledger:
        todo.select("sha", F.explode("todo").alias("rule")).write.mode("append").parquet(f"{root}/seen")

    findings = spark.read.parquet(f"{root}/findings").filter(F.col("rule").isin([r.key for r in rules])).distinct()
    per_blob = findings.groupBy("sha").agg(
        F.array_sort(F.collect_list(F.struct("start", "order", "kind", "end"))).alias("findings")
    )
    salted = per_blob.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
    return (
        paths.select("path", "sha", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt"))
        .join(salted, ["sha", "salt"], "left")
        .select(
            F.col("path").alias(path_col),
            F.lower(F.hex("sha")).alias("blob_sha256"),
            F.coalesce("findings", none).alias("findings"),
        )
    )


def _read(spark, path: str, schema: str) -> DataFrame | None:
    """The table at ``path``, or None while there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if exists else None


def listed(findings: Column) -> Column:
    """The spans as text: kind:start:end, comma-joined in their order."""
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


__all__ = ["BASE", "RULES", "SecretRule", "listed", "scan_blobs", "scan_versions"]
