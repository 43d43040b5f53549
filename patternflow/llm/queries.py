"""The queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternflow.llm import (
    centroids,
    context_mixing,
    exact_dedup,
    fill_middle,
    jaccard_join,
    language_id,
    piece_codec,
    quality_classifier,
    quality_rules,
    secret_scan,
    source_mix,
    token_counts,
    vocabulary,
    warc,
)
from patternflow.llm.common import documents, fold, labels, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A word, for SQL: the same class as ``common.WORD``.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(oracle: str | None = None):
    """Register the decorated function under its own name."""

    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return wrap


def _quality_sql() -> str:
    rules, alpha, delta = quality_rules.CUTOFFS, quality_rules.ALPHA, quality_rules.DELTA
    hits = ", ".join("(" + " + ".join(f"({r} >= {c})::INT" for c in g) + f") AS hits_{r}" for r, g in rules.items())
    steps, before = "", "cells"
    for r, g in rules.items():
        steps += f"""
tested_{r} AS (
  SELECT stratum, step, CAST(sum(n) AS BIGINT) AS good, CAST(coalesce(sum(n) FILTER (WHERE hit OR hits_{r} + step >= {len(g)}), 0) AS BIGINT) AS rejected
  FROM {before}, (SELECT unnest(range(0, {len(g)})) AS step) GROUP BY ALL),
passed_{r} AS (
  SELECT stratum, coalesce(min(step) FILTER (WHERE NOT passes), {len(g)}) AS passed FROM (
    SELECT stratum, step, list_sum(list_transform(range(0, rejected + 1), lambda k: exp(
      lgamma(good + 1) - lgamma(k + 1) - lgamma(good - k + 1) + k * ln({alpha}) + (good - k) * ln(1 - {alpha})
    ))) <= {delta} / ({quality_rules.possible_unions(rules)} * (SELECT count(DISTINCT stratum) FROM cells)) AS passes FROM tested_{r})
  GROUP BY stratum),
union_{r} AS MATERIALIZED (SELECT c.* REPLACE (hit OR hits_{r} + passed > {len(g)} AS hit) FROM {before} c JOIN passed_{r} USING (stratum)),"""
        before = f"union_{r}"
    cuts = ", ".join(
        f"(SELECT [{', '.join(map(str, g))}][passed] FROM passed_{r} p WHERE p.stratum = s.stratum AND passed > 0) AS cut_{r}" for r, g in rules.items()
    )
    failed = "list_filter([" + ", ".join(f"CASE WHEN {r} >= cut_{r} THEN '{r}' END" for r in rules) + "], lambda f: f IS NOT NULL)"
    return rf"""
WITH split AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS body, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i,
         unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS five
  FROM split WHERE len(w) >= 5),
repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM repeated) GROUP BY doc_id),
counted AS (
  SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(regexp_extract_all(body, '[A-Z][A-Z]')) AS BIGINT) AS n_shout
  FROM split LEFT JOIN covered USING (doc_id)),
measured AS MATERIALIZED (
  SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.REPEAT_PERCENT} * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN 1000 * n_symbols // word_chars ELSE 0 END AS symbol_permille,
         CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_line_permille,
         CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat_permille,
         CASE WHEN word_chars > 0 THEN 2000 * n_shout // word_chars ELSE 0 END AS shout_permille
  FROM counted),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
cells AS MATERIALIZED (
  SELECT stratum, {hits}, false AS hit, count(*) AS n FROM (
    SELECT DISTINCT ON (doc_id) * FROM measured JOIN good USING (doc_id) ORDER BY doc_id, stratum, {', '.join(rules)}) GROUP BY ALL),{steps}
chosen AS MATERIALIZED (SELECT stratum, {cuts} FROM (SELECT DISTINCT stratum FROM cells) s),
judged AS (SELECT measured.*, {failed} AS fails FROM measured LEFT JOIN chosen USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND len(fails) = 0 AS kept, coalesce(list_aggregate(fails, 'string_agg', ','), '') AS failed_rules
FROM judged"""


@query(_quality_sql())
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the verdict of the risk-controlled rules on every document."""
    return quality_rules.judge(documents(spark, sf_dir), labels(spark, sf_dir))


@query(
    f"""
WITH n AS (SELECT doc_id, {_LOWER} AS body FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM n WINDOW same AS (PARTITION BY body)"""
)
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays of each group of equal texts: the one with the largest identifier."""
    return exact_dedup.mark_copies(documents(spark, sf_dir), keep="largest")


def _mix_sql() -> str:
    w, share, most = source_mix.WEIGHTS, source_mix.SHARE, source_mix.MOST
    seed, digits = source_mix.SEED, source_mix.BLOCK_DIGITS
    fewest, shard_words = source_mix.FEWEST_LEVELS, source_mix.SHARD_WORDS
    weight = f"CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(w)} " + " ".join(
        f"WHEN {i} THEN {x}" for i, x in enumerate(w)
    ) + " END"
    return rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS skey,
         md5('{seed}|row|' || doc_id) AS key, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
sources AS (SELECT skey, source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL),
weighed AS (SELECT *, {weight} AS weight, {most} * source_size AS cap FROM sources),
levelled AS (
  SELECT *, row_number() OVER bound AS place,
         ({share} * (SELECT sum(source_size) FROM sources) - coalesce(sum(cap) OVER (bound ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (bound ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW bound AS (ORDER BY cap / weight, source NULLS LAST)),
first AS (SELECT place, level FROM levelled WHERE level <= cap / weight ORDER BY place LIMIT 1),
targets AS (
  SELECT skey, source_size, CASE WHEN l.place >= f.place THEN f.level * weight ELSE CAST(cap AS DOUBLE) END AS target
  FROM levelled l LEFT JOIN first f ON true),
blocks AS (SELECT skey, key[1:{digits}] AS block, sum(size) AS words FROM sized GROUP BY ALL),
ordered AS (
  SELECT skey, block, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes,
         coalesce(sum(words) OVER (PARTITION BY skey ORDER BY md5('{seed}|block|' || skey || '|' || block), block
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM blocks JOIN targets USING (skey)),
draws AS (
  SELECT skey, block, pass, row_number() OVER (ORDER BY md5('{seed}|split|' || skey || '|' || block || '|' || pass), skey, block, pass) - 1 AS rank,
         count(*) OVER () AS n
  FROM (
    SELECT skey, block, unnest(range(0, CAST(passes AS BIGINT) + CASE WHEN target - passes * source_size - before > 0 THEN 1 ELSE 0 END)) AS pass
    FROM ordered)),
levels AS (SELECT greatest({fewest}, CAST(ceil(log2(greatest(1, sum(target) / {shard_words}))) AS BIGINT)) AS levels FROM targets),
walk AS (
  SELECT skey, block, pass, 0 AS level, CAST(0 AS BIGINT) AS shard, CAST(rank AS BIGINT) AS rank, CAST(n AS BIGINT) AS n FROM draws
  UNION ALL
  SELECT skey, block, pass, level + 1, 2 * shard + CASE WHEN rank < n // 2 THEN 0 ELSE 1 END,
         CASE WHEN rank < n // 2 THEN rank ELSE rank - n // 2 END, CASE WHEN rank < n // 2 THEN n // 2 ELSE n - n // 2 END
  FROM walk, levels WHERE level < levels),
dealt AS (
  SELECT skey, block, list(shard ORDER BY pass) AS shards FROM walk, levels WHERE level = levels GROUP BY ALL),
placed AS (
  SELECT s.doc_id, s.skey, o.block, s.size, o.source_size, o.target, o.passes, o.target - o.passes * o.source_size - o.before AS room,
         coalesce(sum(s.size) OVER (PARTITION BY s.skey, o.block ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside,
         sum(s.size) OVER (PARTITION BY s.skey, o.block) AS words
  FROM sized s JOIN ordered o ON s.skey = o.skey AND s.key[1:{digits}] = o.block)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
       coalesce(list_aggregate(list_sort(shards[1:copies]), 'string_agg', ','), '') AS shards
FROM (
  SELECT *, CAST(passes + CASE WHEN room > 0 AND (words <= room OR 2 * inside + size <= 2 * room) THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM placed) LEFT JOIN dealt USING (skey, block)
"""


@query(_mix_sql())
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, against its source's target, and the shards that its copies go to."""
    mixed = source_mix.mix_sources(documents(spark, sf_dir))
    shards = F.array_join(F.array_sort("copies.shard"), ",").alias("shards")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", shards)


def _secret_sql() -> str:
    def one(order: int, rule: secret_scan.SecretRule) -> str:
        p = rule.pattern.replace("'", "''")
        return (
            f"SELECT doc_id, '{rule.kind}' AS kind, {order} AS ord, i, len(gaps[i]) AS gap, len(hits[i]) AS hit, len(parts[i]) >= {rule.least} AS ok FROM ("
            f"SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(body, '{p}') AS gaps, "
            f"regexp_extract_all(body, '{p}') AS hits, regexp_extract_all(body, '{p}', {rule.part}) AS parts FROM body))"
        )

    steps = " UNION ALL ".join(one(i, r) for i, r in enumerate(secret_scan.RULES))
    base = f"ord < {secret_scan.BASE}"
    joined = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord)"
    return f"""
WITH body AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
steps AS ({steps}),
spans AS (
  SELECT *, stop - hit AS start FROM (
    SELECT *, CAST(sum(gap + hit) OVER (PARTITION BY doc_id, ord ORDER BY i) AS BIGINT) AS stop FROM steps) WHERE ok),
per AS (
  SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access,
         count(*) FILTER (WHERE ord = 2) AS n_hex, {joined} FILTER (WHERE {base}) AS base, {joined} AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(body) AS blob_sha256
FROM body LEFT JOIN per USING (doc_id)"""


@query(_secret_sql())
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document: counts of the base kinds and all spans."""
    scanned = secret_scan.scan_versions(documents(spark, sf_dir))
    found = F.col("findings")

    def n(order: int):
        return F.size(F.filter(found, lambda s: s["order"] == order)).cast("long")

    base = F.filter(found, lambda s: s["order"] < secret_scan.BASE)
    return scanned.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(found).alias("spans"),
        "blob_sha256",
    )


@query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of four folds of five."""
    docs = documents(spark, sf_dir)
    held_out = fold("doc_id", 5) == 0
    model = language_id.train(docs.filter(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, by a model of two folds of three."""
    docs = documents(spark, sf_dir)
    held_out = fold("doc_id", 3) == 1
    model = quality_classifier.train(docs, labels(spark, sf_dir).filter(~held_out))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of vocabulary pieces of every document."""
    return token_counts.count_tokens(documents(spark, sf_dir), vocabulary.load())


@query()
def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, and the digest of the text that decoding them gives."""
    pieces = vocabulary.load()
    encoded = piece_codec.encode(documents(spark, sf_dir), pieces)
    return encoded.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(piece_codec.decoded(encoded, pieces), 256).alias("decoded_sha256"),
    )


@query()
def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every document, under models of four folds of five."""
    held_out = fold("doc_id", 5) == 1
    scored = context_mixing.score_documents(documents(spark, sf_dir), trained=~held_out)
    return scored.withColumn("held_out", held_out)


@query()
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document among those whose 4-word shingles agree by 85 per cent."""
    return jaccard_join.similar_groups(documents(spark, sf_dir), words=4, percent=85)


@query(
    f"""
WITH n AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT *, CASE WHEN size >= {warc.LEAST_SHARED} THEN max(page_id) OVER (PARTITION BY body) END AS held FROM n)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN held IS NOT NULL AND held IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN held IS DISTINCT FROM page_id THEN held END AS refers_to, true AS sound
FROM m"""
)
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of an archive that was written, read back and held against its digests."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    dest = scratch_path(spark, "warc")
    warc.write_archive(pages, dest)
    found = warc.read_archive(spark, dest, dict(pages.dtypes)["page_id"])
    return found.select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "sound")


def _middle_sql() -> str:
    unit = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
    draws = ", ".join(
        f"CAST('0x' || sha256('{fill_middle.SEED}:' || doc_id)[{8 * i + 1}:{8 * i + 8}] AS BIGINT) AS h{i + 1}" for i in range(4)
    )
    return rf"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{unit}') AS units, {draws} FROM documents),
placed AS (
  SELECT *, len(units) AS n, h1 % (len(units) + 1) AS x, h2 % (len(units) + 1) AS y,
         CASE WHEN body = '' OR regexp_matches(body, '<[PSM]>') OR h3 % 100 >= {fill_middle.RATE} THEN 'plain'
              WHEN h4 % 100 < {fill_middle.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
cut AS (
  SELECT *, array_to_string(units[1:least(x, y)], '') AS prefix, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS middle,
         array_to_string(units[greatest(x, y) + 1:], '') AS suffix
  FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM cut"""


@query(_middle_sql())
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, and digests of its output and of the text rebuilt from that."""
    moved = fill_middle.rearrange(documents(spark, sf_dir))
    return moved.select(
        "doc_id",
        "n",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(moved), 256).alias("restored_sha256"),
    )


def _centroid_sql() -> str:
    d, k = centroids.DIMENSIONS, centroids.CLUSTERS
    squared = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    steps = [
        f"""
whole AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {d} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c FROM (
    SELECT sha256('{centroids.SEED}:' || vec_id) AS h, v FROM whole ORDER BY h, v LIMIT {k}))"""
    ]
    for i in range(centroids.ROUNDS + 1):
        steps.append(
            f"""
a{i} AS MATERIALIZED (SELECT r, min((dist, j)) AS best FROM (SELECT r, j, {squared} AS dist FROM whole, c{i}) GROUP BY r)"""
        )
        if i < centroids.ROUNDS:
            steps.append(
                f"""
m{i} AS (
  SELECT j, list(mean ORDER BY p) AS c FROM (
    SELECT j, p, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS mean FROM (
      SELECT best[2] AS j, p, sum(v[p]) AS s, count(*) AS n FROM a{i} JOIN whole USING (r), range(1, {d + 1}) AS places(p) GROUP BY ALL))
  GROUP BY j),
c{i + 1} AS MATERIALIZED (SELECT j, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (j))"""
            )
    last = centroids.ROUNDS
    return (
        "WITH "
        + ",".join(steps)
        + f"""
SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(best[1] AS BIGINT) AS distance,
       CAST(sum(best[1]) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{last} JOIN whole USING (r) JOIN c{last} ON j = best[2]"""
    )


@query(_centroid_sql())
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's cluster and squared distance, and the clusters' inertias."""
    clustered = centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return clustered.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
