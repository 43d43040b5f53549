"""The corpus pipeline: stages that each work on all rows that the one before kept.

A row of ``documents`` whose text has no letter goes, as its language can't be told; of equal texts, and then of similar ones, the row with the
smallest identifier stays; sources are mixed to their targets; what remains is encoded. Rows
are matched to their verdicts by identifier, so rows that share one share its verdict. Empty
tables pass through, and columns beside those a stage reads are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternflow.llm import exact_dedup, jaccard_join, language_id, piece_codec, source_mix, vocabulary
from patternflow.llm.common import documents, ref, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; texts that are null or have no letter go.

    Where no row with a text names a language there is none to tell, and every text with a letter stays.
    """
    model = language_id.train(docs)
    if not model.languages:
        return docs.filter(language_id.has_letter(ref("text")))
    found = docs.withColumn("_language", language_id.language_of(docs, model))
    return found.filter(F.col("_language.lang") != language_id.UNDETERMINED).drop("_language")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest identifier."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles that agree by 80 per cent the one with the smallest identifier."""
    groups = jaccard_join.similar_groups(docs, words=5, percent=80)
    stays = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(_named("doc_id").alias("_stays")).distinct()
    return docs.join(stays, _named("doc_id") == F.col("_stays"), "left_semi")


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, which may be never; shard by shard, each in random order.

    A shard is cut across tasks where it is large; of rows that share an identifier the longest list of copies holds.
    """
    taken = (
        source_mix.mix_sources(docs)
        .groupBy(_named("doc_id").alias("_taken"))
        .agg(F.max(F.struct(F.size("copies"), "copies"))["copies"].alias("_copies"))
        .filter(F.size("_copies") > 0)
    )
    met = docs.join(taken, _named("doc_id") == F.col("_taken"))
    copies = met.withColumn("_copy", F.explode("_copies"))
    copies = copies.select(
        *[ref(c) for c in docs.columns],
        F.col("_copy.shard").alias("_shard"),
        source_mix.place_key("doc_id", F.col("_copy.pass")).alias("_place"),
    )
    copies = copies.repartitionByRange("_shard", "_place").sortWithinPartitions("_shard", "_place")
    return copies.select(*[ref(c) for c in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_pieces of every row."""
    encoded = piece_codec.encode(docs, vocabulary.load())
    return encoded.withColumn("n_pieces", F.size("ids").cast("long"))


def _named(column: str):
    """The identifier as text, so that null is an identifier like any other."""
    return F.when(ref(column).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), ref(column).cast("string")))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", keep_known_languages),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_to_targets),
    ("SentencePiece encoding and decoding", encode_pieces),
]
#: The last stage's segmentation is no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each result written to the shared folder and read back."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
