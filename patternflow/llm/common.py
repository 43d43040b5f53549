"""Text definitions, folds and staging that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternflow.functions.columns import ref
from patternflow.session import ensure_on_executors, scratch_path

#: A word is a longest run of characters other than the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def whole_text(column: Column | str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(ref(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character left alone.

    Plain ``lower`` does the same on ASCII text and is several times faster.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words(text: Column) -> Column:
    """The words in order; an empty array for null or blank text."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.array_remove(parts, "")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the identifier's text modulo ``n``; a null identifier reads as empty text."""
    return F.crc32(F.coalesce(ref(id_col).cast("string"), F.lit("")).cast("binary")) % n


def narrowed(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that no other column's name can clash with ours."""
    return df.select(*[ref(c) for c in columns])


def staged(df: DataFrame, label: str, compression: str = "snappy", **options: str | int) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back; ``options`` are those of the Parquet writer.

    Cuts the lineage: what is lost with an executor is read again, not computed again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


__all__ = [
    "SPACE", "SPACES", "WORD", "count_words", "documents", "ensure_on_executors", "fold", "labels",
    "lower_ascii", "narrowed", "ref", "scratch_path", "staged", "whole_text", "words",
]
