"""A catalogue of datasets: what was registered, where it lies, which columns it has."""

from __future__ import annotations

import posixpath
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternflow.functions.columns import ref
from patternflow.sources.readers import detect_kind, read_table

DATASETS_SCHEMA = (
    "id string, original_name string, kind string, path string, size_bytes long, "
    "columns array<string>, created_at timestamp"
)


def register_dataset(
    spark: SparkSession, path: str, catalog_path: str, kind: str | None = None, **read_options
) -> str:
    """Read the header, refuse a source without one, append a record; returns the dataset id."""
    kind = kind or ("parquet" if path.rstrip("/").endswith(".parquet") else detect_kind(path))
    columns = read_table(spark, path, kind, **read_options).columns
    # File sizes come from the listing; no content is read.
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    dataset_id = uuid.uuid4().hex
    name = posixpath.basename(path.rstrip("/"))
    row = (dataset_id, name, kind, path, int(size), columns, datetime.now(timezone.utc))
    one = spark.createDataFrame([row], DATASETS_SCHEMA)
    one.coalesce(1).write.mode("append").parquet(catalog_path)
    return dataset_id


def dataset(spark: SparkSession, catalog_path: str, dataset_id: str) -> DataFrame:
    """The record of one dataset."""
    return spark.read.parquet(catalog_path).filter(ref("id") == dataset_id)
