"""Results as versions: replaced in one step, read as one consistent set of files.

The part files of a write share an identifier in their names. An empty marker file in the result's folder names the
identifier of the version that counts; the marker with the highest number wins. A new version's files are written
beside the old ones, then its marker, and only then the old files go. Until the marker is there readers see the old
version, afterwards the new one, wherever a run is cut short. A folder without markers is read as it stands.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_MARKER, _NOTE = "_version-", "_of-"
_MARKER_NAME = re.compile(r"^_version-(\d{10})-([0-9a-f-]{36})$")
#: Spark's name of a part file, with the identifier that all files of one write share.
_PART = re.compile(r"^part-\d+-([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})[.-]")


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _child(spark: SparkSession, path: str, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")


def _marked(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """(number, identifier) of the marker that counts."""
    fs, _ = _folder(spark, path)
    there = fs.globStatus(_child(spark, path, f"{_MARKER}*")) or ()
    found = [m for s in there if (m := _MARKER_NAME.match(s.getPath().getName()))]
    return max(((int(m[1]), m[2]) for m in found), default=None)


def open_result(spark: SparkSession, path: str) -> DataFrame:
    """The current version of the table at ``path``; any Parquet table may stand there."""
    marked = _marked(spark, path)
    reader = spark.read.option("pathGlobFilter", f"*-{marked[1]}[.-]*") if marked else spark.read
    return reader.parquet(path)


def result_version(spark: SparkSession, path: str, table: DataFrame | None = None) -> str:
    """Text that differs between a table and what later replaces it: the marked version, else its files' names and sizes.

    ``table`` spares listing the files again where it has just been opened.
    """
    marked = _marked(spark, path)
    if marked:
        return marked[1]
    # The listing stays in the JVM, whatever its length.
    table = spark.read.parquet(path) if table is None else table
    files = table._jdf.queryExecution().analyzed().relation().location()
    return f"{files.allFiles().size()}-{files.allFiles().hashCode()}-{files.sizeInBytes()}"


def write_version(df: DataFrame, path: str) -> None:
    """Write ``df`` as the new version of the result at ``path``.

    A failed write leaves the old version alone, and one that is cut short at any point leaves either version whole.
    Where something else than one table written by Spark stands, it is removed once the new version is complete.
    """
    spark = df.sparkSession
    if begin_version(spark, path):
        df.write.mode("append").parquet(path)
        finish_version(spark, path)
        return
    fs, folder = _folder(spark, path)
    fresh = f"{path.rstrip('/')}.part"
    df.write.mode("overwrite").parquet(fresh)
    fs.delete(folder, True)
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(fresh), folder):
        raise OSError(f"{fresh} could not take the place of {path}")


def begin_version(spark: SparkSession, path: str) -> bool:
    """Make what is at ``path`` a marked version, and remove what an unfinished write left beside it.

    False where the files' names don't tell them from those of a later write.
    """
    fs, folder = _folder(spark, path)
    if not fs.exists(folder):
        return True
    marked = _marked(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    parts = [n for n in names if not n.startswith(("_", "."))]
    if marked is None and parts:
        writes = {m[1] if (m := _PART.match(n)) else None for n in parts}
        if len(writes) > 1 or None in writes:
            return False
        marked = 0, writes.pop()
        _mark(spark, path, *marked)
    for name in parts:
        if marked and f"-{marked[1]}" not in name:
            fs.delete(_child(spark, path, name), True)
    return True


def has_new_files(spark: SparkSession, path: str) -> bool:
    """Whether anything was written at ``path`` since :func:`begin_version`."""
    fs, folder = _folder(spark, path)
    if not fs.exists(folder):
        return False
    marked = _marked(spark, path)
    writes = (m[1] for s in fs.listStatus(folder) if (m := _PART.match(s.getPath().getName())))
    return any(marked is None or w != marked[1] for w in writes)


def finish_version(spark: SparkSession, path: str) -> None:
    """Mark the files written since :func:`begin_version`, then remove those they replace."""
    fs, folder = _folder(spark, path)
    marked = _marked(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    parts = [(n, m[1]) for n in names if (m := _PART.match(n))]
    fresh = {w for _, w in parts if marked is None or w != marked[1]}
    if len(fresh) != 1:
        raise OSError(f"{path} should hold one new version, not {len(fresh)}")
    version = fresh.pop()
    _mark(spark, path, marked[0] + 1 if marked else 0, version)
    for name, write in parts:
        if write != version:
            fs.delete(_child(spark, path, name), False)
    for name in names:
        if _MARKER_NAME.match(name):
            fs.delete(_child(spark, path, name), False)


def note_version(spark: SparkSession, path: str, version: str) -> None:
    """Leave in the folder at ``path`` that it was made from ``version`` of a table."""
    fs, _ = _folder(spark, path)
    fs.create(_child(spark, path, f"{_NOTE}{version}"), True).close()


def noted_versions(spark: SparkSession, path: str) -> list[str]:
    fs, _ = _folder(spark, path)
    there = fs.globStatus(_child(spark, path, f"{_NOTE}*")) or ()
    return [s.getPath().getName().removeprefix(_NOTE) for s in there]


def _mark(spark: SparkSession, path: str, number: int, version: str) -> None:
    fs, _ = _folder(spark, path)
    fs.create(_child(spark, path, f"{_MARKER}{number:010d}-{version}"), True).close()
