"""Deterministic sharded WARC archives: written from a table, and read back.

Records are range-sorted by (identifier, url, digest). The splitters come from the rows whose keys hash lowest, so
they depend on the rows alone and not on how Spark deals them; each range is one shard, written by one task in order.
A shard rolls to a new file when the one at hand has reached its compressed size. Of rows with equal long payloads one
is written in full and the others as revisits of it.

A task writes under temporary names of its own attempt and returns what it wrote. Only rows of tasks that
succeeded reach the manifest; what it lists is then renamed, the manifest itself last. A reader opens what
the manifest lists and nothing else, so it never sees the files of a failed attempt or of an unfinished run.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternflow.llm import warc_records as records
from patternflow.llm.common import ensure_on_executors, ref, staged, whole_text

#: Payloads below this many bytes are always written in full.
LEAST_SHARED = 1000
#: Payload bytes of a shard; above MOST_SHARDS shards grow instead of becoming more.
SHARD_BYTES, MOST_SHARDS = 64 << 20, 1 << 16
#: Keys per shard that the splitters are chosen among.
KEYS_A_SHARD = 64
#: A file is closed once its compressed size reaches this.
ROLL_BYTES = 16 << 20
LEVEL = 6
#: Archives of equal rows are equal byte by byte, so no clock is read.
DATE = "2000-01-01T00:00:00Z"
SALTS = 32
#: Payload bytes that a task reading an archive hands on at a time.
_SLICE = 8 << 20
_MANIFEST = "manifest"
_MANIFEST_SCHEMA = "file string, temporary string, shard int, roll int, records long, bytes long, sha256 string"


def _sort_key(column: Column, kind: str) -> Column:
    """Text that sorts as the identifier does; null first."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        # With the sign turned over, hexadecimal digits sort as the numbers do.
        text = F.lpad(F.hex(column.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    else:
        text = F.hex(column.cast("string"))
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), text))


def _described(df: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """id, url, payload, size, digest, place: what a record is made from, and its key."""
    kind = dict(df.select(ref(id_col).alias("id")).dtypes)["id"]
    rows = df.select(
        ref(id_col).alias("id"), ref(url_col).cast("string").alias("url"), whole_text(ref(payload_col).cast("string")).alias("payload")
    )
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1(F.encode("payload", "UTF-8")).alias("digest"))
    url = F.when(F.col("url").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("url")))
    return rows.withColumn("place", F.concat_ws("\x01", _sort_key(F.col("id"), kind), url, F.col("digest")))


def _marked(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` with ``first``: (id, url) of the row that holds the payload, null where that is the row itself.

    Groups are added up in two levels and joined back by (digest, salt): copies of one payload, however many, are
    dealt over ``SALTS`` tasks.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    shared = F.col("size") >= least
    parts = salted.filter(shared & F.col("id").isNotNull()).groupBy("digest", "size", "salt").agg(F.max(F.struct("id", "url")).alias("first"))
    known = parts.groupBy("digest", "size").agg(F.max("first").alias("first"))
    # Every (digest, salt) that occurs, also of rows without an identifier.
    met = salted.filter(shared).groupBy("digest", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    groups = (
        met.groupBy("digest", "size").agg(F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))  # at most SALTS numbers
        .filter("n > 1")
        .join(known, ["digest", "size"])
        .select("digest", "size", "first", F.explode("salts").alias("salt"))
    )
    joined = salted.join(groups, ["digest", "size", "salt"], "left")
    other = F.col("first").isNotNull() & ~F.col("first.id").eqNullSafe(F.col("id"))
    return joined.withColumn("first", F.when(other, F.col("first")))


def _splitters(rows: DataFrame, shard_bytes: int, most_shards: int) -> list[str]:
    """Upper ends of all shards but the last; the same for the same rows."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    shards = min(most_shards, -(-(total["size"] or 0) // shard_bytes))
    if shards < 2:
        return []
    wanted = shards * KEYS_A_SHARD
    key = F.xxhash64("place")
    # Twice the wanted share passes; of these the lowest ``wanted`` are fetched, a bounded number.
    ceiling = min((1 << 63) - 1, (2 * wanted << 64) // total["n"] - (1 << 63))
    lowest = rows.filter(key <= ceiling).select("place", "size", key.alias("h")).orderBy("h", "place").limit(wanted)
    sample = sorted((r["place"], r["size"]) for r in lowest.collect())
    # A row weighs what its record takes, roughly: its payload and a header.
    weights = [size + 1024 for _, size in sample]
    ends, seen, share = [], 0, sum(weights) / shards
    for (place, _), weight in zip(sample, weights, strict=True):
        seen += weight
        if seen >= share * (len(ends) + 1) and len(ends) < shards - 1:
            ends.append(place)
    return sorted(set(ends))


def _shard(place: Column, ends: list[str]) -> Column:
    """The number of splitters below ``place``, by binary search in one constant array."""
    if not ends:
        return F.lit(0)
    # Hexadecimal digits sort as the bytes they stand for and hold no comma.
    held, place = F.split(F.lit(",".join(e.encode().hex().upper() for e in ends)), ","), F.hex(place)
    steps = F.array(*(F.lit(1 << i) for i in range(len(ends).bit_length() - 1, -1, -1)))
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when((at + step <= len(ends)) & (F.get(held, at + step - 1) < place), at + step).otherwise(at)
    )


def write_archive(
    df: DataFrame,
    dest: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    *,
    least_shared: int = LEAST_SHARED,
    shard_bytes: int = SHARD_BYTES,
    most_shards: int = MOST_SHARDS,
    roll_bytes: int = ROLL_BYTES,
    date: str = DATE,
    level: int = LEVEL,
) -> DataFrame:
    """One record per row below ``dest``, a folder that driver and executors share; returns the manifest.

    Of rows whose payloads are equal and have ``least_shared`` bytes or more, those with the largest identifier are
    responses, and the others revisits of the largest url among them; where none has an identifier all are responses. Rows that
    repeat give a record each. A null payload is empty; a null url or identifier has no header line and sorts first. An empty table
    gives a manifest without files. A payload is one row and held whole; nothing else grows with
    the input. An archive already at ``dest`` is refused. Equal rows give equal files, whatever the partitions.
    """
    spark = df.sparkSession
    ensure_on_executors(spark)
    dest = dest.rstrip("/")
    if _has(spark, f"{dest}/{_MANIFEST}"):
        raise FileExistsError(f"{dest} holds an archive already")
    described = _described(df, id_col, url_col, payload_col)
    slim = staged(described.select("id", "url", "size", "digest", "place"), "warc-keys")
    ends = _splitters(slim, shard_bytes, most_shards)
    shards, shard = len(ends) + 1, _shard(F.col("place"), ends).cast("int").alias("shard")
    # Notes say which places are revisits; they travel to the shards with the rows, so payloads are shuffled once.
    notes = _marked(slim, least_shared).filter("first IS NOT NULL").groupBy("place").agg(F.first("first").alias("first"))
    none = F.lit(None).cast("string")
    sent = notes.select(
        shard, "place", F.lit(0).alias("what"), none.alias("id"), none.alias("url"), none.alias("payload"),
        F.col("first.id").cast("string").alias("first_id"), F.col("first.url").alias("first_url"),
    ).unionByName(
        described.select(
            shard, "place", F.lit(1).alias("what"), F.col("id").cast("string").alias("id"), "url", "payload",
            none.alias("first_id"), none.alias("first_url"),
        )
    )
    ranged = sent.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place", "what")
    run = uuid.uuid4().hex
    there = _target(spark, dest)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Shelf(there, f"_temporary-{run}", roll_bytes, date, level) as shelf:
            noted, first = None, None
            for batch in batches:
                columns = [batch.column(c) for c in ("shard", "place", "what", "id", "url", "payload", "first_id", "first_url")]
                for i in range(batch.num_rows):
                    number, place, what, row_id, url, payload, first_id, first_url = (c[i].as_py() for c in columns)
                    if what == 0:
                        noted, first = place, (first_id, first_url)
                    else:
                        refers_to = first if place == noted else None
                        shelf.add(number, records.page_record(row_id, url, payload.encode(), date, refers_to))
        yield pa.RecordBatch.from_pylist(shelf.written, schema=_manifest_arrow())

    written = staged(ranged.mapInArrow(write, _MANIFEST_SCHEMA), "warc-written")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(there)
        for batch in batches:
            for r in batch.to_pylist():
                _take_place(fs, f"{root}/{r['temporary']}", f"{root}/{r['file']}", r["bytes"])
            yield batch

    fresh = f"{dest}/{_MANIFEST}.{run}"
    written.mapInArrow(commit, _MANIFEST_SCHEMA).drop("temporary").write.parquet(fresh)
    folder = spark._jvm.org.apache.hadoop.fs.Path
    hadoop = folder(dest).getFileSystem(spark._jsc.hadoopConfiguration())
    if not hadoop.rename(folder(fresh), folder(f"{dest}/{_MANIFEST}")):
        raise OSError(f"The manifest of {dest} could not be put in place")
    hadoop.delete(folder(f"{dest}/_temporary-{run}"), True)
    return manifest(spark, dest)


def _has(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _target(spark: SparkSession, dest: str) -> str:
    """``dest`` with its scheme, as executors open it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(dest)
    name = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    return "file://" + name.removeprefix("file:") if name.startswith("file:/") and not name.startswith("file://") else name


def _manifest_arrow() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in _MANIFEST_SCHEMA.split(", "))])


def _take_place(fs: pa.fs.FileSystem, temporary: str, final: str, size: int) -> None:
    """Rename, unless an earlier attempt of this task did."""
    if fs.get_file_info(temporary).type == pa.fs.FileType.NotFound:
        if fs.get_file_info(final).size != size:
            raise records.DamagedArchive(f"{final} is missing or not complete")
        return
    if fs.get_file_info(final).type != pa.fs.FileType.NotFound:
        fs.delete_file(final)  # of a run that ended before its manifest
    fs.move(temporary, final)


class _Shelf:
    """The files that one task attempt writes; ``written`` lists them."""

    def __init__(self, target: str, folder: str, roll_bytes: int, date: str, level: int):
        self.fs, self.root = pa.fs.FileSystem.from_uri(target)
        self.folder, self.roll_bytes, self.date, self.level = folder, roll_bytes, date, level
        self.attempt = uuid.uuid4().hex
        self.written: list[dict] = []
        self.stream, self.shard, self.roll = None, -1, 0

    def __enter__(self) -> _Shelf:
        self.fs.create_dir(f"{self.root}/{self.folder}", recursive=True)
        return self

    def __exit__(self, *_) -> None:
        self._close()

    def add(self, shard: int, record: bytes) -> None:
        if shard != self.shard:
            self._close()
            self.shard, self.roll = shard, 0
        elif self.size >= self.roll_bytes:
            self._close()
            self.roll += 1
        if self.stream is None:
            self._open()
        self._put(record)
        self.records += 1

    def _open(self) -> None:
        self.name = f"shard-{self.shard:05d}-{self.roll:05d}.warc.gz"
        self.temporary = f"{self.folder}/{self.name}.{self.attempt}"
        self.stream = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
        self.size, self.records, self.digest = 0, 0, hashlib.sha256()
        self._put(records.info_record(self.name, self.date))

    def _put(self, record: bytes) -> None:
        packed = records.member(record, self.level)
        self.stream.write(packed)
        self.digest.update(packed)
        self.size += len(packed)

    def _close(self) -> None:
        if self.stream is None:
            return
        self.stream.close()
        self.stream = None
        self.written.append(
            {
                "file": self.name, "temporary": self.temporary, "shard": self.shard, "roll": self.roll,
                "records": self.records, "bytes": self.size, "sha256": self.digest.hexdigest(),
            }
        )


def manifest(spark: SparkSession, dest: str) -> DataFrame:
    """file, shard, roll, records, bytes, sha256 of every file of a finished archive."""
    schema = _MANIFEST_SCHEMA.replace("temporary string, ", "")
    return spark.read.schema(schema).parquet(f"{dest.rstrip('/')}/{_MANIFEST}")


def read_archive(spark: SparkSession, dest: str, id_type: str = "long") -> DataFrame:
    """One row per record: row_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, sound.

    A revisit's payload is null; its payload_bytes and payload_digest are those of the full payload. ``sound`` tells whether block
    and payload agree with their digests. Urls come as they stand in the archive, with line ends, spaces and characters beyond ASCII
    percent-encoded. A file whose records are cut short or not as many as the manifest says is an error.
    """
    ensure_on_executors(spark)
    there = _target(spark, dest.rstrip("/"))
    names = ["row_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound"]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
    schema = "row_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string, sound boolean"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(there)
        for batch in batches:
            for entry in batch.to_pylist():
                rows, held, n = [], 0, 0
                with fs.open_input_stream(f"{root}/{entry['file']}", compression=None) as stream:
                    for data in records.members(stream):
                        r = records.parsed(data)
                        if r.kind == "warcinfo":
                            continue
                        rows.append(_row(r))
                        n, held = n + 1, held + len(r.payload)
                        if held > _SLICE or len(rows) >= 4096:
                            yield _batch(rows, names, kinds)
                            rows, held = [], 0
                if n != entry["records"]:
                    raise records.DamagedArchive(f"{entry['file']} holds {n} records, not {entry['records']}")
                yield _batch(rows, names, kinds)

    files = manifest(spark, dest).select("file", "records", "shard")
    shards = (files.agg(F.max("shard")).first()[0] or 0) + 1
    read = files.repartitionById(shards, F.col("shard")).mapInArrow(unpack, schema)
    return read.withColumns({c: F.col(c).cast(id_type) for c in ("row_id", "refers_to")})


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _row(r: records.Record) -> tuple:
    revisit = r.kind == "revisit"
    row_id, other = (None if x is None else unquote(x) for x in (r.fields.get(records.ROW_ID), r.fields.get(records.REFERS_TO_ROW)))
    return (
        row_id, r.fields.get("WARC-Target-URI"), None if revisit else r.payload, int(r.http_fields["Content-Length"]),
        records.hex_of(r.fields["WARC-Payload-Digest"]), r.kind, other, r.sound,
    )
