"""WARC archives: round trips, equal bytes on reruns, rolled files, commits."""

import gzip
import hashlib
import io
import re

import pyarrow.fs
import pytest

from patternflow.llm import warc
from patternflow.llm import warc_records as records

SCHEMA = "page_id long, url string, html string, place string, first int, shard int, digest string, size int"
BIG = "é <p>\r\n\r\n" * 150
ROWS = [
    (1, "http://a/1", BIG),
    (2, "http://a/2", BIG),
    (3, "http://b/3", BIG),
    (3, "http://b/33", BIG),
    (4, "http://c", None),
    (5, None, ""),
    (6, "http://d/\r\nX: y z%20", "short"),
    (7, "http://d/ü", "short"),
    (-5, "", "x" * 1000),
    (-7, "http://e", "x" * 1000),
    (8, "http://f", "x" * 999),
    (9, "http://f", "x" * 999),
    (None, "http://g", BIG),
    (None, "http://g", "only nulls" * 200),
    (None, "http://h", "only nulls" * 200),
    (10, "http://i", "twice" * 300),
    (10, "http://i", "twice" * 300),
    (11, "http://j", "\x00 ß 😀" * 60_000),
]


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "p", 1, 2, "d", 3) for r in rows], SCHEMA).repartition(parts)


def expected(rows, least=1000):
    largest = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= least:
            largest[html] = max(i, largest.get(html, i))
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        first = largest.get(html)
        revisit = first is not None and first != i
        shown = None if url is None else records.header_value(url)
        out.append((i, shown, None if revisit else data, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None, True))
    return sorted(out, key=repr)


def read(spark, dest):
    names = ["row_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound"]
    rows = warc.read_archive(spark, dest).select(*names).collect()
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows), key=repr)


def files(dest):
    return {f.name: f.read_bytes() for f in sorted(dest.glob("*.warc.gz"))}


def test_messy_rows_come_back(spark, tmp_path):
    dest = tmp_path / "archive"
    listed = warc.write_archive(table(spark, ROWS), str(dest))
    assert read(spark, str(dest)) == expected(ROWS)
    assert sum(r["records"] for r in listed.collect()) == len(ROWS)


def test_equal_rows_give_equal_files_however_they_are_dealt(spark, tmp_path):
    rows = [(i, f"http://x/{i % 7}", f"text {i % 40} " * 120) for i in range(300)]
    written = []
    for k, parts in enumerate((1, 5, 9)):
        dest = tmp_path / f"run{k}"
        warc.write_archive(table(spark, rows[k * 50 :] + rows[: k * 50], parts), str(dest), shard_bytes=40_000, roll_bytes=1500)
        written.append(files(dest))
    assert written[0] == written[1] == written[2]
    shards = {name.split("-")[1] for name in written[0]}
    assert len(shards) > 3 and len(written[0]) > len(shards)
    # A file ends with the record that takes it past its size, and records are in order over all files.
    ids = [int(i) for data in written[0].values() for i in re.findall(rb"\r\nRow-ID: (\d+)\r\n", gzip.decompress(data))]
    assert ids == sorted(ids) and len(ids) == 300
    assert read(spark, str(tmp_path / "run2")) == expected(rows)


def test_manifest_lists_what_is_there(spark, tmp_path):
    dest = tmp_path / "archive"
    warc.write_archive(table(spark, ROWS), str(dest), shard_bytes=2000, roll_bytes=400)
    there = files(dest)
    for r in warc.manifest(spark, str(dest)).collect():
        assert (len(there[r["file"]]), hashlib.sha256(there[r["file"]]).hexdigest()) == (r["bytes"], r["sha256"])
        assert len(list(records.members(io.BytesIO(there[r["file"]])))) == r["records"] + 1
    assert not list(dest.glob("_temporary*"))
    with pytest.raises(FileExistsError):
        warc.write_archive(table(spark, ROWS), str(dest))


def test_files_that_the_manifest_lacks_are_not_read(spark, tmp_path):
    dest = tmp_path / "archive"
    dest.mkdir()
    (dest / "shard-00000-00000.warc.gz").write_bytes(b"left by a run that ended before its manifest")
    (dest / "shard-00009-00000.warc.gz").write_bytes(b"left too")
    warc.write_archive(table(spark, ROWS), str(dest))
    assert read(spark, str(dest)) == expected(ROWS)


def test_damage_is_found(spark, tmp_path):
    dest = tmp_path / "archive"
    warc.write_archive(table(spark, ROWS), str(dest))
    name, data = next(iter(files(dest).items()))
    parts = list(records.members(io.BytesIO(data)))
    changed = [p.replace(b"short", b"shirt") for p in parts]
    (dest / name).write_bytes(b"".join(records.member(p, 6) for p in changed))
    assert {r[0] for r in read(spark, str(dest)) if not r[-1]} == {6, 7}
    (dest / name).write_bytes(b"".join(records.member(p, 6) for p in parts[:-1]))
    with pytest.raises(Exception, match="records, not"):
        read(spark, str(dest))


def test_a_rename_done_before_is_not_done_again(tmp_path):
    fs = pyarrow.fs.LocalFileSystem()
    (tmp_path / "a.tmp").write_bytes(b"12345")
    for _ in range(2):
        warc._take_place(fs, f"{tmp_path}/a.tmp", f"{tmp_path}/a", 5)
    assert (tmp_path / "a").read_bytes() == b"12345"
    with pytest.raises(records.DamagedArchive):
        warc._take_place(fs, f"{tmp_path}/a.tmp", f"{tmp_path}/a", 6)


def test_no_rows_and_text_identifiers(spark, tmp_path):
    warc.write_archive(table(spark, []), str(tmp_path / "none"))
    assert read(spark, str(tmp_path / "none")) == []
    named = spark.createDataFrame([("b%20\n", BIG), ("a", BIG), ("ü", "x")], "key string, body string")
    named = named.selectExpr("key", "cast(null as string) as link", "body")
    warc.write_archive(named, str(tmp_path / "text"), "key", "link", "body")
    found = warc.read_archive(spark, str(tmp_path / "text"), "string").select("row_id", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found)) == [("a", "revisit", "b%20\n"), ("b%20\n", "response", None), ("ü", "response", None)]


def test_one_group_of_copies_is_dealt_over_salts(spark, tmp_path):
    rows = [(i, f"http://x/{i}", BIG) for i in range(400)]
    warc.write_archive(table(spark, rows), str(tmp_path / "copies"))
    assert read(spark, str(tmp_path / "copies")) == expected(rows)


def test_members_of_any_chunking(monkeypatch):
    data = [b"one", b"", b"two" * 1000]
    packed = b"".join(records.member(d, 6) for d in data)
    for chunk in (1, 7, 1 << 18):
        monkeypatch.setattr(records, "_CHUNK", chunk)
        assert list(records.members(io.BytesIO(packed))) == data
    with pytest.raises(records.DamagedArchive):
        list(records.members(io.BytesIO(packed[:-3])))
