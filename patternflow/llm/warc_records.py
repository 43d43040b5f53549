"""WARC records as bytes: building one and reading a file of them, member by member."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote

VERSION = b"WARC/1.1"
#: A revisit record of this profile has the response's HTTP header and not its payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Extension fields: the row's identifier, and that of the row a revisit refers to.
ROW_ID, REFERS_TO_ROW = "Row-ID", "Refers-To-Row-ID"
_END = b"\r\n\r\n"
#: Bytes fetched from a file, and let out of the decompressor, at a time.
_CHUNK = 1 << 18


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_of(labelled: str) -> str:
    """The bare hex digest of a labelled base-32 one."""
    return base64.b32decode(labelled.removeprefix("sha1:")).hex()


def record_id(*parts: str | None) -> str:
    """A name that depends on nothing but ``parts``; null and empty differ."""
    key = "\x1f".join("-" if p is None else f"+{p}" for p in parts)
    h = hashlib.sha256(key.encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[13:16]}-8{h[17:20]}-{h[20:32]}>"


def header_value(text: str, exact: bool = False) -> str:
    """``text`` with all that could break a header line, such as line ends, percent-encoded.

    With ``exact`` the percent sign is encoded too, so that decoding gives ``text`` back.
    """
    visible = "".join(map(chr, range(33, 127)))
    return quote(text, safe=visible.replace("%", "") if exact else visible)


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    lines = [f"{k}: {v}".encode() for k, v in fields if v is not None]
    return b"\r\n".join([VERSION, *lines]) + _END


def http_header(payload_bytes: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % payload_bytes + _END


def info_record(name: str, date: str) -> bytes:
    """The record that starts a file."""
    block = b"format: WARC File Format 1.1\r\n"
    head = [
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", name)), ("WARC-Date", date), ("WARC-Filename", name),
        ("WARC-Block-Digest", sha1_base32(block)), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block))),
    ]
    return _header(head) + block + _END


def page_record(
    row_id: str | None, url: str | None, payload: bytes, date: str, refers_to: tuple[str | None, str | None] | None
) -> bytes:
    """A response, or where ``refers_to`` names another row and its url, a revisit of it; digests are worked out here."""
    digest = sha1_base32(payload)
    block = http_header(len(payload)) + (payload if refers_to is None else b"")
    head: list[tuple[str, str | None]] = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(row_id, url, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else header_value(url)),
        (ROW_ID, None if row_id is None else header_value(row_id, exact=True)),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", sha1_base32(block)),
    ]
    if refers_to is not None:
        row, its_url = refers_to
        head += [
            ("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", record_id(row, its_url, digest)),
            ("WARC-Refers-To-Target-URI", None if its_url is None else header_value(its_url)),
            (REFERS_TO_ROW, None if row is None else header_value(row, exact=True)),
        ]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(head) + block + _END


def member(record: bytes, level: int) -> bytes:
    """The record as a gzip member of its own; the same bytes each time, as no clock is in it."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(record) + squeeze.flush()


@dataclass(frozen=True)
class Record:
    kind: str
    fields: dict[str, str]
    payload: bytes
    http_fields: dict[str, str] = field(default_factory=dict)
    #: Whether block and payload are those that the digests name.
    sound: bool = True


class DamagedArchive(ValueError):
    """A file that does not hold the records it should."""


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The unpacked gzip members of a file, one at a time."""
    raw = b""
    while raw := raw or stream.read(_CHUNK):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            parts.append(unpack.decompress(raw))
            raw = unpack.unused_data if unpack.eof else stream.read(_CHUNK)
            if not raw and not unpack.eof:
                raise DamagedArchive("A file ends within a record")
        yield b"".join(parts)


def parsed(data: bytes) -> Record:
    """One record from its bytes."""
    head, ok, rest = data.partition(_END)
    lines = head.decode().split("\r\n")
    if not ok or lines[0] != VERSION.decode():
        raise DamagedArchive("A record does not start with a WARC header")
    fields = _fields(lines[1:])
    length = int(fields["Content-Length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != _END:
        raise DamagedArchive("A record's length is not what its header says")
    kind, http, payload = fields["WARC-Type"], {}, block
    sound = sha1_base32(block) == fields["WARC-Block-Digest"]
    if kind in ("response", "revisit"):
        http_head, _, payload = block.partition(_END)
        http = _fields(http_head.decode().split("\r\n")[1:])
        if kind == "response":
            sound = sound and sha1_base32(payload) == fields["WARC-Payload-Digest"] and len(payload) == int(http["Content-Length"])
    return Record(kind, fields, payload, http, sound)


def _fields(lines: list[str]) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in lines)
