"""Reading .xlsx/.xlsm workbooks on the executors, one workbook per row of a file scan.

Spark lists and ships the files (any file system it knows) and each task unpacks
its own; rows leave in batches while the sheet is still being parsed. The format
caps a sheet at about a million rows, which bounds the work of one task. Legacy
binary .xls files are not zip archives and are refused by name.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree.ElementTree import iterparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from patternflow.session import ensure_on_executors

_BATCH_ROWS = 5000

# Built-in number formats that show a date or a time. Fixed values of the format.
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)])
_QUOTED_FORMAT = re.compile(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.IGNORECASE)


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _read_text(element) -> str:
    """All text runs below an element, phonetic hints left out."""
    parts = []
    for child in element:
        name = _tag(child)
        if name == "t":
            parts.append(child.text or "")
        elif name == "r":
            parts.append(_read_text(child))
    return "".join(parts)


class _Book:
    def __init__(self, content: bytes, path: str):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as exc:
            raise ValueError(f"Not an .xlsx workbook: {path}") from exc
        self.path = path
        self.strings = self._shared_strings()
        self.date_styles = self._date_styles()
        self.sheet, self.epoch = self._active_sheet()

    def _elements(self, part: str, *names: str, within: str = ""):
        """Finished elements by name; children of ``within`` are dropped once used."""
        if part not in self.zip.namelist():
            return
        parent = None
        with self.zip.open(part) as fh:
            for event, element in iterparse(fh, events=("start", "end")):
                if event == "start":
                    parent = element if _tag(element) == within else parent
                elif _tag(element) in names:
                    yield element
                    if parent is not None:
                        parent.clear()

    def _shared_strings(self) -> list[str]:
        out = []
        for si in self._elements("xl/sharedStrings.xml", "si", within="sst"):
            out.append(_read_text(si))
        return out

    def _date_styles(self) -> set[int]:
        custom: dict[int, str] = {}
        styles: set[int] = set()
        for e in self._elements("xl/styles.xml", "numFmt", "cellXfs"):
            if _tag(e) == "numFmt":
                custom[int(e.get("numFmtId"))] = e.get("formatCode", "")
                continue
            for i, xf in enumerate(e):
                fmt = int(xf.get("numFmtId", 0))
                code = _QUOTED_FORMAT.sub("", custom.get(fmt, "")).split(";")[0]
                if fmt in _DATE_FORMATS or re.search(r"[dmhysDMHYS]", code):
                    styles.add(i)
        return styles

    def _active_sheet(self) -> tuple[str, datetime]:
        active, sheets, epoch = 0, [], datetime(1899, 12, 30)
        for e in self._elements("xl/workbook.xml", "workbookPr", "workbookView", "sheet"):
            if _tag(e) == "workbookPr" and e.get("date1904") in ("1", "true"):
                epoch = datetime(1904, 1, 1)
            elif _tag(e) == "workbookView":
                active = int(e.get("activeTab", active))
            elif _tag(e) == "sheet":
                sheets.append(next(v for k, v in e.attrib.items() if k.endswith("}id")))
        if not sheets:
            raise ValueError(f"The workbook has no worksheet: {self.path}")
        targets = {
            e.get("Id"): e.get("Target")
            for e in self._elements("xl/_rels/workbook.xml.rels", "Relationship")
        }
        target = targets[sheets[active if active < len(sheets) else 0]]
        return posixpath.normpath(posixpath.join("/xl", target)).lstrip("/"), epoch

    def rows(self) -> Iterator[list[str | None]]:
        """Rows of the active sheet as text cells; gaps between rows are empty rows."""
        expected = 1
        for row in self._elements(self.sheet, "row", within="sheetData"):
            number = int(row.get("r", expected))
            for _ in range(number - expected):
                yield []
            expected = number + 1
            cells: list[str | None] = []
            for c in row:
                if _tag(c) != "c":
                    continue
                at = _column_index(c.get("r")) if c.get("r") else len(cells)
                cells.extend([None] * (at - len(cells)))
                cells.append(self._cell(c))
            yield cells

    def _cell(self, c) -> str | None:
        kind = c.get("t", "n")
        if kind == "inlineStr":
            return next((_read_text(e) for e in c if _tag(e) == "is"), None)
        raw = next((e.text for e in c if _tag(e) == "v"), None)
        if raw is None:
            return None
        if kind == "s":
            return self.strings[int(raw)]
        if kind == "b":
            return "True" if raw == "1" else "False"
        if kind != "n":
            return raw
        number = float(raw) if re.search(r"[.eE]", raw) else int(raw)
        if int(c.get("s", 0)) in self.date_styles:
            return self._moment(number)
        return str(number)

    def _moment(self, serial: float) -> str:
        if self.epoch.year == 1899 and serial < 60:
            # The 1900 calendar counts a 29 February that never was.
            serial += 1 if serial >= 1 else 0
        exact = self.epoch + timedelta(days=serial)
        moment = (exact + timedelta(microseconds=500)).replace(microsecond=0)
        if abs(exact - moment) > timedelta(milliseconds=1):
            moment = exact
        return str(moment.time()) if 0 <= serial < 1 else str(moment)


def _column_index(cell: str) -> int:
    n = 0
    for ch in cell:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _header(cells: list[str | None]) -> list[str]:
    names = [(c or "").strip() for c in cells]
    while names and not names[-1]:
        names.pop()
    seen: dict[str, int] = {}
    for n in names:
        seen[n.lower()] = seen.get(n.lower(), 0) + 1
    # Blank and repeated names are told apart by position, as for CSV.
    return [f"_c{i}" if not n else f"{n}{i}" if seen[n.lower()] > 1 else n for i, n in enumerate(names)]


def _files(spark: SparkSession, path: str) -> DataFrame:
    ensure_on_executors(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content")


def workbook_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the workbook, or of all workbooks in a folder if they agree."""

    def headers(batches):
        for batch in batches:
            for source, content in zip(batch["path"], batch["content"]):
                cells = next(_Book(content, source).rows(), [])
                yield pd.DataFrame({"header": [_header(cells)]})

    found = _files(spark, path).mapInPandas(headers, "header array<string>").distinct().take(2)
    if len(found) > 1:
        raise ValueError(f"Workbooks under {path} have different headers")
    return list(found[0]["header"]) if found else []


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """The active sheet of each workbook, row 1 as header, all cells as nullable strings."""
    columns = workbook_header(spark, path)
    width = len(columns)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])

    def rows(batches):
        for batch in batches:
            for source, content in zip(batch["path"], batch["content"]):
                sheet = _Book(content, source).rows()
                next(sheet, None)
                buffer: list[list[str | None]] = []
                for cells in sheet:
                    # Empty cells read as null, just as in a CSV file.
                    kept = [c or None for c in cells[:width]]
                    buffer.append(kept + [None] * (width - len(kept)))
                    if len(buffer) == _BATCH_ROWS:
                        yield pd.DataFrame(buffer, columns=columns, dtype=object)
                        buffer = []
                if buffer:
                    yield pd.DataFrame(buffer, columns=columns, dtype=object)

    if not columns:
        return spark.range(0).select()
    return _files(spark, path).mapInPandas(rows, schema)
