"""A write-only data source for a single-sheet .xlsx workbook.

Rows stream straight into the zip archive. A task writes under a name of its
own and the driver renames the winning attempt on commit, so a lost or repeated
task leaves no half-written workbook behind.
"""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

# Fixed parts of the file format.
_NS = "http://schemas.openxmlformats.org/"
_PARTS = {
    "[Content_Types].xml": (
        f'<Types xmlns="{_NS}package/2006/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
        '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
        "</Types>"
    ),
    "_rels/.rels": (
        f'<Relationships xmlns="{_NS}package/2006/relationships">'
        f'<Relationship Id="rId1" Type="{_NS}officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
        "</Relationships>"
    ),
    "xl/workbook.xml": (
        f'<workbook xmlns="{_NS}spreadsheetml/2006/main" xmlns:r="{_NS}officeDocument/2006/relationships">'
        '<sheets><sheet name="Results" sheetId="1" r:id="rId1"/></sheets></workbook>'
    ),
    "xl/_rels/workbook.xml.rels": (
        f'<Relationships xmlns="{_NS}package/2006/relationships">'
        f'<Relationship Id="rId1" Type="{_NS}officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
        f'<Relationship Id="rId2" Type="{_NS}officeDocument/2006/relationships/styles" Target="styles.xml"/>'
        "</Relationships>"
    ),
    # Cell styles: 0 general, 1 date, 2 date and time.
    "xl/styles.xml": (
        f'<styleSheet xmlns="{_NS}spreadsheetml/2006/main">'
        '<numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm:ss"/></numFmts>'
        '<fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders>'
        '<cellStyleXfs count="1"><xf/></cellStyleXfs>'
        '<cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="14" applyNumberFormat="1"/>'
        '<xf numFmtId="164" applyNumberFormat="1"/></cellXfs></styleSheet>'
    ),
}
_EPOCH = datetime(1899, 12, 30)


def _cell(value) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, Decimal)) or (isinstance(value, float) and value - value == 0):
        return f"<c><v>{value}</v></c>"
    if isinstance(value, datetime):
        days = (value.replace(tzinfo=None) - _EPOCH).total_seconds() / 86400
        return f'<c s="2"><v>{days!r}</v></c>'
    if isinstance(value, date):
        return f'<c s="1"><v>{value.toordinal() - _EPOCH.toordinal()}</v></c>'
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


@dataclass
class _Written(WriterCommitMessage):
    file: str
    rows: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def write(self, iterator: Iterator) -> _Written:
        part = f"{self.path}.{uuid.uuid4().hex}.part"
        rows = 0
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as book:
            for name, xml in _PARTS.items():
                book.writestr(name, xml)
            with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                sheet.write(
                    f'<worksheet xmlns={quoteattr(_NS + "spreadsheetml/2006/main")}><sheetData>'.encode()
                )
                sheet.write(f"<row>{''.join(map(_cell, self.names))}</row>".encode())
                for row in iterator:
                    sheet.write(f"<row>{''.join(map(_cell, row))}</row>".encode())
                    rows += 1
                sheet.write(b"</sheetData></worksheet>")
        return _Written(part, rows)

    def commit(self, messages) -> None:
        parts = [m for m in messages if m is not None]
        if len(parts) != 1:
            self.abort(messages)
            raise ValueError("A workbook is written from exactly one partition")
        os.replace(parts[0].file, self.path)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.file):
                os.unlink(m.file)


class WorkbookSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "patternflow_xlsx"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        path = self.options["path"].removeprefix("file://")
        if not overwrite and os.path.exists(path):
            raise FileExistsError(path)
        return _Writer(path, list(schema.names))
