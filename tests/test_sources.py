import zipfile
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from patternflow import FLAG, detect_kind, export, export_excel, preview, read_csv, read_table, scratch_path
from patternflow.functions.cells import excel_safe
from patternflow.sources.readers import EmptyTableError, has_multi_line_cells
from patternflow.sources.writers import TooLargeForExcel, check_fits_excel


def rows(df):
    return [tuple(r) for r in df.collect()]


def write(tmp_path, text, name="t.csv", encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize(
    "name, kind",
    [("a.csv", "csv"), ("a.XLSX", "excel"), ("b.xlsm", "excel"), ("c.xls", "excel"), ("d.txt", "csv"), ("e", "csv")],
)
def test_kind_by_name(name, kind):
    assert detect_kind(name) == kind


def test_people_csv(spark, tmp_path):
    df = read_table(spark, write(tmp_path, "ID,Name,Email\n1,Ann,a@x.com\n2,Bob,\n"))
    assert df.columns == ["ID", "Name", "Email"]
    assert rows(df) == [("1", "Ann", "a@x.com"), ("2", "Bob", None)]
    assert rows(preview(df, 2))[1] == ("2", "Bob", "")


def test_header_clean_up(spark, tmp_path):
    assert read_csv(spark, write(tmp_path, "﻿ ID , Name\n1,x\n")).columns == ["ID", "Name"]
    clash = read_csv(spark, write(tmp_path, "a, a,b\n1,2,3\n", "clash.csv"))
    assert clash.columns == ["a", " a", "b"]


def test_short_and_long_rows(spark, tmp_path):
    assert rows(read_csv(spark, write(tmp_path, "a,b\n1\n1,2,3\n"))) == [("1", None), ("1", "2")]


def test_quoted_line_breaks_are_noticed(spark, tmp_path):
    plain = write(tmp_path, 'ID,Note\n1,"said ""hi"", left"\n2,ok\n', "plain.csv")
    broken = write(tmp_path, 'ID,Note\n1,"line one\nline two"\n2,ok\n', "broken.csv")
    assert not has_multi_line_cells(spark, plain)
    assert has_multi_line_cells(spark, broken)
    assert rows(read_csv(spark, plain)) == [("1", 'said "hi", left'), ("2", "ok")]
    assert rows(read_csv(spark, broken)) == [("1", "line one\nline two"), ("2", "ok")]


@pytest.mark.parametrize(
    "line, plain",
    [
        ('1,"a","b,c",', True),
        ('"",""""," "" "', True),
        ('"a""b","""x","x"""', True),
        ('say ""hi"",2', True),
        ('1,"open', False),
        ('a"b,"c', False),
        ('"a"b",c"', False),
        ('5" pipe,2', False),
    ],
)
def test_lines_that_leave_no_cell_open(spark, tmp_path, line, plain):
    assert has_multi_line_cells(spark, write(tmp_path, f"a,b\n{line}\n")) is not plain


def test_clean_csv_is_split(spark, tmp_path):
    body = "".join(f"{i},{'x' * 50}\n" for i in range(20_000))
    path = write(tmp_path, "id,t\n" + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        df = read_csv(spark, path)
        assert df.rdd.getNumPartitions() > 3
        assert df.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_no_header_is_refused(spark, tmp_path):
    with pytest.raises(EmptyTableError):
        read_csv(spark, write(tmp_path, ""))


@pytest.fixture(scope="module")
def awkward(spark):
    data = [("a\x07b", 42, True), (None, 7, False), ("x" * 40_000, 1, True)]
    return spark.createDataFrame(data, f"name string, num int, {FLAG} boolean").coalesce(1)


def test_excel_cells(awkward):
    out = rows(excel_safe(awkward.drop(FLAG)))
    assert out[0] == ("ab", 42) and out[1] == (None, 7)
    assert len(out[2][0]) == 32_767


def test_workbook_round_trip(spark, awkward):
    path = scratch_path(spark, "book") + ".xlsx"
    assert export_excel(awkward, path) == 3
    back = read_table(spark, path)
    assert back.columns == ["name", "num"]
    got = rows(back)
    assert got[:2] == [("ab", "42"), (None, "7")] and len(got[2][0]) == 32_767


def test_workbook_export_of_selected_rows(spark, awkward):
    path = scratch_path(spark, "book") + ".xlsx"
    export(awkward, path, "xlsx", matched_only=True)
    assert [r["num"] for r in read_table(spark, path).collect()] == ["42", "1"]


def test_csv_export_of_selected_rows(spark, awkward):
    path = scratch_path(spark, "csv")
    export(awkward, path, "csv", matched_only=True)
    assert [r["num"] for r in read_csv(spark, path).collect()] == ["42", "1"]
    with pytest.raises(ValueError):
        export(awkward, path, "pdf")


def test_typed_cells_keep_their_type(spark):
    data = [(date(2024, 2, 3), datetime(2024, 2, 3, 4, 5, 6), True, Decimal("1.50"), 2.5, "<&>")]
    df = spark.createDataFrame(data, "d date, t timestamp, b boolean, n decimal(5,2), f double, s string")
    path = scratch_path(spark, "book") + ".xlsx"
    export_excel(df, path)
    assert rows(read_table(spark, path)) == [
        ("2024-02-03 00:00:00", "2024-02-03 04:05:06", "True", "1.5", "2.5", "<&>")
    ]


def test_too_large_for_a_worksheet(spark, awkward):
    with pytest.raises(TooLargeForExcel, match="CSV"):
        check_fits_excel(awkward, max_rows=3)
    with pytest.raises(TooLargeForExcel, match="columns"):
        check_fits_excel(awkward, max_columns=2)
    assert check_fits_excel(awkward, max_rows=4) == 3


def _book(path, sheet, shared="", styles="", sheets=1, active=0, props=""):
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    names = "".join(f'<sheet name="s{i}" sheetId="{i}" r:id="r{i}"/>' for i in range(sheets))
    targets = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(sheets))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns:r="{rel}">{props}<bookViews><workbookView activeTab="{active}"/></bookViews><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{targets}</Relationships>")
        z.writestr(f"xl/worksheets/sheet{active}.xml", f"<worksheet><sheetData>{sheet}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst>{shared}</sst>")
        z.writestr("xl/styles.xml", f"<styleSheet>{styles}</styleSheet>")
    return str(path)


def test_workbook_details(spark, tmp_path):
    shared = "<si><t> ID </t></si><si><r><t>Na</t></r><r><t>me</t></r><rPh><t>no</t></rPh></si><si><t>When</t></si>"
    styles = '<numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="20"/></cellXfs>'
    sheet = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row>'
        '<row r="2"><c r="A2"><v>1</v></c><c r="B2" t="inlineStr"><is><t>Ann</t></is></c><c r="C2" s="1"><v>45325</v></c></row>'
        '<row r="4"><c r="A4" s="2"><v>1.5</v></c><c r="C4" s="3"><v>0.5</v></c></row>'
        '<row r="5"><c r="B5" t="b"><v>1</v></c><c r="C5" t="str"><v>f</v></c><c r="D5"><v>9</v></c></row>'
    )
    path = _book(tmp_path / "people.xlsx", sheet, shared, styles, sheets=3, active=2)
    df = read_table(spark, path)
    assert df.columns == ["ID", "Name", "When"]
    assert rows(df) == [
        ("1", "Ann", "2024-02-03 00:00:00"),
        (None, None, None),
        ("1.5", None, "12:00:00"),
        (None, "True", "f"),
    ]


def test_folder_of_workbooks(spark, tmp_path):
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>'
    for i in (1, 2):
        _book(tmp_path / f"b{i}.xlsx", f"<row>{cell('a')}</row><row>{cell(i)}</row>")
    assert sorted(rows(read_table(spark, str(tmp_path), "excel"))) == [("1",), ("2",)]
    _book(tmp_path / "b3.xlsx", f"<row>{cell('other')}</row>")
    with pytest.raises(ValueError, match="different headers"):
        read_table(spark, str(tmp_path), "excel")


def test_legacy_workbook_is_refused(spark, tmp_path):
    path = write(tmp_path, "not a zip", "old.xls")
    with pytest.raises(Exception, match="Not an .xlsx workbook"):
        read_table(spark, path)


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        read_table(spark, "x", "json")


def test_contacts_are_stable(spark):
    from patternflow import contacts

    a, b = contacts(spark, 500, seed=1), contacts(spark, 500, seed=1).repartition(3)
    assert a.columns == ["ID", "Name", "Email", "Phone", "Notes"]
    assert a.exceptAll(b).count() == 0 and a.count() == 500
    odd = a.filter(~F.col("Phone").rlike(r"^\([2-9]\d\d\) [2-9]\d\d-[1-9]\d{3}$"))
    assert odd.count() == 0
    assert contacts(spark, 500, seed=2).exceptAll(a).count() > 400


def test_files_of_a_folder_must_agree(spark, tmp_path):
    write(tmp_path, "id,name\n1,x\n", "a.csv")
    write(tmp_path, "id,name\n2,y\n", "b.csv")
    assert sorted(rows(read_csv(spark, str(tmp_path)))) == [("1", "x"), ("2", "y")]
    write(tmp_path, "name,id\nz,3\n", "c.csv")
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path)).collect()


def test_csv_export_keeps_every_cell(spark):
    data = [(" lead trail ", 'q"q', "a\r\nb\rc"), ("back\\slash", '\\"', ","), (None, "  ", None)]
    df = spark.createDataFrame(data, "a string, b string, c string")
    path = scratch_path(spark, "csv")
    export(df, path)
    assert sorted(rows(read_csv(spark, path)), key=str) == sorted(data, key=str)


def test_csv_export_of_one_column_keeps_empty_rows(spark):
    path = scratch_path(spark, "csv")
    export(spark.createDataFrame([("a",), (None,), ("",), ("b",)], "c string").coalesce(1), path)
    assert rows(read_csv(spark, path)) == [("a",), (None,), (None,), ("b",)]


def test_excel_export_of_wall_clock_time(spark):
    path = scratch_path(spark, "book") + ".xlsx"
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        export_excel(spark.sql("SELECT timestamp'2024-07-01 10:00:00' AS t"), path)
        assert rows(read_table(spark, path)) == [("2024-07-01 10:00:00",)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_excel_export_keeps_row_order(spark):
    path = scratch_path(spark, "book") + ".xlsx"
    df = spark.range(0, 20_000, 1, 8).withColumn(FLAG, F.col("id") % 3 == 0)
    assert export_excel(df, path, matched_only=True) == 6667
    assert [int(r["id"]) for r in read_table(spark, path).collect()] == list(range(0, 20_000, 3))
