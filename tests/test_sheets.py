"""Spreadsheets: what is written comes back, and workbooks of other programs' making are read."""

import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.sources import io, sheets

DAY = datetime.datetime(2024, 2, 29, 13, 45, 30)


def test_round_trip_of_types_nulls_and_two_sheets(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    a = spark.createDataFrame([(1, 1.5, "a & <b> é 😀", True, DAY), (2, None, " spaces \n", None, None), (None, float("inf"), "_x0041_ \x01", False, DAY), (2**60, -0.25, "", True, DAY)], "i long, d double, s string, b boolean, t timestamp_ntz").coalesce(1)
    b = spark.range(12_000).select("id", (F.col("id") / 8).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"))
    sheets.write({"first & only": a, "long": b}, path)
    got = sheets.read(spark, path, "first & only")
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "string", "boolean", "timestamp_ntz"]  # 2 ** 60 and inf are text
    assert [tuple(r) for r in got.collect()] == [("1", "1.5", "a & <b> é 😀", True, DAY), ("2", None, " spaces \n", None, None), (None, "inf", "_x0041_ \x01", False, DAY), (str(2**60), "-0.25", "", True, DAY)]
    second = sheets.read(spark, path, 1)
    assert [f.dataType.simpleString() for f in second.schema] == ["bigint", "double", "string"]
    assert sorted(map(tuple, second.collect()), key=lambda r: r[0]) == [tuple(r) for r in b.orderBy("id").collect()]
    with pytest.raises(Exception, match="no sheet"):
        sheets.read(spark, path, "third").collect()


def book(path, rows, styles="", shared="", setting=""):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{sheets.MAIN[1:-1]}" xmlns:r="{sheets.RELATION[1:-1]}">{setting}<sheets><sheet name="S" sheetId="1" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{sheets.PACKAGE}/relationships"><Relationship Id="a" Target="/xl/worksheets/one.xml"/></Relationships>')
        z.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{sheets.MAIN[1:-1]}"><sheetData>{rows}</sheetData></worksheet>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{sheets.MAIN[1:-1]}">{styles}</styleSheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{sheets.MAIN[1:-1]}">{shared}</sst>')


def test_shared_texts_formats_gaps_and_errors(spark, tmp_path):
    rows = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>0</v></c><c r="D1" t="inlineStr"><is><t>when</t></is></c></row><row/>'
    rows += '<row><c r="B3"><v>1E3</v></c><c r="C3" t="e"><v>#N/A</v></c><c r="D3" s="1"><v>1.5</v></c></row><row><c r="A4" t="str"><f>x</f><v>run</v></c><c r="C4"><v>7</v></c></row>'
    styles = '<numFmts><numFmt numFmtId="164" formatCode="yyyy&quot;s&quot;"/><numFmt numFmtId="165" formatCode="0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="165"/><xf numFmtId="164"/></cellXfs>'
    book(tmp_path / "a.xlsx", rows, styles, "<si><r><t>na</t></r><r><t>me</t></r><rPh><t>x</t></rPh></si>", '<workbookPr date1904="1"/>')
    got = io.load(spark, str(tmp_path / "a.xlsx"))
    assert got.columns == ["name", "column1", "name_1", "when"]
    assert [tuple(r) for r in got.collect()] == [(None, 1000.0, None, datetime.datetime(1904, 1, 2, 12)), ("run", None, 7, None)]


def test_a_folder_of_books_is_one_table(spark, tmp_path):
    book(tmp_path / "a.xlsx", '<row><c r="A1" t="inlineStr"><is><t>k</t></is></c></row><row><c r="A2"><v>1</v></c></row>')
    book(tmp_path / "b.xlsx", '<row><c r="A1" t="inlineStr"><is><t>k</t></is></c><c r="B1" t="inlineStr"><is><t>z</t></is></c></row><row><c r="A2"><v>2.5</v></c><c r="B2" t="b"><v>1</v></c></row>')
    book(tmp_path / "empty.xlsx", "")
    (tmp_path / "note.txt").write_text("not a book")
    got = sheets.read(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1.0, None), (2.5, True)]


def test_what_does_not_fit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "MOST_ROWS", 10)
    with pytest.raises(ValueError, match="does not fit"):
        io.save(spark.range(10), str(tmp_path / "x.xlsx"))
    io.save(spark.range(9), str(tmp_path / "x.xlsx"))
    assert io.load(spark, str(tmp_path / "x.xlsx")).count() == 9
    with pytest.raises(ValueError, match="old binary"):
        io.load(spark, "x.xls")


def test_a_table_of_more_rows_than_a_sheet_is_a_folder_of_books(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "MOST_ROWS", 10)
    df = spark.range(95).repartition(3).selectExpr("id", "if(id % 7 = 0, double('NaN'), id / 4) as x", "if(id % 5 = 0, null, concat('é ', id)) as s", "id % 2 = 0 as b", "timestamp_ntz'2024-02-29 13:45:30' as t")
    path = str(tmp_path / "many.xlsx")
    io.save(df, path, folder=True)
    names = sorted(p.name for p in (tmp_path / "many.xlsx").glob("[!.]*"))
    assert len(names) == 12 and all(n.endswith(".xlsx") for n in names)
    assert all(sum(1 for _ in sheets.Workbook((tmp_path / "many.xlsx" / n).read_bytes()).rows()) <= 10 for n in names)
    got = io.load(spark, path)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "double", "string", "boolean", "timestamp_ntz"]
    assert sorted(map(tuple, got.collect())) == [(i, None if i % 7 == 0 else i / 4, None if i % 5 == 0 else f"é {i}", i % 2 == 0, DAY) for i in range(95)]
    with pytest.raises(FileExistsError):
        io.save(df, path, folder=True)
    io.save(df.where("id < 0"), str(tmp_path / "none.xlsx"), folder=True)
    assert io.load(spark, str(tmp_path / "none.xlsx")).columns == df.columns
