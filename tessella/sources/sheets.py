"""Spreadsheets (xlsx): files of any number are read as a table, a sheet's XML as a stream; a table is written to one file a sheet.

A workbook is a zip of XML parts. Spark lists and reads the files, so they can stand in any store; each is one task, as its deflated
stream has one beginning. The rows of a sheet come out in batches, whatever its length. A sheet has 1,048,576 rows at most by
its format; a table of more is written as a folder of files, by the tasks that hold its rows.
"""

from __future__ import annotations

import datetime
import io
import itertools
import math
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
ROW, CELL, VALUE = f"{MAIN}row", f"{MAIN}c", f"{MAIN}v"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_ROWS, MOST_COLUMNS = 1_048_576, 16_384
WHOLE = re.compile(r"-?\d{1,18}").fullmatch
EPOCH = datetime.datetime(1899, 12, 30)
#: Number formats that show a date or a time, of those without a text of their own.
DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
#: Rows of a batch, and of a file of a folder.
BATCH = 5000
BOOK = 100_000
#: Kinds of cells, the wider after the narrower; two kinds in a column are text, but for whole and other numbers.
KINDS = {"b": "boolean", "i": "bigint", "n": "double", "d": "timestamp_ntz", "s": "string"}


@lru_cache(MOST_COLUMNS)
def _column(letters: str) -> int:
    """The number from 0 of a column, from its letters such as BC."""
    n = 0
    for c in letters:
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


class Workbook:
    """A workbook's bytes: its sheets by name, and the cells of a sheet row by row."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        links = {r.get("Id"): r.get("Target", "") for r in self._part("xl/_rels/workbook.xml.rels").iter(f"{{{PACKAGE}/relationships}}Relationship")}
        book = self._part("xl/workbook.xml")
        self.sheets = {s.get("name", ""): self._path(links[s.get(f"{RELATION}id")]) for s in book.iter(f"{MAIN}sheet")}
        setting = book.find(f"{MAIN}workbookPr")
        self.from_1904 = setting is not None and setting.get("date1904") in ("1", "true")
        names = set(self.zip.namelist())
        self.texts = [_text(si) for si in self._part("xl/sharedStrings.xml").iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        self.dated = self._dated(self._part("xl/styles.xml")) if "xl/styles.xml" in names else []

    def _part(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))

    @staticmethod
    def _path(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    @staticmethod
    def _dated(styles: ElementTree.Element) -> list[bool]:
        """Whether each style of cells shows a time."""
        own = {f.get("numFmtId"): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")) for f in styles.iter(f"{MAIN}numFmt")}
        cells = styles.find(f"{MAIN}cellXfs")
        return [int(x.get("numFmtId", 0)) in DATES or bool(re.search("[ymdhs]", own.get(x.get("numFmtId"), ""), re.I)) for x in (cells if cells is not None else [])]

    def rows(self, sheet: str | int = 0) -> Iterator[list[tuple[str, Any] | None]]:
        """The rows of a sheet as lists of (kind, value); empty cells are None. One row is held at a time."""
        if isinstance(sheet, int):
            sheet = list(self.sheets)[sheet]
        if sheet not in self.sheets:
            raise ValueError(f"no sheet {sheet!r}")
        with self.zip.open(self.sheets[sheet]) as part:
            above = None
            for event, e in ElementTree.iterparse(part, ("start", "end")):
                if event == "start" and e.tag == f"{MAIN}sheetData":
                    above = e
                elif event == "end" and e.tag == ROW:
                    out: list[tuple[str, Any] | None] = []
                    for c in e.iter(CELL):
                        ref = c.get("r")
                        at = _column(ref.rstrip("0123456789")) if ref else len(out)
                        out += [None] * (at + 1 - len(out))
                        out[at] = self._value(c)
                    yield out
                    if above is not None:
                        above.clear()  # rows that are done go

    def _value(self, c: ElementTree.Element) -> tuple[str, Any] | None:
        kind, v = c.get("t", "n"), c.findtext(VALUE)
        if kind == "inlineStr":
            text = c.find(f"{MAIN}is")
            return None if text is None else ("s", _text(text))
        if v is None or kind == "e":
            return None
        if kind == "s":
            return "s", self.texts[int(v)]
        if kind == "b":
            return "b", v == "1"
        if kind in ("str", "d"):
            return "s", v
        x = float(v)
        style = c.get("s")
        if style and int(style) < len(self.dated) and self.dated[int(style)] or not style and self.dated[:1] == [True]:
            return "d", EPOCH + datetime.timedelta(days=1462 if self.from_1904 else 0) + datetime.timedelta(milliseconds=round(x * 86_400_000))
        return ("i", int(v)) if WHOLE(v) else ("n", x)


def _text(e: ElementTree.Element) -> str:
    """The text of all runs, without phonetic marks. _xHHHH_ stands for a character that XML does not take."""
    whole = "".join(t.text or "" for child in e for t in ([child] if child.tag == f"{MAIN}t" else child.iter(f"{MAIN}t") if child.tag == f"{MAIN}r" else []))
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m.group(1), 16)), whole)


def _plain(cell: tuple[str, Any] | None, kind: str) -> Any:
    if cell is None:
        return None
    own, v = cell
    if kind == "double":
        return float(v)
    if kind == "string" and own != "s":
        return str(v).lower() if own == "b" else v.isoformat(" ") if own == "d" else str(v)
    return v


def _named(head: list[tuple[str, Any] | None]) -> list[str]:
    """Names of the columns: the first row's texts; empty ones are column0, column1, ..., and repeated ones get a number."""
    out: list[str] = []
    for i, cell in enumerate(head):
        name = base = _plain(cell, "string") or f"column{i}"
        n = 1
        while name.lower() in (o.lower() for o in out):
            name, n = f"{base}_{n}", n + 1
        out.append(name)
    return out


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("content")


def read(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """The sheet, by name or number, of a file or of all files of a folder. The first row names the columns; types are those of the
    cells: boolean, bigint, double, timestamp_ntz or string, and string where kinds differ. Rows that are empty are left out, shorter rows end in
    nulls, errors in cells are null, and files that lack a column have nulls there. A column without a cell is string."""

    def seen(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                rows = Workbook(content).rows(sheet)
                names = _named(next(rows, []))
                kinds: list[set[str]] = [set() for _ in names]
                for row in rows:
                    for k, cell in zip(kinds, row, strict=False):
                        if cell is not None:
                            k.add(cell[0])
                if names:
                    yield pd.DataFrame({"at": range(len(names)), "name": names, "kinds": ["".join(sorted(k)) for k in kinds]})

    told = _files(spark, path).mapInPandas(seen, "at int, name string, kinds string").groupBy("name").agg(F.min("at").alias("at"), F.collect_set("kinds").alias("kinds")).orderBy("at", "name").collect()
    types = {}
    for r in told:  # a row for each column
        kinds = set("".join(r.kinds))
        types[r.name] = KINDS[kinds.pop()] if len(kinds) == 1 else "double" if kinds == {"i", "n"} else "string"
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in types.items()])

    def cells(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                rows = Workbook(content).rows(sheet)
                names = _named(next(rows, []))
                held: list[list[Any]] = []
                for row in rows:
                    if any(c is not None for c in row):
                        found = dict(zip(names, row, strict=False))
                        held.append([_plain(found.get(n), k) for n, k in types.items()])
                    if len(held) >= BATCH:
                        yield pd.DataFrame(held, columns=list(types), dtype=object)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=list(types), dtype=object)

    return _files(spark, path).mapInPandas(cells, schema)


def _cell(ref: str, v: Any) -> str:
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and (abs(v) <= 2**53 if isinstance(v, int) else math.isfinite(v)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    if isinstance(v, datetime.datetime):
        return f'<c r="{ref}" s="1"><v>{(v.replace(tzinfo=None) - EPOCH) / datetime.timedelta(days=1)!r}</v></c>'
    if isinstance(v, datetime.date):
        return f'<c r="{ref}" s="1"><v>{(v - EPOCH.date()).days}</v></c>'
    told = re.sub(r"_x([0-9A-Fa-f]{4})_", r"_x005F_x\1_", str(v))
    told = re.sub(r"[\x00-\x08\x0b-\x1f￾￿]", lambda m: f"_x{ord(m.group()):04X}_", told)
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(told)}</t></is></c>'


def write(sheets: dict[str, DataFrame], path: str) -> None:
    """One workbook with a sheet for each table. Rows come to the driver a partition at a time and go to the file as they come;
    a table of more rows than a sheet has raises before anything is written. Whole numbers beyond 2 ** 53, decimals and
    nested values are text; infinities are text, NaN and nulls are empty cells."""
    for name, df in sheets.items():
        if len(df.columns) > MOST_COLUMNS or df.limit(MOST_ROWS).count() >= MOST_ROWS:
            raise ValueError(f"{name!r} does not fit a sheet")
    spark = next(iter(sheets.values())).sparkSession
    made = io.BytesIO()
    _book(made, {name: (df.columns, df.select(*[_writable(f) for f in df.schema.fields]).toLocalIterator(prefetchPartitions=True)) for name, df in sheets.items()})
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    try:
        for start in range(0, len(made.getbuffer()), 1 << 20):
            out.write(bytes(made.getbuffer()[start : start + (1 << 20)]))
    finally:
        out.close()


def write_folder(df: DataFrame, path: str, name: str = "Sheet1") -> None:
    """A table of any length as a new folder of workbooks of BOOK rows at most, which read() takes as one table. Each is made and
    written by the task that holds its rows; values are those of write()."""
    if len(df.columns) > MOST_COLUMNS:
        raise ValueError(f"{name!r} does not fit a sheet")
    spark, columns, most = df.sparkSession, df.columns, min(BOOK, MOST_ROWS - 1)
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(at(path)):
        raise FileExistsError(path)

    def books(batches):
        import pyarrow as pa

        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for first in rows:
            made = io.BytesIO()
            _book(made, {name: (columns, itertools.chain([first], itertools.islice(rows, most - 1)))}, b"\n")
            # The text writer ends a row with the byte that is the archive's comment.
            yield pa.RecordBatch.from_arrays([pa.array([made.getvalue()[:-1]], pa.binary())], ["content"])

    made, n = f"{path}/_made-{uuid.uuid4().hex}", 0
    content = df.select(*[_writable(f) for f in df.schema.fields]).mapInArrow(books, "content binary").select(F.col("content").cast("string"))
    content.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "none").text(made)
    for part in files.listStatus(at(made)):
        file = part.getPath().getName()
        if file.startswith("part-") and part.getLen():
            if not files.rename(part.getPath(), at(f"{path}/{file.removesuffix('.txt')}.xlsx")):
                raise OSError(f"cannot rename {file}")
            n += 1
    files.delete(at(made), True)
    if not n:
        write({name: df.limit(0)}, f"{path}/part-0.xlsx")


def _book(made: io.BytesIO, sheets: dict[str, tuple[list[str], Iterable[Any]]], comment: bytes = b"") -> None:
    """Write a workbook: the columns and rows of each sheet by name."""
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        z.comment = comment
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(len(sheets)))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
        office = RELATION.strip("{}")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        links = "".join(f'<Relationship Id="r{i + 1}" Type="{office}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">{links}<Relationship Id="r0" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, n in enumerate(sheets))
        main = MAIN.strip("{}")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        for i, (columns, rows) in enumerate(sheets.values()):
            with z.open(f"xl/worksheets/sheet{i + 1}.xml", "w") as part:
                part.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                refs = [_letters(c) for c in range(len(columns))]
                for r, row in enumerate(itertools.chain([columns], rows), 1):
                    part.write(f'<row r="{r}">{"".join(_cell(f"{a}{r}", v) for a, v in zip(refs, row, strict=True))}</row>'.encode())
                part.write(b"</sheetData></worksheet>")


def _writable(f: T.StructField):
    c, kind = F.col(f"`{f.name}`"), f.dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c.cast("double")).alias(f.name)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c).alias(f.name)
    if isinstance(kind, T.BinaryType):
        return F.base64(c).alias(f.name)
    if isinstance(kind, T.DecimalType):
        return c.cast("string").alias(f.name)
    return c.alias(f.name)
