"""XLSX as a Spark data source (read: one partition per sheet) and a workbook writer, on the standard library."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Rows of a sheet that the format allows.
SHEET_ROWS = 1_048_576


def column_number(letters: str) -> int:
    """0-based column of 'A', 'Z', 'AA' …"""
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_letters(n: int) -> str:
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_MAIN + "sheet"):
        target = targets[s.get(_REL + "id")]
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else "xl/" + target))
    return out


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(_MAIN + "t"))


class _Sheet(InputPartition):
    def __init__(self, path: str, name: str, part: str):
        super().__init__(name)
        self.path, self.name, self.part = path, name, part


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.paths = [p for p in options["path"].split(",") if p]
        self.only = options.get("sheet")

    def partitions(self) -> Sequence[_Sheet]:
        out = []
        for path in self.paths:
            with zipfile.ZipFile(path) as book:
                out += [_Sheet(path, n, p) for n, p in _sheets(book) if self.only in (None, n)]
        return out

    def read(self, partition: _Sheet) -> Iterator[tuple]:
        with zipfile.ZipFile(partition.path) as book:
            names = set(book.namelist())
            shared = [_text(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(_MAIN + "si")] if "xl/sharedStrings.xml" in names else []
            folder, _, leaf = partition.part.rpartition("/")
            rels = f"{folder}/_rels/{leaf}.rels"
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read(rels))} if rels in names else {}
            links: dict[int, str] = {}
            if targets:
                for h in ElementTree.fromstring(book.read(partition.part)).iter(_MAIN + "hyperlink"):
                    m = re.match(r"[A-Z]+(\d+)", h.get("ref", ""))
                    if m and h.get(_REL + "id") in targets:
                        links[int(m[1])] = targets[h.get(_REL + "id")]
            with book.open(partition.part) as stream:
                for _, row in ElementTree.iterparse(stream):
                    if row.tag != _MAIN + "row":
                        continue
                    number, cells = int(row.get("r")), []
                    for c in row.iter(_MAIN + "c"):
                        ref = re.match(r"[A-Z]+", c.get("r", ""))
                        at = column_number(ref[0]) if ref else len(cells)
                        cells += [""] * (at + 1 - len(cells))
                        v = c.find(_MAIN + "v")
                        value = v.text or "" if v is not None else ""
                        kind = c.get("t", "n")
                        cells[at] = shared[int(value)] if kind == "s" and value else _text(c) if kind == "inlineStr" else value
                    yield partition.name, number, cells, links.get(number)
                    row.clear()


class XlsxSource(DataSource):
    """spark.read.format('xlsx').option('path', …)[.option('sheet', name)]: sheet, row, cells ARRAY<STRING>, url.

    Cells that are absent are ''; url is the hyperlink of the row, null without. Streams rows, so memory is the shared
    strings and one row.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return "sheet string, row int, cells array<string>, url string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    spark.dataSource.register(XlsxSource)
    reader = spark.read.format("xlsx").option("path", path)
    return (reader.option("sheet", sheet) if sheet else reader).load()


def below_header(rows: DataFrame, first_cell: str) -> DataFrame:
    """Rows below each sheet's header: the first row whose first cell, without white space, is `first_cell`. Rows with a
    blank first cell and sheets without a header are dropped. Header positions are one row per sheet."""
    head = F.regexp_replace(F.try_element_at("cells", F.lit(1)), r"(?U)\s+", "")
    at = rows.where(head == first_cell).groupBy("sheet").agg(F.min("row").alias("header"))
    return rows.join(F.broadcast(at), "sheet").where((F.col("row") > F.col("header")) & (F.coalesce(head, F.lit("")) != "")).drop("header")


def by_header(rows: DataFrame, first_cell: str, columns: Sequence[str]) -> DataFrame:
    """Named columns of a sheet, found by the names in its header row."""
    head = F.regexp_replace(F.try_element_at("cells", F.lit(1)), r"(?U)\s+", "")
    names = rows.where(head == first_cell).groupBy("sheet").agg(F.min_by("cells", "row").alias("names"))
    body = below_header(rows, first_cell).join(F.broadcast(names), "sheet")
    pick = lambda c: F.when(F.array_position("names", c) > 0, F.try_element_at("cells", F.array_position("names", c).cast("int")))
    return body.select("sheet", "row", *(F.coalesce(pick(c), F.lit("")).alias(c) for c in columns))


def route_sheets(rows: DataFrame, routes: Sequence[tuple[str, str]], name: str = "grp") -> DataFrame:
    """Rows with the group of their sheet by the first pattern that matches its name; other sheets are dropped."""
    out = F.when(F.col("sheet").rlike(routes[0][1]), routes[0][0])
    for label, pattern in routes[1:]:
        out = out.when(F.col("sheet").rlike(pattern), label)
    return rows.withColumn(name, out).where(F.col(name).isNotNull())


def write_xlsx(path: str, sheets: Mapping[str, DataFrame], lists: Mapping[str, Sequence[str]] | None = None, widths: Mapping[str, int] | None = None) -> None:
    """A workbook with one sheet per DataFrame: bold header, frozen first row, filter, column widths, and list validation
    for the columns named in `lists`. Rows stream from the executors; the format's row limit is checked."""
    lists, widths = lists or {}, widths or {}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        ids = range(1, len(sheets) + 1)
        override = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in ids)
        book.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{override}</Types>')
        book.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        tabs = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(ids, sheets))
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-1]}"><sheets>{tabs}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Type="{_REL[1:-1]}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids)
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}<Relationship Id="rIdS" Type="{_REL[1:-1]}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'<?xml version="1.0" encoding="UTF-8"?><styleSheet xmlns="{_MAIN[1:-1]}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        for i, df in zip(ids, sheets.values()):
            names = df.columns
            with book.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                put = lambda s: out.write(s.encode("utf-8"))
                put(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>')
                put("<cols>" + "".join(f'<col min="{k}" max="{k}" width="{widths.get(c, 14)}" customWidth="1"/>' for k, c in enumerate(names, 1)) + "</cols><sheetData>")
                cell = lambda ref, v, style="": f'<c r="{ref}"{style}><v>{v}</v></c>' if isinstance(v, (int, float)) and not isinstance(v, bool) else f'<c r="{ref}" t="inlineStr"{style}><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
                put('<row r="1">' + "".join(cell(column_letters(k) + "1", c, ' s="1"') for k, c in enumerate(names)) + "</row>")
                last = 1
                for last, row in enumerate(df.toLocalIterator(), 2):
                    if last > SHEET_ROWS:
                        raise ValueError("a sheet has more rows than the format allows")
                    put(f'<row r="{last}">' + "".join(cell(f"{column_letters(k)}{last}", v) for k, v in enumerate(row) if v is not None) + "</row>")
                put(f'</sheetData><autoFilter ref="A1:{column_letters(len(names) - 1)}{last}"/>')
                checks = [(column_letters(names.index(c)), v) for c, v in lists.items() if c in names]
                if checks:
                    rules = "".join(f'<dataValidation type="list" allowBlank="1" sqref="{c}2:{c}{SHEET_ROWS}"><formula1>{escape(chr(34) + ",".join(v) + chr(34))}</formula1></dataValidation>' for c, v in checks)
                    put(f'<dataValidations count="{len(checks)}">{rules}</dataValidations>')
                put("</worksheet>")
