"""Spreadsheets in the Office Open XML format, read by tasks from Spark's own file scan, so any store will do.

A workbook is a zip of XML parts, one for each sheet; a task takes a file and streams its sheets' cells. The format bounds a sheet to 1 048 576 rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import csv
from .sinks import write

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
CELLS = "file string, sheet string, row int, col int, value string"


def column_number(ref: str) -> int:
    """1 for A, 27 for AA, of a reference such as AA7."""
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n


def column_name(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def text_of(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{{{MAIN}}}t"))


def sheet_cells(z: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, int, str]]:
    """(row, col, value) of the cells of one sheet that hold something."""
    with z.open(part) as f:
        row = 0
        for _, node in ElementTree.iterparse(f):
            if node.tag != f"{{{MAIN}}}row":
                continue
            row = int(node.get("r") or row + 1)
            col = 0
            for c in node.iter(f"{{{MAIN}}}c"):
                col = column_number(c.get("r")) if c.get("r") else col + 1
                v = c.find(f"{{{MAIN}}}v")
                value = text_of(c) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                if value not in (None, ""):
                    yield row, col, value
            node.clear()


def workbook_cells(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, content in zip(b["path"], b["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                shared = [text_of(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{{{MAIN}}}si")] if "xl/sharedStrings.xml" in z.namelist() else []
                parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{{{PACKAGE}}}Relationship")}
                for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet"):
                    target = parts[sheet.get(f"{{{LINKS}}}id")]
                    held = []
                    for cell in sheet_cells(z, target.lstrip("/") if target.startswith("/") else f"xl/{target}", shared):
                        held.append((path, sheet.get("name"), *cell))
                        if len(held) == 50_000:
                            yield pd.DataFrame(held, columns=["file", "sheet", "row", "col", "value"])
                            held = []
                    yield pd.DataFrame(held, columns=["file", "sheet", "row", "col", "value"])


def cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, col, value) of every cell that holds something, of all workbooks that ``path`` names."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(workbook_cells, CELLS)


def sheet(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """The rows of one sheet (the first by default) as strings under the names in its first row; empty cells are null, empty rows go.

    Unnamed columns are called by their letters; a name that repeats gets them at its end.
    """
    held = cells(spark, path)
    if name is None:
        first = held.limit(1).collect()
        if not first:
            raise ValueError("no sheet holds anything")
        name = first[0]["sheet"]
    held = held.where(F.col("sheet") == name)
    top = {r["col"]: r["value"] for r in held.where("row = 1").select("col", "value").collect()}  # a row of names
    width = held.agg(F.max("col")).first()[0]
    if not width:
        raise ValueError(f"no sheet {name}, or nothing in it")
    names = []
    for c in range(1, width + 1):
        n = (top.get(c) or column_name(c)).strip()
        names.append(f"{n}_{column_name(c)}" if n in names else n)
    row = held.where("row > 1").groupBy("file", "row").agg(*[F.max(F.when(F.col("col") == c, F.col("value"))).alias(f"c{c}") for c in range(1, width + 1)])
    return row.select(*[F.col(f"c{c}").alias(n) for c, n in enumerate(names, 1)])


def workbook_bytes(tables: Sequence[tuple[str, Sequence[str], Iterable[Sequence]]]) -> bytes:
    """A workbook of (sheet, names, rows); numbers stay numbers, the rest are strings in their cells."""
    def cell(ref: str, v) -> str:
        if v is None or v != v:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(tables) + 1))
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(tables) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}">{links}</Relationships>')
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _, _) in enumerate(tables, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{names}</sheets></workbook>')
        for i, (_, header, rows) in enumerate(tables, 1):
            lines = [f'<row r="{r}">{"".join(cell(f"{column_name(c)}{r}", v) for c, v in enumerate(values, 1))}</row>' for r, values in enumerate([header, *rows], 1)]
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return out.getvalue()


def write_sheet(df: DataFrame, path: str, name: str = "Sheet1") -> None:
    """One small table as a workbook; the format's bound on rows is the bound on what comes to the driver."""
    rows = df.limit(1_048_576).collect()
    if len(rows) > 1_048_575:
        raise ValueError("a sheet holds 1 048 575 rows below its names")
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(where, True)
    try:
        stream.write(bytearray(workbook_bytes([(name, df.columns, [tuple(r) for r in rows])])))
    finally:
        stream.close()


def to_csv(spark: SparkSession, path: str, out: str, name: str | None = None) -> DataFrame:
    """A sheet written as CSV and read back; raises where rows or columns were lost on the way."""
    source = sheet(spark, path, name)
    write(source, out, "csv")
    back = csv(spark, out)
    had, has = (source.count(), len(source.columns)), (back.count(), len(back.columns))
    if had != has:
        raise ValueError(f"{had} rows and columns became {has}")
    return back
