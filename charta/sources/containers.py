"""Rows from files that hold tables of their own: SQLite databases and workbooks, parsed where Spark reads their bytes.

``files`` is any table with a column ``content`` (binary), such as ``spark.read.format("binaryFile")``
gives; each file is opened in memory by the task that has it, one at a time.
"""

from __future__ import annotations

import io
import re
import sqlite3
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that leave a task at once.
ROWS = 4096


def _each(files: DataFrame, rows_of, schema: T.StructType) -> DataFrame:  # noqa: ANN001
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held: list[tuple] = []
                for row in rows_of(content.as_py()) if content.is_valid else ():
                    held.append(row)
                    if len(held) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return files.select(F.col("content")).mapInArrow(run, schema)


def sqlite_rows(files: DataFrame, table: str, schema: str) -> DataFrame:
    """The rows of one table of SQLite databases, with the columns of ``schema`` (DDL); a file without the table fails, null content gives nothing."""
    kind = T.StructType.fromDDL(schema)
    columns = ", ".join('"{}"'.format(c.replace('"', '""')) for c in kind.names)
    name = '"{}"'.format(table.replace('"', '""'))

    def rows_of(content: bytes) -> Iterator[tuple]:
        with sqlite3.connect(":memory:") as con:
            con.deserialize(content)
            yield from con.execute(f"SELECT {columns} FROM {name}")

    return _each(files, rows_of, kind)


def sqlite_bytes(tables: dict[str, tuple[str, list[tuple]]]) -> bytes:
    """A small database of the given tables: name, its columns as SQL, and rows."""
    with sqlite3.connect(":memory:") as con:
        for name, (columns, rows) in tables.items():
            con.execute(f'CREATE TABLE "{name}" ({columns})')
            con.executemany(f'INSERT INTO "{name}" VALUES ({", ".join("?" * len(columns.split(",")))})', rows)
        con.commit()
        return con.serialize()


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_CELL = "sheet string, row_no int, col_no int, value string"


def _column(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]*", reference)[0]:
        number = 26 * number + ord(letter) - 64
    return number


def _cells(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        titles = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for title, name in zip(titles, sheets, strict=False):
            with book.open(name) as sheet:
                for _, cell in ElementTree.iterparse(sheet):
                    if cell.tag != f"{_MAIN}c":
                        continue
                    found, kind = cell.find(f"{_MAIN}v"), cell.get("t")
                    inline = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    value = shared[int(found.text)] if kind == "s" and found is not None else inline if kind == "inlineStr" else None if found is None else found.text
                    if value is not None:
                        place = cell.get("r", "")
                        yield title, int(re.search(r"\d+$", place)[0]), _column(place), value
                    cell.clear()


def workbook_cells(files: DataFrame) -> DataFrame:
    """(sheet, row_no, col_no, value) of every filled cell of workbooks, rows and columns from 1; numbers as they are written."""
    return _each(files, _cells, T.StructType.fromDDL(_CELL))


def workbook_bytes(sheets: dict[str, list[list[str | float | None]]]) -> bytes:
    """A small workbook: a sheet for each name, with its rows; texts inline."""
    from xml.sax.saxutils import escape, quoteattr

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        for i, rows in enumerate(sheets.values(), 1):
            lines = []
            for r, row in enumerate(rows, 1):
                cells = [f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>' for c, v in enumerate(row) if v is not None]
                lines.append(f'<row r="{r}">{"".join(cells)}</row>')
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return out.getvalue()
