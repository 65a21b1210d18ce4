"""Sheets of workbooks (zip files of XML) as rows of text cells.

A workbook is one file and is parsed by one task, row by row; different workbooks are
different tasks. Spark reads the bytes, so any store it knows will do.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The namespaces of workbook parts.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS = 2000


def _text(node) -> str:
    """All text runs of a node, but for phonetic ones."""
    return "".join(t.text or "" for child in node if child.tag != MAIN + "rPh" for t in child.iter(MAIN + "t"))


def _column(reference: str) -> int:
    """AB12 -> 27"""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cells(book: zipfile.ZipFile, name: str) -> Iterator[tuple[int, dict[int, str]]]:
    """(row number from 1, column -> text) of a sheet's rows that hold something."""
    sheets = {s.get("name"): s.get(LINK) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(MAIN + "sheet")}
    if name not in sheets:
        raise ValueError(f"no sheet {name!r} among {sorted(sheets)}")
    parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = parts[sheets[name]]
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = [("".join(t.text or "" for t in s.findall(MAIN + "t")) or _text(s)) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(MAIN + "si")]
    row = 0
    with book.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag != MAIN + "row":
                continue
            row, out, column = int(node.get("r") or row + 1), {}, -1
            for c in node.findall(MAIN + "c"):
                column = _column(c.get("r")) if c.get("r") else column + 1
                value, kind = c.find(MAIN + "v"), c.get("t")
                if kind == "inlineStr":
                    own = c.find(MAIN + "is")
                    out[column] = "".join(t.text or "" for t in own.findall(MAIN + "t")) or _text(own)
                elif value is not None and value.text is not None:
                    out[column] = shared[int(value.text)] if kind == "s" else {"1": "TRUE", "0": "FALSE"}[value.text] if kind == "b" else value.text
            if out:
                yield row, out
            node.clear()


def sheet(spark: SparkSession, path: str, name: str, columns: Sequence[str], header_row: int = 1) -> DataFrame:
    """(path, row, columns as text) of a sheet's rows below its header, which is row `header_row` (from 1).

    Empty cells are null and rows without a cell are left out; rows above the header (titles,
    notes) are skipped. A column that the header lacks, a name that it has twice, or a
    missing sheet fails the job.
    """
    columns = list(columns)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                place, held = None, []

                def out() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([file] * len(held), pa.string()), pa.array([r for r, _ in held], pa.int64()), *[pa.array([cells.get(k) for _, cells in held], pa.string()) for k in place]], names=["path", "row", *columns])  # noqa: B023

                for row, cells in _cells(zipfile.ZipFile(io.BytesIO(content)), name):
                    if row == header_row:
                        names = [v.strip() for v in cells.values()]
                        wrong = [c for c in columns if names.count(c) != 1]
                        if wrong:
                            raise ValueError(f"{file}: not once in the header: {wrong}")
                        of = {v.strip(): k for k, v in cells.items()}
                        place = [of[c] for c in columns]
                    elif row > header_row:
                        if place is None:
                            raise ValueError(f"{file}: row {header_row} is empty")
                        held.append((row, cells))
                        if len(held) >= ROWS:
                            yield out()
                            held = []
                if held:
                    yield out()

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, "path string, row long, " + ", ".join(f"`{c}` string" for c in columns))
