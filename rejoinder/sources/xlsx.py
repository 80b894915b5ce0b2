"""Workbooks as rows: a file is a zip of XML parts, read where its bytes are, one file a row of binaryFile."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, row long, cells map<int, string>"
#: The format's parts and the letters of its cell types (fixed values).
WORKBOOK, RELATIONS, STRINGS = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml"
SHARED, INLINE, TRUTH = "s", "inlineStr", "b"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _column(ref: str) -> int:
    """The number, from 0, of the column of a place such as AB12."""
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _texts(item) -> str:
    """A string's runs, without the readings that some scripts give beside them."""
    return "".join(t.text or "" for part in item if _local(part.tag) != "rPh" for t in part.iter() if _local(t.tag) == "t")


def _plain(number: str) -> str:
    """A number as people write it: 3 for 3.0, and without the noise of its last binary digits."""
    try:
        x = float(number)
    except ValueError:
        return number
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else f"{x:.15g}"


def sheet_rows(content: bytes, sheet: int = 0) -> Iterator[tuple[int, dict[int, str]]]:
    """Row numbers (from 1) and cells by column of a sheet; empty cells are left out. The sheet is read as a stream."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        ids = [next(v for k, v in e.attrib.items() if _local(k) == "id") for e in ElementTree.fromstring(z.read(WORKBOOK)).iter() if _local(e.tag) == "sheet"]
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read(RELATIONS))}
        part = targets[ids[sheet]]
        shared = [_texts(e) for e in ElementTree.fromstring(z.read(STRINGS)) if _local(e.tag) == "si"] if STRINGS in z.namelist() else []
        last = 0
        with z.open(part.lstrip("/") if part.startswith("/") else f"xl/{part}") as f:
            for _, e in ElementTree.iterparse(f):
                if _local(e.tag) != "row":
                    continue
                last, cells, at = int(e.get("r") or last + 1), {}, -1
                for c in e:
                    at = _column(c.get("r")) if c.get("r") else at + 1
                    kind, value = c.get("t"), next((v.text for v in c if _local(v.tag) == "v"), None)
                    if kind == INLINE:
                        cells[at] = "".join(_texts(v) for v in c if _local(v.tag) == "is")
                    elif value is not None:
                        cells[at] = shared[int(value)] if kind == SHARED else ("TRUE" if value == "1" else "FALSE") if kind == TRUTH else _plain(value) if kind in (None, "n") else value
                yield last, cells
                e.clear()


def workbook_rows(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """path, row, cells of a sheet of every workbook at the path."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                rows = list(sheet_rows(bytes(content), sheet))
                yield pd.DataFrame({"path": [name] * len(rows), "row": [r for r, _ in rows], "cells": [c for _, c in rows]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, CELLS)


def workbook_table(spark: SparkSession, path: str, columns: list[str], sheet: int = 0) -> DataFrame:
    """The rows below each workbook's first row; columns by their names there (stripped, in lower case), null if absent."""
    rows = workbook_rows(spark, path, sheet).filter(F.size("cells") > 0)
    names = F.transform_values("cells", lambda _, v: F.lower(F.trim(v)))
    first = rows.groupBy("path").agg(F.min("row").alias("first"), F.min_by(names, "row").alias("names"))  # a row for each file
    own = rows.join(first, "path").filter("row > first")
    def under(name: str) -> Column:
        places = F.map_keys(F.map_filter("names", lambda _, v: v == name))
        return F.when(F.size(places) > 0, F.element_at("cells", F.get(places, F.lit(0))))

    found = {c: under(c) for c in columns}
    return own.select("path", "row", *[found[c].alias(c) for c in columns])


def _workbook(rows: list[tuple]) -> bytes:
    """A workbook of one sheet; texts are shared strings, numbers numbers."""
    strings: dict[str, int] = {}

    def cell(v, at: str) -> str:
        if v is None or v != v:
            return ""
        if isinstance(v, int | float):
            return f'<c r="{at}"><v>{v!r}</v></c>'
        return f'<c r="{at}" t="s"><v>{strings.setdefault(str(v), len(strings))}</v></c>'

    lines = "".join(f'<row r="{i}">{"".join(cell(v, f"{chr(65 + k)}{i}") for k, v in enumerate(r))}</row>' for i, r in enumerate(rows, 1))
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/></Types>',
        WORKBOOK: f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        RELATIONS: '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="t" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {space}><sheetData>{lines}</sheetData></worksheet>",
        STRINGS: f"<sst {space}>{''.join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings)}</sst>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def write_workbooks(df: DataFrame, folder: str, most: int = 100_000) -> int:
    """A workbook of at most ``most`` rows (and its header) from each task, or several; up to 26 columns. Gives their number."""
    columns = df.columns

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top)
        held: list[tuple] = []

        def close() -> pd.DataFrame:
            with store.open_output_stream(f"{top}/{uuid.uuid4().hex}.xlsx") as f:
                f.write(_workbook([tuple(columns), *held]))
            held.clear()
            return pd.DataFrame({"n": [1]})

        for b in batches:
            for r in b.astype(object).where(b.notna(), None).itertuples(index=False, name=None):
                held.append(r)
                if len(held) == most:
                    yield close()
        if held:
            yield close()

    return df.mapInPandas(write, "n int").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
