"""Workbooks (Office Open XML) as rows of cells, without an office library.

A workbook is a zip, so one task reads one; within it, sheets are streamed: rows leave in batches while the XML is still being read,
and only the shared strings and the number formats of the workbook are held.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import iterparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .delimited import read_keyword_table

#: Rows that leave a task together.
TOGETHER = 2_000
#: Numbers of the built-in formats that show dates or times. Fixed values.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
ROWS = "path string, sheet string, row long, cells array<string>"


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attributes(e) -> dict[str, str]:
    return {_name(k): v for k, v in e.attrib.items()}


def _part(z: zipfile.ZipFile, name: str):
    return z.open(name) if name in z.namelist() else io.BytesIO(b"<none/>")


def _ended(f, *names: str):
    """Elements of these names as they end; what has been read is let go of."""
    parents = []
    for event, e in iterparse(f, ("start", "end")):
        if event == "start":
            parents.append(e)
            continue
        parents.pop()
        if _name(e.tag) in names:
            yield e
            e.clear()
            if parents:
                parents[-1].remove(e)


def _text(e) -> str:
    """The text of a string item: its own, or that of its rich runs; phonetic hints are no part of it."""
    runs = [e, *(r for r in e if _name(r.tag) == "r")]
    return "".join(t.text or "" for r in runs for t in r if _name(t.tag) == "t")


class Book:
    """Sheets by name in their order, shared strings, and which styles show dates."""

    def __init__(self, content: bytes):
        self.zip = z = zipfile.ZipFile(io.BytesIO(content))
        to = {}
        for e in _ended(_part(z, "xl/_rels/workbook.xml.rels"), "Relationship"):
            to[e.get("Id")] = e.get("Target")
        self.sheets, self.first_day = {}, dt.datetime(1899, 12, 30)
        for e in _ended(_part(z, "xl/workbook.xml"), "sheet", "workbookPr"):
            if _name(e.tag) == "workbookPr":
                if e.get("date1904") in ("1", "true"):
                    self.first_day = dt.datetime(1904, 1, 1)
            else:
                target = to.get(_attributes(e).get("id"), "")
                self.sheets[e.get("name")] = target[1:] if target.startswith("/") else "xl/" + target
        self.strings = [_text(e) for e in _ended(_part(z, "xl/sharedStrings.xml"), "si")]
        self.dates = self._date_styles()

    def _date_styles(self) -> set[int]:
        own, styles = {}, []
        for e in _ended(_part(self.zip, "xl/styles.xml"), "numFmt", "cellXfs"):
            if _name(e.tag) == "numFmt":
                own[int(e.get("numFmtId"))] = e.get("formatCode") or ""
            else:
                styles = [int(x.get("numFmtId") or 0) for x in e if _name(x.tag) == "xf"]
        shown = lambda code: re.search("[ymdhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", code).lower()) is not None
        return {i for i, f in enumerate(styles) if f in DATE_FORMATS or (f in own and shown(own[f]))}

    def rows(self, sheet: str) -> Iterator[tuple[int, list[str | None]]]:
        """Numbers (from 1) and cells of the rows that are there; a cell that is not is null, at the end it is left out."""
        last = 0
        for row in _ended(_part(self.zip, self.sheets[sheet]), "row"):
            last = int(row.get("r") or last + 1)
            cells: list[str | None] = []
            for c in row:
                if _name(c.tag) != "c":
                    continue
                at = column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at - len(cells))
                cells.append(self._cell(c))
            yield last, cells

    def _cell(self, c) -> str | None:
        kind, value = c.get("t") or "n", None
        for x in c:
            if _name(x.tag) == "v":
                value = x.text
            elif _name(x.tag) == "is":
                return _text(x)
        if value is None or kind == "e":  # an empty cell, or an error in its formula
            return None
        if kind == "s":
            return self.strings[int(value)]
        if kind == "b":
            return "true" if value == "1" else "false"
        if kind in ("str", "d"):
            return value
        return self._number(float(value), int(c.get("s") or 0) in self.dates)

    def _number(self, v: float, date: bool) -> str:
        if not date:
            return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
        at = self.first_day + dt.timedelta(milliseconds=round(v * 86_400_000))
        return at.date().isoformat() if v == int(v) else at.isoformat(" ", "seconds" if not at.microsecond else "milliseconds")


def column(ref: str) -> int:
    """Place of a cell such as AB12, from 0."""
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheet_rows(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """files(path, content) → path, sheet, row, cells: every row of every sheet, or of the one that is named. Numbers are text as a
    delimited file would have them, dates ISO text, booleans true or false; errors and blank cells are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                book, held = Book(content), []
                for name in book.sheets:
                    if sheet in (None, name):
                        for n, cells in book.rows(name):
                            held.append((path, name, n, cells))
                            if len(held) >= TOGETHER:
                                yield pd.DataFrame(held, columns=["path", "sheet", "row", "cells"])
                                held = []
                yield pd.DataFrame(held, columns=["path", "sheet", "row", "cells"])

    return files.select("path", "content").mapInPandas(run, ROWS)


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """sheet_rows of the workbooks at a path, by Spark's reader."""
    return sheet_rows(spark.read.format("binaryFile").load(path), sheet)


def read_workbook_table(spark: SparkSession, path: str, keywords: dict[str, tuple[str, ...]], sheet: str | None = None, least: int = 2) -> DataFrame:
    """The table of one sheet, its header found by keywords; see delimited.read_keyword_table."""
    return read_keyword_table(read_workbook(spark, path, sheet), "cells", "row", keywords, least)
