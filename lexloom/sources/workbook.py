"""Cells of Office Open XML workbooks, with their values and fill colours, read with the standard library alone."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _xml(book: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _text(node: ElementTree.Element | None) -> str:
    """The text of a string item, of all its runs."""
    return "" if node is None else "".join(t.text or "" for t in node.iter(f"{{{_NS['m']}}}t"))


def column_number(ref: str) -> int:
    """From 1, of a cell's name such as AB12."""
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n


def sheet_cells(content: bytes, sheet: int) -> list[tuple[int, int, str | None, str | None, int | None]]:
    """(row, col, value, rgb, theme) of a sheet by its place, from 1: cells that have a value or a solid fill.

    Values are as the file has them, strings resolved. A workbook without such a sheet has no cells.
    """
    with zipfile.ZipFile(BytesIO(content)) as book:
        names = _xml(book, "xl/workbook.xml")
        sheets = names.findall("m:sheets/m:sheet", _NS) if names is not None else []
        if not 1 <= sheet <= len(sheets):
            return []
        links = {r.get("Id"): r.get("Target") for r in _xml(book, "xl/_rels/workbook.xml.rels")}
        target = links[sheets[sheet - 1].get(_REL)]
        page = _xml(book, target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        shared = _xml(book, "xl/sharedStrings.xml")
        strings = [_text(x) for x in shared.findall("m:si", _NS)] if shared is not None else []
        styles = _xml(book, "xl/styles.xml")
        fills: list[tuple[str | None, int | None]] = []
        used: list[int] = []
        if styles is not None:
            for fill in styles.findall("m:fills/m:fill/m:patternFill", _NS):
                colour = fill.find("m:fgColor", _NS) if fill.get("patternType") == "solid" else None
                fills.append((None, None) if colour is None else (colour.get("rgb"), int(colour.get("theme")) if colour.get("theme") else None))
            used = [int(x.get("fillId", 0)) for x in styles.findall("m:cellXfs/m:xf", _NS)]
        out = []
        for cell in page.iterfind("m:sheetData/m:row/m:c", _NS):
            ref, kind, raw = cell.get("r"), cell.get("t"), cell.find("m:v", _NS)
            value = _text(cell.find("m:is", _NS)) if kind == "inlineStr" else None if raw is None else strings[int(raw.text)] if kind == "s" else raw.text
            style = int(cell.get("s", 0))
            rgb, theme = fills[used[style]] if style < len(used) and used[style] < len(fills) else (None, None)
            if value is not None or rgb or theme is not None:
                out.append((int(re.search("[0-9]+", ref)[0]), column_number(ref), value, rgb, theme))
        return out


def cells(found: DataFrame, sheet: int = 3) -> DataFrame:
    """(path, row, col, value, rgb, theme) of workbooks (path, content). Files that are no workbooks have no cells."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                if zipfile.is_zipfile(BytesIO(bytes(content))):
                    rows += [(path, *x) for x in sheet_cells(bytes(content), sheet)]
            out = pd.DataFrame(rows, columns=["path", "row", "col", "value", "rgb", "theme"])
            yield out.astype({"theme": "Int64"})

    return found.select("path", "content").mapInPandas(each, "path string, row int, col int, value string, rgb string, theme int")
