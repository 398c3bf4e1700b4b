"""Sheets of workbooks, over the standard library's zip and XML readers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def cell_column(ref: str) -> int:
    """Zero-based column of a cell reference."""
    n = 0
    for c in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def _number(text: str) -> int | float:
    x = float(text)
    return int(x) if x.is_integer() and "." not in text and "e" not in text.lower() else x


def as_text(value: str | int | float | bool | None) -> str | None:
    """A cell as text. Nought and false count as empty, as a text of 0 doesn't."""
    return value if isinstance(value, str) else str(value) if value else None


def _sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """The path inside the workbook of each sheet, in their order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    targets = {s.get("name"): links[s.get(_REL)] for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iterfind("m:sheets/m:sheet", _NS)}
    return {name: t.lstrip("/") if t.startswith("/") else f"xl/{t}" for name, t in targets.items()}


def sheet_names(book: zipfile.ZipFile) -> list[str]:
    return list(_sheets(book))


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    return ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]


def sheet_rows(book: zipfile.ZipFile, sheet: str, wanted: set[int] | None = None) -> Iterator[tuple[int, list[str | int | float | bool | None]]]:
    """(row number from 1, typed cells) of one sheet; rows are read as they come, one at a time. Rows and cells without a place follow the one before.

    Cells of columns that aren't wanted stay null and are not parsed; shared texts are read with the first wanted cell that has one.
    """
    path = _sheets(book).get(sheet)
    if path is None:
        raise ValueError(f"the workbook has no sheet {sheet!r}")
    shared: list[str] | None = None
    number = 0
    for _, row in ElementTree.iterparse(book.open(path)):
        if row.tag != f"{{{_NS['m']}}}row":
            continue
        number = int(row.get("r") or number + 1)
        cells: list[str | int | float | bool | None] = []
        for cell in row.iterfind("m:c", _NS):
            at = cell_column(cell.get("r")) if cell.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            if wanted is not None and at not in wanted:
                continue
            value, inline = cell.find("m:v", _NS), cell.find("m:is", _NS)
            if cell.get("t") == "s" and value is not None:
                shared = _shared_texts(book) if shared is None else shared
                cells[at] = shared[int(value.text)]
            elif inline is not None:
                cells[at] = "".join(t.text or "" for t in inline.iter(f"{{{_NS['m']}}}t"))
            elif value is not None and cell.get("t") in ("str", "e", "d"):
                cells[at] = value.text
            elif value is not None and value.text:
                cells[at] = value.text == "1" if cell.get("t") == "b" else _number(value.text)
        yield number, cells
        row.clear()


def read_sheet(spark: SparkSession, path: str, sheet: str, columns: dict[int, str], has_header: bool = True) -> DataFrame:
    """Rows of one sheet of each workbook in path: form_id (its path), row_idx, and cells by position as strings.

    Cells are read by their type: nought and false are null, as truth tests on them say, and a text of 0 is a text.

    A workbook is one file of bounded size, read by one task through Spark's own file systems.
    """
    names = list(columns.values())

    def parse(batches):
        import pandas as pd

        for batch in batches:
            for form, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    rows = [(form, i, *[as_text(cells[k]) if k < len(cells) else None for k in columns]) for i, cells in sheet_rows(book, sheet, set(columns)) if i > has_header]
                yield pd.DataFrame(rows, columns=["form_id", "row_idx", *names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "form_id string, row_idx long, " + ", ".join(f"{n} string" for n in names))


#: Positions of the survey and choice sheets' columns.
SURVEY_COLUMNS = {0: "type", 1: "name", 2: "label", 5: "required", 8: "relevant"}
CHOICE_COLUMNS = {0: "list_name", 1: "value", 2: "label"}


def read_survey(spark: SparkSession, path: str) -> DataFrame:
    return read_sheet(spark, path, "survey", SURVEY_COLUMNS)


def read_choices(spark: SparkSession, path: str) -> DataFrame:
    return read_sheet(spark, path, "choices", CHOICE_COLUMNS)


def read_csv_sheet(spark: SparkSession, path: str, columns: dict[int, str]) -> DataFrame:
    """A sheet saved as CSV, columns bound by position."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    picked = [F.col(f"`{raw.columns[k]}`").alias(n) if k < len(raw.columns) else F.lit(None).cast("string").alias(n) for k, n in columns.items()]
    return raw.select(F.input_file_name().alias("form_id"), F.monotonically_increasing_id().alias("row_idx"), *picked)
