"""Workbooks as a registered data source: `spark.read.format("workbook")`."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from tessera.sources.files import find_files, open_file
from tessera.sources.xlsx import as_text, cell_column, sheet_names, sheet_rows


@dataclass
class Sheet(InputPartition):
    file: str
    sheet: str


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.columns = schema.names
        self.files = find_files(options["path"], ".xlsx")
        self.sheets = {s.strip() for s in options["sheets"].split(",")} if options.get("sheets") else None
        self.first = int(options.get("header", "true") == "true")
        odd = [c for c in self.columns if c not in ("file", "sheet", "row", "cells") and not re.fullmatch("[A-Z]{1,3}", c)]
        if odd:
            raise ValueError(f"columns of a workbook are file, sheet, row, cells and letters, not {odd}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the sheet's name choose the partitions; others are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("sheet",):
                self.sheets = (self.sheets or {f.value}) & {f.value}
            elif isinstance(f, In) and f.attribute == ("sheet",):
                self.sheets = set(f.value) if self.sheets is None else self.sheets & set(f.value)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [Sheet(file, name) for file in self.files for name in sheet_names(zipfile.ZipFile(open_file(file))) if self.sheets is None or name in self.sheets]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        places = {c: cell_column(c) for c in self.columns if c.isupper()}
        wanted = None if "cells" in self.columns else set(places.values())
        with zipfile.ZipFile(open_file(partition.file)) as book:
            for row, cells in sheet_rows(book, partition.sheet, wanted):
                if row <= self.first:
                    continue
                known = {"file": partition.file, "sheet": partition.sheet, "row": row}
                yield tuple(known[c] if c in known else [as_text(x) for x in cells] if c == "cells" else as_text(cells[places[c]]) if places[c] < len(cells) else None for c in self.columns)


class WorkbookSource(DataSource):
    """Rows of the sheets of workbooks; a task for each sheet of each file.

    Options: path (a file, a folder or a pattern), sheets (names, comma-separated; all by default), header (true: row 1 of a sheet is
    left out). Without a schema, columns are file, sheet, row and cells, an array of all cells. With one, columns are any of those and
    the sheet's own by their letters (`row long, A string, C string`): cells of other columns are not parsed, and texts shared by
    cells are read only if a wanted cell refers to them. Cells are texts; nought, false and empty cells are null. A filter on sheet
    chooses the tasks. Files come through Arrow's file systems; for stores that only Spark reads, see xlsx.read_sheet.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "file string, sheet string, row long, cells array<string>"

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(schema, dict(self.options))
