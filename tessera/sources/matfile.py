"""Constraint-based models in binary MAT files (level 5) as a registered data source: `spark.read.format("matfile")`."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera.sources.files import find_files, open_file
from tessera.sources.models import TABLES

# Fixed values of the file format: types of data elements, and classes of arrays.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
TEXTS = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCT, CHAR, SPARSE = 1, 2, 4, 5
COMPLEX = 0x0800

# A model's fields.
MATRIX_FIELD, NAMES = "S", {"rxns": "rxn", "mets": "met"}
OF_REACTIONS, OF_METABOLITES = ("lb", "ub", "c"), ("b",)

#: Columns of the matrix that one task turns into rows.
COLUMNS = 4096


@dataclass
class Sparse:
    """Compressed columns: rows[starts[j]:starts[j + 1]] and values likewise are column j."""

    shape: tuple[int, ...]
    rows: np.ndarray
    starts: np.ndarray
    values: np.ndarray


class MatError(ValueError):
    """A file that isn't a MAT file of level 5, or ends early."""


class Elements:
    """Data elements in a buffer, one after another."""

    def __init__(self, data: memoryview, order: str) -> None:
        self.data, self.order, self.at = data, order, 0

    def tag(self) -> tuple[int, memoryview]:
        """(type, data) of the next element; a compressed one is unpacked."""
        if self.at + 8 > len(self.data):
            raise MatError("the file ends inside an element")
        kind, size = struct.unpack_from(f"{self.order}II", self.data, self.at)
        if kind >> 16:  # up to four bytes stand in the tag itself
            kind, size, start, after = kind & 0xFFFF, kind >> 16, self.at + 4, self.at + 8
        else:
            start = self.at + 8
            after = start + size + (-size % 8 if kind != COMPRESSED else 0)
        if start + size > len(self.data):
            raise MatError("the file ends inside an element")
        self.at = after
        data = self.data[start : start + size]
        if kind == COMPRESSED:
            return Elements(memoryview(zlib.decompress(data)), self.order).tag()
        return kind, data

    def numbers(self) -> np.ndarray:
        kind, data = self.tag()
        if kind in TEXTS:
            return np.frombuffer(data, "u1")
        return np.frombuffer(data, self.order + TYPES[kind])

    def text(self) -> str:
        kind, data = self.tag()
        if kind in TEXTS:
            order = "" if kind == 16 else "-le" if self.order == "<" else "-be"
            return bytes(data).decode(TEXTS[kind] + order)
        return "".join(map(chr, np.frombuffer(data, self.order + TYPES[kind]))) if len(data) else ""


def _array(data: memoryview, order: str, fields: set[str] | None = None) -> tuple[str, Any]:
    """(name, value) of a matrix element; of a struct, only the fields given are read."""
    if not len(data):
        return "", None
    inside = Elements(data, order)
    flags = int(inside.numbers()[0])
    shape = tuple(int(x) for x in inside.numbers())
    name, kind, count = inside.text(), flags & 0xFF, int(np.prod(shape))
    if kind == CELL:
        return name, [_array(inside.tag()[1], order)[1] for _ in range(count)]
    if kind == STRUCT:
        width = int(inside.numbers()[0])
        names = bytes(inside.tag()[1])
        names = [names[i : i + width].split(b"\0")[0].decode() for i in range(0, len(names), width)]
        out = {}
        for _ in range(min(count, 1)):
            for field in names:
                _, value = inside.tag()
                if fields is None or field in fields:
                    out[field] = _array(value, order)[1]
        return name, out
    if kind == CHAR:
        return name, inside.text()
    if flags & COMPLEX:
        raise MatError(f"{name or 'an array'} is complex")
    if kind == SPARSE:
        rows, starts = inside.numbers(), inside.numbers()
        return name, Sparse(shape, rows[: starts[-1]], starts, inside.numbers().astype(float)[: starts[-1]])
    return name, inside.numbers().astype(float).reshape(shape, order="F")


def read_struct(path: str, variable: str | None, fields: set[str]) -> dict[str, Any]:
    """Fields of the named variable, or of the first struct that has all of them; others are passed over unread."""
    with open_file(path) as file:
        data = memoryview(file.read())
    order = {b"IM": "<", b"MI": ">"}.get(bytes(data[126:128]))
    if order is None:
        raise MatError(f"{path} is not a MAT file of level 5")
    elements = Elements(data[128:], order)
    while elements.at < len(elements.data):
        kind, body = elements.tag()
        if kind != MATRIX:
            continue
        name, value = _array(body, order, fields)
        if isinstance(value, dict) and (name == variable if variable else fields <= set(value)):
            return value
    raise MatError(f"{path} has no struct {variable or 'with fields ' + ', '.join(sorted(fields))}")


def _compressed(matrix: Sparse | np.ndarray) -> Sparse:
    if isinstance(matrix, Sparse):
        return matrix
    columns, rows = np.nonzero(matrix.T)
    return Sparse(matrix.shape, rows, np.searchsorted(columns, np.arange(matrix.shape[1] + 1)), matrix.T[columns, rows])


@dataclass
class Part(InputPartition):
    file: str
    first: int
    last: int


class MatReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.table, self.variable = schema, options.get("table", "stoich"), options.get("variable")
        if self.table not in TABLES:
            raise ValueError(f"table is one of {', '.join(TABLES)}")
        self.files, self.columns = find_files(options["path"], ".mat"), int(options.get("columns", COLUMNS))

    def _fields(self, wanted: set[str]) -> set[str]:
        """Fields of the file that the columns wanted come from."""
        if self.table == "stoich":
            return {MATRIX_FIELD} | {f for f, c in NAMES.items() if c in wanted}
        return {f for f, c in NAMES.items() if c in wanted} | (wanted & set(OF_REACTIONS if self.table == "reactions" else OF_METABOLITES))

    def partitions(self) -> Sequence[InputPartition]:
        if self.table != "stoich":
            return [Part(f, 0, 0) for f in self.files]
        parts = []
        for f in self.files:
            n = read_struct(f, self.variable, {MATRIX_FIELD})[MATRIX_FIELD]
            n = n.shape[1]
            parts += [Part(f, k, min(k + self.columns, n)) for k in range(0, n, self.columns)]
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        wanted = set(self.schema.names)
        model = read_struct(partition.file, self.variable, self._fields(wanted))
        if self.table == "stoich":
            s = _compressed(model[MATRIX_FIELD])
            lo, hi = int(s.starts[partition.first]), int(s.starts[partition.last])
            column = np.repeat(np.arange(partition.first, partition.last), np.diff(s.starts[partition.first : partition.last + 1]))
            # stored noughts are no entries
            some = s.values[lo:hi] != 0
            found = {"coef": pa.array(s.values[lo:hi][some])}
            for field, place in (("mets", s.rows[lo:hi]), ("rxns", column)):
                if field in model:
                    found[NAMES[field]] = pa.array(model[field], pa.string()).take(pa.array(place[some].astype(np.int64)))
        else:
            found = {f: pa.array(_dense(model[f]).ravel(order="F")) for f in model if f not in NAMES} | {NAMES[f]: pa.array(model[f], pa.string()) for f in model if f in NAMES}
        n = len(next(iter(found.values()))) if found else 0
        found["file"] = pa.array([partition.file] * n, pa.string())
        yield pa.RecordBatch.from_arrays([found[c] for c in self.schema.names], self.schema.names)


def _dense(value: Sparse | np.ndarray) -> np.ndarray:
    if not isinstance(value, Sparse):
        return value
    out = np.zeros(value.shape)
    out[value.rows, np.repeat(np.arange(value.shape[1]), np.diff(value.starts))] = value.values
    return out


class MatSource(DataSource):
    """The long tables of constraint-based models in MAT files of level 5, compressed or not, of either byte order.

    Options: path (a file, a folder or a pattern), table (stoich, reactions or metabolites), variable (the struct's name; the first
    struct with the fields by default), columns (of the matrix for each task). A schema names the columns wanted (with file,
    if several files are read); fields behind other columns are not parsed. The matrix may be sparse or full; stored noughts are no rows.
    A task holds the one file that it reads.
    """

    @classmethod
    def name(cls) -> str:
        return "matfile"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "stoich")]

    def reader(self, schema: StructType) -> MatReader:
        return MatReader(schema, dict(self.options))


def read_mat_model(spark: SparkSession, path: str, variable: str | None = None) -> dict[str, DataFrame]:
    """The three long tables of the model in one file, as read_model gives them."""
    spark.dataSource.register(MatSource)
    source = spark.read.format("matfile").option("path", path)
    source = source.option("variable", variable) if variable else source
    return {name: source.schema(schema).option("table", name).load() for name, schema in TABLES.items()}
