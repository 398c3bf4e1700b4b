"""Registered data sources over files that the tests write."""

import struct
import zipfile
import zlib

import numpy as np
import pytest

from tessera.operators import flux
from tessera.sources.formats import register_formats
from tessera.sources.matfile import read_mat_model

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _cell(ref, v):
    return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'


def _book(path, sheets):
    """sheets: name -> rows of XML cells."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        listed = "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {NS}><sheetData>" + "".join(f'<row r="{k}">{r}</row>' for k, r in enumerate(rows, 1)) + "</sheetData></worksheet>")


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    register_formats(spark)
    folder = tmp_path_factory.mktemp("books")
    # B3 isn't a number, and C2 refers to a shared text that isn't there
    _book(folder / "a.xlsx", {"survey": [_cell("A1", "type"), _cell("A2", "note") + '<c r="C2" t="s"><v>7</v></c>', _cell("A3", "text") + '<c r="B3"><v>wrong</v></c>', '<c r="A4"><v>0</v></c><c r="D4"><v>2.5</v></c>'], "choices": [_cell("A1", "list_name"), _cell("A2", "yn")]})
    _book(folder / "b.xlsx", {"choices": [_cell("A1", "list_name"), _cell("B2", "only")], "empty": []})
    return str(folder)


def test_sheets_are_partitions(spark, books):
    rows = spark.read.format("workbook").schema("file string, sheet string, row long, A string").load(books)
    assert rows.rdd.getNumPartitions() == 4
    assert sorted((r.file[-6:], r.sheet, r.row, r.A) for r in rows.collect()) == [("a.xlsx", "choices", 2, "yn"), ("a.xlsx", "survey", 2, "note"), ("a.xlsx", "survey", 3, "text"), ("a.xlsx", "survey", 4, None), ("b.xlsx", "choices", 2, None)]
    assert spark.read.format("workbook").load(f"{books}/a*.xlsx").rdd.getNumPartitions() == 2
    named = spark.read.format("workbook").option("sheets", "choices, none").option("header", "false").schema("sheet string, A string, B string").load(books)
    assert named.rdd.getNumPartitions() == 2 and sorted(map(str, named.collect())) == ["Row(sheet='choices', A='list_name', B=None)"] * 2 + ["Row(sheet='choices', A='yn', B=None)", "Row(sheet='choices', A=None, B='only')"]


def test_columns_that_are_not_read_are_not_parsed(spark, books):
    source = lambda schema: spark.read.format("workbook").schema(schema).load(f"{books}/a.xlsx")
    assert {r.D for r in source("row long, A string, D string").collect()} == {None, "2.5"}
    for column in "BC":
        with pytest.raises(Exception, match="could not convert|no item named|sharedStrings"):
            source(f"row long, {column} string").collect()
    with pytest.raises(Exception, match="columns of a workbook"):
        source("row long, label string").collect()


def test_filters_on_the_sheet_choose_partitions(spark, books):
    rows = spark.read.format("workbook").schema("sheet string, row long, A string").load(books).where("sheet = 'choices' AND row > 1")
    assert rows.rdd.getNumPartitions() == 2 and {r.A for r in rows.collect()} == {"yn", None}


class MatWriter:
    """A plain writer of level 5 files."""

    def __init__(self, order="<"):
        self.o = order

    def element(self, kind, data):
        if 0 < len(data) <= 4:
            return struct.pack(self.o + ("HH" if self.o == ">" else "HH"), *((kind, len(data)) if self.o == "<" else (len(data), kind))) + data.ljust(4, b"\0")
        return struct.pack(self.o + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    def matrix(self, kind, shape, name, *parts):
        body = self.element(6, struct.pack(self.o + "II", kind, 0)) + self.element(5, np.array(shape, self.o + "i4").tobytes()) + self.element(1, name.encode()) + b"".join(parts)
        return self.element(14, body)

    def dense(self, x, store=9, name=""):
        x = np.atleast_2d(np.asarray(x, float))
        dtype = {9: "f8", 2: "u1", 3: "i2"}[store]
        return self.matrix(6, x.shape, name, self.element(store, x.astype(self.o + dtype).tobytes(order="F")))

    def sparse(self, x):
        columns, rows = np.nonzero(x.T)
        starts = np.searchsorted(columns, np.arange(x.shape[1] + 1))
        return self.matrix(5, x.shape, "", self.element(5, rows.astype(self.o + "i4").tobytes()), self.element(5, starts.astype(self.o + "i4").tobytes()), self.element(9, x.T[columns, rows].astype(self.o + "f8").tobytes()))

    def texts(self, values):
        chars = [self.matrix(4, (1, len(v)), "", self.element(4, v.encode("utf-16-le" if self.o == "<" else "utf-16-be"))) for v in values]
        return self.matrix(1, (len(values), 1), "", *chars)

    def struct(self, name, fields):
        width = max(map(len, fields)) + 1
        return self.matrix(2, (1, 1), name, self.element(5, struct.pack(self.o + "i", width)), self.element(1, b"".join(f.encode().ljust(width, b"\0") for f in fields)), *fields.values())

    def file(self, path, *variables, packed):
        head = b"MATLAB 5.0 MAT-file".ljust(124) + (b"\x00\x01IM" if self.o == "<" else b"\x01\x00MI")
        if packed:
            variables = [struct.pack(self.o + "II", 15, len(z)) + z for z in (zlib.compress(v) for v in variables)]
        path.write_bytes(head + b"".join(variables))


def _model(seed, m=40, n=70):
    rng = np.random.default_rng(seed)
    s = np.where(rng.random((m, n)) < 0.1, rng.integers(-4, 5, (m, n)), 0).astype(float)
    return s, rng.uniform(-1000, 0, n), rng.uniform(1, 1000, n), (np.arange(n) == 3).astype(float), np.zeros(m), [f"R{j}_é" if j % 9 == 0 else f"RXN{j}" for j in range(n)], [f"m{i}[c]" for i in range(m)]


@pytest.mark.parametrize(("order", "packed", "full"), [("<", True, False), ("<", False, False), (">", True, False), ("<", True, True)])
def test_model_comes_back_from_a_mat_file(spark, tmp_path, order, packed, full):
    s, lb, ub, c, b, rxns, mets = _model(3)
    w = MatWriter(order)
    wrong = w.matrix(6, (1, 1), "", w.element(99, b"12345678"))  # a field that can't be read
    fields = {"description": wrong, "S": w.dense(s, 3) if full else w.sparse(s), "lb": w.dense(lb[:, None]), "ub": w.dense(ub[:, None]), "c": w.dense(c[:, None], 2), "b": w.dense(b[:, None], 2), "rxns": w.texts(rxns), "mets": w.texts(mets)}
    w.file(tmp_path / "m.mat", w.dense([[1, 2]], name="other"), w.struct("model", fields), packed=packed)
    model = read_mat_model(spark, str(tmp_path / "m.mat"))
    assert {(r.met, r.rxn): r.coef for r in model["stoich"].collect()} == {(mets[i], rxns[j]): s[i, j] for i, j in zip(*np.nonzero(s))}
    assert [tuple(r) for r in model["reactions"].collect()] == list(zip(rxns, lb, ub, c))
    assert [tuple(r) for r in model["metabolites"].collect()] == list(zip(mets, b))
    named = spark.read.format("matfile").option("columns", 16).option("variable", "model").schema("file string, coef double").load(str(tmp_path))
    assert named.rdd.getNumPartitions() == 5 and named.count() == np.count_nonzero(s)


def test_files_that_are_not_models(spark, tmp_path):
    w = MatWriter()
    w.file(tmp_path / "none.mat", w.dense([[1]], name="x"), packed=False)
    (tmp_path / "text.mat").write_bytes(b"x" * 200)
    w.file(tmp_path / "cut.mat", w.struct("model", {"S": w.sparse(np.eye(9)), "rxns": w.texts(["a"] * 9), "mets": w.texts(["a"] * 9)}), packed=False)
    (tmp_path / "cut.mat").write_bytes((tmp_path / "cut.mat").read_bytes()[:-300])
    for name, what in (("none", "no struct"), ("text", "not a MAT file"), ("cut", "ends inside")):
        with pytest.raises(Exception, match=what):
            read_mat_model(spark, str(tmp_path / f"{name}.mat"))["stoich"].collect()


def test_a_read_model_is_solved(spark, tmp_path):
    w = MatWriter()
    s = np.array([[1.0, -1.0, 0.0], [0.0, 1.0, -1.0]])
    w.file(tmp_path / "m.mat", w.struct("model", {"S": w.sparse(s), "lb": w.dense([[0], [0], [0]]), "ub": w.dense([[10], [4], [9]]), "c": w.dense([[0], [0], [1]]), "b": w.dense([[0], [0]]), "rxns": w.texts(["in", "mid", "out"]), "mets": w.texts(["a", "b"])}), packed=True)
    model = read_mat_model(spark, str(tmp_path / "m.mat"))
    from pyspark.sql import functions as F

    best = flux.flux_balance(model["reactions"].withColumn("scenario", F.lit("x")), model["stoich"], model["metabolites"]).collect()
    assert {r.objective for r in best} == {4.0} and {r.status for r in best} == {"optimal"}


def _soft(path, samples, rows, end="\n"):
    """A SOFT file, and its table rows and attributes as a plain pass over the lines finds them."""
    rng = np.random.default_rng(1)
    with open(path, "w", newline="") as f:
        f.write(f"^DATABASE = Geo{end}!Database_name = x = y{end}^PLATFORM = P1{end}!platform_table_begin{end}ID\tGene{end}")
        f.writelines(f"p{i}\tg{i % 7}{end}" for i in range(rows))
        f.write(f"!platform_table_end{end}")
        for s in range(samples):
            f.write(f"^SAMPLE = S{s}{end}!Sample_title = subject {s}{end}#ID_REF = probe{end}!sample_table_begin{end}" + ("VALUE\tID_REF" if s % 2 else "ID_REF\tVALUE\tP") + end)
            for i in range(rows if s % 5 else 0):
                v = "null" if i % 11 == 0 else f"{rng.normal():.4f}"
                f.write((f"{v}\tp{i}" if s % 2 else f"p{i}\t{v}\t0.5") + end)
            f.write(f"!sample_table_end{end}!Sample_end = yes{end}")
    cells, attributes = [], []
    name = head = None
    inside = False
    for n, line in enumerate(open(path, newline="").read().split("\n")[:-1], 1):
        line = line.removesuffix("\r")
        if line.startswith("^"):
            name = line.split(" = ", 1)[1]
        elif "_table_begin" in line:
            inside, head = True, None
        elif "_table_end" in line:
            inside = False
        elif inside and head is None:
            head = line.split("\t")
        elif inside:
            cells.append((n, name, tuple(sorted(zip(head, line.split("\t"))))))
        if line.startswith("!") and "=" in line:
            attributes.append((n, name, *line[1:].split(" = ", 1)))
    return cells, attributes


@pytest.mark.parametrize(("split", "end"), [("128m", "\n"), ("700", "\n"), ("64", "\r\n"), ("37", "\n")])
def test_soft_files_read_in_splits_are_the_whole_file(spark, tmp_path, split, end):
    """However a file is split, in the middle of tables, before their first line or right after a mark."""
    from tessera.sources.soft import read_soft_attributes, read_soft_tables

    cells, attributes = _soft(tmp_path / "x.soft", 6, 12, end)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = read_soft_tables(spark, str(tmp_path / "x.soft"))
        assert sorted((r.line_no, r.name, tuple(sorted(r.cells.items()))) for r in rows.collect()) == cells
        assert sorted((r.line_no, r.name, r.key, r.value) for r in read_soft_attributes(spark, str(tmp_path / "x.soft")).collect()) == attributes
        assert (spark.read.text(str(tmp_path / "x.soft")).rdd.getNumPartitions() > 4) == (split != "128m")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
