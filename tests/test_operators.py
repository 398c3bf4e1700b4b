"""Operators against plain loops and known cases."""

import json
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.numbers import python_round
from tessera.functions.text import number_token, unfence
from tessera.operators import flux, forms, interior, judge, learn, near, scorecard
from tessera.plans import queries
from tessera.sources import documents as docs
from tessera.sources.xlsx import read_choices, read_survey

SURVEY = "form_id string, row_idx long, type string, name string, label string, required string, relevant string"


def _loop(rows):
    section, depth, repeat, out = "ROOT", 0, None, []
    for kind, name, label in rows:
        if kind == "begin_group":
            section = label or name
        elif kind == "begin_repeat":
            depth, repeat = depth + 1, label or name
        elif kind == "end_repeat":
            depth = max(0, depth - 1)
            repeat = repeat if depth else None
        out.append((section, depth, repeat))
    return out


def test_state_scan_is_the_loop(spark):
    rng = random.Random(5)
    kinds = ["begin_group", "begin_repeat", "end_repeat", "end_repeat", "select_one a", None, "begin group"]
    sheets = {f"f{k}": [(rng.choice(kinds), f"n{i}", rng.choice([None, "", f"L{i}"])) for i in range(40)] for k in range(20)}
    rows = [(f, i, *r, None, None) for f, sheet in sheets.items() for i, r in enumerate(sheet)]
    got = {(r.form_id, r.row_idx): (r.section, r.depth, r.repeat_name) for r in forms.scan_state(spark.createDataFrame(rows, SURVEY)).collect()}
    assert got == {(f, i): s for f, sheet in sheets.items() for i, s in enumerate(_loop(sheet))}


def _form(spark):
    rows = [
        ("begin_group", "g", "SECCIÓN 9.11. Demencia"), ("select_one yn", "q1", "One"), ("end_repeat", None, None), ("begin_repeat", "r", ""), ("select_multiple yn", "agregar_fam", "In"),
        ("begin_repeat", "inner", "Inner"), ("end_repeat", None, None), ("select_one_from_file iso3166_paises.csv", "c", "Country"), ("end_repeat", None, None), ("select_one_from_file none.csv", "x", "X"),
        ("begin_group", "other", None), ("select_one yn or_other", "agregar_fam", "Gate"), ("select_one yn", "q2", "Two"), ("text", "t", "T"), ("", "e", "E"),
    ]
    return spark.createDataFrame([("f", i, *r, "yes" if i % 2 else "Yes", None) for i, r in enumerate(rows)], SURVEY)


def _choices(spark):
    return spark.createDataFrame([(2, "yn", "2", "No"), (1, "yn", "1", "Yes"), (3, "yn", "0", "Zero"), (4, "yn", "", "Empty"), (5, "yn", "5", None)], "row_idx long, list_name string, value string, label string")


def test_extraction_decides_row_by_row(spark):
    one = {r.row_idx: r for r in forms.extract_questions(_form(spark), _choices(spark), "evaluation").collect()}
    assert sorted(one) == [1, 4, 7, 11, 12]
    # a text of 0 stays
    assert [c.value for c in one[1].choices] == ["1", "2", "0"] and one[11].choices == []
    assert one[1].required and not one[12].required
    assert (one[4].in_repeat, one[4].repeat_name, one[7].repeat_name, one[7].category) == (True, "r", "Inner", "from_file_reduced")
    two = {r.row_idx: r for r in forms.extract_questions(_form(spark), _choices(spark), "generation").collect()}
    assert {k: v.category for k, v in two.items()} == {1: "select", 7: "from_file_reduced", 11: "gate"}
    assert two[11].repeat_name == "Registro de familiares con enfermedad" and two[7].in_repeat
    assert [r.reason for r in forms.excluded_log(_form(spark), _choices(spark)).collect()] == ["Excluido: catálogo none.csv"]
    with pytest.raises(ValueError):
        forms.extract_questions(_form(spark), _choices(spark), "else")


def _workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="survey" r:id="a"/><sheet name="choices" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>select_one yn</t></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f'<worksheet {ns}><sheetData><row r="1">{cell("A1", "type")}</row><row r="2"><c r="A2" t="s"><v>0</v></c>{cell("C2", "Label")}{cell("I2", "a &gt; 1")}</row></sheetData></worksheet>')
        typed = "".join(f'<row>{cell("A9", "yn")}{value}{cell("C9", label)}</row>' for value, label in (('<c r="B9"><v>0</v></c>', "Nought"), (cell("B9", "0"), "Text"), ('<c r="B9" t="b"><v>0</v></c>', "False"), ('<c r="B9" t="b"><v>1</v></c>', "True"), ('<c r="B9"><v>1.5</v></c>', "Half")))
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {ns}><sheetData><row r="1"/><row r="2">{cell("A2", "yn")}<c r="B2"><v>1</v></c>{cell("C2", "Yes")}</row>{typed}</sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    _workbook(tmp_path / "f.xlsx")
    row = read_survey(spark, str(tmp_path / "f.xlsx")).collect()
    assert [(r.row_idx, r.type, r.name, r.label, r.required, r.relevant) for r in row] == [(2, "select_one yn", None, "Label", None, "a > 1")]
    got = read_choices(spark, str(tmp_path / "f.xlsx")).collect()
    assert [tuple(r)[1:] for r in got] == [(2, "yn", "1", "Yes"), (3, "yn", None, "Nought"), (4, "yn", "0", "Text"), (5, "yn", None, "False"), (6, "yn", "True", "True"), (7, "yn", "1.5", "Half")]


def test_documents_round_trip(spark, tmp_path):
    doc = docs.schema_document(forms.extract_questions(_form(spark), _choices(spark)), forms.excluded_log(_form(spark), _choices(spark)), "evaluation")
    docs.write_json_document(doc, str(tmp_path / "s.json"))
    back = docs.read_schema_document(spark, str(tmp_path / "s.json")).collect()
    assert [r.name for r in back] == ["q1", "agregar_fam", "c", "agregar_fam", "q2"] and back[0].choices[0].label == "Yes"
    scores = spark.createDataFrame([("s", 1, 4, 2, 5, True, 0), ("s", 2, 4, 3, 1, False, 1), ("t", 3, 3, 3, 3, False, 2), ("u", None, 1, 1, 1, False, 3)], "section string, clarity int, relevance int, completeness int, granularity int, in_repeat boolean, row_idx long")
    card = scorecard.section_scorecard(scores).join(scorecard.first_appearance(scores).select("section", "first_idx"), "section")
    (tmp_path / "X").mkdir()
    docs.write_section_summary(card, str(tmp_path / "X" / "section_summary_c1_r03.json"))
    text = json.loads((tmp_path / "X" / "section_summary_c1_r03.json").read_text())
    assert list(text) == ["s", "t"] and text["s"]["n_needs_improvement"] == 2 and np.isnan(text["t"]["clarity"]["std"])
    rows = docs.read_section_summaries(spark, str(tmp_path / "X")).orderBy("ord").collect()
    assert [(r.form, r.run, r.section, r.clarity.mean, r.clarity.std) for r in rows] == [("X", 3, "s", 1.5, 0.71), ("X", 3, "t", 3.0, None)]
    docs.write_bom_csv(scores, str(tmp_path / "b.csv"))
    assert (tmp_path / "b.csv").read_bytes().startswith(b"\xef\xbb\xbfsection,")
    assert docs.read_prior_results(spark, str(tmp_path / "nothing"), "name string").count() == 0
    assert scorecard.summary_stability(docs.read_section_summaries(spark, str(tmp_path / "X"))).count() == 1


def test_judge_retries_parses_and_resumes(spark):
    waits = []

    def broken(system, prompt, run):
        raise RuntimeError("down")

    assert judge.ask(broken, "q", 1, sleep=waits.append) == (None, "down") and waits == [30.0, 60.0]
    replies = [('```json\n{"clarity_score": 4, "x": 1}\n```', None), ("no", None), (None, "down"), ("[1]", None), ('{"clarity_score": "5"}', None), ('{"clarity_score": 5} and more', None), ("{'clarity_score': 5}", None)]
    rows = judge.parse_reply(spark.createDataFrame(replies, "reply string, error string")).collect()
    assert [r.clarity_score for r in rows] == [4.0, None, None, None, 5.0, None, None]
    assert rows[0].other == {"x": "1"} and rows[1].clarity_comment == "Error de parseo" and rows[2].clarity_comment == "down" and rows[1].synthetic_generation_issues == "no"
    questions = forms.extract_questions(_form(spark), _choices(spark)).withColumn("name", F.concat("name", F.col("row_idx").cast("string")))
    first = judge.evaluate(questions, judge.StubClient(), runs=2).cache()
    assert first.count() == 10 and first.where("score_in_range").count() == 10
    assert judge.evaluate(questions, judge.StubClient(), runs=3, done=first).count() == 5
    failed = first.withColumn("clarity_score", F.when(F.col("run") == 1, F.col("clarity_score")))
    assert judge.evaluate(questions, judge.StubClient(), runs=2, done=failed, retry_failed=True).count() == 5
    lines = judge.progress(first, 7).where("run = 1").orderBy("idx").collect()
    assert [r.idx for r in lines] == [8, 9, 10, 11, 12] and all(1 <= r.avg <= 5 for r in lines)
    prompts = {r.name: r.prompt for r in judge.with_prompts(questions).collect()}
    assert "(sin opciones" in prompts["agregar_fam11"] and "Pertenece a sección iterativa: r" in prompts["agregar_fam4"]


def test_stream_adds_nothing_twice(spark, tmp_path):
    from tessera.streaming.judging import judge_stream

    questions = forms.extract_questions(_form(spark), _choices(spark)).withColumn("name", F.concat("name", F.col("row_idx").cast("string")))
    questions.coalesce(1).write.parquet(str(tmp_path / "in"))
    for k in range(2):  # another checkpoint folder: all questions come again
        stream = spark.readStream.schema(questions.schema).parquet(str(tmp_path / "in"))
        judge_stream(stream, judge.StubClient(), str(tmp_path / "out"), str(tmp_path / f"c{k}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_stream_retries_by_timers_and_keeps_no_answer_twice(spark, tmp_path):
    import time

    from tessera.streaming.judging import judge_stream

    calls = str(tmp_path / "calls")

    def fails_first(system, prompt, run):
        """Counts its calls in files; the first one for each prompt and run fails, and all do for prompts with `never`."""
        import hashlib
        import os

        name = f"{calls}/{hashlib.sha256(prompt.encode()).hexdigest()[:16]}-{run}"
        with open(name, "a") as f:
            f.write("x")
        if os.path.getsize(name) <= 1 or "never" in prompt:
            raise RuntimeError("busy")
        return judge.StubClient()(system, prompt, run)

    base = forms.extract_questions(_form(spark), _choices(spark)).withColumn("name", F.concat("name", F.col("row_idx").cast("string")))
    base = base.withColumn("label", F.when(F.col("row_idx") == 12, "never").otherwise(F.col("label")))
    (tmp_path / "calls").mkdir()
    base.where("row_idx <= 4").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start = lambda: judge_stream(stream, fails_first, str(tmp_path / "out"), str(tmp_path / "c"), runs=2, backoff=0.1, trigger={"processingTime": "200 milliseconds"})
    results = lambda: spark.read.parquet(str(tmp_path / "out"))

    def until(query, n):
        for _ in range(240):
            time.sleep(0.5)
            assert query.exception() is None
            if (tmp_path / "out").exists() and any((tmp_path / "out").glob("batch=*/_SUCCESS")) and results().count() >= n:
                break
        query.stop()

    until(start(), 4)
    assert {(r.name, r.run) for r in results().where("score_in_range").collect()} == {(n, k) for n in ("q11", "agregar_fam4") for k in (1, 2)}
    # a restart with the same questions again and new ones: each is answered once, or has failed three times
    base.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    until(start(), 10)
    rows = results().collect()
    assert len(rows) == 10 and len({(r.name, r.run) for r in rows}) == 10
    assert sorted((r.run, r.clarity_score, r.clarity_comment) for r in rows if r.row_idx == 12) == [(1, None, "busy"), (2, None, "busy")]
    assert sorted(f.stat().st_size for f in (tmp_path / "calls").iterdir()) == [2] * 8 + [3] * 2


def test_repeated_keys_of_a_reply_take_the_last_value(spark):
    rows = spark.createDataFrame([('{"clarity_score": 1, "clarity_score": 4, "é": [1, {"a": "b"}]}', None), ("[1]", None), ("", None), (None, None)], "reply string, error string")
    got = judge.parse_reply(rows).collect()
    assert [r.clarity_score for r in got] == [4.0, None, None, None] and got[0].other == {"é": '[1,{"a":"b"}]'}


def test_rules_of_a_tree_are_its_predictions(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    rows = spark.createDataFrame([(*map(float, v), int(v[0] > 0.3) + int(v[1] * v[2] > 0)) for v in x] + [(None, 1.0, 1.0, 1)], "`a b` double, y double, z double, label int")
    names = ["a b", "y", "z"]
    model = learn.fit_tree(rows, names, "label", 5)
    rules = learn.tree_rules(model, names, spark).collect()
    told = rows.withColumn("told", learn.by_rules([(r.path, r.prediction) for r in rules])).where("`a b` IS NOT NULL")
    own = model.transform(learn._tree_vectors(told, names))
    assert own.where("told = prediction").count() == 600
    for r in rules:  # each row reaches one leaf, with the numbers that it says
        reached = told.where(r.path)
        assert reached.count() == r.support and max(q["count"] for q in reached.groupBy("label").count().collect()) / r.support == pytest.approx(r.purity)
    assert sum(r.support for r in rules) == 600 and [r.rule for r in rules] == list(range(1, len(rules) + 1)) and max(r.length for r in rules) <= 5


def test_small_functions(spark):
    row = spark.createDataFrame([(" ```x```",)], "t string").select(unfence(F.col("t")).alias("a"), number_token(F.lit(0.28)).alias("b"), number_token(F.lit(1.0)).alias("c"), python_round(F.lit(49 / 40)).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ("x", "0_28", "1", round(49 / 40, 2))


def test_simplex_finds_vertices():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, lb, ub = rng.integers(-2, 3, (2, 5)).astype(float), np.zeros(5), rng.integers(1, 6, 5).astype(float)
        c, b = rng.normal(size=5), np.zeros(2)
        status, x = flux.maximize(c, a, b, lb, ub)
        assert status == "optimal" and np.allclose(a @ x, b, atol=1e-6) and np.all(x >= lb - 1e-6) and np.all(x <= ub + 1e-6)
        free = np.linalg.svd(a)[2][np.linalg.matrix_rank(a) :]
        for _ in range(300):  # no feasible point that is drawn is better
            d = free.T @ rng.normal(size=len(free))
            some = np.abs(d) > 1e-12
            ends = np.stack([(lb[some] - x[some]) / d[some], (ub[some] - x[some]) / d[some]]) if some.any() else np.zeros((2, 1))
            t = rng.uniform() * min(0.0, ends.min(0).max()) if rng.uniform() < 0.5 else rng.uniform() * max(0.0, ends.max(0).min())
            assert c @ (x + t * d) <= c @ x + 1e-6


def test_interior_points_are_as_good_as_vertices():
    rng = np.random.default_rng(6)
    for k in range(60):
        m, n = (int(rng.integers(2, 12)), int(rng.integers(3, 25))) if k < 50 else (40, 90)
        full = np.where(rng.random((m, n)) < 0.4, rng.integers(-3, 4, (m, n)), 0).astype(float)
        full[m - 1] = full[0] * 2  # a row that depends on another
        lb, ub = -rng.integers(0, 4, n).astype(float), rng.integers(0, 1000, n).astype(float)
        b = full @ np.clip(rng.normal(size=n), lb, ub) if k % 3 else np.zeros(m)
        if k % 10 == 9:
            b[m - 1] += 5.0  # no solution
        c = rng.normal(size=n) * (rng.random(n) < 0.5)
        i, j = np.nonzero(full)
        status, x = interior.maximize_sparse(c, interior.Sparse(i, j, full[i, j], full.shape), b, lb, ub)
        other, y = flux.maximize(c, full, b, lb, ub)
        assert status == other, (k, status, other)
        if status == "optimal":
            assert abs(c @ x - c @ y) <= 1e-6 * (1 + abs(c @ y)), (k, c @ x, c @ y)
            assert np.abs(full @ x - b).max() <= 1e-6 * (1 + np.abs(x).max()) and np.all(x >= lb - 1e-6) and np.all(x <= ub + 1e-6)


def test_models_without_bounds_or_solutions():
    one = interior.Sparse(np.array([0, 0]), np.array([0, 1]), np.array([1.0, -1.0]), (1, 2))
    none, free = np.zeros(1), np.full(2, np.inf)
    assert interior.maximize_sparse(np.array([1.0, 0.0]), one, none, np.zeros(2), free)[0] == "unbounded"
    status, x = interior.maximize_sparse(np.array([-1.0, 0.0]), one, none, np.array([-3.0, -np.inf]), free)
    assert status == "optimal" and np.allclose(x, -3, atol=1e-5)
    assert interior.maximize_sparse(np.ones(2), one, none, np.ones(2), np.zeros(2))[0] == "infeasible"
    assert interior.maximize_sparse(np.ones(2), one, np.array([9.0]), np.zeros(2), np.ones(2))[0] == "infeasible"
    assert interior.maximize_sparse(np.ones(2), interior.Sparse(np.zeros(0, int), np.zeros(0, int), np.zeros(0), (1, 2)), none, np.zeros(2), np.ones(2))[1].tolist() == pytest.approx([1, 1], abs=1e-6)


def test_solvers_agree_on_a_model_in_tables(spark):
    rng = np.random.default_rng(9)
    m, n = 60, 110
    full = np.where(rng.random((m, n)) < 0.08, rng.integers(-2, 3, (m, n)), 0).astype(float)
    stoich = spark.createDataFrame([(f"m{i}", f"r{j}", float(full[i, j])) for i, j in zip(*np.nonzero(full))] + [("m1", "other", 1.0), ("none", "r1", 1.0)], "met string, rxn string, coef double")
    mets = spark.createDataFrame([(f"m{i}", 0.0) for i in range(m)], "met string, b double")
    reactions = spark.createDataFrame([(s, f"r{j}", -1000.0 if j % 2 else 0.0, 1000.0 * f if j == 3 else 1000.0, float(j % 7 == 3)) for s, f in (("a", 1.0), ("b", 0.01)) for j in range(n)], "scenario string, rxn string, lb double, ub double, c double")
    best = {k: {r.scenario: (r.status, r.objective) for r in flux.flux_balance(reactions, stoich, mets, k).select("scenario", "status", "objective").distinct().collect()} for k in ("simplex", "interior")}
    assert best["simplex"].keys() == best["interior"].keys() == {"a", "b"}
    for s in "ab":
        assert best["interior"][s][0] == best["simplex"][s][0] == "optimal" and best["interior"][s][1] == pytest.approx(best["simplex"][s][1], rel=1e-6)


def test_clusters_and_anomalies(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.1, (40, 2)), rng.normal(5, 0.1, (40, 2)), [[20.0, 20.0]]])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    got = {r.id: r.cluster for r in learn.dbscan(rows, "id", "v", 0.8, 4).collect()}
    assert {got[i] for i in range(40)} == {0} and {got[i] for i in range(40, 80)} == {40} and got[80] == -1
    assert max(learn.isolation_forest(rows, "id", "v", trees=30).collect(), key=lambda r: r.score).id == 80
    assert max(learn.local_outlier_factor(rows, "id", "v", 5).collect(), key=lambda r: r.lof).id == 80
    assert learn.kmeans(rows, "v", 3)[1] > 0.8
    assert learn.birch(rows, "id", "v", 0.5, 3).select("cluster").distinct().count() == 3
    assert learn.pca_to_variance(rows, "v", 0.85)[1] == 1


def test_forecast_repeats_a_season(spark):
    rows = spark.createDataFrame([("p", t, float(10 + 5 * (t % 2) + t)) for t in range(12)], "k string, t int, v double")
    got = [r.forecast for r in learn.seasonal_forecast(rows, "k", "t", "v", 2, 2).orderBy("step").collect()]
    assert np.allclose(got, [22, 28], atol=1e-6)


def _small_model(spark):
    """Two ways from uptake to product, with peroxide as a by-product of one."""
    stoich = spark.createDataFrame([("a", "IN", 1.0), ("a", "G6PDH2", -1.0), ("b", "G6PDH2", 1.0), ("a", "SLOW", -1.0), ("b", "SLOW", 1.0), ("h", "G6PDH2", 1.0), ("h", "EX_h2o2_e", -1.0), ("b", "OUT", -1.0)], "met string, rxn string, coef double")
    reactions = spark.createDataFrame([("IN", 0.0, 10.0, 0.0), ("G6PDH2", 0.0, 20.0, 0.0), ("SLOW", 0.0, 3.0, 0.0), ("EX_h2o2_e", 0.0, 6.0, 0.0), ("OUT", 0.0, 100.0, 1.0)], "rxn string, lb double, ub double, c double")
    return reactions, stoich, spark.createDataFrame([("a", 0.0), ("b", 0.0), ("h", 0.0)], "met string, b double")


def test_models_round_trip(spark, tmp_path):
    from tessera.sources import models

    reactions, stoich, mets = _small_model(spark)
    models.write_model({"reactions": reactions, "stoich": stoich, "metabolites": mets}, str(tmp_path / "m"))
    back = models.read_model(spark, str(tmp_path / "m"))
    grid = flux.perturb(back["reactions"], flux.scenario_grid(spark))
    optima = flux.flux_balance(grid, back["stoich"], back["metabolites"])
    # G6PD at 0.5 of 20 lets 10 through, peroxide at 0.5 of 6 lets 3, and 3 go the slow way
    assert {r.scenario: round(r.objective, 6) for r in optima.collect()}["G6PD_0_5_h2o2_0_5"] == 6.0
    samples = flux.sample_fluxes(grid, back["stoich"], back["metabolites"], chains=2, samples=20)
    baseline = flux.flux_balance(back["reactions"].withColumn("scenario", F.lit("as it is")), back["stoich"], back["metabolites"])
    models.write_scenarios(str(tmp_path / "out"), grid, optima, samples, baseline)
    assert spark.read.parquet(str(tmp_path / "out" / "samples")).where("chain = 2 AND g6pd = '0_28' AND h2o2 = '0_75'").count() == 20
    assert spark.read.parquet(str(tmp_path / "out" / "v_or")).count() == 5
    assert flux.chain_rhat(samples.withColumn("x", F.element_at("flux", 1)), "x", ["scenario"]).count() == 9


def test_simplex_solves_large_models():
    """A thousand reactions; the optimum is the one that bounds of a chain of reactions give."""
    rng = np.random.default_rng(4)
    n = 1000
    ub = rng.uniform(5, 50, n)
    a = np.zeros((n - 1, n))
    a[np.arange(n - 1), np.arange(n - 1)], a[np.arange(n - 1), np.arange(1, n)] = 1, -1
    status, x = flux.maximize(np.eye(n)[-1], a, np.zeros(n - 1), np.zeros(n), ub)
    assert status == "optimal" and np.allclose(x, ub.min(), atol=1e-6)


def test_neighbours_in_many_cells_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in (0, 4, 9)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    far = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    got = {(r.a, r.b) for r in learn.neighbours(rows, "id", "v", 0.5, block=20).collect()}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(far <= 0.5)) if i < j}
    np.fill_diagonal(far, np.inf)
    near = {(r.id, r["rank"]): r.neighbour for r in learn.nearest(rows, "id", "v", 4, F.col("id") % 20 == 0, block=20).collect()}
    assert near == {(i, k + 1): int(np.argsort(far[i], kind="stable")[k]) for i in range(0, 180, 20) for k in range(4)}


def test_pairs_compared_grow_slowly(spark):
    """Of unit vectors in clusters of about 20: below n ** 1.5, from one size to four times it."""
    rng = np.random.default_rng(2)

    def compared(n):
        centres = rng.normal(size=(n // 20, 12))
        x = centres[rng.integers(0, n // 20, n)] + rng.normal(size=(n, 12)) * 0.05
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
        return near.meeting_blocks(rows, "id", "v", 0.05, block=32).agg(F.sum(F.size("own") * F.size("ids"))).first()[0]

    small, large = compared(1500), compared(6000)
    assert large < small * 4**1.5 and large < 6000**2 / 10, (small, large)


def test_neighbours_of_copies_outliers_and_no_rows(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([np.zeros((150, 2)), rng.normal(size=(90, 2)), [[1e6, 0], [0, -1e6]]])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>")
    far = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    got = {(r.a, r.b) for r in near.neighbours(rows, "id", "v", 0.4, block=16).collect()}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(far <= 0.4)) if i < j}
    np.fill_diagonal(far, np.inf)
    best = {(r.id, r["rank"]): (r.dist, r.neighbour) for r in near.nearest(rows, "id", "v", 3, block=16).collect()}
    assert best == {(i, k + 1): (far[i, j], int(j)) for i in range(len(x)) for k, j in enumerate(np.lexsort((np.arange(len(x)), far[i]))[:3])}
    none = rows.limit(0)
    assert near.neighbours(none, "id", "v", 1.0).count() == near.nearest(none, "id", "v", 3).count() == learn.local_outlier_factor(none, "id", "v", 3).count() == 0
    assert learn.pca_to_variance(none, "v")[1] == 0 and flux.mahalanobis(none, "v", none).count() == 0
    assert flux.mahalanobis(rows, "v", rows).where("id = 999").first().mahalanobis is None


def _groups(spark, monkeypatch):
    """Groups of copies, of near points and lone ones, with vectors that are null or not finite; tasks hold few points of them."""
    monkeypatch.setattr(near, "HELD", 96)
    monkeypatch.setattr(near, "PASSING", 96)
    rng = np.random.default_rng(12)
    x = np.concatenate([np.zeros((90, 3)) + 1e4, rng.normal(1e4 + 3, 0.25, (90, 3)), rng.normal(1e4 + 5, 2, (60, 3))])
    odd = [(900, None), (901, [float("nan"), 1e4, 1e4]), (902, [1e4, None, 1e4])]
    return x, np.sqrt(((x[:, None] - x) ** 2).sum(2)), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "id long, v array<double>")


def test_dbscan_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(learn, "neighbours", None)
    x, far, rows = _groups(spark, monkeypatch)
    eps, least = 0.4, 4
    got = {r.id: (r.is_core, r.cluster) for r in learn.dbscan(rows, "id", "v", eps, least).collect()}
    core, label = (far <= eps).sum(1) >= least, np.arange(len(x))
    while ((new := np.array([min(label[j] for j in np.flatnonzero((far[i] <= eps) & core)) if c else i for i, c in enumerate(core)])) != label).any():
        label = new
    for i in range(len(x)):
        beside = label[(far[i] <= eps) & core]
        assert got[i] == (core[i], label[i] if core[i] else beside.min() if len(beside) else -1)
    assert all(got[i] == (False, -1) for i in (900, 901, 902)) and sum(c for c, _ in got.values()) > 120
    assert {r.id: r.degree for r in learn.density_counts(rows, "id", "v", eps, least).where("id < 900").collect()} == dict(enumerate((far <= eps).sum(1).tolist()))
    blocks, n = near.blocked(rows, "id", "v", block=16)
    counts = near.degrees(blocks, n, eps).select("key", "at", (F.col("degree") >= least).alias("is_core"))
    edges = near.links(blocks, n, eps, counts).where("NOT border").count()
    assert n == len(x) and edges < 4 * n < (far <= eps).sum() / 2


def test_degrees_need_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(learn, "neighbours", None)
    rows = spark.createDataFrame([(i, [float(i // 30), 0.0]) for i in range(75)] + [(99, None)], "id long, v array<double>")
    got = {r.id: (r.degree, r.is_core) for r in learn.density_counts(rows, "id", "v", 0.5, 20).collect()}
    assert got == {i: (30, True) if i < 60 else (15, False) for i in range(75)} | {99: (1, False)}


def test_nearest_shuffles_no_vectors(spark, monkeypatch):
    x, far, rows = _groups(spark, monkeypatch)
    best = near.nearest(rows, "id", "v", 5, block=16)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and not [line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning(id" not in line]
    np.fill_diagonal(far, np.inf)
    got = {(r.id, r["rank"]): r.neighbour for r in best.collect()}
    assert got == {(i, k + 1): int(j) for i in range(len(x)) for k, j in enumerate(np.lexsort((np.arange(len(x)), far[i]))[:5])}


def test_outlier_factors_shuffle_no_vectors(spark, monkeypatch, tmp_path):
    x, far, rows = _groups(spark, monkeypatch)
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    plans, nearest = [], near.nearest

    def seen(*args):
        plans.append((out := nearest(*args))._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(learn, "nearest", seen)
    # copies have no density; the others' factors are compared
    x, far, rows = x[90:], far[90:, 90:], rows.where("id >= 90")
    got = {r.id: r.lof for r in learn.local_outlier_factor(rows, "id", "v", 5).collect()}
    assert len(plans) == 1 and "CartesianProduct" in plans[0]
    np.fill_diagonal(far, np.inf)
    beside = np.argsort(far, axis=1, kind="stable")[:, :5]
    d = np.take_along_axis(far, beside, 1)
    density = 5 / np.maximum(d, d[beside, 4]).sum(1)
    assert np.allclose([got[i + 90] for i in range(len(x))], density[beside].mean(1) / density)


def test_outlier_factors_of_copies(spark, tmp_path):
    """Seven equal points, one whose nearest are five of them, and a group of points that are apart."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.zeros((7, 3)), [[1.0, 0, 0]], rng.normal(50, 1, (20, 3))]).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.id: r.lof for r in learn.local_outlier_factor(rows, "vec_id", "embedding", 5).collect()}
    assert [got[i] for i in range(8)] == [1.0] * 7 + [np.inf]
    alone = {r.id: r.lof for r in learn.local_outlier_factor(rows.where("vec_id > 7"), "vec_id", "embedding", 5).collect()}
    assert alone.keys() == set(range(8, 28)) and all(np.isclose(got[i], v) for i, v in alone.items())
    millionths = {r.id: r.lof_millionths for r in queries.lof(spark, str(tmp_path)).collect()}
    assert millionths == {i: None if v == np.inf else round(v * 1e6) for i, v in got.items()}


def _shuffled(spark, act):
    """Bytes that the stages of act wrote for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def written():
        bus.waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    act()
    return sum(n for k, n in written().items() if k not in before)


def _apart(spark, n):
    """Unit vectors that nearly all lie as far from each other, as the tables' do."""
    x = np.random.default_rng(n).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")


def test_nearest_shuffles_in_proportion(spark, monkeypatch):
    """Vectors are shuffled as often, and a point has as many answers, however many points there are."""
    monkeypatch.setattr(near, "HELD", 512)
    monkeypatch.setattr(near, "PASSING", 512)
    small, large = (_shuffled(spark, lambda n=n: near.nearest(_apart(spark, n), "id", "v", 5, block=64).collect()) for n in (500, 3000))
    assert 500 * 64 * 8 < small and large < small * 6 * 1.1, (small, large)


def test_reaches_of_blocks_shuffle_no_vectors(spark, monkeypatch):
    """Whether Spark takes a node's bound to be small or not, blocks with reaches cost as much as blocks without."""
    monkeypatch.setattr(near, "HELD", 512)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        without, reaches = (_shuffled(spark, lambda k=k: near.blocked(_apart(spark, 1000), "id", "v", block=64, k=k)) for k in (0, 5))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert 1000 * 64 * 8 < without and reaches < without + 1000 * 64 * 8 / 2, (without, reaches)


def test_outlier_factors_shuffle_in_proportion(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(near, "HELD", 512)
    monkeypatch.setattr(near, "PASSING", 512)
    monkeypatch.setattr(learn, "nearest", lambda *args: near.nearest(*args, block=64))
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    small, large = (_shuffled(spark, lambda n=n: learn.local_outlier_factor(_apart(spark, n), "id", "v", 5).collect()) for n in (500, 3000))
    assert 500 * 64 * 8 < small and large < small * 6 * 1.1, (small, large)


def test_degrees_shuffle_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(near, "HELD", 512)
    monkeypatch.setattr(near, "PASSING", 512)
    monkeypatch.setattr(learn, "blocked", lambda *args: near.blocked(*args, block=64))
    small, large = (_shuffled(spark, lambda n=n: learn.density_counts(_apart(spark, n), "id", "v", 0.9, 4).collect()) for n in (500, 3000))
    assert 500 * 64 * 8 < small and large < small * 6 * 1.1, (small, large)


def test_feature_trees_hold_all_points():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.05, (300, 2)) for c in ((0, 0), (3, 0), (0, 3), (5, 5))])
    tree = learn.FeatureTree(2, 0.2, branching=4)
    for v in rng.permutation(x):
        tree.add(v)
    found = tree.features()
    assert sum(n for n, _ in found) == len(x) and 4 <= len(found) < 60
    blocks = learn.FeatureTree(2, 0.2, branching=4)
    for part in np.array_split(rng.permutation(x), 9):
        blocks.add_block(part)
    found = blocks.features()
    assert sum(n for n, _ in found) == len(x) and 4 <= len(found) < 60
    assert np.allclose(sum(n * c for n, c in found), x.sum(0)) and np.allclose(blocks._summed(blocks.root)[1], x.sum(0))
    assert np.allclose(sum(n * c for n, c in found), x.sum(0))


def test_birch_with_tasks_without_rows_and_odd_vectors(spark):
    x = [(i, [float(i % 2) * 9, float(i % 3) / 9]) for i in range(30)]
    odd = [(90, None), (91, [1.0, None]), (92, [float("nan"), 0.0]), (93, [float("inf"), 0.0])]
    rows = spark.createDataFrame(x + odd, "id long, v array<double>").repartition(5).unionAll(spark.createDataFrame([], "id long, v array<double>"))
    rows = rows.repartitionByRange(7, "id").where("id < 6 or id > 20")
    got = {r.id: r.cluster for r in learn.birch(rows, "id", "v", 0.5, 2).collect()}
    kept = [i for i, _ in x if i < 6 or i > 20]
    assert got.keys() == {*kept, 90, 91, 92, 93} and all(got[i] is None for i, _ in odd)
    assert all((got[i] == got[j]) == (i % 2 == j % 2) for i in kept for j in kept)
    assert learn.birch(rows.where("id < 3"), "id", "v", 0.5, 9).count() == 3
    assert learn.birch(rows.where("id < 0"), "id", "v", 0.5, 2).count() == 0
    assert [r.cluster for r in learn.birch(rows.where("id = 90"), "id", "v", 0.5, 2).collect()] == [None]


def test_mahalanobis_is_the_formula(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3)) @ np.array([[1, 0.4, 0], [0, 1, 0.2], [0, 0, 2]])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r.id: r.mahalanobis for r in flux.mahalanobis(rows, "v", rows.where("id < 40")).collect()}
    centred = x - x[:40].mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", centred, np.linalg.inv(np.cov(x[:40].T)), centred))
    assert np.allclose([got[i] for i in range(60)], want, rtol=1e-6)


def test_features_of_matrices(spark):
    rows = spark.createDataFrame([("m", [[1.0, 0.0, 3.0], [2.0, 0.0, -4.0]])], "name string, flux array<array<double>>")
    got = sorted((r["sample"], r.l1, r.l2) for r in flux.flux_features(rows).collect())
    assert got == [(0, 3.0, 5.0**0.5), (1, 0.0, 0.0), (2, 7.0, 5.0)]


def test_trend_counts_pairs(spark):
    rng = random.Random(2)
    rows = [("a", t, float(rng.randrange(6))) for t in range(30)] + [("a", 4, 2.0), ("b", 1, 1.0)]
    got = {r.k: r.mann_kendall for r in learn.trend(spark.createDataFrame(rows, "k string, t int, v double"), "k", "t", "v").collect()}
    of = [r for r in rows if r[0] == "a"]
    assert got == {"a": sum((q[2] > p[2]) - (q[2] < p[2]) for p in of for q in of if p[1] < q[1]), "b": 0}


def test_soft_files(spark, tmp_path):
    from tessera.sources.soft import read_expression, read_soft_attributes

    text = "^PLATFORM = P1\n!Platform_title = Array = one\n!platform_table_begin\nID\tGENE\n1\tG6PD\n!platform_table_end\n"
    text += "".join(f"^SAMPLE = S{k}\r\n!Sample_title = subject {k}\r\n#VALUE = level\r\n!sample_table_begin\r\nID_REF\tVALUE\r\np1\t{k}.5\r\np2\tnull\r\n!sample_table_end\r\n" for k in (1, 2))
    (tmp_path / "x.soft").write_bytes(text.encode())
    assert {(r.kind, r.name, r.key, r.value) for r in read_soft_attributes(spark, str(tmp_path / "x.soft")).collect()} == {("platform", "P1", "Platform_title", "Array = one"), ("sample", "S1", "Sample_title", "subject 1"), ("sample", "S2", "Sample_title", "subject 2")}
    assert sorted((r.subject, r.probe, r.value) for r in read_expression(spark, str(tmp_path / "x.soft")).collect()) == [("S1", "p1", 1.5), ("S1", "p2", None), ("S2", "p1", 2.5), ("S2", "p2", None)]


def test_report_and_rounded_summary(spark):
    scores = spark.createDataFrame([("s", 1, 4, 2, 5, True, 0), ("s", 2, 4, 3, 1, False, 1), ("t", 3, 3, 3, 3, False, 2), ("u", None, 1, 1, 1, False, 3)], "section string, clarity int, relevance int, completeness int, granularity int, in_repeat boolean, row_idx long")
    lines = [r.line for r in scorecard.report_lines(scores).orderBy("part", "ord").collect()]
    assert lines[0] == "Evaluadas: 3/4" and lines[1] == "clarity: 2.00 ± 1.00" and lines[5:] == ["s (2): clarity 1.50, relevance 4.00, completeness 2.50, granularity 3.00", "t (1): clarity 3.00, relevance 3.00, completeness 3.00, granularity 3.00"]
    assert {r.section: r.clarity_std for r in scorecard.rounded_summary(scorecard.section_scorecard(scores)).collect()} == {"s": 0.71, "t": None}
