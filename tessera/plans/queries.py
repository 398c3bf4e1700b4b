"""Registered queries over the driver's tables, and the SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.functions.fixed_values import COUNTRIES, GATE_NOTE, GATES, GENERATION_SECTIONS
from tessera.functions.numbers import binarize
from tessera.functions.text import file_name, first_truthy, list_name, unfence
from tessera.operators import expression, flux, forms, judge, learn, reliability, scorecard, series
from tessera.plans.views import SCORED, SURVEY, choices, scored, survey, table
from tessera.session import ensure_checkpoints

DIMS = scorecard.DIMS


def _mean(d: str) -> str:
    return f"CASE WHEN count({d}) > 0 THEN CAST(sum({d}) AS DOUBLE) / count({d}) END"


def _std(d: str) -> str:
    return f"CASE WHEN count({d}) > 1 THEN sqrt(CAST(count({d}) * sum({d} * {d}) - sum({d}) * sum({d}) AS DOUBLE) / (count({d}) * (count({d}) - 1))) END"


_STATS = ", ".join(f"{_mean(d)} AS {d}_mean, {_std(d)} AS {d}_std" for d in DIMS)
_OVERALL = f"({' + '.join(_mean(d) for d in DIMS)}) / 4 AS avg_overall"
_COUNTS = "count(*) AS n_questions, count(*) FILTER (in_repeat) AS n_in_repeat, count(*) FILTER (completeness <= 2 OR granularity <= 2) AS n_needs_improvement"


def section_scorecard(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.section_scorecard(scored(spark, d))


def global_scores(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.global_scores(scored(spark, d))


def scorecard_rollup(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.scorecard_rollup(scored(spark, d))


def first_appearance_sections(spark: SparkSession, d: str) -> DataFrame:
    keyed = scored(spark, d).withColumn("row_idx", F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return scorecard.first_appearance(keyed).select("section", F.col("first_idx.l_orderkey").alias("first_order"), "n_rows")


def run_stability(spark: SparkSession, d: str) -> DataFrame:
    """Over runs, the spread of each form's section sums, in exact integers."""
    runs = scorecard.scored_only(scored(spark, d)).groupBy("form", "section", "run").agg(F.sum("clarity").alias("s"))
    return runs.groupBy("form", "section").agg(F.count("*").alias("n_runs"), F.sum("s").alias("total"), F.min("s").alias("least"), F.max("s").alias("most"), F.sum(F.col("s") * F.col("s")).alias("squares"))


def stability_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean, deviation and their ratio of section means over runs, in millionths, as sums of means run in any order."""
    out = scorecard.run_stability(scored(spark, d), "clarity")
    return out.select("form", "section", "n_runs", *[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in ("mean", "sd", "least", "most", "cv")])


def program_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Programs (brands) clustered by what is asked of them, in PCA space."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    programs = lines.groupBy("p_brand").agg(F.array(F.avg("l_quantity"), F.avg("l_discount"), F.avg("l_tax"), F.avg("l_extendedprice") / 1000, F.count("*").cast("double") / 100).alias("v"))
    return learn.cluster_in_pca_space(programs, "v", 4)[0].select("p_brand", "cluster")


def before_after_delta(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.form_delta(scored(spark, d), "F", "O")


def low_performers(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.low_performers(section_scorecard(spark, d), 5)


def row_mean_nonnull(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", scorecard.row_mean().alias("row_mean"))


def category_counts(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("in_repeat", F.col("value") > 50).withColumn("row_idx", F.col("event_id"))
    return forms.category_counts(events, "event_type")


def form_state_scan(spark: SparkSession, d: str) -> DataFrame:
    return forms.scan_state(survey(spark, d)).select("form_id", "row_idx", "section", "depth", "repeat_name")


def _questions(spark: SparkSession, d: str, mode: str) -> DataFrame:
    out = forms.extract_questions(survey(spark, d), choices(spark, d), mode)
    return out.withColumn("choices", F.array_join(F.transform("choices", lambda c: F.concat(c["value"], F.lit("="), c["label"])), "|"))


def extract_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d, "evaluation")


def extract_generation(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d, "generation")


def excluded_log(spark: SparkSession, d: str) -> DataFrame:
    return forms.excluded_log(survey(spark, d), choices(spark, d))


def section_counts(spark: SparkSession, d: str) -> DataFrame:
    return forms.section_counts(forms.extract_questions(survey(spark, d), choices(spark, d), "generation"))


def choice_lists(spark: SparkSession, d: str) -> DataFrame:
    return forms.choice_lists(choices(spark, d)).select("list_name", F.array_join(F.transform("choices", lambda c: F.concat(c["value"], F.lit("="), c["label"])), "|").alias("choices"))


def list_name_parse(spark: SparkSession, d: str) -> DataFrame:
    kind = F.concat(F.when(F.col("p_size") % 2 == 0, "select_one ").otherwise("select_multiple "), F.col("p_brand"), F.when(F.col("p_size") % 3 == 0, " or_other ").otherwise(""))
    return table(spark, d, "part").select("p_partkey", list_name(kind).alias("list_name"), first_truthy(F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_name")), F.col("p_brand")).alias("shown"))


def file_name_parse(spark: SparkSession, d: str) -> DataFrame:
    kind = F.concat(F.lit("select_one_from_file "), F.col("p_brand"), F.lit(".csv "))
    return table(spark, d, "part").select("p_partkey", file_name(kind).alias("file_name"))


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").withColumn("list_name", F.concat(F.lit("list"), (F.col("p_size") % 7).cast("string")))
    lists = forms.choice_lists(choices(spark, d))
    return parts.join(F.broadcast(lists), "list_name", "left").select(
        "p_partkey", F.col("p_brand").alias("section"), F.col("p_name").alias("name"), F.col("p_type").alias("label"), F.lit("select_one").alias("type"), F.coalesce("choices", F.array().cast(forms.CHOICE)).alias("choices"),
        F.when(F.col("p_size") % 2 == 0, "x > 1").alias("relevant"), (F.col("p_size") % 3 == 0).alias("in_repeat"), F.when(F.col("p_size") % 6 == 0, "Registro de animales").otherwise("otro").alias("repeat_name"),
    )


def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    return judge.with_prompts(_rendered(spark, d)).select("p_partkey", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"), F.length("prompt").cast("long").alias("n_chars"))


def fence_strip_parse(spark: SparkSession, d: str) -> DataFrame:
    """Replies with and without fences, without JSON, with prose after it and in single quotes, through the judge's parser."""
    n, props = F.col("event_id") % 6, F.replace(F.col("props"), F.lit('"k"'), F.lit('"clarity_score"'))
    reply = F.when(n == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(n == 1, F.concat(F.lit("  "), props, F.lit("\n"))).when(n == 2, F.concat(F.lit("```\n"), props, F.lit("```")))
    reply = reply.when(n == 3, F.repeat(F.lit("no json "), 40)).when(n == 4, F.concat(props, F.lit(" and more"))).otherwise(F.replace(props, F.lit('"'), F.lit("'")))
    parsed = judge.parse_reply(table(spark, d, "events").select("event_id", reply.alias("reply"), F.lit(None).cast("string").alias("error")))
    return parsed.select("event_id", "clarity_score", "clarity_comment", "synthetic_generation_issues", "suggested_improvement", "score_in_range")


def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("name"), "lang")
    return judge.pending(docs, table(spark, d, "labels").select(F.col("doc_id").alias("name")))


def union_resume(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "labels").select(F.col("doc_id").alias("name"), F.col("quality").cast("double").alias("score"))
    return done.unionByName(resume_pending(spark, d).select("name", "lang"), allowMissingColumns=True)


def scenario_grid(spark: SparkSession, d: str) -> DataFrame:
    rxns = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") == 1, "G6PDH2").when(F.col("s_suppkey") == 2, "EX_h2o2_e").otherwise(F.col("s_name")).alias("rxn"), F.lit(0.0).alias("lb"), F.col("s_acctbal").alias("ub"), F.lit(0.0).alias("c"))
    return flux.perturb(rxns, flux.scenario_grid(spark)).select("scenario", "rxn", "ub")


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: F.floor(x * 1000).cast("double"))
    return table(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", V.l1(F.col("v")).alias("l1"), V.l2(F.col("v")).alias("l2"), V.linf(F.col("v")).alias("linf"), V.sparsity(F.col("v")).alias("sparsity"))


def vector_entropy(spark: SparkSession, d: str) -> DataFrame:
    """In billionths, as logarithms differ in the last bit between engines."""
    return table(spark, d, "embeddings").select("vec_id", F.round(V.entropy(F.col("embedding").cast("array<double>")) * 1e6).cast("long").alias("entropy_millionths"))


def distance_to_reference(spark: SparkSession, d: str) -> DataFrame:
    """Distances of integer vectors to the vector of id 0."""
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x * 1000).cast("double")).alias("v"))
    reference = rows.where("vec_id = 0").select(F.col("v").alias("r"))
    both = rows.crossJoin(F.broadcast(reference))  # one row
    diff = V.minus(F.col("v"), F.col("r"))
    return both.select("vec_id", V.l1(diff).alias("d_l1"), V.l2(diff).alias("d_l2"), V.linf(diff).alias("d_linf"), V.dot(F.col("v"), F.col("r")).alias("dot"))


def pathway_share(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_returnflag"), F.col("l_partkey").alias("rxn"), F.col("l_quantity").alias("v"))
    return flux.pathway_usage(lines, table(spark, d, "part").select(F.col("p_partkey").alias("rxn"), F.col("p_type").alias("pathway")))


def metabolite_production(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_returnflag", F.col("l_partkey").alias("rxn"), F.col("l_quantity").alias("v"))
    stoich = table(spark, d, "part").select(F.col("p_partkey").alias("rxn"), F.col("p_brand").alias("met"), (F.col("p_size") % 3 - 1).cast("double").alias("coef"))
    return flux.metabolite_production(lines, stoich)


def log2_binarize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", binarize(F.col("value")).alias("bit"))


def family_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Probe to gene to family: suppliers are probes, their nations genes, regions families; every seventh probe codes for nothing."""
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    values = s.select(F.col("s_suppkey").alias("subject"), F.col("s_suppkey").alias("probe"), F.col("s_acctbal").alias("value"))
    probes = s.select(F.col("s_suppkey").alias("probe"), F.when(F.col("s_suppkey") % 7 != 0, F.col("s_nationkey")).alias("gene"))
    families = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("gene"), F.col("r_name").alias("family"))
    mapped = expression.map_families(values, probes, families)
    genes = mapped.groupBy("family").agg(F.countDistinct("gene").alias("n_genes"))
    return expression.family_matrix(mapped).groupBy("family").agg(F.sum("n").alias("n_probes"), F.sum("active").alias("n_active")).join(genes, "family")


def cluster_clinical(spark: SparkSession, d: str) -> DataFrame:
    """Clusters (market segments) of subjects (customers) against what is known of them (orders)."""
    clinical = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum(F.floor(F.col("o_totalprice") / 1000)).alias("total")).withColumnRenamed("o_custkey", "c_custkey")
    clusters = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("cluster"))
    return expression.clinical_profiles(clusters, clinical, "c_custkey", ["n_orders", "total"])


def section_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sections' figures as summaries state them, to two digits."""
    return scorecard.rounded_summary(section_scorecard(spark, d))


def summary_stability(spark: SparkSession, d: str) -> DataFrame:
    """Over runs, means and deviations of whole summaries by form, in millionths, as sums run in any order."""
    cards = scorecard.section_scorecard(scored(spark, d), ("form", "run", "section"))
    shaped = cards.select("form", "run", "section", "n_questions", "n_needs_improvement", "avg_overall", *[F.struct(F.col(f"{x}_mean").alias("mean"), F.col(f"{x}_std").alias("std")).alias(x) for x in DIMS])
    out = scorecard.summary_stability(shaped)
    return out.select("form", "n_runs", *[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in out.columns[2:]])


def low_questions(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.low_questions(scored(spark, d), 20, "l_partkey")


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    return scorecard.report_lines(scored(spark, d).withColumn("row_idx", F.col("l_orderkey")))


def reference_features(spark: SparkSession, d: str) -> DataFrame:
    """Features of integer vectors and distances to the vector of id 0; quotients in millionths, as logarithms and roots differ in the last bit."""
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x * 1000).cast("double")).alias("flux"))
    both = rows.crossJoin(F.broadcast(rows.where("vec_id = 0").select(F.col("flux").alias("r"))))  # one row
    out = flux.flux_features(both, "flux", "r")
    return out.select("vec_id", "l1", "l2", "linf", "d_l1", "d_l2", "d_linf", *[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in ("d_cosine", "pearson")])


def silhouette(spark: SparkSession, d: str) -> DataFrame:
    value = learn.silhouette(table(spark, d, "embeddings"), "embedding", "label")
    return spark.createDataFrame([(round(value * 1e6),)], "silhouette_millionths long")


def _months(spark: SparkSession, d: str) -> DataFrame:
    t = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int").alias("t")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("program"), t).agg(F.count("*").alias("n"))


def trend_slope(spark: SparkSession, d: str) -> DataFrame:
    """Mann-Kendall statistic and, exact in integers, numerator and denominator of the slope."""
    m = _months(spark, d)
    sums = m.groupBy("program").agg((F.count("*") * F.sum(F.col("t") * F.col("n")) - F.sum("t") * F.sum("n")).alias("slope_num"), (F.count("*") * F.sum(F.col("t") * F.col("t")) - F.sum("t") * F.sum("t")).alias("slope_den"))
    return learn.trend(m, "program", "t", "n").select("program", "n", "mann_kendall").join(sums, "program")


def pre_post_effect(spark: SparkSession, d: str) -> DataFrame:
    return learn.intervention_effect(_months(spark, d), "program", "t", "n", 1995 * 12 + 6).select("program", "pre_mean", "post_mean", "effect")


def trend_decision(spark: SparkSession, d: str) -> DataFrame:
    """Statistic, its variance, score and median slope in millionths, and what they decide."""
    out = series.trend_test(_months(spark, d), "program", "t", "n")
    return out.select("program", "n", "mann_kendall", *[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in ("variance", "z", "sen_slope")], "trend")


def intervention_line(spark: SparkSession, d: str) -> DataFrame:
    """Levels and slopes before and after, in thousandths, and the error of the slope's change without lags."""
    out = series.intervention_test(_months(spark, d), "program", "t", "n", 1995 * 12 + 6, lags=0)
    return out.select("program", "n", *[F.round(F.col(c) * 1e3).cast("long").alias(c) for c in ("level", "slope", "level_change", "slope_change", "se_slope_change")])


def score_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Of each section's parts, judged again and again; in millionths."""
    out = reliability.agreement(scored(spark, d), "clarity", ["section"], ["l_partkey"])
    return out.select("section", "subjects", "n", *[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in ("within", "between", "icc")])


def paired_forms(spark: SparkSession, d: str) -> DataFrame:
    """Parts judged under both forms, by section."""
    out = reliability.paired_permutation(scored(spark, d), "clarity", ["section"], ["l_partkey"], "form", "F", "O")
    return out.select("section", "pairs", "extreme", "draws", "rank", *[F.round(F.col(c) * 1e6).cast("long").alias(c) for c in ("change", "p_value", "p_adjusted")])


def chain_rhat(spark: SparkSession, d: str) -> DataFrame:
    """Of every dimension; chains are ids modulo three; rounded to millionths, as sums run in any order."""
    rows = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 3).alias("chain"), F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    return flux.chain_rhat(rows, "x", ["label", "dim"]).select("label", "dim", "n_chains", F.round(F.col("rhat") * 1e6).cast("long").alias("rhat_millionths"))


def lof_knn(spark: SparkSession, d: str) -> DataFrame:
    near = learn.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", 5)
    return near.select(F.col("id").alias("vec_id"), "neighbour", "rank")


def lof(spark: SparkSession, d: str) -> DataFrame:
    """In millionths, as sums run in any order; null for factors that are infinite, beside copies."""
    ensure_checkpoints(spark)
    return learn.local_outlier_factor(table(spark, d, "embeddings"), "vec_id", "embedding", 5).select("id", F.round(F.col("lof") * 1e6).try_cast("long").alias("lof_millionths"))


EPS, MIN_POINTS = 0.9, 4


def dbscan_core(spark: SparkSession, d: str) -> DataFrame:
    return learn.density_counts(table(spark, d, "embeddings"), "vec_id", "embedding", EPS, MIN_POINTS).select(F.col("id").alias("vec_id"), F.col("degree").cast("long"), "is_core")


def dbscan(spark: SparkSession, d: str) -> DataFrame:
    ensure_checkpoints(spark)
    return learn.dbscan(table(spark, d, "embeddings"), "vec_id", "embedding", EPS, MIN_POINTS)


def pca85(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return learn.pca_to_variance(rows, "v")[0].select("vec_id", "pca")


def kmeans(spark: SparkSession, d: str) -> DataFrame:
    return learn.kmeans(table(spark, d, "embeddings"), "embedding", 10)[0].select("vec_id", "cluster")


def birch_like(spark: SparkSession, d: str) -> DataFrame:
    return learn.birch(table(spark, d, "embeddings"), "vec_id", "embedding", 0.5, 10)


def tree_explainer(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    rows = vectors.select("label", *[F.element_at("embedding", i + 1).alias(f"x{i}") for i in range(width)])
    importance, _ = learn.explain_by_tree(rows, [f"x{i}" for i in range(width)], "label")
    return spark.createDataFrame(sorted(importance.items()), "feature string, importance double")


def isolation_forest(spark: SparkSession, d: str) -> DataFrame:
    return learn.isolation_forest(table(spark, d, "embeddings"), "vec_id", "embedding")


def sarima_lite(spark: SparkSession, d: str) -> DataFrame:
    """In ten-thousandths, as sums run in any order."""
    return learn.seasonal_forecast(_months(spark, d), "program", "t", "n", 6, 12).select("program", "step", F.round(F.col("forecast") * 1e4).cast("long").alias("forecast_e4"))


def mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return flux.mahalanobis(rows, "v", rows.where("label = 0")).select("vec_id", "mahalanobis")


def _model(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A network from the tables: each region is a metabolite that its suppliers' balances let in and its customers' let out; the first two regions' inflows are those that scenarios change."""
    def balance(name: str, key: str, money: str) -> DataFrame:
        t, n, r = table(spark, d, name), table(spark, d, "nation"), table(spark, d, "region")
        sums = t.join(n, t[key] == n.n_nationkey).groupBy("n_regionkey").agg(F.sum(F.greatest(F.floor(money), F.lit(0))).cast("double").alias("ub"))
        return r.join(sums, r.r_regionkey == sums.n_regionkey, "left").select("r_regionkey", "r_name", F.coalesce("ub", F.lit(0.0)).alias("ub"))

    inward = F.when(F.col("r_regionkey") == 0, "G6PDH2").when(F.col("r_regionkey") == 1, "EX_h2o2_e").otherwise(F.concat(F.lit("IN_"), "r_name")).alias("rxn")
    outward = F.concat(F.lit("OUT_"), "r_name").alias("rxn")
    zero = F.lit(0.0)
    reactions = balance("supplier", "s_nationkey", "s_acctbal").select(inward, zero.alias("lb"), "ub", zero.alias("c")).unionAll(balance("customer", "c_nationkey", "c_acctbal").select(outward, zero.alias("lb"), "ub", F.lit(1.0).alias("c")))
    regions = table(spark, d, "region")
    stoich = regions.select(F.col("r_name").alias("met"), inward, F.lit(1.0).alias("coef")).unionAll(regions.select(F.col("r_name").alias("met"), outward, F.lit(-1.0).alias("coef")))
    return reactions, stoich, regions.select(F.col("r_name").alias("met"), zero.alias("b"))


def fba_lp(spark: SparkSession, d: str) -> DataFrame:
    reactions, stoich, mets = _model(spark, d)
    return flux.flux_balance(flux.perturb(reactions, flux.scenario_grid(spark)), stoich, mets).select("scenario", "status", F.round(F.col("objective") * 100).cast("long").alias("objective_cents")).distinct()


def hit_and_run(spark: SparkSession, d: str) -> DataFrame:
    reactions, stoich, mets = _model(spark, d)
    return flux.flux_features(flux.sample_fluxes(flux.perturb(reactions, flux.scenario_grid(spark)), stoich, mets))


def judge_runs(spark: SparkSession, d: str) -> DataFrame:
    """Questions of the survey view judged by the stub in all runs, then summed up by section."""
    from tessera.operators.judge import StubClient, as_scorecard_input, evaluate

    questions = forms.extract_questions(survey(spark, d), choices(spark, d), "generation")
    return scorecard.section_scorecard(as_scorecard_input(evaluate(questions, StubClient())), ("run", "section"))


_FUNCTIONS = (
    section_scorecard, global_scores, scorecard_rollup, first_appearance_sections, run_stability, stability_stats, program_clusters, before_after_delta, low_performers, row_mean_nonnull, category_counts, form_state_scan,
    extract_evaluation, extract_generation, excluded_log, section_counts, choice_lists, list_name_parse, file_name_parse, prompt_render, fence_strip_parse, resume_pending, union_resume, scenario_grid,
    vector_norms, vector_entropy, distance_to_reference, pathway_share, metabolite_production, log2_binarize, family_mapping, trend_slope, pre_post_effect, chain_rhat, lof_knn, lof, dbscan_core, dbscan,
    cluster_clinical, section_summary, summary_stability, low_questions, report_lines, reference_features, silhouette, pca85, kmeans, birch_like, tree_explainer, isolation_forest, sarima_lite, mahalanobis, fba_lp, hit_and_run, judge_runs,
    trend_decision, intervention_line, score_agreement, paired_forms,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}


def _values(items) -> str:
    quote = lambda x: "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, row)) + ")" for row in items)


_COUNTRIES = "|".join(f"{k}={v}" for k, v in COUNTRIES.items())
_EXTRACT = f"""WITH {SURVEY}, gates(gate, gate_label) AS (VALUES {_values(GATES.items())}), targets(target) AS (VALUES {_values((s,) for s in GENERATION_SECTIONS)}),
sel AS (
  SELECT state.*, depth > 0 AS rep, CASE WHEN depth > 0 THEN begun END AS rep_name, type LIKE '%from_file%' AS ff, trim(string_split(type, 'from_file ')[-1]) AS file, gate_label, target,
    trim(replace(replace(type, 'select_one ', ''), 'select_multiple ', '')) AS ln FROM state LEFT JOIN gates ON name = gate LEFT JOIN targets ON section = target WHERE type LIKE '%select%'
)"""
_EXTRACTED = """SELECT form_id, row_idx, section, name, label, CASE WHEN type LIKE '%select_multiple%' THEN 'select_multiple' ELSE 'select_one' END AS type,
  CASE WHEN ff THEN '{countries}' ELSE coalesce(array_to_string(choices, '|'), '') END AS choices, relevant, required = 'yes' AS required, {category} AS category,
  {rep} AS in_repeat, {rep_name} AS repeat_name, {note} AS note FROM sel LEFT JOIN lists ON ln = list_name WHERE {keep}"""
_FILE_KEPT = "ff AND file = 'iso3166_paises.csv'"
_GENERATED = f"({_FILE_KEPT}) OR (NOT ff AND NOT rep AND (gate_label IS NOT NULL OR target IS NOT NULL))"
_VEC = "list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1000))"
_FOLD = "list_reduce(list_prepend(0.0::DOUBLE, {v}), lambda s, x: {e})"


def _fold(v: str, e: str) -> str:
    return _FOLD.format(v=v, e=e)


from tessera.functions.fixed_values import NO_CHOICES, PARSE_ERROR, PROMPT, REPEAT_CONTEXT, REVIEW  # noqa: E402

_Q = {k: "'" + v.replace("'", "''") + "'" for k, v in PROMPT.items()}
_RENDER = f"""concat({_Q["section"]}, p_brand, {_Q["name"]}, p_name, {_Q["label"]}, p_type, {_Q["type"]}, 'select_one',
  CASE WHEN p_size % 2 = 0 THEN {_Q["relevant"]} || 'x > 1' ELSE '' END,
  CASE WHEN p_size % 6 = 0 THEN concat({_Q["repeat"]}, 'Registro de animales', {_Q["context"]}, '{REPEAT_CONTEXT["Registro de animales"]}') WHEN p_size % 3 = 0 THEN concat({_Q["repeat"]}, 'otro') ELSE '' END,
  {_Q["choices"]}, coalesce(opts, '{NO_CHOICES}'))"""
_ASKED = f"""concat({_Q["section"]}, section, {_Q["name"]}, name, {_Q["label"]}, coalesce(label, 'None'), {_Q["type"]}, CASE WHEN type LIKE '%select_multiple%' THEN 'select_multiple' ELSE 'select_one' END,
  CASE WHEN relevant <> '' THEN {_Q["relevant"]} || relevant ELSE '' END, CASE WHEN ff AND rep AND rep_name <> '' THEN {_Q["repeat"]} || rep_name ELSE '' END,
  {_Q["choices"]}, CASE WHEN ff THEN '{chr(10).join(f"  - {k}: {v}" for k, v in COUNTRIES.items())}' ELSE coalesce(opts, '{NO_CHOICES}') END)"""
_MONTHS = "months AS (SELECT o_orderpriority AS program, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS t, count(*) AS n FROM orders GROUP BY 1, 2)"
_DIST = "sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))), lambda s, x: s + x))"

ORACLE_SQL = {
    "section_scorecard": f"WITH {SCORED} SELECT section, {_COUNTS}, {_STATS}, {_OVERALL} FROM valid GROUP BY section",
    "global_scores": f"WITH {SCORED} SELECT count(*) AS n_questions, {_STATS}, {_OVERALL} FROM valid",
    "scorecard_rollup": f"WITH {SCORED} SELECT section, CAST(grouping(section) AS INTEGER) AS is_total, {_COUNTS}, {_STATS}, {_OVERALL} FROM valid GROUP BY ROLLUP (section)",
    "first_appearance_sections": f"WITH {SCORED} SELECT section, min(l_orderkey) AS first_order, count(*) AS n_rows FROM scored GROUP BY section",
    "run_stability": f"WITH {SCORED} SELECT form, section, count(*) AS n_runs, CAST(sum(s) AS BIGINT) AS total, CAST(min(s) AS BIGINT) AS least, CAST(max(s) AS BIGINT) AS most, CAST(sum(s * s) AS BIGINT) AS squares FROM (SELECT form, section, run, sum(clarity) AS s FROM valid GROUP BY ALL) GROUP BY ALL",
    "stability_stats": f"WITH {SCORED}, m AS (SELECT form, section, run, CAST(sum(clarity) AS DOUBLE) / count(clarity) AS m FROM valid GROUP BY ALL), a AS (SELECT form, section, count(*) AS n_runs, avg(m) AS mean, stddev_samp(m) AS sd, min(m) AS least, max(m) AS most FROM m GROUP BY ALL) SELECT form, section, n_runs, " + ", ".join(f"CAST(round({e} * 1e6) AS BIGINT) AS {c}" for c, e in (("mean", "mean"), ("sd", "sd"), ("least", "least"), ("most", "most"), ("cv", "sd / mean"))) + " FROM a",
    "before_after_delta": f"WITH {SCORED}, sides AS (SELECT section, " + ", ".join(f"CAST(sum({d}) FILTER (form = '{f}') AS DOUBLE) / nullif(count({d}) FILTER (form = '{f}'), 0) AS {d}_{s}" for d in DIMS for s, f in (("before", "F"), ("after", "O"))) + " FROM valid WHERE form IN ('F', 'O') GROUP BY section) SELECT *, " + ", ".join(f"{d}_after - {d}_before AS {d}_delta" for d in DIMS) + " FROM sides",
    "low_performers": f"WITH {SCORED} SELECT section, count(*) AS n_questions, count(*) FILTER (completeness <= 2 OR granularity <= 2) AS n_needs_improvement, {_OVERALL} FROM valid GROUP BY section ORDER BY n_needs_improvement DESC, avg_overall, section LIMIT 5",
    "row_mean_nonnull": f"WITH {SCORED} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(coalesce(clarity, 0) + relevance + completeness + granularity AS DOUBLE) / (3 + (clarity IS NOT NULL)::INTEGER) AS row_mean FROM scored",
    "category_counts": "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_in_repeat, min(event_id) AS first_idx FROM events GROUP BY event_type",
    "form_state_scan": f"WITH {SURVEY} SELECT form_id, row_idx, section, depth, CASE WHEN depth > 0 THEN begun END AS repeat_name FROM state",
    "extract_evaluation": f"{_EXTRACT} " + _EXTRACTED.format(countries=_COUNTRIES, category="CASE WHEN ff THEN 'from_file_reduced' ELSE 'select' END", rep="rep", rep_name="rep_name", note="CASE WHEN ff THEN 'ISO 3166 reducido a 15 países' END", keep=f"NOT ff OR ({_FILE_KEPT})"),
    "extract_generation": f"{_EXTRACT} " + _EXTRACTED.format(
        countries=_COUNTRIES, category="CASE WHEN ff THEN 'from_file_reduced' WHEN gate_label IS NOT NULL THEN 'gate' ELSE 'select' END", rep="CASE WHEN ff THEN rep ELSE false END", rep_name="CASE WHEN ff THEN rep_name ELSE gate_label END",
        note=f"CASE WHEN ff THEN 'ISO 3166 reducido a 15 países' WHEN gate_label IS NOT NULL THEN '{GATE_NOTE}' END", keep=_GENERATED,
    ),
    "excluded_log": f"{_EXTRACT} SELECT form_id, row_idx, name, label, CASE WHEN file = 'lab_loinc.csv' THEN 'Excluido: LOINC laboratorio' ELSE 'Excluido: catálogo ' || file END AS reason FROM sel WHERE ff AND file <> 'iso3166_paises.csv'",
    "section_counts": f"{_EXTRACT}, ords(target, ord) AS (VALUES {', '.join(f'({_values([(s,)])[1:-1]}, {i})' for i, s in enumerate(GENERATION_SECTIONS))}) SELECT CAST(ord AS INTEGER) AS ord, section, count(*) AS n FROM sel JOIN ords ON section = ords.target WHERE NOT ff AND NOT rep AND gate_label IS NULL GROUP BY ALL",
    "choice_lists": "SELECT 'list' || n_regionkey AS list_name, string_agg(n_nationkey || '=' || n_name, '|' ORDER BY n_nationkey) AS choices FROM nation WHERE n_nationkey <> 0 GROUP BY 1",
    "list_name_parse": "SELECT p_partkey, p_brand || CASE WHEN p_size % 3 = 0 THEN ' or_other' ELSE '' END AS list_name, CASE WHEN p_size % 5 = 0 THEN p_brand ELSE p_name END AS shown FROM part",
    "file_name_parse": "SELECT p_partkey, p_brand || '.csv' AS file_name FROM part",
    "prompt_render": "WITH lists AS (SELECT n_regionkey AS k, string_agg('  - ' || n_nationkey || ': ' || n_name, chr(10) ORDER BY n_nationkey) AS opts FROM nation WHERE n_nationkey <> 0 GROUP BY 1), r AS (SELECT p_partkey, " + _RENDER + " AS p FROM part LEFT JOIN lists ON p_size % 7 = k) SELECT p_partkey, md5(p) AS prompt_md5, length(p) AS n_chars FROM r",
    "fence_strip_parse": f"""WITH r AS (SELECT event_id, event_id % 6 AS n, replace(props, '"k"', '"clarity_score"') AS p FROM events) SELECT event_id, CASE WHEN n < 3 THEN TRY_CAST(json_extract_string(p, '$.clarity_score') AS DOUBLE) END AS clarity_score,
      CASE WHEN n >= 3 THEN '{PARSE_ERROR}' END AS clarity_comment, CASE n WHEN 3 THEN substr(repeat('no json ', 40), 1, 200) WHEN 4 THEN substr(p || ' and more', 1, 200) WHEN 5 THEN substr(replace(p, '"', chr(39)), 1, 200) END AS synthetic_generation_issues,
      CASE WHEN n >= 3 THEN '{REVIEW}' END AS suggested_improvement, false AS score_in_range FROM r""",
    "resume_pending": "SELECT doc_id AS name, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "union_resume": "SELECT doc_id AS name, CAST(quality AS DOUBLE) AS score, NULL AS lang FROM labels UNION ALL SELECT doc_id, NULL, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "scenario_grid": "SELECT 'G6PD_' || n1 || '_h2o2_' || n2 AS scenario, CASE s_suppkey WHEN 1 THEN 'G6PDH2' WHEN 2 THEN 'EX_h2o2_e' ELSE s_name END AS rxn, CASE s_suppkey WHEN 1 THEN s_acctbal * f1 WHEN 2 THEN s_acctbal * f2 ELSE s_acctbal END AS ub FROM supplier, (VALUES (0.1::DOUBLE, '0_1'), (0.28::DOUBLE, '0_28'), (0.5::DOUBLE, '0_5')) AS a(f1, n1), (VALUES (1::DOUBLE, '1'), (0.75::DOUBLE, '0_75'), (0.5::DOUBLE, '0_5')) AS b(f2, n2)",
    "vector_norms": f"WITH e AS (SELECT vec_id, {_VEC} AS v FROM embeddings) SELECT vec_id, {_fold('v', 's + abs(x)')} AS l1, sqrt({_fold('v', 's + x * x')}) AS l2, {_fold('v', 'greatest(s, abs(x))')} AS linf, CAST(len(list_filter(v, lambda x: abs(x) <= 1e-9)) AS DOUBLE) / len(v) AS sparsity FROM e",
    "vector_entropy": f"WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS v FROM embeddings), t AS (SELECT vec_id, v, {_fold('v', 's + x')} AS n FROM e) SELECT vec_id, CAST(round(list_sum(list_transform(list_filter(v, lambda x: x > 0), lambda x: -(x / n) * ln(x / n))) * 1e6) AS BIGINT) AS entropy_millionths FROM t",
    "distance_to_reference": f"WITH e AS (SELECT vec_id, {_VEC} AS v FROM embeddings), d AS (SELECT e.vec_id, list_transform(list_zip(e.v, r.v), lambda z: z[1] - z[2]) AS x, list_transform(list_zip(e.v, r.v), lambda z: z[1] * z[2]) AS p FROM e, e AS r WHERE r.vec_id = 0) SELECT vec_id, {_fold('x', 's + abs(x)').replace('list_prepend(0.0::DOUBLE, x)', 'list_prepend(0.0::DOUBLE, d.x)')} AS d_l1, sqrt({_fold('d.x', 's + x * x')}) AS d_l2, {_fold('d.x', 'greatest(s, abs(x))')} AS d_linf, {_fold('d.p', 's + x')} AS dot FROM d",
    "pathway_share": "WITH u AS (SELECT l_returnflag, p_type AS pathway, sum(l_quantity) AS usage FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT *, usage / sum(usage) OVER (PARTITION BY l_returnflag) AS share FROM u",
    "metabolite_production": "WITH x AS (SELECT l_returnflag, p_brand AS met, (p_size % 3 - 1) * l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT l_returnflag, met, sum(greatest(q, 0.0)) AS produced, sum(q) AS net FROM x GROUP BY ALL",
    "log2_binarize": "SELECT event_id, CASE WHEN value > 0 THEN CAST(log2(value) > 1.5 AS INTEGER) END AS bit FROM events",
    "family_mapping": "SELECT r_name AS family, count(*) AS n_probes, CAST(count(*) FILTER (s_acctbal > 0 AND log2(greatest(s_acctbal, 1e-9)) > 1.5) AS BIGINT) AS n_active, count(DISTINCT n_nationkey) AS n_genes FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 7 <> 0 GROUP BY 1",
    "trend_slope": f"WITH {_MONTHS}, p AS (SELECT a.program, CAST(sum(sign(b.n - a.n)) AS BIGINT) AS mann_kendall FROM months a JOIN months b ON a.program = b.program AND a.t < b.t GROUP BY 1) SELECT program, count(*) AS n, any_value(mann_kendall) AS mann_kendall, CAST(count(*) * sum(t * n) - sum(t) * sum(n) AS BIGINT) AS slope_num, CAST(count(*) * sum(t * t) - sum(t) * sum(t) AS BIGINT) AS slope_den FROM months JOIN p USING (program) GROUP BY program",
    "pre_post_effect": f"WITH {_MONTHS}, s AS (SELECT program, avg(n) FILTER (t < 23946) AS pre_mean, avg(n) FILTER (t >= 23946) AS post_mean FROM months GROUP BY 1) SELECT *, post_mean - pre_mean AS effect FROM s",
    "chain_rhat": "WITH x AS (SELECT label, vec_id % 3 AS c, CAST(unnest(embedding) AS DOUBLE) AS x, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS dim FROM embeddings), p AS (SELECT label, dim, c, count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM x GROUP BY ALL), g AS (SELECT label, dim, count(*) AS n_chains, avg(n) AS n, avg(v) AS w, var_samp(m) AS b FROM p GROUP BY 1, 2) SELECT label, dim, n_chains, CAST(round(sqrt(((n - 1) / n * w + b) / w) * 1e6) AS BIGINT) AS rhat_millionths FROM g",
    "lof_knn": f"SELECT vec_id, neighbour, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5",
    "dbscan_core": f"SELECT a.vec_id, count(*) AS degree, count(*) >= {MIN_POINTS} AS is_core FROM embeddings a JOIN embeddings b ON {_DIST} <= {EPS} GROUP BY 1",
}

_MEAN2 = ", ".join(f"CAST(printf('%.2f', {e}) AS DOUBLE) AS {n}" for d in DIMS for e, n in ((_mean(d), f"{d}_mean"), (_std(d), f"{d}_std")))
_CENTRES = f"d AS (SELECT a.vec_id AS a, a.label AS la, b.label AS lb, b.vec_id AS b, power({_DIST}, 2) AS q FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"
_KNN = f"near AS (SELECT * FROM (SELECT a.vec_id AS id, b.vec_id AS nb, {_DIST} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 5)"
_LINES = ", ".join(f"'{d}: ' || printf('%.2f', {_mean(d)}) || ' ± ' || printf('%.2f', {_std(d)})" for d in DIMS)
_SECTION_LINE = " || ', ' || ".join(f"'{d} ' || printf('%.2f', {_mean(d)})" for d in DIMS)
ORACLE_SQL |= {
    "cluster_clinical": "WITH o AS (SELECT o_custkey, count(*) AS n_orders, sum(floor(o_totalprice / 1000)) AS total FROM orders GROUP BY 1), l AS (SELECT c_mktsegment AS cluster, unnest(['n_orders', 'total']) AS variable, unnest([CAST(n_orders AS DOUBLE), total]) AS x FROM customer JOIN o ON c_custkey = o_custkey) SELECT cluster, variable, count(*) AS n, sum(x) / count(*) AS mean, CASE WHEN count(*) > 1 THEN sqrt((count(*) * sum(x * x) - sum(x) * sum(x)) / CAST(count(*) * (count(*) - 1) AS DOUBLE)) END AS std FROM l GROUP BY ALL",
    "section_summary": f"WITH {SCORED} SELECT section, {_COUNTS}, {_MEAN2}, CAST(printf('%.2f', {_OVERALL.removesuffix(' AS avg_overall')}) AS DOUBLE) AS avg_overall FROM valid GROUP BY section",
    "summary_stability": f"WITH {SCORED}, c AS (SELECT form, run, section, {_COUNTS}, {', '.join(f'{_mean(d)} AS {d}' for d in DIMS)}, {_OVERALL.replace('avg_overall', 'overall')} FROM valid GROUP BY ALL), r AS (SELECT form, run, {', '.join(f'sum({d} * n_questions) / sum(n_questions) AS {d}' for d in (*DIMS, 'overall'))}, sum(n_needs_improvement) AS needs_improvement FROM c GROUP BY ALL) SELECT form, count(*) AS n_runs, {', '.join(f'CAST(round({f}({d}) * 1e6) AS BIGINT) AS {d}_{x}' for d in (*DIMS, 'overall', 'needs_improvement') for f, x in (('avg', 'mean'), ('stddev_samp', 'sd')))} FROM r GROUP BY form",
    "low_questions": f"WITH {SCORED} SELECT l_partkey, count(*) AS n_runs, count(*) FILTER (completeness <= 2 OR granularity <= 2) AS n_needs_improvement, CAST(sum(clarity + relevance + completeness + granularity) AS DOUBLE) / (4 * count(*)) AS mean FROM valid GROUP BY 1 ORDER BY n_needs_improvement DESC, mean, l_partkey LIMIT 20",
    "report_lines": f"WITH {SCORED}, top AS (SELECT ['Evaluadas: ' || count(*) || '/' || (SELECT count(*) FROM scored), {_LINES}] AS l FROM valid), firsts AS (SELECT section, min(l_orderkey) AS ord FROM scored GROUP BY 1) SELECT CAST(0 AS INTEGER) AS part, unnest(range(0, len(l))) AS ord, unnest(l) AS line FROM top UNION ALL SELECT 1, any_value(ord), section || ' (' || count(*) || '): ' || {_SECTION_LINE} FROM valid JOIN firsts USING (section) GROUP BY section",
    "reference_features": f"WITH e AS (SELECT vec_id, {_VEC} AS v FROM embeddings), d AS (SELECT e.vec_id, e.v, r.v AS r, list_transform(list_zip(e.v, r.v), lambda z: z[1] - z[2]) AS x, list_transform(list_zip(e.v, r.v), lambda z: z[1] * z[2]) AS p FROM e, e AS r WHERE r.vec_id = 0), s AS (SELECT vec_id, {_fold('v', 's + abs(x)').replace('list_prepend(0.0::DOUBLE, v)', 'list_prepend(0.0::DOUBLE, d.v)')} AS l1, sqrt({_fold('d.v', 's + x * x')}) AS l2, {_fold('d.v', 'greatest(s, abs(x))')} AS linf, {_fold('d.x', 's + abs(x)')} AS d_l1, sqrt({_fold('d.x', 's + x * x')}) AS d_l2, {_fold('d.x', 'greatest(s, abs(x))')} AS d_linf, {_fold('d.p', 's + x')} AS dot, {_fold('d.v', 's + x')} AS sa, {_fold('d.r', 's + x')} AS sb, {_fold('d.v', 's + x * x')} AS aa, {_fold('d.r', 's + x * x')} AS bb, len(d.v) AS n FROM d) SELECT vec_id, l1, l2, linf, d_l1, d_l2, d_linf, CAST(round((1 - dot / (sqrt(aa) * sqrt(bb))) * 1e6) AS BIGINT) AS d_cosine, CAST(round((n * dot - sa * sb) / (sqrt(n * aa - sa * sa) * sqrt(n * bb - sb * sb)) * 1e6) AS BIGINT) AS pearson FROM s",
    "silhouette": f"WITH {_CENTRES}, m AS (SELECT a, la, lb, avg(q) AS q FROM d GROUP BY ALL), s AS (SELECT a, max(q) FILTER (la = lb) AS own, min(q) FILTER (la <> lb) AS other FROM m GROUP BY a) SELECT CAST(round(avg(CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(other, own) END) * 1e6) AS BIGINT) AS silhouette_millionths FROM s",
    "lof": f"WITH {_KNN}, k AS (SELECT id, max(d) AS kd FROM near GROUP BY 1), r AS (SELECT near.id, count(*) / sum(greatest(d, kd)) AS lrd FROM near JOIN k ON nb = k.id GROUP BY 1) SELECT near.id, CAST(round(avg(o.lrd) / any_value(r.lrd) * 1e6) AS BIGINT) AS lof_millionths FROM near JOIN r ON near.id = r.id JOIN r o ON near.nb = o.id GROUP BY 1",
    "dbscan": f"WITH RECURSIVE near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON {_DIST} <= {EPS}), core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= {MIN_POINTS}), links AS (SELECT near.a, b FROM near JOIN core ON near.a = core.a JOIN core c ON near.b = c.a), reach(a, l) AS (SELECT a, a FROM core UNION SELECT links.b, reach.l FROM reach JOIN links ON reach.a = links.a), named AS (SELECT a, min(l) AS l FROM reach GROUP BY a), border AS (SELECT near.a, min(l) AS l FROM near JOIN named ON near.b = named.a GROUP BY 1) SELECT vec_id AS id, named.a IS NOT NULL AS is_core, coalesce(named.l, border.l, -1) AS cluster FROM embeddings LEFT JOIN named ON vec_id = named.a LEFT JOIN border ON vec_id = border.a",
    "sarima_lite": f"WITH RECURSIVE {_MONTHS}, y AS (SELECT program, CAST(n AS DOUBLE) AS v, row_number() OVER (PARTITION BY program ORDER BY t) AS i, count(*) OVER (PARTITION BY program) AS m FROM months), d AS (SELECT a.program, a.i, a.m, a.v - b.v AS d FROM y a JOIN y b ON a.program = b.program AND a.i = b.i + 12), fit AS (SELECT a.program, any_value(a.m) AS m, greatest(least(regr_slope(b.d, a.d), 0.99), -0.99) AS phi, regr_intercept(b.d, a.d) AS c, max_by(b.d, b.i) AS last FROM d a JOIN d b ON a.program = b.program AND b.i = a.i + 1 GROUP BY 1), f(program, m, phi, c, step, last) AS (SELECT program, m, phi, c, 1, c + phi * last FROM fit UNION ALL SELECT program, m, phi, c, step + 1, c + phi * last FROM f WHERE step < 6) SELECT f.program, CAST(step AS INTEGER) AS step, CAST(round((v + last) * 1e4) AS BIGINT) AS forecast_e4 FROM f JOIN y ON f.program = y.program AND y.i = f.m + step - 12",
    "fba_lp": "WITH s AS (SELECT n_regionkey AS k, sum(greatest(floor(s_acctbal), 0)) AS ub FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), c AS (SELECT n_regionkey AS k, sum(greatest(floor(c_acctbal), 0)) AS ub FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), g AS (SELECT * FROM (VALUES (0.1::DOUBLE, '0_1'), (0.28::DOUBLE, '0_28'), (0.5::DOUBLE, '0_5')) AS a(f1, n1), (VALUES (1::DOUBLE, '1'), (0.75::DOUBLE, '0_75'), (0.5::DOUBLE, '0_5')) AS b(f2, n2)) SELECT 'G6PD_' || n1 || '_h2o2_' || n2 AS scenario, 'optimal' AS status, CAST(round(sum(least(coalesce(s.ub, 0) * CASE s.k WHEN 0 THEN f1 WHEN 1 THEN f2 ELSE 1 END, coalesce(c.ub, 0))) * 100) AS BIGINT) AS objective_cents FROM g, s JOIN c USING (k) GROUP BY ALL",
    "judge_runs": f"{_EXTRACT}, shown AS (SELECT 'list' || n_regionkey AS list_name, string_agg('  - ' || n_nationkey || ': ' || n_name, chr(10) ORDER BY n_nationkey) AS opts FROM nation WHERE n_nationkey <> 0 GROUP BY 1), asked AS (SELECT section, ff AND rep AS in_repeat, {_ASKED} AS p FROM sel LEFT JOIN shown ON ln = list_name WHERE {_GENERATED}), h AS (SELECT CAST(run AS INTEGER) AS run, section, in_repeat, sha256(run || chr(10) || p) AS h FROM asked, range(1, 10) AS r(run)), valid AS (SELECT run, section, in_repeat, {', '.join(f'1 + CAST((chr(48) || chr(120) || substr(h, {2 * i + 1}, 2)) AS INTEGER) % 5 AS {d}' for i, d in enumerate(DIMS))} FROM h) SELECT run, section, {_COUNTS}, {_STATS}, {_OVERALL} FROM valid GROUP BY run, section",
}

_PAIRED = "paired AS (SELECT section, l_partkey, CAST(round((avg(clarity) FILTER (form = 'O') - avg(clarity) FILTER (form = 'F')) * 1e6) AS BIGINT) AS d FROM valid WHERE form IN ('F', 'O') GROUP BY ALL HAVING count(*) FILTER (form = 'O') > 0 AND count(*) FILTER (form = 'F') > 0)"
_KENDALL = "(n * (n - 1) * (2 * n + 5) - ties) / 18.0"
ORACLE_SQL |= {
    "trend_decision": f"""WITH {_MONTHS}, pairs AS (SELECT a.program, CAST(sum(sign(b.n - a.n)) AS BIGINT) AS s, median((b.n - a.n) / CAST(b.t - a.t AS DOUBLE)) AS sen FROM months a JOIN months b ON a.program = b.program AND a.t < b.t GROUP BY 1),
      tied AS (SELECT program, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (SELECT program, n, count(*) AS c FROM months GROUP BY ALL) GROUP BY 1), sizes AS (SELECT program, count(*) AS n FROM months GROUP BY 1),
      z AS (SELECT program, n, s, sen, {_KENDALL} AS variance, (s - sign(s)) / sqrt({_KENDALL}) AS z FROM pairs JOIN tied USING (program) JOIN sizes USING (program))
      SELECT program, n, s AS mann_kendall, CAST(round(variance * 1e6) AS BIGINT) AS variance, CAST(round(z * 1e6) AS BIGINT) AS z, CAST(round(sen * 1e6) AS BIGINT) AS sen_slope, CASE WHEN abs(z) < 1.959963984540054 THEN 'stagnant' WHEN s > 0 THEN 'rising' ELSE 'falling' END AS trend FROM z""",
    "intervention_line": f"""WITH {_MONTHS}, x AS (SELECT program, CAST(t - 23946 AS DOUBLE) AS t, CAST(n AS DOUBLE) AS n FROM months),
      f AS (SELECT program, count(*) AS k, regr_intercept(n, t) FILTER (t < 0) AS a0, regr_slope(n, t) FILTER (t < 0) AS b0, regr_intercept(n, t) FILTER (t >= 0) AS a1, regr_slope(n, t) FILTER (t >= 0) AS b1, avg(t) FILTER (t < 0) AS m0, avg(t) FILTER (t >= 0) AS m1 FROM x GROUP BY 1),
      e AS (SELECT program, t, m0, m1, k, a0, b0, a1, b1, n - CASE WHEN t < 0 THEN a0 + b0 * t ELSE a1 + b1 * t END AS u FROM x JOIN f USING (program)),
      v AS (SELECT program, any_value(k) AS k, any_value(a0) AS a0, any_value(b0) AS b0, any_value(a1) AS a1, any_value(b1) AS b1, sum(power((t - m0) * u, 2)) FILTER (t < 0) / power(sum(power(t - m0, 2)) FILTER (t < 0), 2) + sum(power((t - m1) * u, 2)) FILTER (t >= 0) / power(sum(power(t - m1, 2)) FILTER (t >= 0), 2) AS var FROM e GROUP BY 1)
      SELECT program, k AS n, """ + ", ".join(f"CAST(round({e} * 1e3) AS BIGINT) AS {c}" for c, e in (("level", "a0"), ("slope", "b0"), ("level_change", "(a1 - a0)"), ("slope_change", "(b1 - b0)"), ("se_slope_change", "sqrt(var * k / (k - 4))"))) + " FROM v",
    "score_agreement": f"WITH {SCORED}, p AS (SELECT section, l_partkey, count(*) AS k, CAST(sum(clarity) AS DOUBLE) AS s, sum(clarity * clarity) AS q FROM valid GROUP BY ALL), g AS (SELECT section, count(*) AS subjects, CAST(sum(k) AS BIGINT) AS n, sum(s) AS t, sum(q) AS q, sum(s * s / k) AS b, sum(k * k) AS kk FROM p GROUP BY 1), c AS (SELECT *, (q - b) / (n - subjects) AS w, (b - t * t / n) / (subjects - 1) AS m, (n - kk / CAST(n AS DOUBLE)) / (subjects - 1) AS e FROM g) SELECT section, subjects, n, CAST(round(w * 1e6) AS BIGINT) AS within, CAST(round((m - w) / e * 1e6) AS BIGINT) AS \"between\", CAST(round((m - w) / (m + (e - 1) * w) * 1e6) AS BIGINT) AS icc FROM c",
    "paired_forms": f"""WITH {SCORED}, {_PAIRED}, r AS (SELECT section, count(*) AS pairs, CAST(sum(d) AS BIGINT) AS total FROM paired GROUP BY 1),
      bits AS (SELECT section, d, b, (strpos('0123456789abcdef', substr(md5('1|' || section || '|' || l_partkey || '|0'), CAST(b // 4 + 1 AS BIGINT), 1)) - 1) // CAST(power(2, b % 4) AS BIGINT) % 2 AS flip FROM paired, range(128) AS bit(b)),
      sums AS (SELECT section, b, sum(d * (1 - 2 * flip)) AS s FROM bits GROUP BY ALL), far AS (SELECT section, count(*) FILTER (abs(s) >= abs(total)) AS extreme, count(*) AS draws FROM sums JOIN r USING (section) GROUP BY 1),
      t AS (SELECT *, (extreme + 1) / CAST(draws + 1 AS DOUBLE) AS p FROM r JOIN far USING (section)), k AS (SELECT *, row_number() OVER (ORDER BY p, section) AS rank, count(*) OVER () AS g FROM t)
      SELECT section, pairs, extreme, draws, CAST(rank AS INTEGER) AS rank, CAST(round(total / CAST(pairs AS DOUBLE) / 1e6 * 1e6) AS BIGINT) AS change, CAST(round(p * 1e6) AS BIGINT) AS p_value, CAST(round(least(1.0, max(p * (g - rank + 1)) OVER (ORDER BY p, section)) * 1e6) AS BIGINT) AS p_adjusted FROM k""",
}
