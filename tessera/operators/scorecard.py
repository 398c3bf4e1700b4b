"""Scores by section, over runs and between forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import exact_mean, exact_std, python_round

DIMS = ("clarity", "relevance", "completeness", "granularity")


def _valid(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def scored_only(evaluations: DataFrame) -> DataFrame:
    """Rows with a clarity score; this one score decides."""
    return evaluations.where(_valid("clarity").isNotNull())


def _stats() -> list[Column]:
    return [f(_valid(d)).alias(f"{d}_{n}") for d in DIMS for n, f in (("n", F.count), ("sum", F.sum), ("sq", lambda c: F.sum(c * c)))]


def _finish(grouped: DataFrame, keys: list[str], extra: list[str] = ()) -> DataFrame:
    total = {d: (F.col(f"{d}_sum"), F.col(f"{d}_sq"), F.col(f"{d}_n")) for d in DIMS}
    means = [exact_mean(s, n) for s, _, n in total.values()]
    known = F.filter(F.array(*means), lambda m: m.isNotNull())
    overall = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, m: s + m) / F.size(known))
    return grouped.select(*keys, *extra, *[c for d, (s, q, n) in total.items() for c in (exact_mean(s, n).alias(f"{d}_mean"), exact_std(s, q, n).alias(f"{d}_std"))], overall.alias("avg_overall"))


def needs_improvement() -> Column:
    """Whether completeness or granularity is two or less; null scores say no."""
    return F.coalesce(_valid("completeness") <= 2, F.lit(False)) | F.coalesce(_valid("granularity") <= 2, F.lit(False))


def _counts() -> list[Column]:
    return [F.count("*").alias("n_questions"), F.count_if("in_repeat").alias("n_in_repeat"), F.count_if(needs_improvement()).alias("n_needs_improvement")]


def section_scorecard(evaluations: DataFrame, keys: tuple[str, ...] = ("section",)) -> DataFrame:
    """Numbers, means, sample deviations and the mean of means by keys, of rows with a score.

    One aggregation with a map-side combine; statistics come from sums, so integers give the same result in any order.
    """
    grouped = scored_only(evaluations).groupBy(*keys).agg(*_counts(), *_stats())
    return _finish(grouped, list(keys), ["n_questions", "n_in_repeat", "n_needs_improvement"])


def global_scores(evaluations: DataFrame) -> DataFrame:
    grouped = scored_only(evaluations).agg(F.count("*").alias("n_questions"), *_stats())
    return _finish(grouped, [], ["n_questions"])


def scorecard_rollup(evaluations: DataFrame) -> DataFrame:
    """Sections and, with is_total = 1, all together, in one rollup."""
    grouped = scored_only(evaluations).rollup("section").agg(F.grouping("section").cast("int").alias("is_total"), *_counts(), *_stats())
    return _finish(grouped, ["section", "is_total"], ["n_questions", "n_in_repeat", "n_needs_improvement"])


def first_appearance(evaluations: DataFrame, order: str = "row_idx") -> DataFrame:
    """Sections by where they first stand, over all rows."""
    return evaluations.groupBy("section").agg(F.min(order).alias("first_idx"), F.count("*").alias("n_rows"))


def run_stability(evaluations: DataFrame, dim: str) -> DataFrame:
    """Of a dimension's section means over runs, by form: number, mean, sample deviation, extremes and their ratio."""
    means = scored_only(evaluations).groupBy("form", "section", "run").agg(F.avg(_valid(dim)).alias("m"))
    out = means.groupBy("form", "section").agg(F.count("m").alias("n_runs"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.min("m").alias("least"), F.max("m").alias("most"))
    return out.withColumn("cv", F.when(F.col("mean") != 0, F.col("sd") / F.col("mean")))


def form_delta(evaluations: DataFrame, before: str, after: str) -> DataFrame:
    """Means of each dimension in both forms, and their difference, by section; a section in one form has nulls for the other."""
    rows = scored_only(evaluations).where(F.col("form").isin(before, after))
    side = lambda d, f: exact_mean(F.col(f"{d}_{f}_sum"), F.col(f"{d}_{f}_n"))
    parts = [g(F.when(F.col("form") == form, _valid(d))).alias(f"{d}_{name}_{n}") for d in DIMS for name, form in (("before", before), ("after", after)) for n, g in (("sum", F.sum), ("n", F.count))]
    grouped = rows.groupBy("section").agg(*parts)
    return grouped.select("section", *[c for d in DIMS for c in (side(d, "before").alias(f"{d}_before"), side(d, "after").alias(f"{d}_after"), (side(d, "after") - side(d, "before")).alias(f"{d}_delta"))])


def low_performers(scorecard: DataFrame, k: int = 5) -> DataFrame:
    """The k sections with the most questions that need improvement; ties by overall mean, then name."""
    return scorecard.orderBy(F.desc("n_needs_improvement"), F.asc("avg_overall"), "section").limit(k).select("section", "n_questions", "n_needs_improvement", "avg_overall")


def low_questions(evaluations: DataFrame, k: int = 5, name: str = "name") -> DataFrame:
    """The k questions that most often need improvement, over all runs; ties by the mean of all their scores, then by name."""
    scores = [_valid(d) for d in DIMS]
    total = F.sum(sum((F.coalesce(c, F.lit(0.0)) for c in scores), F.lit(0.0)))
    known = F.sum(sum((c.isNotNull().cast("long") for c in scores), F.lit(0)))
    by = scored_only(evaluations).groupBy(name).agg(F.count("*").alias("n_runs"), F.count_if(needs_improvement()).alias("n_needs_improvement"), (total / known).alias("mean"))
    return by.orderBy(F.desc("n_needs_improvement"), F.asc("mean"), name).limit(k)


def rounded_summary(scorecard: DataFrame) -> DataFrame:
    """A scorecard as summaries state it: means and deviations to two digits, half to even. For report tables, as rounding leaves the JVM."""
    rounded = {f"{d}_{x}" for d in DIMS for x in ("mean", "std")} | {"avg_overall"}
    return scorecard.select(*[python_round(F.col(c), 2).alias(c) if c in rounded else c for c in scorecard.columns])


def report_lines(evaluations: DataFrame) -> DataFrame:
    """(ord, line): the console report. How many are scored, then each dimension over all, then sections by first appearance with their means."""
    total = evaluations.agg(F.count("*").alias("n"), F.count(_valid("clarity")).alias("ok"))
    whole = global_scores(evaluations).crossJoin(F.broadcast(total))  # one row each
    shown = lambda c: F.coalesce(F.format_string("%.2f", python_round(F.col(c), 2)), F.lit("nan"))
    heads = [F.format_string("Evaluadas: %d/%d", "ok", "n"), *[F.concat(F.lit(f"{d}: "), shown(f"{d}_mean"), F.lit(" ± "), shown(f"{d}_std")) for d in DIMS]]
    top = whole.select(F.posexplode(F.array(*heads)).alias("i", "line")).select(F.lit(0).alias("part"), F.col("i").cast("long").alias("ord"), "line")
    cards = section_scorecard(evaluations).join(first_appearance(evaluations).select("section", "first_idx"), "section")
    body = cards.select(F.lit(1).alias("part"), F.col("first_idx").cast("long").alias("ord"), F.concat("section", F.format_string(" (%d): ", "n_questions"), F.concat_ws(", ", *[F.concat(F.lit(f"{d} "), shown(f"{d}_mean")) for d in DIMS])).alias("line"))
    return top.unionAll(body)


def row_mean() -> Column:
    """Mean of a row's scores that aren't null."""
    known = F.filter(F.array(*[_valid(d) for d in DIMS]), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known))


def summary_stability(summaries: DataFrame) -> DataFrame:
    """Of section summaries read from files: overall means of each run, weighted by questions, then over runs by form."""
    dims = {"clarity": F.col("clarity.mean"), "relevance": F.col("relevance.mean"), "completeness": F.col("completeness.mean"), "granularity": F.col("granularity.mean"), "overall": F.col("avg_overall")}
    runs = summaries.groupBy("form", "run").agg(*[(F.sum(c * F.col("n_questions")) / F.sum("n_questions")).alias(d) for d, c in dims.items()], F.sum("n_needs_improvement").alias("needs_improvement"))
    return runs.groupBy("form").agg(F.count("*").alias("n_runs"), *[x for d in (*dims, "needs_improvement") for x in (F.avg(d).alias(f"{d}_mean"), F.stddev_samp(d).alias(f"{d}_sd"))])
