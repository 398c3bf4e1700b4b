"""JSON documents, prior results and report files."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.fixed_values import DESIGN_DECISIONS, FORM_TITLE

CHOICES = "array<struct<value: string, label: string>>"
_FIELDS = {
    "section": "string", "name": "string", "label": "string", "type": "string", "choices": CHOICES, "relevant": "string", "required": "boolean", "category": "string",
    "in_repeat": "boolean", "repeat_name": "string", "note": "string",
}
QUESTION = ", ".join(f"{k} {v}" for k, v in _FIELDS.items())
DOCUMENT = (
    f"form_title string, mode string, n_questions int, questions array<struct<{', '.join(f'{k}: {v}' for k, v in _FIELDS.items())}>>, "
    "excluded_items array<struct<name: string, label: string, reason: string>>, design_decisions struct<from_file_excluded: string, repeats_evaluation: string, repeats_generation: string>"
)
_STAT = "struct<mean: double, std: double>"
SUMMARY = f"map<string, struct<n_questions: int, n_in_repeat: int, clarity: {_STAT}, relevance: {_STAT}, completeness: {_STAT}, granularity: {_STAT}, avg_overall: double, n_needs_improvement: int>>"


def read_schema_document(spark: SparkSession, path: str) -> DataFrame:
    """One row per question of a schema document, with its place."""
    return spark.read.json(path, schema=DOCUMENT, multiLine=True).select("form_title", "mode", F.posexplode("questions").alias("row_idx", "q")).select("form_title", "mode", F.col("row_idx").cast("long"), "q.*")


def read_section_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Section summaries keyed by section, one row per file and section; NaN becomes null.

    form is the file's folder and run the number at the end of its name.
    """
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="section_summary*.json").select("value", F.col("_metadata.file_path").alias("path"))
    rows = texts.select(
        F.element_at(F.split("path", "/"), -2).alias("form"), F.regexp_extract("path", r"_r(\d+)\.json$", 1).cast("int").alias("run"),
        F.posexplode(F.map_entries(F.from_json("value", SUMMARY, {"allowNonNumericNumbers": "true"}))).alias("ord", "e"),
    )
    flat = rows.select("form", "run", "ord", F.col("e.key").alias("section"), "e.value.*")
    clean = lambda c: F.struct(*[F.nanvl(F.col(f"{c}.{s}"), F.lit(None).cast("double")).alias(s) for s in ("mean", "std")]).alias(c)
    return flat.select("form", "run", "ord", "section", "n_questions", "n_in_repeat", *[clean(c) for c in ("clarity", "relevance", "completeness", "granularity")], "avg_overall", "n_needs_improvement")


def read_prior_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results written before, or an empty table where there are none."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def schema_document(questions: DataFrame, excluded: DataFrame, mode: str) -> DataFrame:
    """The one-row schema document of a form; a form's questions fit one row."""
    fields = list(_FIELDS)
    listed = questions.agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", F.struct(*fields).alias("q")))), lambda x: x["q"]).alias("questions"))
    logged = excluded.agg(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", F.struct("name", "label", "reason").alias("x")))), lambda x: x["x"]).alias("excluded_items"))
    return listed.crossJoin(F.broadcast(logged)).select(
        F.lit(FORM_TITLE).alias("form_title"), F.lit(mode).alias("mode"), F.size("questions").alias("n_questions"), "questions", "excluded_items",
        F.struct(*[F.lit(v).alias(k) for k, v in DESIGN_DECISIONS.items()]).alias("design_decisions"),
    )


def write_json_document(row: DataFrame, path: str) -> None:
    """The only row of a small document, indented by two, null fields written, on the driver."""
    Path(path).write_text(json.dumps(row.first().asDict(recursive=True), ensure_ascii=False, indent=2), encoding="utf-8")


def write_section_summary(summary: DataFrame, path: str) -> None:
    """A scorecard as a document keyed by section, rounded to two digits; a missing deviation is NaN, as report readers expect."""
    two = lambda x: math.nan if x is None else round(float(x), 2)
    out = {}
    for r in summary.orderBy("first_idx").toLocalIterator():
        out[r.section] = {"n_questions": r.n_questions, "n_in_repeat": r.n_in_repeat}
        out[r.section] |= {d: {"mean": two(r[f"{d}_mean"]), "std": two(r[f"{d}_std"])} for d in ("clarity", "relevance", "completeness", "granularity")}
        out[r.section] |= {"avg_overall": two(r.avg_overall), "n_needs_improvement": r.n_needs_improvement}
    Path(path).write_text(json.dumps(out, ensure_ascii=False, indent=2), encoding="utf-8")


def write_bom_csv(df: DataFrame, path: str) -> None:
    """A small table as one CSV with a byte-order mark, on the driver."""
    df.toPandas().to_csv(path, index=False, encoding="utf-8-sig")
