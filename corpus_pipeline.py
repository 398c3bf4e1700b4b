"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again for the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import decontaminate
from tessera.llm.line_dedup import line_dedup
from tessera.llm.mixing import mix_sources, word_count
from tessera.llm.ngram_join import SHINGLE, ngram_components
from tessera.llm.quality import quality, trusted_labels
from tessera.llm.storage import discard, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their language's perplexity threshold; texts that are null or empty go."""
    scored = quality(docs.select(*COLUMNS), trusted_labels(spark, sf_dir)).where("kept")
    return scored.select("rest.doc_id", "text", "rest.lang", "rest.source", "rest.n_chars")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a smaller id has; those left with fewer words than a shingle after a loss go. n_chars follows the text.

    Rows of one id are one document; rows without an id are documents of their own, after all others.
    """
    done = line_dedup(docs.select(*COLUMNS))
    left = done.where((F.col("n_dropped") == 0) | (word_count("text") >= SHINGLE))
    return left.select("rest.doc_id", "text", "rest.lang", "rest.source", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("rest.n_chars")).alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of near duplicates. Of repeated rows of that id all stay; rows without an id all stay."""
    kept = ngram_components(docs).where("doc_id = component_id").select("doc_id").distinct()
    lone = docs.where("doc_id IS NULL")
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS).unionAll(lone.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark. Each row is judged by its own text, whatever its id; null texts hold no window and stay."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where(F.size("spans") > 0).select("text_key").distinct()
    return docs.join(hit, F.xxhash64("text") == F.col("text_key"), "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy taken of a row, numbered from 0; repeated rows and rows without an id are taken each by itself."""
    mixed = mix_sources(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.select("rest.*", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The quality model is not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
