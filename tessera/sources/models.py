"""Constraint-based models and sampling results as folders of Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {"stoich": "met string, rxn string, coef double", "reactions": "rxn string, lb double, ub double, c double", "metabolites": "met string, b double"}


def read_model(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three long tables of a model."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in TABLES.items()}


def write_model(model: dict[str, DataFrame], folder: str) -> None:
    for name in TABLES:
        model[name].write.mode("overwrite").parquet(f"{folder}/{name}")


def write_scenarios(folder: str, reactions: DataFrame, optima: DataFrame, samples: DataFrame, baseline: DataFrame | None = None) -> None:
    """Perturbed models, optima and samples of all scenarios, by the two fractions as file names have them; samples by chain too, so that one is read alone.

    baseline, the optimum of the model as it is, goes beside them as v_or.
    """
    by = lambda df: df.select("*", F.regexp_extract("scenario", "^G6PD_(.*)_h2o2_", 1).alias("g6pd"), F.regexp_extract("scenario", "_h2o2_(.*)$", 1).alias("h2o2"))
    by(reactions).write.mode("overwrite").partitionBy("g6pd", "h2o2").parquet(f"{folder}/models")
    by(optima).write.mode("overwrite").partitionBy("g6pd", "h2o2").parquet(f"{folder}/optima")
    by(samples).write.mode("overwrite").partitionBy("g6pd", "h2o2", "chain").parquet(f"{folder}/samples")
    if baseline is not None:
        baseline.write.mode("overwrite").parquet(f"{folder}/v_or")
