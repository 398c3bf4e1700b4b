"""Expression data: probes to functional families, and clusters of subjects against clinical variables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import exact_mean, exact_std


def map_families(expression: DataFrame, probes: DataFrame, families: DataFrame) -> DataFrame:
    """Rows of expression (…, probe, …) with gene and family, by probes (probe, gene) and families (gene, family).

    Probes without a gene (those that don't code) and genes without a family go; a gene of several families gives a row for each.
    Mapping tables are joined as they are: the optimiser broadcasts them where they are small.
    """
    coding = probes.where("gene IS NOT NULL").select("probe", "gene").distinct()
    return expression.join(coding, "probe").join(families.select("gene", "family").distinct(), "gene")


def family_matrix(mapped: DataFrame, subject: str = "subject", threshold: float = 1.5) -> DataFrame:
    """(subject, family, n, active): a subject's probes by family, and those whose base-2 logarithm is above the threshold."""
    above = F.coalesce((F.col("value") > 0) & (F.log2(F.when(F.col("value") > 0, F.col("value"))) > threshold), F.lit(False))
    return mapped.groupBy(subject, "family").agg(F.count("*").alias("n"), F.count_if(above).alias("active"))


def clinical_profiles(clusters: DataFrame, clinical: DataFrame, subject: str, variables: list[str], cluster: str = "cluster") -> DataFrame:
    """(cluster, variable, n, mean, std) of clinical variables in each cluster of subjects; null values don't count.

    Subjects in one table alone go. Sums are exact for whole numbers, whatever their order.
    """
    joined = clusters.select(subject, cluster).join(clinical.select(subject, *variables), subject)
    long = joined.select(cluster, F.explode(F.create_map(*[x for v in variables for x in (F.lit(v), F.col(v).cast("double"))])).alias("variable", "x"))
    sums = long.where("x IS NOT NULL").groupBy(cluster, "variable").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    return sums.select(cluster, "variable", "n", exact_mean(F.col("s"), F.col("n")).alias("mean"), exact_std(F.col("s"), F.col("q"), F.col("n")).alias("std"))
