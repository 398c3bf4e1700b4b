"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Weights of the sources, by code point of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A document is taken this many times at most, and a source to this many times its size.
REPEATS = 3
SEED = 20240501
#: Documents of one source and size are dealt into this many buckets by the digest of their id, or of their text without one.
BUCKETS = 4096


def word_count(text_col: str = "text"):
    """Number of runs of anything but `[\\x20\\x09-\\x0D]`; null has none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _by_name(name: str) -> list[Column]:
    """By code point, null (an empty key) last."""
    return [F.col(name) == "", F.col(name)]


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(key, source_size, target) from (key, source_size): one row per source, which fits one task.

    Target = min(repeats * size, level * weight), the level such that targets sum to all sizes: what stops at its limit
    shares its excess among the others by weight, again and again. Sorted by limit / weight, the sources that stop are a
    prefix, so prefix sums give the level without a loop.
    """
    everything = Window.orderBy(*_by_name("key"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.row_number().over(everything) - 1).cast("int") % len(weights) + 1)
    known = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * repeats)
    whole = Window.partitionBy(F.lit(1))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")), *_by_name("key")).rowsBetween(Window.unboundedPreceding, -1)
    level = (
        known.withColumn("total", F.sum("source_size").over(whole)).withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
        .withColumn("rest_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
        .withColumn("level", F.col("rest").cast("double") / F.col("rest_weight"))
        # the first source, in this order, that doesn't stop has the level of all that don't
        .withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("final", F.min(F.when(~F.col("stops"), F.struct((F.col("cap") / F.col("weight")).alias("r"), (F.col("key") == "").alias("n"), "key", "level"))).over(whole))
    )
    return level.select("key", "source_size", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.col("final.level") * F.col("weight")).alias("target"))


def _part(text: Column) -> Column:
    """A number of 32 bits of a string's digest."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10)


def mix_sources(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED, buckets: int = BUCKETS,
) -> DataFrame:
    """How often each document is taken so that sources come to their target sizes in words.

    Each document of a source is expected target / size times. Documents of a source stand by size, digest bucket and
    id; the prefix sum of expected copies plus one random offset of the source (from the seed) crosses an integer once
    for each copy. As neighbours have like sizes, a source misses its target by about one document at most.

    Ranks come from counts: (source, size), then its buckets, then the rows of one bucket, so no task sorts a source.
    Returns one row per input row: rest (struct of all input columns, of whatever names), id, source, size, source_size,
    target, copies, taken. The row goes through with its copies, so rows of one id, or without one, each have their own. Documents
    without words are taken as others are but add nothing; a source without words has target 0 and is left out. Null sources are
    one source, the last. Rows without an id are dealt into buckets by their text; rows of one id stand by text, and equal rows are
    interchangeable. Ids of any type. An empty table gives no rows.
    """
    # an empty key is that of no source, so that plain joins reuse the windows' partitions
    sized = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("rest"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("key"),
        word_count(text_col).alias("size"), (_part(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("null"))).cast("long") % buckets).alias("bucket"), F.xxhash64(text_col).alias("said"),
    )
    of_source, of_size = Window.partitionBy("key").orderBy("size"), Window.partitionBy("key", "size").orderBy("bucket")
    counted = sized.groupBy("key", "size", "bucket").agg(F.count("*").alias("n"))
    by_size = counted.groupBy("key", "size").agg(F.sum("n").alias("n")).withColumn("before_size", F.sum("n").over(of_source) - F.col("n"))
    goals = targets(by_size.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, repeats)
    steps = counted.withColumn("before_bucket", F.sum("n").over(of_size) - F.col("n")).drop("n")
    steps = steps.join(by_size.drop("n"), ["key", "size"]).join(goals, "key").select("key", "size", "bucket", (F.col("before_size") + F.col("before_bucket")).alias("before"), "source_size", "target")
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("id", "said"))
    joined = sized.withColumn("rank", rank).join(steps, ["key", "size", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    offset = _part(F.concat(F.coalesce("source", F.lit("null")), F.lit(f":{seed}"))).cast("double") / float(1 << 32)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate * F.col("rank") + offset) - F.floor(rate * (F.col("rank") - 1) + offset)
    return joined.withColumn("copies", F.least(copies, F.lit(repeats)).cast("long")).select("rest", "id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP4_CTES = f"""
sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, 'null')), 1, 8) AS BIGINT) % {BUCKETS} AS bucket FROM {{docs}}
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), known AS (
  SELECT source, source_size, 3 * source_size AS cap, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight FROM sizes
), levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM known WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight THEN CAST(cap AS DOUBLE)
    ELSE first_value(CASE WHEN cap > level * weight THEN level END IGNORE NULLS) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * weight END AS target FROM levels
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, bucket, doc_id) AS rank FROM sized
), drawn AS (
  SELECT doc_id, r.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, rank,
    CAST(CAST('0x' || substr(md5(coalesce(r.source, 'null') || ':{SEED}'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS o
  FROM ranked r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source
), mixed AS (
  SELECT doc_id, size, source_size, target, CAST(least(floor(rate * rank + o) - floor(rate * (rank - 1) + o), {REPEATS}) AS BIGINT) AS copies FROM drawn
)"""
OP4_SQL = "WITH " + OP4_CTES.format(docs="documents") + " SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"
