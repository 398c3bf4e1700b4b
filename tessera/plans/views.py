"""Staging views that put the driver's tables into the shapes of the operators, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as judged questions: sections are brands, forms order states, runs months; a missing clarity is a failed reply."""
    lines, orders, parts = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(parts, lines.l_partkey == parts.p_partkey)
    return joined.select(
        F.col("p_brand").alias("section"), F.col("o_orderstatus").alias("form"), F.month("o_orderdate").alias("run"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_tax") != 0.08, F.substring("o_orderpriority", 1, 1).cast("int")).alias("clarity"), (F.col("l_quantity").cast("int") % 5 + 1).alias("relevance"),
        (F.col("l_suppkey") % 5 + 1).cast("int").alias("completeness"), ((F.col("l_partkey") + F.col("l_linenumber")) % 5 + 1).cast("int").alias("granularity"), (F.col("l_linenumber") > 1).alias("in_repeat"),
    )


SCORED = """scored AS (
  SELECT p_brand AS section, o_orderstatus AS form, month(o_orderdate) AS run, l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CASE WHEN l_tax <> 0.08 THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS clarity, CAST(trunc(l_quantity) AS INTEGER) % 5 + 1 AS relevance,
    CAST(l_suppkey % 5 + 1 AS INTEGER) AS completeness, CAST((l_partkey + l_linenumber) % 5 + 1 AS INTEGER) AS granularity, l_linenumber > 1 AS in_repeat
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
), valid AS (SELECT * FROM scored WHERE clarity IS NOT NULL)"""


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as survey sheets, a form per user: views begin groups, signups begin repeats, purchases end them, the rest are questions."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id") % 7
    kind = (
        F.when(F.col("event_type") == "view", "begin_group").when(F.col("event_type") == "signup", "begin_repeat").when(F.col("event_type") == "purchase", "end_repeat")
        .when(F.col("event_type") == "error", F.when(n == 0, "select_multiple_from_file iso3166_paises.csv").when(n == 1, "select_one_from_file lab_loinc.csv").when(n == 2, "select_multiple_from_file unknown.csv").otherwise("select_multiple list3"))
        .otherwise(F.when(n == 6, "text").otherwise(F.concat(F.lit("select_one list"), (F.col("event_id") % 5).cast("string"))))
    )
    return e.select(
        F.col("user_id").alias("form_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("row_idx"), kind.alias("type"),
        F.when(F.col("event_id") % 11 == 0, "agregar_fam").otherwise(F.concat(F.lit("q"), F.col("event_id").cast("string"))).alias("name"),
        F.when(F.col("event_id") % 13 == 0, "").when(F.col("event_id") % 3 == 0, "SECCIÓN 9.11. Demencia").otherwise(F.concat(F.lit("L"), (F.col("event_id") % 17).cast("string"))).alias("label"),
        F.when(F.col("event_id") % 2 == 0, "yes").otherwise("no").alias("required"), F.when(F.col("event_id") % 4 == 0, "x > 1").alias("relevant"),
    )


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as choices: lists are regions, and the nation of key 0, a numeric nought, has no value."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row_idx"), F.concat(F.lit("list"), F.col("n_regionkey").cast("string")).alias("list_name"), F.when(F.col("n_nationkey") != 0, F.col("n_nationkey").cast("string")).alias("value"), F.col("n_name").alias("label"))


SURVEY = """survey AS (
  SELECT user_id AS form_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_idx,
    CASE WHEN event_type = 'view' THEN 'begin_group' WHEN event_type = 'signup' THEN 'begin_repeat' WHEN event_type = 'purchase' THEN 'end_repeat'
      WHEN event_type = 'error' THEN CASE event_id % 7 WHEN 0 THEN 'select_multiple_from_file iso3166_paises.csv' WHEN 1 THEN 'select_one_from_file lab_loinc.csv' WHEN 2 THEN 'select_multiple_from_file unknown.csv' ELSE 'select_multiple list3' END
      ELSE CASE WHEN event_id % 7 = 6 THEN 'text' ELSE 'select_one list' || (event_id % 5) END END AS type,
    CASE WHEN event_id % 11 = 0 THEN 'agregar_fam' ELSE 'q' || event_id END AS name,
    CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 3 = 0 THEN 'SECCIÓN 9.11. Demencia' ELSE 'L' || (event_id % 17) END AS label,
    CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS required, CASE WHEN event_id % 4 = 0 THEN 'x > 1' END AS relevant
  FROM events
), steps AS (
  SELECT *, coalesce(nullif(label, ''), name) AS said, sum(CASE type WHEN 'begin_repeat' THEN 1 WHEN 'end_repeat' THEN -1 ELSE 0 END) OVER w AS s FROM survey WINDOW w AS (PARTITION BY form_id ORDER BY row_idx)
), state AS (
  SELECT form_id, row_idx, type, name, label, required, relevant,
    coalesce(last_value(CASE WHEN type = 'begin_group' THEN said END IGNORE NULLS) OVER w, 'ROOT') AS section, CAST(s - least(0, min(s) OVER w) AS BIGINT) AS depth,
    last_value(CASE WHEN type = 'begin_repeat' THEN said END IGNORE NULLS) OVER w AS begun
  FROM steps WINDOW w AS (PARTITION BY form_id ORDER BY row_idx)
), lists AS (
  SELECT 'list' || n_regionkey AS list_name, list(CAST(n_nationkey AS VARCHAR) || '=' || n_name ORDER BY n_nationkey) AS choices FROM nation WHERE n_nationkey <> 0 GROUP BY 1
)"""
