"""Expression data in SOFT files: entities with attributes and tables, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def _last(c: Column, window) -> Column:
    return F.last(c, ignorenulls=True).over(window)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the entity that they belong to (`^KIND = name` begins one) and whether they stand in its table.

    A file is read in Spark's own splits. A first pass takes from each split its number of lines and the last marks in it, a row a
    split; what those leave is the state that each split begins with. The second carries the state on inside the splits, all at once.
    A table's columns are its first line, wherever the split ends.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    line = F.regexp_replace("value", "\r$", "")
    begins, ends = line.rlike(r"^!\w+_table_begin"), line.rlike(r"^!\w+_table_end")
    split = Window.partitionBy("file", "block").orderBy("at")
    lines = raw.select("file", "block", "at", line.alias("line"), F.when(line.startswith("^"), line).alias("head"), F.when(begins, F.lit(True)).when(ends, F.lit(False)).alias("mark"))
    lines = lines.withColumns({"nth": F.row_number().over(split), "after": F.lag("mark").over(split)})

    # a mark is its state and its place: (block, line in it) tells tables apart
    marks = lines.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("head").isNotNull(), F.struct("nth", "head")))["head"].alias("head"), F.max(F.when(F.col("mark").isNotNull(), F.struct("nth", "mark"))).alias("mark"),
        F.max(F.when(F.col("after"), F.struct("nth", "line")))["line"].alias("columns"), F.min_by("line", "at").alias("first_line"), F.max_by("mark", "at").alias("last_mark"),
    )
    order = Window.partitionBy("file").orderBy("block")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    # the first line of a split names columns if the split before ended with a table's beginning
    marks = marks.withColumn("opens", F.coalesce(F.lag("last_mark").over(order), F.lit(False)))
    marks = marks.withColumn("columns", F.coalesce("columns", F.when(F.col("opens"), F.col("first_line"))))
    state = marks.select(
        "file", "block", "opens", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("lines_before"), _last(F.col("head"), so_far).alias("old_head"),
        _last(F.when(F.col("mark").isNotNull(), F.struct(F.col("mark.mark").alias("inside"), F.col("block").alias("of"), F.col("mark.nth").alias("nth"))), so_far).alias("old_mark"), _last(F.col("columns"), so_far).alias("old_columns"),
    )
    here = lines.join(state, ["file", "block"])
    names = F.coalesce("after", (F.col("nth") == 1) & F.col("opens"))
    mark = F.when(F.col("mark").isNotNull(), F.struct(F.col("mark").alias("inside"), F.col("block").alias("of"), F.col("nth").alias("nth")))
    carried = here.select(
        "file", (F.col("lines_before") + F.col("nth")).alias("line_no"), "line", F.coalesce(_last(F.col("head"), split), "old_head").alias("head"), F.coalesce(_last(mark, split), "old_mark").alias("state"),
        F.coalesce(_last(F.when(names, F.col("line")), split), "old_columns").alias("columns"), names.alias("names_columns"),
    )
    name = F.split("head", r"\s*=\s*", 2)
    return carried.select("file", "line_no", "line", F.lower(F.substring(name[0], 2, 100)).alias("kind"), name[1].alias("name"), F.coalesce("state.inside", F.lit(False)).alias("in_table"), "columns", F.coalesce("names_columns", F.lit(False)).alias("names_columns"))


def read_soft_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, kind, name, key, value) of each `!key = value` line."""
    pair = F.split("line", r"\s*=\s*", 2)
    return _lines(spark, path).where("line LIKE '!%=%'").select("file", "line_no", "kind", "name", F.substring(pair[0], 2, 1000).alias("key"), pair[1].alias("value"))


def read_soft_tables(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, kind, name, cells) of each table row, cells by column name. A table's first line names its columns."""
    rows = _lines(spark, path).where("in_table AND NOT names_columns AND line NOT LIKE '!%'")
    columns, cells = F.split("columns", "\t", -1), F.split("line", "\t", -1)
    named = rows.select("file", "line_no", "kind", "name", cells.alias("cells"), columns.alias("columns"))
    width = F.least(F.size("columns"), F.size("cells"))
    return named.select("file", "line_no", "kind", "name", F.map_from_arrays(F.slice("columns", F.lit(1), width), F.slice("cells", F.lit(1), width)).alias("cells"))


def read_expression(spark: SparkSession, path: str, probe: str = "ID_REF", value: str = "VALUE") -> DataFrame:
    """(subject, probe, value): samples' tables as one long expression matrix; values that aren't numbers are null."""
    return read_soft_tables(spark, path).where("kind = 'sample'").select(F.col("name").alias("subject"), F.col("cells")[probe].alias("probe"), F.col("cells")[value].try_cast("double").alias("value"))
