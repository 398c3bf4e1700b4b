"""Question extraction from survey sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.fixed_values import FILE_STRATEGIES, GATE_NOTE, GATES, GENERATION_SECTIONS, UNKNOWN_FILE_NOTE
from tessera.functions.text import file_name, first_truthy, list_name, truthy

CHOICE = "array<struct<value: string, label: string>>"


def scan_state(survey: DataFrame, form: str = "form_id", order: str = "row_idx") -> DataFrame:
    """Survey rows with section, depth and repeat_name as they stand after each row.

    A section lasts until the next begin_group, never closed. Depth counts open repeats, clamped at nought: the running sum of
    steps less its least value so far, if negative. The repeat's label is the last one begun while any is open, so that an
    inner label outlasts its repeat. One window per form; a form is one sheet.
    """
    so_far = Window.partitionBy(form).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    label = first_truthy(F.col("label"), F.col("name"))
    # in a struct, a null label still counts as the last one
    last = lambda kind: F.last(F.when(F.col("type") == kind, F.struct(label.alias("v"))), ignorenulls=True).over(so_far)
    step = F.when(F.col("type") == "begin_repeat", 1).when(F.col("type") == "end_repeat", -1).otherwise(0)
    stepped = survey.withColumn("steps", F.sum(step).over(so_far)).withColumn("group", last("begin_group")).withColumn("repeat", last("begin_repeat"))
    deep = stepped.withColumn("depth", F.col("steps") - F.least(F.lit(0), F.min("steps").over(so_far)))
    return deep.select(
        *survey.columns, F.when(F.col("group").isNull(), F.lit("ROOT")).otherwise(F.col("group.v")).alias("section"), F.col("depth").cast("long"),
        F.when(F.col("depth") > 0, F.col("repeat.v")).alias("repeat_name"),
    )


def choice_lists(choices: DataFrame) -> DataFrame:
    """(list_name, choices) in sheet order; rows with any cell empty or nought are left out."""
    ok = truthy(F.col("list_name")) & truthy(F.col("value")) & truthy(F.col("label"))
    grouped = choices.where(ok).groupBy("list_name").agg(F.array_sort(F.collect_list(F.struct("row_idx", "value", "label"))).alias("c"))
    return grouped.select("list_name", F.transform("c", lambda x: F.struct(x["value"].alias("value"), x["label"].alias("label"))).alias("choices"))


def strategy_table(spark: SparkSession) -> DataFrame:
    rows = [(k, s, [{"value": v, "label": t} for v, t in c], n) for k, (s, c, n) in FILE_STRATEGIES.items()]
    return spark.createDataFrame(rows, f"file string, strategy string, file_choices {CHOICE}, file_note string")


def gate_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GATES.items()), "gate string, gate_label string")


def section_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, i) for i, s in enumerate(GENERATION_SECTIONS)], "target string, ord int")


def _classified(survey: DataFrame, choices: DataFrame, sections: DataFrame | None = None, gates: DataFrame | None = None, strategies: DataFrame | None = None) -> DataFrame:
    """Select questions with state, flags and what the look-up tables say; those tables have some dozens of rows."""
    spark = survey.sparkSession
    sections = section_table(spark) if sections is None else sections
    gates = gate_table(spark) if gates is None else gates
    strategies = strategy_table(spark) if strategies is None else strategies
    rows = scan_state(survey).where(F.col("type").contains("select"))
    rows = rows.withColumn("from_file", F.col("type").contains("from_file")).withColumn("file", F.when(F.col("from_file"), file_name(F.col("type")))).withColumn("list", list_name(F.col("type")))
    rows = rows.join(F.broadcast(strategies), "file", "left").join(F.broadcast(gates), F.col("name") == F.col("gate"), "left").join(F.broadcast(sections.select("target")), F.col("section") == F.col("target"), "left")
    # choice lists can be long, so this one join is left to the optimiser
    return rows.join(choice_lists(choices), F.col("list") == F.col("list_name"), "left").withColumn("in_repeat", F.col("depth") > 0)


def _emitted(rows: DataFrame, mode: str) -> Column:
    """The category that a row is emitted with, null if it isn't."""
    kept = F.when(F.col("from_file"), F.when(F.coalesce("strategy", F.lit("exclude")) != "exclude", F.lit("from_file_reduced")))
    if mode == "evaluation":
        return kept.otherwise("select")
    return kept.when(F.col("gate").isNotNull() & ~F.col("in_repeat"), "gate").when(F.col("in_repeat") | F.col("target").isNull(), F.lit(None)).otherwise("select")


def extract_questions(survey: DataFrame, choices: DataFrame, mode: str = "evaluation", **tables: DataFrame) -> DataFrame:
    """Questions of forms in evaluation or generation mode.

    survey: form_id, row_idx, type, name, label, required, relevant. choices: row_idx, list_name, value, label.
    File questions are kept or left out by strategy in both modes, whatever their section or repeat. Evaluation takes all
    others; generation takes gates outside repeats, and questions of its sections outside repeats.
    """
    if mode not in ("evaluation", "generation"):
        raise ValueError(f"no such mode: {mode}")
    rows = _classified(survey, choices, **tables)
    rows = rows.withColumn("category", _emitted(rows, mode)).where(F.col("category").isNotNull())
    of_file, gate, state = F.col("category") == "from_file_reduced", F.col("category") == "gate", F.lit(mode == "evaluation")
    return rows.select(
        "form_id", "row_idx", "section", "name", "label", F.when(F.col("type").contains("select_multiple"), "select_multiple").otherwise("select_one").alias("type"),
        F.when(of_file, F.col("file_choices")).otherwise(F.coalesce("choices", F.array().cast(CHOICE))).alias("choices"), "relevant",
        F.coalesce(F.col("required") == "yes", F.lit(False)).alias("required"), "category",
        F.when(of_file | state, F.col("in_repeat")).otherwise(F.lit(False)).alias("in_repeat"),
        F.when(of_file | state, F.col("repeat_name")).when(gate, F.col("gate_label")).alias("repeat_name"),
        F.when(of_file, F.col("file_note")).when(gate, F.lit(GATE_NOTE)).alias("note"),
    )


def excluded_log(survey: DataFrame, choices: DataFrame, **tables: DataFrame) -> DataFrame:
    """File questions that are left out, and why."""
    rows = _classified(survey, choices, **tables).where(F.col("from_file") & (F.coalesce("strategy", F.lit("exclude")) == "exclude"))
    return rows.select("form_id", "row_idx", "name", "label", F.coalesce("file_note", F.concat(F.lit(UNKNOWN_FILE_NOTE), "file")).alias("reason"))


def category_counts(questions: DataFrame, category: str = "category", order: str = "row_idx") -> DataFrame:
    """Questions and those in repeats by category, most first, then by first appearance."""
    return questions.groupBy(category).agg(F.count("*").alias("n"), F.count_if("in_repeat").alias("n_in_repeat"), F.min(order).alias("first_idx")).orderBy(F.desc("n"), "first_idx")


def section_counts(questions: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Plain questions by generation section, in the sections' order; sections without any are left out."""
    sections = section_table(questions.sparkSession) if sections is None else sections
    counted = questions.where("category = 'select'").groupBy("section").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(sections), F.col("section") == F.col("target")).select("ord", "section", "n").orderBy("ord")
