"""Scalar expressions over survey and judge texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"


def strip(c: Column) -> Column:
    """Without white space at both ends (SQL trim takes spaces alone)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def first_truthy(a: Column, b: Column) -> Column:
    """a unless it is null or empty, else b."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def list_name(kind: Column) -> Column:
    """Name of the choice list in a question type."""
    return strip(F.replace(F.replace(kind, F.lit("select_one "), F.lit("")), F.lit("select_multiple "), F.lit("")))


def file_name(kind: Column) -> Column:
    """Name of the file catalog in a question type."""
    return strip(F.element_at(F.split(kind, "from_file "), -1))


def unfence(reply: Column) -> Column:
    """A reply without the fence around it: what stands between its first two fences, without a leading `json`."""
    bare = strip(reply)
    inner = F.regexp_replace(F.try_element_at(F.split(bare, FENCE), F.lit(2)), "^json", "")
    return F.when(F.startswith(bare, F.lit(FENCE)), inner).otherwise(bare)


def run_tag(run: Column) -> Column:
    return F.format_string("c1_r%02d", run)


def number_token(x: Column) -> Column:
    """A number as it stands in file names: 0_28, 1."""
    return F.replace(F.regexp_replace(x.cast("string"), r"\.0$", ""), F.lit("."), F.lit("_"))


def truthy(c: Column) -> Column:
    """Not null and not empty. Sheet readers give numeric noughts and false as null, and a text of 0 as it stands."""
    return c.isNotNull() & (c != "")
