"""How far scores can be relied on: agreement of repeated scores, and paired tests of two forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sign changes that one digest gives; a test draws a multiple of them.
BITS = 128


def agreement(scores: DataFrame, value: str, group: list[str], subject: list[str]) -> DataFrame:
    """(group, subjects, n, within, between, icc): variance components of repeated scores of subjects, and the share that is between subjects.

    One-way, for unlike numbers of scores: subjects are summed first, groups from those, so no group is a list. Null scores don't count;
    icc is null where a group has one subject, or no subject with two scores.
    """
    x = F.col(value).cast("double")
    per = scores.where(F.col(value).isNotNull()).groupBy(*group, *[c for c in subject if c not in group]).agg(F.count("*").alias("_k"), F.sum(x).alias("_s"), F.sum(x * x).alias("_q"))
    sums = per.groupBy(*group).agg(F.count("*").alias("subjects"), F.sum("_k").alias("n"), F.sum("_s").alias("_t"), F.sum("_q").alias("_sq"), F.sum(F.col("_s") * F.col("_s") / F.col("_k")).alias("_b"), F.sum(F.col("_k") * F.col("_k")).alias("_kk"))
    within, between = F.try_divide(F.col("_sq") - F.col("_b"), F.col("n") - F.col("subjects")), F.try_divide(F.col("_b") - F.col("_t") * F.col("_t") / F.col("n"), F.col("subjects") - 1)
    each = F.try_divide(F.col("n") - F.col("_kk") / F.col("n"), F.col("subjects") - 1)
    parts = sums.select(*group, "subjects", "n", within.alias("within"), between.alias("between_mean"), each.alias("each"))
    return parts.select(*group, "subjects", "n", "within", F.try_divide(F.col("between_mean") - F.col("within"), F.col("each")).alias("between"), F.try_divide(F.col("between_mean") - F.col("within"), F.col("between_mean") + (F.col("each") - 1) * F.col("within")).alias("icc"))


def _flips(digest: Column, bit: Column) -> Column:
    """1 or -1 by a bit of a digest in hexadecimal."""
    digit = F.instr(F.lit("0123456789abcdef"), F.substr(digest, F.floor(bit / 4).cast("int") + 1, F.lit(1))) - 1
    return 1 - 2 * (F.floor(digit / F.pow(F.lit(2), bit % 4)) % 2).cast("long")


def paired_permutation(scores: DataFrame, value: str, group: list[str], subject: list[str], form: str, before: str, after: str, digests: int = 1, seed: str = "1") -> DataFrame:
    """(group, pairs, change, extreme, draws, p_value, rank, p_adjusted): whether subjects scored under both forms change.

    A subject's change is that of its mean, in whole millionths, so sums are exact. Each draw flips the sign of every subject by a bit of
    an MD5 of seed, subject and number, the same in every run; extreme counts draws whose sum is as far from nought as the real one.
    p_value is (extreme + 1) / (draws + 1). Groups are ranked by it, ties by name, and adjusted for their number (Holm).
    """
    keys = [*group, *[c for c in subject if c not in group]]
    side = lambda f: F.avg(F.when(F.col(form) == f, F.col(value)))
    pairs = scores.where(F.col(form).isin(before, after) & F.col(value).isNotNull()).groupBy(*keys).agg(side(before).alias("x"), side(after).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    pairs = pairs.select(*keys, F.round((F.col("y") - F.col("x")) * 1e6).cast("long").alias("d"))
    real = pairs.groupBy(*group).agg(F.count("*").alias("pairs"), F.sum("d").alias("total"))
    named = pairs.select(*keys, "d", F.explode(F.sequence(F.lit(0), F.lit(digests - 1))).alias("block"))
    named = named.withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in keys], F.col("block").cast("string"))))
    drawn = named.select(*group, "d", "block", "h", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit")).groupBy(*group, "block", "bit").agg(F.sum(F.col("d") * _flips(F.col("h"), F.col("bit"))).alias("sum"))
    far = drawn.join(real.select(*group, "total"), group).groupBy(*group).agg(F.count_if(F.abs("sum") >= F.abs("total")).alias("extreme"), F.count("*").alias("draws"))
    tested = real.join(far, group).select(*group, "pairs", (F.col("total") / F.col("pairs") / 1e6).alias("change"), "extreme", "draws", ((F.col("extreme") + 1) / (F.col("draws") + 1)).alias("p_value"))
    order = Window.orderBy("p_value", *group)  # a row for each group
    ranked = tested.withColumn("rank", F.row_number().over(order)).withColumn("groups", F.count("*").over(Window.partitionBy(F.lit(1))))
    return ranked.withColumn("p_adjusted", F.least(F.lit(1.0), F.max(F.col("p_value") * (F.col("groups") - F.col("rank") + 1)).over(order))).drop("groups")
