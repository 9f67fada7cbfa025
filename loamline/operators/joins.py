"""Joins by nearness in time, nested children, key lists, existence flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, before: int, after: int) -> DataFrame:
    """Pairs of equal keys with right_at in [left_at - before, left_at + after]; the clocks are integers.

    The right side is dealt to buckets as wide as the band, the left side looks into the two or three buckets the band can
    meet, so the plan is an equi-join whatever the clocks' spread, and never a nested loop.
    """
    width = max(1, before + after)
    cell = F.floor(F.col(right_at) / F.lit(width))
    probes = F.sequence(F.floor((F.col(left_at) - before) / F.lit(width)), F.floor((F.col(left_at) + after) / F.lit(width)))
    a = left.where(F.col(left_at).isNotNull()).withColumn("_cell", F.explode(probes))
    b = right.where(F.col(right_at).isNotNull()).withColumn("_cell", cell)
    gap = F.col(right_at) - F.col(left_at)
    return a.join(b, [*keys, "_cell"]).where((gap >= -before) & (gap <= after)).drop("_cell")


def unique_match(pairs: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key, candidates) with right_key only where exactly one distinct candidate matched."""
    found = pairs.groupBy(left_key).agg(F.countDistinct(right_key).alias("candidates"), F.min(right_key).alias("only"))
    return found.select(left_key, F.when(F.col("candidates") == 1, F.col("only")).alias(right_key), "candidates")


def nearest(pairs: DataFrame, left_key: str, gap: Column, right_key: str) -> DataFrame:
    """Of each left_key's pairs the one with the smallest gap, the smaller right_key on a tie."""
    return pairs.groupBy(left_key).agg(F.min(F.struct(gap.alias("gap"), F.col(right_key))).alias("best")).select(left_key, f"best.{right_key}", "best.gap")


def latest_start(pairs: DataFrame, left_key: str, at: str, start: str, right_key: str) -> DataFrame:
    """Of each left_key's candidate windows: one that starts not after `at` before others, then the latest such start (or the earliest of those after), then the smaller key."""
    late = F.col(start) > F.col(at)
    order = F.struct(late.cast("int").alias("late"), F.when(late, F.col(start)).otherwise(-F.col(start)).alias("by"), F.col(right_key))
    return pairs.groupBy(left_key).agg(F.min(order).alias("best")).select(left_key, f"best.{right_key}", (F.col("best.late") == 1).alias("after_start"))


def with_children(parents: DataFrame, children: DataFrame, key: str, order: str, fields: list[str], name: str) -> DataFrame:
    """parents with an array of their children's fields, in order; an empty array where there are none."""
    own = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias(name))
    empty = F.array().cast(own.schema[name].dataType)
    return parents.join(own, key, "left").withColumn(name, F.coalesce(name, empty))


def with_exists(df: DataFrame, other: DataFrame, key: str, flag: str) -> DataFrame:
    """df with a boolean: whether other has a row of that key."""
    marks = other.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(marks, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def lookup(df: DataFrame, keys: list[tuple], names: list[str], schema: str) -> DataFrame:
    """The rows of a list of keys, with each key's position in the list."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], f"{schema}, position int")
    return df.join(F.broadcast(wanted) if len(keys) <= 10_000 else wanted, names)
