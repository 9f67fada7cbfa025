"""Top-k with a truncation probe, newest per group, tiers, paging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first `limit` rows and whether there were more, known from one row beyond; `order` must end in a unique key.

    The plan is a TakeOrderedAndProject: each task keeps limit + 1 rows. The window runs over these few rows only.
    """
    few = df.orderBy(*order).limit(limit + 1)
    rank = F.row_number().over(Window.orderBy(*order))
    return few.withColumn("_rank", rank).withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(0))) > limit).where(F.col("_rank") <= limit).drop("_rank")


def newest_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first by `order`."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def first_per(df: DataFrame, keys: list[str], limit: int, *order: Column) -> DataFrame:
    """At most `limit` rows a key, in order; Spark stops each group at the limit before it shuffles."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("position") <= limit)


def name_tier(name: Column, wanted: str) -> Column:
    """0 equal, 1 starts with, 2 contains, 3 has all words, else null; case-folded."""
    low, want = F.lower(name), wanted.lower()
    words = [low.contains(w) for w in want.split()]
    every = words[0] if words else F.lit(False)
    for w in words[1:]:
        every = every & w
    return F.when(low == want, 0).when(low.startswith(want), 1).when(low.contains(want), 2).when(every, 3)


def page(df: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def union_top(parts: list[DataFrame], limit: int, *order: Column) -> DataFrame:
    """The first rows of several disjoint tables together: each gives at most `limit` rows to the final sort."""
    out = parts[0].orderBy(*order).limit(limit)
    for p in parts[1:]:
        out = out.unionByName(p.orderBy(*order).limit(limit), allowMissingColumns=True)
    return out.orderBy(*order).limit(limit)


def numbered(df: DataFrame, keys: list[str], order: list[Column], cut: Callable[[DataFrame, str], DataFrame], name: str) -> DataFrame:
    """The rows with their place within their key, from 1, also where one key has most of the rows; `order` must end in a key that is unique within `keys`.

    Rows are cut into ranges of key and order, numbered within their range, and the sizes of the key's ranges before are added: no task sees more than a range, and only one row a key and range is summed up.
    """
    sliced = cut(df.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()), "slices")
    local = sliced.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order)))
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ahead = sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_slice").alias("_s"), before.alias("_before"))
    same = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(ahead, same).select(*df.columns, (F.col(name) + F.col("_before")).alias(name))
