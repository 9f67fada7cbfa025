"""Half-open spans [start, end): merging, clipping, holes, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_spans(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching spans of a key become one; empty ones go."""
    by = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.where(F.col(start) < F.col(end)).withColumn("_new", F.coalesce((F.col(start) > before).cast("int"), F.lit(1)))
    numbered = marked.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def clip_spans(spans: DataFrame, low, high, start: str = "start", end: str = "end") -> DataFrame:
    """What of each span lies in [low, high)."""
    low, high = (x if hasattr(x, "cast") else F.lit(x) for x in (low, high))
    return spans.withColumn(start, F.greatest(F.col(start), low)).withColumn(end, F.least(F.col(end), high)).where(F.col(start) < F.col(end))


def holes(spans: DataFrame, keys: list[str], ranges: DataFrame, start: str = "start", end: str = "end", low: str = "low", high: str = "high") -> DataFrame:
    """The parts of each key's [low, high) that no span covers; `ranges` has one row a key."""
    inside = clip_spans(spans.join(ranges, keys), F.col(low), F.col(high), start, end).select(*keys, start, end)
    merged = merge_spans(inside, keys, start, end)
    # an empty span at each end of the range makes the first and the last hole ordinary gaps
    ends = ranges.select(*keys, F.col(low).alias(start), F.col(low).alias(end)).unionByName(ranges.select(*keys, F.col(high).alias(start), F.col(high).alias(end)))
    by = Window.partitionBy(*keys).orderBy(start, end)
    gaps = merged.unionByName(ends).withColumn("_from", F.lag(end).over(by))
    return gaps.where(F.col("_from") < F.col(start)).select(*keys, F.col("_from").alias(start + "_hole"), F.col(start).alias(end + "_hole"))


def settle(spans: DataFrame, keys: list[str], ranges: DataFrame, start: str = "start", end: str = "end", low: str = "low", high: str = "high") -> DataFrame:
    """covered, partial or not_covered: how far the spans cover each key's [low, high), with the covered length."""
    inside = merge_spans(clip_spans(spans.join(ranges, keys), F.col(low), F.col(high), start, end).select(*keys, start, end), keys, start, end)
    length = inside.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered_length"))
    out = ranges.join(length, keys, "left").withColumn("covered_length", F.coalesce("covered_length", F.lit(0)))
    state = F.when(F.col("covered_length") == 0, "not_covered").when(F.col("covered_length") == F.col(high) - F.col(low), "covered").otherwise("partial")
    return out.withColumn("state", state)


def worst_gap(reads: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The longest time between consecutive reads of a key; null where there are fewer than two."""
    by = Window.partitionBy(*keys).orderBy(at)
    return reads.withColumn("_gap", F.col(at) - F.lag(at).over(by)).groupBy(*keys).agg(F.max("_gap").alias("worst_gap"), F.count("*").alias("reads"))


def sequence_gaps(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """How many numbers are missing between the smallest and the largest of a key; unnumbered rows (0 or null) don't count."""
    by = Window.partitionBy(*keys).orderBy(number)
    seen = rows.where(F.col(number) > 0).select(*keys, number).distinct()
    return seen.withColumn("_step", F.col(number) - F.lag(number).over(by) - 1).groupBy(*keys).agg(F.coalesce(F.sum("_step"), F.lit(0)).alias("missing"), F.count("*").alias("numbers"))
