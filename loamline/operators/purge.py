"""Clearing credentials that were archived before a rule named them: the only way by which content leaves the archive.

Records have source, database, store, key, value, content_hash and removed_at. Values move nowhere: only rows whose key changes are shuffled, and of these only the key and a few marks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE = ["source", "database", "store"]


def denied(records: DataFrame, names: Column, at: Column) -> DataFrame:
    """All records, with `purged` where the database or store is a denied one (`names`: a condition on them; null is no) and there was something to clear: value null, hash empty, removed from `at` unless it was before. A second run purges nothing."""
    hit = F.coalesce(names, F.lit(False)) & (F.col("value").isNotNull() | (F.coalesce("content_hash", F.lit("")) != ""))
    cleared = {"value": F.when(~F.col("purged"), F.col("value")), "content_hash": F.when(F.col("purged"), "").otherwise(F.col("content_hash")), "removed_at": F.when(F.col("purged"), F.coalesce("removed_at", at)).otherwise(F.col("removed_at"))}
    return records.withColumn("purged", hit).withColumns(cleared)


def unscrubbed_keys(records: DataFrame, scrub: Callable[[Column], Column], at: Column) -> tuple[DataFrame, DataFrame]:
    """Records whose keys hold no credential any more, with `purged`, and source and n: how many rows of a source were changed or went.

    Where a record of the same place holds the scrubbed key, the unscrubbed ones go. Otherwise one row takes it, cleared, removed since the earliest time that one of them was or else `at`. Records of a null place are a place like others; a null key is left alone. Columns
    beyond those of a record are kept, and null in a row that several became.
    """
    own = ["key", "value", "content_hash", "removed_at", *PLACE]
    rest = [c for c in records.columns if c not in own]
    marked = records.withColumn("_key", F.coalesce(scrub(F.col("key")), F.col("key")))
    clean = marked.where("_key <=> key").drop("_key").withColumn("purged", F.lit(False))
    hits = marked.where("NOT (_key <=> key)")
    same = lambda other: [F.col(f"h.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in PLACE]
    groups = hits.groupBy(*PLACE, "_key").agg(F.min("removed_at").alias("removed_at"), F.count("*").alias("_n"), *(F.when(F.count("*") == 1, F.first(c)).alias(c) for c in rest))
    held = clean.select(*PLACE, "key")
    free = groups.alias("h").join(held.alias("c"), [*same("c"), F.col("h._key") == F.col("c.key")], "left_anti")
    taken = free.select(*PLACE, F.col("_key").alias("key"), F.lit(None).cast(records.schema["value"].dataType).alias("value"), F.lit("").alias("content_hash"), F.coalesce("removed_at", at).alias("removed_at"), *rest, F.lit(True).alias("purged"))
    return clean.unionByName(taken), groups.groupBy("source").agg(F.sum("_n").alias("n"))
