"""Folder roots, reply components, copies."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roots(nodes: DataFrame, key: str, parent: str, depth: int = 16) -> DataFrame:
    """key, root and depth by following parents, at most `depth` steps; a missing parent ends the walk.

    Each step doubles the reach (a node's ancestor takes over its own ancestor), so 16 steps need four joins.
    """
    own = nodes.select(F.col(key).alias("_id"))
    up = nodes.join(own.withColumnRenamed("_id", "_p"), F.col(parent) == F.col("_p"), "left").select(F.col(key), F.coalesce("_p", key).alias("root"), F.when(F.col("_p").isNull(), 0).otherwise(1).alias("depth"))
    reach = 1
    while reach < depth:
        far = up.select(F.col(key).alias("_k"), F.col("root").alias("_r"), F.col("depth").alias("_d"))
        up = up.join(far, F.col("root") == F.col("_k")).select(key, F.col("_r").alias("root"), (F.col("depth") + F.col("_d")).alias("depth"))
        reach *= 2
    return up


def components(edges: DataFrame, a: str, b: str, rounds: int = 20) -> DataFrame:
    """node and component (the smallest node reachable) of short-chained edges, by shortcutting label propagation.

    Labels fall to the neighbours' smallest label and then to that label's own label. The lineage is cut every other round by a checkpoint
    in spark.checkpoint.dir; the loop ends when no label falls.
    """
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or f"{tempfile.gettempdir()}/loamline-checkpoints")
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = both.union(both.select("y", "x")).where("x <> y").distinct().checkpoint()
    labels = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("c")).withColumnRenamed("x", "node").checkpoint()
    for _ in range(rounds):
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("c").alias("m"))
        low = labels.join(near, F.col("node") == F.col("x")).select("node", F.least("c", "m").alias("c"), F.col("c").alias("was"))
        hop = labels.select(F.col("node").alias("k"), F.col("c").alias("kc"))
        new = low.join(hop, F.col("c") == F.col("k"), "left").select("node", F.least("c", F.coalesce("kc", "c")).alias("c"), "was").checkpoint()
        labels = new.select("node", "c")
        if not new.where("c <> was").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    return labels.select("node", F.col("c").alias("component"))
