"""Connected components of an edge table by large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_skewed, written


EDGES_A_TASK = 500_000


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of (a, b) edges but the roots; a root is the smallest node of its component.

    Each round is a few aggregations and skew-safe joins over an edge table that is written to the shared folder. A large star links a node's bigger
    neighbours to its smallest one, so paths shrink by halves; it is needed while there are paths. A small star links a node's smaller
    neighbours, and itself, to the smallest of them; it is needed while a node has several. Without either the table is stars.

    The number of tasks follows the number of edges (EDGES_A_TASK), as a round over few edges costs little but its tasks.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).distinct(), "edges")
    tasks = max(8, -(-now.count() // EDGES_A_TASK))
    few = (lambda df: df.coalesce(tasks)) if tasks < int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) else (lambda df: df)
    for _ in range(rounds):
        own = written(few(now.groupBy("big").agg(F.min("small").alias("low"), F.count("*").alias("n"))), "lowest")
        uses = few(now.groupBy("small").agg(F.count("*").alias("n")))
        step = written(few(uses.join(own.select(F.col("big").alias("small"), "low"), "small", "left").select("small", "n", F.coalesce("low", "small").alias("low"))), "large")
        paths, several = not step.where("low <> small").isEmpty(), not own.where("n > 1").isEmpty()
        old = [own, step]
        if not paths and not several:
            break
        if paths:
            old.append(now)
            now = written(few(few(join_skewed(now, step, "small", "n")).select("big", F.col("low").alias("small")).distinct()), "edges")
            if several:
                own = written(few(now.groupBy("big").agg(F.min("small").alias("low"), F.count("*").alias("n"))), "lowest")
                old.append(own)
        if several:
            old.append(now)
            linked = few(join_skewed(now, own, "big", "n")).where("small <> low").select(F.col("small").alias("big"), F.col("low").alias("small"))
            now = written(few(linked.unionByName(own.select("big", F.col("low").alias("small"))).distinct()), "edges")
        for df in old:
            discard(df)
    else:
        raise RuntimeError("components did not settle")
    for df in old:
        discard(df)
    return now.select(F.col("big").alias("node"), F.col("small").alias("root"))


def labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each of n items' component under the pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            return label
        label = new
