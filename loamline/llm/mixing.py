"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws the key -ln(u) / w from a hash u of its id and text and its quality weight w: a score of the quality classifier
where one is given, else the share of plain letters in its text. Within a source, documents in order of their keys form a weighted sample
without replacement; a prefix sum of their sizes cuts it at the source's budget. A target of more than one epoch takes
all documents for each complete epoch, then a sample for the rest. The document at the cut is taken in part (boundary="part") or goes whole to
the nearer side (boundary="whole").

The prefix sum is made in two steps. Rows of a source are counted in cells of equal ratio of keys (CELLS to each doubling), a cell
with many rows is divided evenly, and so buckets hold about the same number of rows whatever the weights are. Bucket totals
are summed per source (at most MAX_BUCKETS and the cells a source), and each bucket's own documents are summed from its offset, so no
source lies in one task.

Null texts have size 0 and are never taken; very long ones count whole; null sources form one source, last in order; ties of the key are broken by
doc_id, then by the text's checksum; repeated rows each take part. An empty table gives an empty result; extra columns are ignored, and kept by
sampled_documents whatever their names. A mixture names its sources: their number, not that of documents, is what the driver holds.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free_names, map_slices, small_batches, small_enough, unit_hash, written
from .textbytes import per_document, text_bytes, word_bounds

MAX_BUCKETS = 1 << 16
ROWS_A_BUCKET = 256
CELLS = 64
LEAST_WEIGHT = 0.05
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100), 0x20, *range(0x09, 0x0E), *b".,;:'-"]] = True


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, share: float = 1.0) -> dict[str | None, float]:
    """Target words of each source: `weights` repeat over the sources by code point, null last; what exceeds cap times a source's size is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    open_, rest = set(order), share * sum(sizes.values())
    while open_:
        unit = rest / sum(weight[s] for s in order if s in open_)
        full = [s for s in order if s in open_ and unit * weight[s] > cap * sizes[s]]
        if not full:
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in full:
            out[s] = cap * float(sizes[s])
            rest -= out[s]
            open_.discard(s)
    return {s: max(0.0, out[s]) for s in order}


def plain_share(texts: pa.Array) -> np.ndarray:
    """The share of plain letters and punctuation in each text."""
    raw, offsets = text_bytes(texts)
    return per_document(_PLAIN[raw], offsets) / np.maximum(1, np.diff(offsets))


def measured(docs: DataFrame, weigh: Callable[[pa.Array], np.ndarray] = plain_share) -> DataFrame:
    """(doc_id, source, size, weight, key, tie) of each document, written; size is its number of words, weight what `weigh` says, LEAST_WEIGHT at least."""

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = text_bytes(batch.column(2))
        starts, _, first = word_bounds(raw, offsets)
        weight = np.clip(weigh(batch.column(2)), LEAST_WEIGHT, 1.0)
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.diff(first), pa.int64()), pa.array(weight), pa.array(crc, pa.int64())],
            ["doc_id", "source", "size", "weight", "tie"],
        )

    rows = map_slices(docs.select("doc_id", "source", "text"), "text", measure, "doc_id long, source string, size long, weight double, tie long")
    # a hash may round to 1, of which the logarithm is 0
    with small_batches(docs.sparkSession):
        return written(rows.withColumn("key", F.greatest(F.lit(1e-18), -F.log(unit_hash("doc_id", "tie")) / F.col("weight"))), "sizes")


def bucketed(rows: DataFrame) -> DataFrame:
    """rows (name, rows, key, ...) with their bucket: ordered like keys, and about as many rows in one as in another."""
    rows = rows.withColumn("cell", F.floor(F.log2("key") * CELLS).cast("int"))
    aim = F.greatest(F.lit(ROWS_A_BUCKET), F.ceil(F.col("rows") / MAX_BUCKETS))
    cells = rows.groupBy("name", "rows", "cell").agg(F.count("*").alias("n")).select("name", "cell", F.ceil(F.col("n") / aim).cast("int").alias("parts"))
    cells = F.broadcast(cells) if small_enough(cells) else cells
    low, high = (F.pow(F.lit(2.0), (F.col("cell") + k) / F.lit(float(CELLS))) for k in (0, 1))
    part = F.greatest(F.lit(0), F.least(F.col("parts") - 1, F.floor((F.col("key") - low) / (high - low) * F.col("parts")).cast("int")))
    return rows.join(cells, ["name", "cell"]).withColumn("part", part).drop("parts", "rows")


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, share: float = 1.0, boundary: str = "part", weigh: Callable[[pa.Array], np.ndarray] = plain_share
) -> DataFrame:
    """doc_id, tie (the text's crc32), size, source_size, target and taken of every document."""
    spark = docs.sparkSession
    rows = measured(docs, weigh)
    # one row a source: a mixture names its sources, so the list is as short as its weights
    per = {r["source"]: (r["words"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()}
    aims = targets({s: v[0] for s, v in per.items()}, weights, cap, share)
    plan = []
    for s, (words, n) in per.items():
        goal = math.floor(aims[s] + 0.5)
        epochs = min(math.floor(cap), goal // words) if words else 0
        plan.append((s, words, float(aims[s]), epochs, goal - epochs * words, n))
    table = spark.createDataFrame(plan, "_source string, source_size long, target double, epochs long, budget long, rows long")
    table = F.broadcast(table) if len(plan) <= BROADCAST_ROWS else table
    rows = rows.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = bucketed(rows.withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source"))
    before = rows.groupBy("name", "cell", "part").agg(F.sum("size").alias("held"))
    before = before.withColumn("offset", F.sum("held").over(Window.partitionBy("name").orderBy("cell", "part")) - F.col("held")).drop("held")
    own = Window.partitionBy("name", "cell", "part").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.join(before, ["name", "cell", "part"]).withColumn("ahead", F.col("offset") + F.sum("size").over(own) - F.col("size"))
    room = F.col("budget") - F.col("ahead")
    if boundary == "part":
        extra = F.greatest(F.lit(0), F.least("size", room))
    else:
        extra = F.when((room > 0) & (2 * room >= F.col("size")) & (F.col("epochs") < math.floor(cap)), F.col("size")).otherwise(0)
    taken = (F.col("epochs") * F.col("size") + extra).cast("long")
    return ranked.select("doc_id", "tie", "size", "source_size", "target", taken.alias("taken"))


def sampled_documents(docs: DataFrame, weigh: Callable[[pa.Array], np.ndarray] = plain_share) -> DataFrame:
    """docs as the mix takes them: whole documents, repeated once for each epoch that has them."""
    id_, tie, copies, total, rows, crc, nth, copy = free_names(docs.columns, "id", "tie", "copies", "total", "rows", "crc", "nth", "copy")
    mixed = mix_sources(docs, boundary="whole", weigh=weigh).where("size > 0 and taken > 0")
    taken = mixed.select(F.col("doc_id").alias(id_), F.col("tie").alias(tie), (F.col("taken") / F.col("size")).cast("int").alias(copies))
    # rows that repeat id and text are told apart by nothing but their number, so their copies are added up on one side
    taken = taken.groupBy(id_, tie).agg(F.sum(copies).alias(total), F.count("*").alias(rows))
    kept = docs.withColumn(crc, F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    joined = kept.join(taken, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(crc) == F.col(tie)))
    if mixed.groupBy("doc_id", "tie").count().where("count > 1").limit(1).count():
        order = F.row_number().over(Window.partitionBy("doc_id", crc).orderBy(F.lit(0)))
        share = F.floor(F.col(total) / F.col(rows)) + F.when(F.col(nth) <= F.col(total) % F.col(rows), 1).otherwise(0)
        joined = joined.withColumn(nth, order).withColumn(total, share).where(F.col(total) > 0)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(total).cast("int")))).select(docs.columns)
