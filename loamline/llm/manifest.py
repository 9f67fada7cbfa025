"""A Merkle manifest of a dataset, its proofs found by butterfly exchange.

Leaves are SHA-256 digests of rows. Within a group (a language) they ascend by key and form a tree of fanout F: while nodes remain, every F consecutive
ones become the digest of their digests, the last run with fewer, even with one. The groups' roots form a tree of the same kind, whose root stands for
all rows. A proof holds, level by level, what stands left and right of a leaf's path.

How it runs: a range shuffle of small rows (key and digest) and prefix sums over the ranges' counts give each leaf its place; F ** BLOCK_LEVELS
consecutive leaves are a block, which one task hashes alone. Blocks then meet in a butterfly: in round r the F blocks whose numbers differ in digit r to
base F swap the roots they hold, and every one hashes the common ancestor for itself. So after the last round each block holds its group's root and all
upper siblings, and nothing is handed down. Where a group's blocks are no power of F, empty ones are added (fewer than F times as many), so every meeting has F
blocks whatever the group's size. The groups' roots go through the same steps as leaves of the tree above.

Odd rows: a null field counts as `-`; a null group comes first, a null key first in its group; equal keys go by digest, and of equal rows each has a place
of its own (which one is arbitrary: their digests are the same). An empty table gives no rows. Very long texts are only hashed, once, and never shuffled. A hot
group is cut into blocks like others. Other columns of a caller are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, small_enough, written

FANOUT = 2
#: A block has FANOUT ** BLOCK_LEVELS leaves.
BLOCK_LEVELS = 12
#: Rounds after which the exchange is written, so that no plan grows without end.
ROUNDS_A_PLAN = 8
_PATH = "array<struct<left:string,right:string>>"


def record_digest(*fields: Column) -> Column:
    """SHA-256, in hex, of the fields one after the other: `-` for null, else the number of UTF-8 bytes, `:` and the value (numbers in decimal)."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def placed(leaves: DataFrame) -> DataFrame:
    """leaves (grp, key, digest, changed, salt) with each one's place in its group (from 0) and the group's size."""
    order = ["grp", "key", "digest", "salt"]  # the salt parts equal rows, however many there are
    asc = [F.col(c).asc_nulls_first() for c in order]
    ids = F.monotonically_increasing_id()
    ranged = leaves.repartitionByRange(*asc).sortWithinPartitions(*asc).select("grp", "key", "digest", "changed", F.shiftright(ids, 33).alias("range"), ids.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))
    held = written(ranged, "merkle-order")
    counts = held.groupBy("grp", "range").agg(F.min("nth").alias("first"), F.count("*").alias("n"))  # at most one row a range and one a group
    before = F.coalesce(F.sum("n").over(Window.partitionBy("grp").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("grp", "range", "first", before.alias("before"), F.sum("n").over(Window.partitionBy("grp")).alias("total"))
    counts = written(counts, "merkle-counts")
    right = F.broadcast(counts) if small_enough(counts) else counts
    return held.join(right, ["grp", "range"]).select("grp", "key", "digest", "changed", (F.col("before") + F.col("nth") - F.col("first")).alias("place"), "total")


def _levels(digests: list[str], fanout: int, height: int) -> list[list[str]]:
    """The digests of each level, from the leaves to the one of `height`."""
    out = [digests]
    for _ in range(height):
        below = out[-1]
        out.append([hashlib.sha256("".join(below[i : i + fanout]).encode()).hexdigest() for i in range(0, len(below), fanout)])
    return out


def _height(total: int, fanout: int, levels: int) -> int:
    """Levels that a block of a group with so many leaves has below its root."""
    h, nodes = 0, total
    while nodes > 1 and h < levels:
        nodes, h = -(-nodes // fanout), h + 1
    return h


def blocks_of(leaves: DataFrame, fanout: int, levels: int) -> DataFrame:
    """grp, block, total, rows (key, digest, changed in order) and root: one row a block, written."""
    size = fanout**levels
    row = F.struct((F.col("place") % size).cast("int").alias("at"), "key", "digest", "changed")
    packed = placed(leaves).groupBy("grp", F.expr(f"place div {size}").alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(row)).alias("rows"))  # at most `size` small rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for total, rows in zip(batch.column("total").to_pylist(), batch.column("rows"), strict=True):
                digests = [d.hex() for d in rows.values.field("digest").to_pylist()]
                roots.append(_levels(digests, fanout, _height(total, fanout, levels))[-1][0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], [*batch.schema.names, "root"])

    key = leaves.schema["key"].dataType.simpleString()
    schema = f"grp string, block long, total long, rows array<struct<at:int,key:{key},digest:binary,changed:binary>>, root string"
    return written(packed.mapInArrow(run, schema), "merkle-blocks")


def butterfly(blocks: DataFrame, fanout: int, levels: int) -> DataFrame:
    """grp, block, path (the siblings of each level above the block, left and right) and root of the group, by rounds of swaps among fanout blocks."""
    most = blocks.agg(F.max("total")).first()[0] or 0
    ends = [fanout**levels]  # leaves that 0, 1, ... rounds reach
    while ends[-1] < most:
        ends.append(ends[-1] * fanout)
    rounds = sum(((F.col("total") > e).cast("int") for e in ends), F.lit(0))
    count = F.expr(f"(total + {ends[0] - 1}) div {ends[0]}")
    nodes = blocks.select("grp", "block", F.col("root").alias("digest"), rounds.alias("rounds"), count.alias("blocks"))
    span = F.element_at(F.array(F.lit(0), *(F.lit(fanout**r) for r in range(len(ends)))), F.col("rounds") + 1).cast("long")  # blocks below the last round's node
    extra = F.explode(F.filter(F.transform(F.array(*(F.lit(j) for j in range(1, fanout))), lambda j: F.col("block") + j * F.col("span")), lambda v: v >= F.col("blocks")))
    empty = nodes.withColumn("span", span).where("block < span").select("grp", extra.alias("block"), F.lit(None).cast("string").alias("digest"), "rounds")
    state = nodes.select("grp", "block", "digest", "rounds").unionByName(empty).withColumn("path", F.array().cast(_PATH))
    cut = None
    for r in range(len(ends) - 1):
        active = F.col("rounds") > r
        meet = F.when(active, F.expr(f"block - (block div {fanout**r}) % {fanout} * {fanout**r}")).otherwise(F.col("block"))
        state = state.withColumn("meet", meet)
        state = state.withColumn("met", F.array_sort(F.collect_list(F.struct("block", "digest")).over(Window.partitionBy("grp", "meet"))))  # fanout rows
        side = lambda keep: F.array_join(F.transform(F.filter("met", keep), lambda x: x.digest), "")
        state = state.withColumns({"left": side(lambda x: x.block < F.col("block")), "right": side(lambda x: x.block > F.col("block"))})
        under = F.concat("left", F.coalesce("digest", F.lit("")), "right")
        state = state.select(
            "grp", "block", F.when(active, F.when(under != "", F.sha2(under, 256))).otherwise(F.col("digest")).alias("digest"), "rounds",
            F.when(active, F.concat("path", F.array(F.struct("left", "right")))).otherwise(F.col("path")).alias("path"),
        )
        if r % ROUNDS_A_PLAN == ROUNDS_A_PLAN - 1:
            state, old = written(state, "merkle-round"), cut
            if old is not None:
                discard(old)
            cut = state
    real = state.join(blocks.select("grp", "block"), ["grp", "block"], "left_semi") if len(ends) > 1 else state
    return real.select("grp", "block", "path", F.col("digest").alias("root"))


def _sides(digests: list[str], fanout: int, height: int) -> list[list[tuple[str, str]]]:
    """For each level below the block's root the digests left and right of each node in its run."""
    out = []
    for level in _levels(digests, fanout, height)[:height]:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        out.append([("".join(run[:i]), "".join(run[i + 1 :])) for run in runs for i in range(len(run))])
    return out


def paths(blocks: DataFrame, upper: DataFrame, fanout: int, levels: int) -> DataFrame:
    """key, path and root of every leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                sides = _sides([x["digest"].hex() for x in b["rows"]], fanout, _height(b["total"], fanout, levels))
                out = [[*({"left": x[0], "right": x[1]} for x in (s[i // fanout**h] for h, s in enumerate(sides))), *b["path"]] for i in range(len(b["rows"]))]
                yield pa.RecordBatch.from_arrays([pa.array([x["key"] for x in b["rows"]]), pa.array(out, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), pa.array([b["root"]] * len(out), pa.string())], ["key", "path", "root"])

    joined = blocks.select("grp", "block", "total", "rows").join(upper, ["grp", "block"]).select("total", "rows", "path", "root")
    return joined.mapInArrow(run, f"key string, path {_PATH}, root string")


def _folded(digest: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        digest = hashlib.sha256(f"{left}{digest}{right}".encode()).hexdigest()
    return digest


def _proved(blocks: DataFrame, key: str, fanout: int, levels: int) -> DataFrame:
    """One row a leaf from blocks with their own path, the group's root and path, and the root of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = {n: batch.column(n)[i].as_py() for n in ("total", "path", "subroot", "top", "root")}
                rows = batch.column("rows")[i].values
                leaves, changed = [d.hex() for d in rows.field("digest").to_pylist()], [d and d.hex() for d in rows.field("changed").to_pylist()]
                sides = _sides(leaves, fanout, _height(b["total"], fanout, levels))
                above = [(x["left"], x["right"]) for x in (*b["path"], *b["top"])]
                tail, ends, proofs, roots = "".join(x + y for x, y in above), {}, [], []
                for at, leaf in enumerate(leaves):
                    own = [s[at // fanout**h] for h, s in enumerate(sides)]
                    proofs.append(hashlib.sha256(("".join(x + y for x, y in own) + tail).encode()).hexdigest())
                    end = _folded(changed[at] or leaf, own)
                    if end not in ends:  # most leaves of a block meet in its root
                        ends[end] = _folded(end, above)
                    roots.append(ends[end])
                n = len(leaves)
                columns = [rows.field("key"), leaves, [b["subroot"]] * n, [b["root"]] * n, proofs, roots, [r == b["root"] for r in roots]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return blocks.select("total", "rows", "path", "subroot", "top", "root").mapInArrow(run, f"key {key}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(rows: DataFrame, key: str, group: str, leaf: Column, changed: Column | None = None, fanout: int = FANOUT, levels: int = BLOCK_LEVELS) -> DataFrame:
    """key, leaf, subroot (of the row's group), root, proof_sha256 (of all siblings, level by level, left to right), folded_root (of the changed leaf, where there is
    one, with the original siblings) and verified (whether that is the root).

    leaf and changed are columns of hex digests over the rows, see record_digest(); changed is null where a row is as it was. group is a string column.
    """
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null first, then bytewise
    changed = F.lit(None).cast("string") if changed is None else changed
    leaves = written(rows.select(grp.alias("grp"), F.col(key).alias("key"), F.unhex(leaf).alias("digest"), F.unhex(changed).alias("changed"), F.monotonically_increasing_id().alias("salt")), "merkle-leaves")
    blocks = blocks_of(leaves, fanout, levels)
    upper = written(butterfly(blocks, fanout, levels), "merkle-upper")
    discard(leaves)
    roots = upper.where("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.unhex("root").alias("digest"), F.lit(None).cast("binary").alias("changed"), F.lit(0).cast("long").alias("salt"))
    over = blocks_of(roots, fanout, levels)
    tops = paths(over, butterfly(over, fanout, levels), fanout, levels).select(F.col("key").alias("grp"), F.col("path").alias("top"), "root")
    tops = written(tops, "merkle-tops")
    joined = blocks.join(upper.withColumnRenamed("root", "subroot"), ["grp", "block"])
    joined = joined.join(F.broadcast(tops) if small_enough(tops, 10_000) else tops, "grp")
    kind = rows.schema[key].dataType.simpleString()
    return _proved(joined.drop(blocks["root"]), kind, fanout, levels).withColumnRenamed("key", key)


def documents_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents by language; every seventh document by crc32 of its id is tampered with: 1 is added to its n_chars."""
    fields = lambda n_chars: [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    changed = F.when(hit, record_digest(*fields(F.col("n_chars").cast("decimal(20,0)") + 1)))
    return manifest(docs, "doc_id", "lang", record_digest(*fields(F.col("n_chars"))), changed)
