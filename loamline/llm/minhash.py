"""Near-duplicate documents by a chosen-path set similarity join over MinHash tokens.

1. A document's set is its distinct word shingles (64-bit hashes). Documents with equal sets form a class; only classes go on.
2. Trees: each of TREES independent trees branches all classes by one minwise token. A node of at most NODE classes is compared
   exhaustively; a larger one branches again by BRANCHES tokens of its tree and level, LEVELS times at most. What stays large after that is
   mostly near copies of one text, which no token tells apart: such a node is dealt to parts of NODE / 2 classes, each compared in itself
   and with one common pivot, and then only classes that are not in one component yet are compared across parts. Comparing uses 128
   one-byte minhashes and keeps pairs that agree in SLACK percent less than the threshold.
3. The kept pairs' spanning forests give candidate groups. A group's texts come together once and exact intersections of their full sets
   decide every link; a group too large for one task is verified like a large node: in parts with a common pivot first, then
   across parts only between what is not linked yet. So a group of n near copies that hang together costs n, not n squared.
4. Components of the links are found by large-star and small-star rounds.

A pair at similarity s meets in no node with probability (1 - s)^8, and, where its nodes branch at every level,
(1 - s (1 - (1 - s)^2)^2)^8: 1.6 in a million at 0.85, 23 in a million at 0.80. The sketch misses 2.5 and 18 in a million of pairs right at
these thresholds. No other step loses a link.

Sizes of nodes and groups are counted before rows move, joins on hot keys are skew-safe, and no group is collected whole.

Null texts and texts without words have no set, link to nothing and stay; very long texts count whole. Rows that repeat a doc_id are one node with the
links of all its rows. Rows with a null doc_id are together one node, the smallest, whose component_id is null. Extra columns are
ignored, and kept by drop_near_duplicates; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, join_skewed, map_slices, matching, slices, written
from .components import connected, labels
from .textbytes import mix, per_document, shingle_hashes, text_bytes, word_bounds, word_hashes

TREES, BRANCHES, LEVELS, SIGNATURE, SLACK = 8, 2, 2, 128, 15
TOKENS = TREES * (1 + BRANCHES * LEVELS)
NODE, GROUP_ROWS, GROUP_BYTES = 2048, 1500, 16 << 20
NO_ID = -(1 << 63)
_RNG = np.random.default_rng(77)
_FACTOR = _RNG.integers(0, 1 << 31, SIGNATURE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _RNG.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, joined, and where each text's begin."""
    raw, offsets = text_bytes(texts)
    starts, ends, first = word_bounds(raw, offsets)
    hashes, first = shingle_hashes(word_hashes(raw, starts, ends), first, width)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(first)))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc, n (set size), n_bytes, set_key (a digest of the set), tokens (minwise values that branch trees) and sketch of every document."""

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, first = shingle_sets(batch.column(1), width)
        _, offsets = text_bytes(batch.column(1))
        small = (hashes >> np.uint64(32)).astype(np.uint32)
        least = np.zeros((SIGNATURE, batch.num_rows), np.uint32)
        for k in range(SIGNATURE):
            least[k] = per_document(mixed32(small * _FACTOR[k] + _SHIFT[k]), first, np.minimum)
        keys = np.column_stack([per_document(mix(hashes), first), per_document(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), first)])
        low = np.ascontiguousarray((least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).T)
        tokens = pa.FixedSizeListArray.from_arrays(pa.array(least[:TOKENS].T.reshape(-1).view(np.int32)), TOKENS).cast(pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).fill_null(NO_ID), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array([k.tobytes() for k in keys], pa.binary()), tokens, pa.array([s.tobytes() for s in low], pa.binary())],
            ["doc", "n", "n_bytes", "set_key", "tokens", "sketch"],
        )

    return map_slices(docs.select("doc_id", "text"), "text", sketch, "doc long, n long, n_bytes long, set_key binary, tokens array<int>, sketch binary")


def mixed32(x: np.ndarray) -> np.ndarray:
    """Spread the high bits' order: a multiplied value's top bits decide the minimum, so fold the low ones in."""
    return (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)


def tree_nodes(classes: DataFrame, node: int) -> tuple[DataFrame, DataFrame | None]:
    """(key, doc) rows of the nodes with at most `node` classes, and (key, doc, size) of those that stay larger at all levels, if there are any."""

    def sized(rows: DataFrame) -> DataFrame:
        n = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n")), "nodes")
        return written(join_skewed(rows, n, "key", "n"), "tree-rows")

    trees = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(t, F.get("tokens", t)).alias("key"))))
    rows = sized(classes.select("doc", trees.alias("at")).select("doc", "at.tree", "at.key"))
    small = rows.where(F.col("size") <= node).select("key", "doc")
    for level in range(LEVELS):
        large = rows.where(F.col("size") > node)
        if large.isEmpty():
            return small, None
        token = lambda b: F.get("tokens", TREES + (level * TREES + F.col("tree")) * BRANCHES + b)  # noqa: B023, E731
        branch = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BRANCHES - 1)), lambda b: F.xxhash64("key", b, token(b))))  # noqa: B023
        rows = sized(large.select("key", "tree", "doc").join(classes.select("doc", "tokens"), "doc").select("doc", "tree", branch.alias("key")))
        small = small.unionByName(rows.where(F.col("size") <= node).select("key", "doc"))
    large = rows.where(F.col("size") > node).select("key", "doc", "size")
    return small, None if large.isEmpty() else large


def dealt(rows: DataFrame, parts: str) -> DataFrame:
    """(key, doc) of the parts of each key's rows (key, doc, `parts`), with the key's smallest doc as a pivot in each."""
    own = rows.select(F.xxhash64("key", F.pmod(F.xxhash64("doc"), F.col(parts))).alias("key"), "doc")
    pivots = rows.groupBy("key").agg(F.min("doc").alias("doc"), F.max(parts).alias(parts))
    pivots = pivots.select("doc", "key", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)).alias("part")).select(F.xxhash64("key", F.col("part").cast("long")).alias("key"), "doc")
    return own.unionByName(pivots).distinct()


def across(rows: DataFrame) -> DataFrame | None:
    """(key, doc) of tasks in which all docs of a key meet that are in different components, from (key, doc, component, load) rows; a task has loads of about 2. None where each key is one component.

    A component with a load of 1 or more has parts of its own, which don't meet each other; smaller ones share parts.
    """
    loads = written(rows.groupBy("key", "component").agg(F.sum("load").alias("load")), "loads")
    small = F.col("load") < 1
    keys = written(loads.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.when(small, F.col("load"))).alias("rest")).where("n > 1").drop("n"), "split-keys")
    if keys.isEmpty():
        return None
    many = written(loads.join(keys, "key").select("key", "component", small.alias("shared"), F.when(small, F.ceil("rest")).otherwise(F.ceil("load")).alias("parts")), "parts")
    part_of = lambda whole, number: F.xxhash64(whole, number)
    # what meets what: components with parts of their own, and all small ones of a key as one; pairs are made of these before their parts are numbered
    own = many.where("not shared").select("key", F.col("component").alias("whole"), "parts")
    units = own.unionByName(many.where("shared").groupBy("key").agg(F.max("parts").alias("parts")).withColumn("whole", F.lit(None).cast("long")))
    others = units.select("key", F.col("whole").alias("other_whole"), F.col("parts").alias("other_parts"))
    pairs = units.join(others, "key").where(F.coalesce(F.col("whole") != F.col("other_whole"), F.lit(True)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    pairs = pairs.withColumn("number", numbers("parts")).withColumn("other_number", numbers("other_parts"))
    pairs = pairs.select("key", part_of(F.col("whole"), F.col("number")).alias("part"), part_of(F.col("other_whole"), F.col("other_number")).alias("other"))
    pairs = pairs.select("key", "part", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("task"))
    part = F.when(F.col("shared"), part_of(F.lit(None).cast("long"), F.pmod(F.xxhash64("component"), F.col("parts")))).otherwise(part_of(F.col("component"), F.pmod(F.xxhash64("doc"), F.col("parts"))))
    placed = rows.join(many, ["key", "component"]).select("key", "doc", part.alias("part"))
    return placed.join(pairs, ["key", "part"]).select(F.col("task").alias("key"), "doc")


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return start, np.diff(np.append(start, len(keys)))


def _edges(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
    b = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _forest(docs: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star of each component of the pairs."""
    label = labels(len(docs), i, j)
    off = np.flatnonzero(label != np.arange(len(docs)))
    return docs[off], docs[label[off]]


def candidate_links(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): spanning forests, node by node, of the pairs whose sizes allow the threshold and whose sketches agree enough."""
    rows = members.join(classes.select("doc", "n", "sketch"), "doc").select("key", "doc", "n", "sketch")
    least = (percent - SLACK) * SIGNATURE // 100

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["key"]):
            docs, n = table.column("doc").to_numpy(), table.column("n").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SIGNATURE)
            start, size = _runs(table.column("key").to_numpy())
            two = start[size == 2]
            near = (sketch[two] == sketch[two + 1]).sum(1) >= least
            near &= 100 * np.minimum(n[two], n[two + 1]) >= percent * np.maximum(n[two], n[two + 1])
            out = [(docs[two[near]], docs[two[near] + 1])]
            for s, m in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                own, count, i, j = sketch[s : s + m], n[s : s + m], [], []
                for at in range(0, m, 64):
                    agree = np.count_nonzero(own[at : at + 64, None, :] == own[None, :, :], axis=2) >= least
                    agree &= 100 * np.minimum(count[at : at + 64, None], count) >= percent * np.maximum(count[at : at + 64, None], count)
                    x, y = np.nonzero(agree)
                    i.append(x[x + at < y] + at)
                    j.append(y[x + at < y])
                out.append(_forest(docs[s : s + m], np.concatenate(i), np.concatenate(j)))
            yield _edges(out)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")


def exact_pairs(hashes: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets with 100 * intersection >= percent * union, by full intersection counts.

    Shingles in few sets add their pairs one by one; those in many are multiplied as 0/1 columns, a block at a time.
    """
    m, size = len(first) - 1, np.diff(first)
    doc = np.repeat(np.arange(m), size)
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], doc[order]
    start, count = _runs(h) if len(h) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    both = np.zeros((m, m), np.float32)
    for c in range(2, 33):
        s = start[count == c]
        if len(s):
            sets = d[s[:, None] + np.arange(c)]
            x, y = np.triu_indices(c, 1)
            step = max(1, (1 << 20) // len(x))
            for lo in range(0, len(s), step):
                part = sets[lo : lo + step]
                both += np.bincount((part[:, x] * m + part[:, y]).ravel(), minlength=m * m).reshape(m, m)
    wide = np.flatnonzero(count > 32)
    for lo in range(0, len(wide), 4096):
        some = wide[lo : lo + 4096]
        column = np.repeat(np.arange(len(some)), count[some])
        at = np.repeat(start[some], count[some]) + np.arange(len(column)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
        block = np.zeros((m, len(some)), np.float32)
        block[d[at], column] = 1
        both += np.triu(block @ block.T, 1)
    union = size[:, None] + size[None, :] - both
    i, j = np.nonzero(np.triu(100 * both.astype(np.float64) >= percent * union, 1) & (both > 0))
    return i, j


def candidate_groups(classes: DataFrame, percent: int, node: int = NODE) -> DataFrame:
    """(node, root): the components of the pairs whose sketches agree enough."""
    small, large = tree_nodes(classes.select("doc", "tokens"), node)
    if large is None:
        return connected(candidate_links(small, classes, percent))
    large = large.withColumn("parts", F.ceil(F.col("size") / (node / 2)))
    links = connected(candidate_links(small.unionByName(dealt(large, "parts")), classes, percent))
    named = large.select("key", "doc").join(links.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("root", "doc").alias("component"), F.lit(2 / node).alias("load"))
    tasks = across(written(named, "large-nodes"))
    if tasks is None:
        return links
    more = written(candidate_links(tasks, classes, percent), "more-candidates")
    if more.isEmpty():
        return links
    return connected(more.unionByName(links.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def verified_links(docs: DataFrame, groups: DataFrame, sizes: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, root): the components of the exact links within candidate groups (node, root)."""
    members = written(groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).join(sizes, F.col("node") == F.col("doc")).drop("node"), "members")
    load = F.greatest(F.lit(2 / GROUP_ROWS), F.col("n_bytes") * F.lit(2 / GROUP_BYTES)).alias("load")
    total = members.select("root", load).groupBy("root").agg(F.count("*").alias("n"), F.sum("load").alias("whole"))
    total = written(total.withColumn("parts", F.when(F.col("whole") > 2, F.ceil("whole")).otherwise(F.lit(1).cast("long"))).drop("whole"), "groups")
    rows = written(join_skewed(members.select("root", "doc", load), total, "root", "n").select(F.col("root").alias("key"), "doc", "load", "parts"), "group-rows")
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text")
    texts = matching(texts, members.select("doc"), ["doc"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["key"]):
            docs, out = table.column("doc").to_numpy(), []
            hashes, sizes = [], []
            for batch in table.select(["text"]).to_batches():
                for part in slices(batch, 0):
                    h, first = shingle_sets(part.column(0), width)
                    hashes.append(h)
                    sizes.append(np.diff(first))
            h, first = np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            start, size = _runs(table.column("key").to_numpy())
            for s, m in zip(start.tolist(), size.tolist(), strict=True):
                if m > 1:
                    i, j = exact_pairs(h[first[s] : first[s + m]], first[s : s + m + 1] - first[s], percent)
                    out.append(_forest(docs[s : s + m], i, j))
            yield _edges(out)

    def meet(tasks: DataFrame) -> DataFrame:
        return tasks.join(texts, "doc").select("key", "doc", "text").repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long")

    large = rows.where("parts > 1")
    if large.isEmpty():
        return connected(meet(rows.select("key", "doc")))
    known = connected(meet(rows.where("parts = 1").select("key", "doc").unionByName(dealt(large, "parts"))))
    named = large.join(known.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", F.coalesce("root", "doc").alias("component"), "load")
    tasks = across(written(named, "large-groups"))
    if tasks is None:
        return known
    more = written(meet(tasks), "more-links")
    if more.isEmpty():
        return known
    return connected(more.unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document: linked documents have 100 * intersection >= percent * union."""
    rows = written(signatures(docs, width), "signatures")
    some = rows.where("n > 0")
    classes = written(some.groupBy("set_key").agg(F.min("doc").alias("doc"), F.count("*").alias("rows"), F.first("n").alias("n"), F.max("n_bytes").alias("n_bytes"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")), "classes")
    candidates = candidate_groups(classes, percent)
    links = verified_links(docs, candidates, classes.select("doc", "n_bytes"), width, percent)
    # rows of one doc_id with different sets tie their classes together
    named = classes.join(links.withColumnRenamed("node", "doc"), "doc", "left").select("set_key", F.col("rows").alias("n"), F.coalesce("root", "doc").alias("component"))
    found = join_skewed(some.select("doc", F.col("n").alias("n_shingles"), "set_key"), written(named, "components"), "set_key", "n").drop("set_key")
    found = found.unionByName(rows.where("n = 0").select("doc", F.col("n").alias("n_shingles"), F.col("doc").alias("component")))
    own = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(own("doc").alias("doc_id"), "n_shingles", own("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id."""
    gone = written(near_duplicates(docs, width, percent).where("not kept").select("doc_id").distinct(), "near-copies")
    return matching(docs, gone, ["doc_id"], keep=False)
