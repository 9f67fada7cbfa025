"""Substring dedup by content-defined chunking.

A gear rolling hash over the last GEAR_WORDS words runs along a text. A chunk ends after a word whose hash is the least of some
`reach` neighbouring ones (the last of equal ones), so bounds depend on near content only and resync after an insertion, and
`reach` = (min_words - GEAR_WORDS + 1) / 2 makes sure that any run of `min_words` words holds two bounds wherever it
stands. Between its first and last bound it is cut alike in all documents, so it holds a whole chunk whose digest they share.

1. Digests of all chunks are counted; those of two documents or more are repeated.
2. Repeated chunks are joined to super-chunks: from each chunk as many as make `min_words` words. A super-chunk that another
   document holds too is a repeated span, with all its words in one and the same partner.
3. A shorter passage may hold no super-chunk. Its repeated chunk is then extended by half of what is missing to `min_words`, to
   the left and to the right; one of these is shared too, or there is no such passage. Where one is, every run of
   `min_words` words around the chunk is told by its digest in all documents that share the extension.

So a document is reported if and only if a run of `min_words` words or more stands in another document too (words told by 64-bit hashes).
Passages found in step 2 are cut at chunk bounds (up to `reach` + GEAR_WORDS words at either end may stay), those of step 3 at words.

A span is kept in the first of its holders (the smallest doc_id) and is a copy in the others. That is judged word by word: a word is a
copy if a shared run that holds it has an earlier holder, and spans are split where that changes, so of every repeated run each word
stays somewhere.

Digests are counted with map-side combining and joined back skew-safe, so a passage that a third of the documents share costs no
task more. Nothing is capped, and no text is compared with all others.

Null texts count as empty and have no chunks; very long ones are cut like others. A null doc_id is a document like others, smaller than all. Rows
that repeat doc_id and text count once; texts under one doc_id are kept apart, and what they share among themselves is no repeat.
Extra columns are ignored by repeated_spans and kept by without_repeats, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_names, join_skewed, map_slices, small_enough, written
from .textbytes import RunHash, mix, text_bytes, word_bounds, word_hashes

MIN_WORDS, GEAR_WORDS = 50, 8
NO_ID = -(1 << 63)
#: What tells the digests of super-chunks and of left and right extensions apart.
SUPER, LEFT, RIGHT = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179), np.uint64(0x3C6EF372FE94F82B)


def gear_hashes(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The gear hash at every word: the sum of word hash << 8 * age over the last GEAR_WORDS words of the same document, by doubling."""
    h = words.copy()
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    step = 1
    while step < GEAR_WORDS:
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint64(8 * step)
        older[place < step] = 0
        h = h + older
        step *= 2
    return h


def reach_of(min_words: int) -> int:
    """In how many neighbouring words a chunk must end."""
    if min_words < GEAR_WORDS + 1:
        raise ValueError(f"passages need {GEAR_WORDS + 1} words at least")
    return (min_words - GEAR_WORDS + 1) // 2


def chunk_bounds(words: np.ndarray, first: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of every chunk; chunks tile each document and are no longer than `reach` words but at its ends."""
    n = len(words)
    marks = np.zeros(0, np.int64)
    if n >= reach:
        # the hash's upper half, then the place from the right: equal hashes give the last one
        low = mix(gear_hashes(words, first)) >> np.uint64(32) << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
        width = 1
        while width < reach:
            step = min(width, reach - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
        start = np.arange(n - reach + 1)
        inside = (place[: n - reach + 1] >= GEAR_WORDS - 1) & (start + reach <= np.repeat(first[1:], np.diff(first))[: n - reach + 1])
        marks = (np.uint64(0xFFFFFFFF) - (low[inside] & np.uint64(0xFFFFFFFF))).astype(np.int64) + 1
    bounds = np.unique(np.concatenate([first, marks]))
    return bounds[:-1], bounds[1:]


class Cut:
    """A batch of texts cut into chunks: words, chunks and digests of runs of words."""

    def __init__(self, texts: pa.Array, min_words: int):
        self.raw, self.offsets = text_bytes(texts)
        self.starts, self.ends, self.first = word_bounds(self.raw, self.offsets)
        words = word_hashes(self.raw, self.starts, self.ends, lower=False)
        self.low, self.high = chunk_bounds(words, self.first, reach_of(min_words))
        self.digest = RunHash(words)
        self.doc = np.searchsorted(self.first, self.low, "right") - 1  # the last of the documents that begin here: the one with words
        self.base = np.searchsorted(self.low, self.first)  # each document's first chunk

    def text_keys(self) -> np.ndarray:
        return np.array([zlib.crc32(self.raw[a:b]) for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True)], np.int64)


def chunks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, text_key, ordinal and digest of every chunk."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = Cut(batch.column(1), min_words)
        ids, keys = batch.column(0).fill_null(NO_ID).to_numpy(), c.text_keys()
        ordinal = np.arange(len(c.low)) - c.base[c.doc]
        return pa.RecordBatch.from_arrays([pa.array(ids[c.doc], pa.int64()), pa.array(keys[c.doc], pa.int64()), pa.array(ordinal, pa.int32()), pa.array(c.digest(c.low, c.high).view(np.int64))], ["doc", "text_key", "ordinal", "digest"])

    return map_slices(docs.select("doc_id", "text"), "text", cut, "doc long, text_key long, ordinal int, digest long")


def _shared(rows: DataFrame, digest: str, name: str) -> DataFrame:
    """digest, n (its rows) and first_doc of the digests that two documents or more hold, written."""
    counts = rows.groupBy(digest).agg(F.count("*").alias("n"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"))
    return written(counts.where("first_doc < last_doc").drop("last_doc"), name)


def _with_texts(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """doc, text_key and text of the documents in lists, with its other columns."""
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"), "text")
    ids = lists.select("doc").distinct()
    if small_enough(ids):  # else the join below drops the other documents as well
        texts = texts.join(F.broadcast(ids), "doc", "left_semi")
    return texts.join(lists, ["doc", "text_key"]).select("doc", "text_key", "text", *(c for c in lists.columns if c not in ("doc", "text_key")))


def _flat(lists: pa.Array, *fields: str) -> tuple[np.ndarray, ...]:
    """The row of each entry of a list column, and the entries (their fields, where they are structs)."""
    lists = lists.fill_null([]) if lists.null_count else lists
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    values = lists.flatten()
    return (row, *((values.field(f).to_numpy(zero_copy_only=False) for f in fields) if fields else (values.to_numpy(zero_copy_only=False),)))


def extended(docs: DataFrame, hits: DataFrame, min_words: int) -> DataFrame:
    """doc, text_key, ordinal, last and key: super-chunks (to chunk `last`) and both extensions (last = -1) of the repeated chunks."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = Cut(batch.column(2), min_words)
        row, ordinal = _flat(batch.column(3))
        at = c.base[row] + ordinal
        repeated = np.zeros(len(c.low) + 1, np.int64)
        repeated[at + 1] = 1
        total = np.cumsum(repeated)
        low, high, start, stop = c.low[at], c.high[at], c.first[row], c.first[row + 1]
        last = np.searchsorted(c.high, low + min_words)
        fits = low + min_words <= stop
        fits[fits] = total[last[fits] + 1] - total[at[fits]] == last[fits] + 1 - at[fits]  # shared super-chunks hold repeated chunks only
        more = -(-(min_words - (high - low)) // 2)
        left, right = (more > 0) & (low - more >= start), (more > 0) & (high + more <= stop)
        parts = [
            (np.flatnonzero(fits), last[fits] - c.base[row[fits]], c.digest(low[fits], c.high[last[fits]]) ^ SUPER),
            (np.flatnonzero(left), None, c.digest((low - more)[left], high[left]) ^ LEFT),
            (np.flatnonzero(right), None, c.digest(low[right], (high + more)[right]) ^ RIGHT),
        ]
        pick = np.concatenate([p for p, _, _ in parts])
        ends = np.concatenate([np.full(len(p), -1) if e is None else e for p, e, _ in parts])
        keys = np.concatenate([k for _, _, k in parts])
        ids = [batch.column(k).take(pa.array(row[pick])) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*ids, pa.array(ordinal[pick], pa.int32()), pa.array(ends, pa.int32()), pa.array(keys.view(np.int64))], ["doc", "text_key", "ordinal", "last", "key"])

    return map_slices(_with_texts(docs, hits), "text", cut, "doc long, text_key long, ordinal int, last int, key long")


def _uncovered(found: DataFrame) -> DataFrame:
    """The keys of shared extensions whose chunk lies in no repeated super-chunk of its document."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, low, last = _flat(batch.column(0), "ordinal", "last")
            own, ordinal, key = _flat(batch.column(1), "ordinal", "key")
            size = np.zeros(batch.num_rows, np.int64)
            np.maximum.at(size, row, last.astype(np.int64) + 2)
            np.maximum.at(size, own, ordinal.astype(np.int64) + 2)
            at = np.cumsum(size) - size
            depth = np.zeros(int(size.sum()), np.int32)
            np.add.at(depth, at[row] + low, 1)
            np.add.at(depth, at[row] + last + 1, -1)
            open_ = np.cumsum(depth)[at[own] + ordinal] == 0
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(key[open_]), pa.int64())], ["key"])

    return found.select("supers", "sides").mapInArrow(keys, "key long").distinct()


def _merged(low: np.ndarray, high: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """Intervals joined where they meet, each with its smallest first holder."""
    out: list[list[int]] = []
    for k in np.argsort(low, kind="stable"):
        if out and low[k] <= out[-1][1]:
            out[-1][1], out[-1][2] = max(out[-1][1], int(high[k])), min(out[-1][2], int(first[k]))
        else:
            out.append([int(low[k]), int(high[k]), int(first[k])])
    return [(a, b, f) for a, b, f in out]


def runs(docs: DataFrame, lists: DataFrame, min_words: int) -> DataFrame:
    """doc, text_key, word, n_words, start, size (bytes), first_doc and digest: repeated super-chunks, joined, with their first holder;
    and, with a digest instead, every run of min_words words that holds one of the chunks in `open`."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = Cut(batch.column(2), min_words)
        ids = batch.column(0).to_numpy()
        row, ordinal, last, holder = _flat(batch.column(3), "ordinal", "last", "first_doc")
        spans = []
        low, high, copied = c.low[c.base[row] + ordinal], c.high[c.base[row] + last], holder < ids[row]
        at = np.searchsorted(row, np.arange(len(ids) + 1))
        for d in np.flatnonzero(np.diff(at)):
            for copy in (True, False):
                own = at[d] + np.flatnonzero(copied[at[d] : at[d + 1]] == copy)
                spans += [(d, a, b, f) for a, b, f in _merged(low[own], high[own], holder[own])]
        at, chunk = _flat(batch.column(4))
        lo = np.maximum(c.high[c.base[at] + chunk] - min_words, c.first[at])
        hi = np.minimum(c.low[c.base[at] + chunk], c.first[at + 1] - min_words) + 1
        marks = np.zeros(len(c.starts) + 1, np.int64)
        np.add.at(marks, lo[lo < hi], 1)
        np.add.at(marks, hi[lo < hi], -1)
        word = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        s = np.array(spans, np.int64).reshape(-1, 4)
        doc = np.concatenate([s[:, 0], np.searchsorted(c.first, word, "right") - 1])
        low, high = np.concatenate([s[:, 1], word]), np.concatenate([s[:, 2], word + min_words])
        start = c.starts[low]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array(low - c.first[doc], pa.int32()), pa.array(high - low, pa.int32()), pa.array(start - c.offsets[doc], pa.int64()), pa.array(c.ends[high - 1] - start, pa.int64()),
                pa.concat_arrays([pa.array(s[:, 3], pa.int64()), pa.nulls(len(word), pa.int64())]), pa.concat_arrays([pa.nulls(len(s), pa.int64()), pa.array(c.digest(word, word + min_words).view(np.int64), pa.int64())]),
            ],
            ["doc", "text_key", "word", "n_words", "start", "size", "first_doc", "digest"],
        )

    return map_slices(_with_texts(docs, lists.select("doc", "text_key", "supers", "open")), "text", cut, "doc long, text_key long, word int, n_words int, start long, size long, first_doc long, digest long")


def split_spans(low: np.ndarray, high: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, own: int) -> list[tuple[int, int, int, int, bool]]:
    """(start, size, n_words, first_doc, kept) from one document's shared runs (words low to high, bytes start to end, first holder).

    Words in runs with an earlier holder are copies; what is left of the runs that this document holds first is kept.
    """
    begin, stop = dict(zip(low.tolist(), start.tolist(), strict=True)), dict(zip(high.tolist(), end.tolist(), strict=True))
    copies, firsts = (_merged(low[m], high[m], first[m]) for m in (first < own, first >= own))
    out = [(begin[a], stop[b] - begin[a], b - a, f, False) for a, b, f in copies]
    k = 0
    for a, b, f in firsts:
        while k < len(copies) and copies[k][1] <= a:
            k += 1
        at, byte, j = a, begin[a], k
        while at < b:
            if j == len(copies) or copies[j][0] >= b:
                out.append((byte, stop[b] - byte, b - at, f, True))
                break
            if copies[j][0] > at:
                out.append((byte, begin[copies[j][0]] - byte, copies[j][0] - at, f, True))
            at, byte, j = copies[j][1], stop[copies[j][1]], j + 1
    return sorted(out)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key, start, size (bytes), n_words, first_doc_id and kept (it is the first holder) of every repeated span."""
    rows = written(chunks(docs, min_words), "chunks")
    shared = _shared(rows, "digest", "shared-chunks")
    hits = join_skewed(rows, shared.drop("first_doc"), "digest", "n").groupBy("doc", "text_key").agg(F.sort_array(F.collect_set("ordinal")).alias("ordinals"))
    hits = written(hits, "repeated-chunks")
    discard(rows)
    discard(shared)
    keys = written(extended(docs, hits, min_words), "extended")
    discard(hits)
    shared = _shared(keys, "key", "shared-extended")
    whole, side = F.col("last") >= 0, F.col("last") < 0
    found = join_skewed(keys, shared, "key", "n").groupBy("doc", "text_key").agg(
        F.collect_set(F.when(whole, F.struct("ordinal", "last", "first_doc"))).alias("supers"), F.collect_set(F.when(side, F.struct("ordinal", "key"))).alias("sides"))
    found = written(found, "found")
    discard(keys)
    open_keys = written(_uncovered(found).join(shared.select("key", "n"), "key"), "open")
    discard(shared)
    sides = found.select("doc", "text_key", F.explode("sides").alias("side")).select("doc", "text_key", "side.ordinal", "side.key")
    open_ = join_skewed(sides, open_keys, "key", "n").groupBy("doc", "text_key").agg(F.collect_set("ordinal").alias("open"))
    lists = written(found.drop("sides").join(open_, ["doc", "text_key"], "left").where("size(supers) > 0 or open is not null"), "lists")
    discard(found)
    parts = written(runs(docs, lists, min_words), "runs")
    discard(lists)
    told = parts.where("digest is not null").drop("first_doc")
    confirmed = join_skewed(told, _shared(told, "digest", "shared-runs"), "digest", "n").drop("digest")
    every = parts.where("digest is null").drop("digest").unionByName(confirmed)
    lists = every.groupBy("doc", "text_key").agg(F.collect_set(F.struct("word", "n_words", "start", "size", "first_doc")).alias("runs"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, word, n, start, size, first = _flat(batch.column(2), "word", "n_words", "start", "size", "first_doc")
            at = np.searchsorted(row, np.arange(batch.num_rows + 1))
            ids, doc, out = batch.column(0).to_pylist(), [], []
            for d, own in enumerate(ids):
                s = slice(at[d], at[d + 1])
                found = split_spans(word[s], word[s] + n[s], start[s], start[s] + size[s], first[s], own)
                doc += [d] * len(found)
                out += found
            cols = list(zip(*out, strict=True)) or [()] * 5
            take = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True))], ["doc", "text_key", "start", "size", "n_words", "first_doc", "kept"])

    spans = lists.mapInArrow(split, "doc long, text_key long, start long, size long, n_words long, first_doc long, kept boolean")
    own = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return spans.select(own("doc").alias("doc_id"), "text_key", "start", "size", "n_words", own("first_doc").alias("first_doc_id"), "kept")


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with all spans but the kept ones cut out of their texts; all columns and rows stay."""
    id_, key, cuts, crc = free_names(docs.columns, "id", "key", "cuts", "crc")
    lists = spans.where("not kept").groupBy(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias(cuts))
    marked = docs.withColumn(crc, F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    joined = marked.join(lists, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(crc) == F.col(key)), "left")
    data = F.col("text").cast("binary")
    ends = F.transform(cuts, lambda s: s["start"] + s["size"])
    gaps = F.transform(
        F.sequence(F.lit(0), F.size(cuts)),
        lambda i: F.substring(data, F.when(i == 0, F.lit(1)).otherwise(F.get(ends, i - 1) + 1).cast("int"), (F.coalesce(F.get(cuts, i)["start"], F.octet_length("text").cast("long")) - F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))).cast("int")),
    )
    cut = F.decode(F.aggregate(gaps, F.lit(b""), lambda a, x: F.concat(a, x)), "utf-8")
    return joined.withColumn("text", F.when(F.col(cuts).isNull(), F.col("text")).otherwise(cut)).select(docs.columns)
