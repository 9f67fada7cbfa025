"""Best-fit packing of token sequences by length patterns.

1. Every text becomes token ids (a public tokenizer file, its path a parameter) and an end id, cut only where it is longer
   than a sequence. The pieces (a few dozen bytes each) are written once.
2. Their length histogram, at most `capacity` rows at any corpus size, goes to the driver. Patterns of few documents are
   enumerated on a coarse grid of lengths, non-negative least squares fits how often each repeats, the counts are rounded
   down to what the histogram has, and residual lengths are packed best-fit, longest first, into the gaps and new sequences.
3. The plan is a list of runs (length, ranks, first sequence, offset). A piece's rank among those of its length comes from
   salted row numbers plus prefix-summed salt counts, so a common length is not in one task; the rank gives its place.

A null text is empty: it holds only the end id. Repeated rows are packed like any others. Extra columns are ignored; an
empty table gives an empty result. Text is tokenized whole: it is cut at ASCII white space, which no token of this tokenizer
spans, and each distinct word is encoded once a task.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, slices, small_batches, written

CAPACITY, END_ID, SALTS = 4096, 1, 1024
#: Words that an encoder remembers; beyond that it forgets those that came in one slice of text only.
WORDS_HELD = 200_000
#: Bytes of text whose words are encoded at once, and the words that the tokenizer gets in one call.
SLICE_BYTES, CALL_WORDS = 2 << 20, 20_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of whole texts by distinct words, with a bounded memory of words already encoded.

    The tokenizer folds case and never joins letters with what follows them, so a word of letters and closing marks is its
    letters' ids and the marks' ids. Words of letters alone are single runs of tokens whose last one alone ends a word, so many
    are encoded in one call. All other words are encoded as they are.
    """

    MARKS = ".,!?%&*#$|:;-"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.known: dict[str, int] = {}
        self.ids, self.begin, self.slices = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint8)
        self.used = 0
        self._append([""], np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def forget(self) -> None:
        """Keep the words that came in two slices or more; if these are more than half of what may be held, none."""
        stays = self.slices[: len(self.known)] > 1
        stays &= stays.sum() <= WORDS_HELD // 2
        stays[0] = True  # the empty word
        at = np.flatnonzero(stays)
        ids, size = self._gather(at)
        words = [w for w, keep in zip(self.known, stays.tolist(), strict=True) if keep]  # a dict keeps the order of numbers
        self.known, self.used = {}, 0
        self.slices[:] = 0
        self._append(words, ids, size)

    def _append(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known)
        while n + len(words) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.slices = np.concatenate([self.slices, np.zeros_like(self.slices)])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[n + 1 : n + 1 + len(words)] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))

    def _append_each(self, words: list[str]) -> None:
        for k in range(0, len(words), CALL_WORDS):
            part = words[k : k + CALL_WORDS]
            coded = [c.ids for c in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self._append(part, np.array([i for ids in coded for i in ids], np.uint32), np.array([len(ids) for ids in coded], np.int64))

    def _append_stems(self, stems: list[str]) -> None:
        for k in range(0, len(stems), CALL_WORDS):
            self._append_some(stems[k : k + CALL_WORDS])

    def _append_some(self, stems: list[str]) -> None:
        joined = [" ".join(stems[i : i + 200]) for i in range(0, len(stems), 200)]
        ids = np.concatenate([np.array(c.ids, np.uint32) for c in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(stems):
            self._append(stems, ids, np.diff(ends, prepend=0))
        else:  # a letter whose small form is two characters ends a word early
            self._append_each(stems)

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many known words one after another, and how many each has."""
        begin = self.begin[at]
        size = self.begin[at + 1] - begin
        ahead = np.cumsum(size) - size
        total = int(size.sum())
        kind = np.int32 if max(total, self.used) < 1 << 31 else np.int64  # half the room for what a slice has
        place = np.repeat((begin - ahead).astype(kind), size)
        place += np.arange(total, dtype=kind)
        return self.ids[place], size

    def _learn(self, words: list[str]) -> None:
        known, marks = self.known, self.MARKS
        cut = [s.lower() if s.isascii() else s for s in (w.rstrip(marks) for w in words)]
        pairs = [(w, s, w[len(s) :]) if s.isalpha() else (w, "", w) for w, s in zip(words, cut, strict=True)]
        if stems := [s for s in dict.fromkeys(s for _, s, _ in pairs) if s not in known]:
            self._append_stems(stems)
        if others := [m for m in dict.fromkeys(m for _, _, m in pairs) if m not in known]:
            self._append_each(others)
        if rest := [p for p in pairs if p[0] not in known]:
            ids, size = self._gather(np.array([known[x] for _, s, m in rest for x in (s, m)], np.int64))
            self._append([w for w, _, _ in rest], ids, size.reshape(-1, 2).sum(1))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): each text's ids and after them the end id."""
        if len(self.known) > WORDS_HELD:
            self.forget()
        split = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if fresh := [w for w in distinct if w not in self.known]:
            self._learn(fresh)
        number = np.array([self.known[w] for w in distinct], np.int64)
        self.slices[number] = np.minimum(self.slices[number], 1) + 1
        del distinct, fresh
        at = number[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        ids, size = self._gather(at)
        del words, at, number
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(size)])[bounds] + np.arange(len(bounds))
        out = np.full(offsets[-1], END_ID, np.uint32)
        inner = np.ones(len(out), bool)
        inner[offsets[1:] - 1] = False
        out[inner] = ids
        return out, offsets


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encoder = WordEncoder(path)  # a task's own, so a worker that is used again holds none of it
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                ids, offsets = encoder.encode(part.column(1))
                pieces = -(-np.diff(offsets) // capacity)
                row = np.repeat(np.arange(part.num_rows), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = offsets[row] + piece * capacity
                end = np.minimum(begin + capacity, offsets[row + 1])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin, end, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(end - begin, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
                del ids, offsets, crc
            pa.default_memory_pool().release_unused()
        del encoder
        give_back()

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares by active sets: min |a x - b| with x >= 0."""
    x, active = np.zeros(a.shape[1]), np.zeros(0, np.int64)
    floor = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= floor:
            break
        active = np.append(active, best)
        while len(active):
            s = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            now, low = x[active], s <= 0
            if not low.any():
                x[active] = s
                break
            now = now + (now[low] / (now[low] - s[low] + 1e-300)).min() * (s - now)
            stays = now > 1e-9
            x[active] = np.where(stays, now, 0)
            active = active[stays]
    return x


def patterns(units: int, most: int = 3) -> list[tuple[int, ...]]:
    """Every way to fill `units` grid units exactly with at most `most` lengths, longest first."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int, top: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < most:
            for k in range(min(top, left), 0, -1):
                if k * (most - len(head)) >= left:
                    extend((*head, k), left - k, k)

    extend((), units, units)
    return out


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, grid: int = 128) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece once, and the number of sequences.

    All sequences of a run of bins are alike, so the plan's size depends on the distinct lengths, not on the corpus.
    """
    left = {k: v for k, v in histogram.items() if v}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    bins: dict[int, list[tuple[int, int]]] = {}  # free room -> runs (first sequence, count)
    rooms: list[int] = []
    sequences = 0

    def place(length: int, count: int, first: int, offset: int) -> None:
        runs.append((length, rank[length], count, first, offset))
        rank[length] += count
        left[length] -= count
        if not left[length]:
            del left[length]

    def keep(first: int, count: int, room: int) -> None:
        if room:
            if room not in bins:
                bisect.insort(rooms, room)
            bins.setdefault(room, []).append((first, count))

    unit = -(-capacity // grid)
    supply = np.zeros(grid + 1)
    for length, count in left.items():
        supply[-(-length // unit)] += count
    found = [p for p in patterns(grid) if len(p) > 1 and all(supply[k] for k in p)]
    if found:
        a = np.zeros((grid + 1, len(found)))
        for j, p in enumerate(found):
            for k in p:
                a[k, j] += 1
        fitted = nnls(a, supply)
        stock = sorted(left)
        members: dict[int, list[int]] = {}
        for length in sorted(left, reverse=True):
            members.setdefault(-(-length // unit), []).append(length)
        for j in np.argsort(-fitted, kind="stable"):
            p = found[j]
            repeat = int(min(np.floor(fitted[j] + 0.5), *(sum(left.get(x, 0) for x in members[k]) // p.count(k) for k in set(p))))
            while repeat > 0 and all(sum(left.get(x, 0) for x in members[k]) >= p[:-1].count(k) for k in set(p[:-1])):
                # runs of exact lengths: the longest of each grid cell, then the longest that the rest has room for
                free, lengths, uses = capacity, [], {}
                for k in p[:-1]:
                    length = next(x for x in members[k] if left.get(x, 0) > uses.get(x, 0))
                    uses[length] = uses.get(length, 0) + 1
                    lengths.append(length)
                    free -= length
                i = bisect.bisect_right(stock, free) - 1
                while i >= 0 and left.get(stock[i], 0) <= uses.get(stock[i], 0):
                    i -= 1
                if i >= 0:
                    lengths.append(stock[i])
                    uses[stock[i]] = uses.get(stock[i], 0) + 1
                    free -= stock[i]
                count = min([repeat, *(left[x] // n for x, n in uses.items())])
                at = 0
                for length in lengths:
                    place(length, count, sequences, at)
                    at += length
                stock = [x for x in stock if x in left] if any(x not in left for x in lengths) else stock
                keep(sequences, count, free)
                sequences += count
                repeat -= count
    for length in sorted(left, reverse=True):
        while length in left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, count = bins[room].pop()
                used = min(count, left[length])
                if used < count:
                    bins[room].append((first + used, count - used))
                if not bins[room]:
                    del bins[room], rooms[i]
                place(length, used, first, capacity - room)
                keep(first, used, room - length)
            else:
                each = min(capacity // length, left[length])
                count = left[length] // each
                for k in range(each):
                    place(length, count, sequences, k * length)
                keep(sequences, count, capacity - each * length)
                sequences += count
    return runs, sequences


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    with small_batches(spark):
        pieces = written(token_pieces(docs, capacity, tokenizer).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS))), "pieces")
    counts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    counts = counts.withColumn("ahead", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan_packing(histogram, capacity)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    plan = spark.sparkContext.broadcast((table[:, 0] << 44 | table[:, 1], table[:, 1], table[:, 3], table[:, 4]))  # bounded by the distinct lengths
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.join(counts.drop("n"), ["length", "salt"]).withColumn("rank", F.col("ahead") + F.row_number().over(own) - 1)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rank, first, offset = plan.value
        for batch in batches:
            ranks = batch.column(5).to_numpy()
            at = np.searchsorted(keys, batch.column(3).to_numpy() << 44 | ranks, "right") - 1
            cols = [*batch.columns[:5], pa.array(first[at] + ranks - rank[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return placed.mapInArrow(locate, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
