"""A kept search index: positional postings, sorted by token, that upserts append to.

A posting says which row holds a token, how often and where. The postings of a token from a few megabytes of text are one block: (token, field, ids, counts, places). Each batch is a generation of its own, its blocks dealt
out by ranges of the token (and, within a token, of a hash, so a token of nearly every row is many ranges) and sorted by it. Parquet's statistics are therefore the dictionary: a search for a word or
for all words with a prefix reads the files, row groups and pages of that stretch alone, and positions only where there is a phrase.

A batch replaces the postings of the rows it brings. A hit counts unless a later generation has its row; that is asked of the hits alone, and only of the generations after the
oldest. compact() rewrites what counts as one generation, after which older ones are no longer looked at.

Rows need a key that is not null. A row whose texts are all null has no postings any more. The same generation written twice is one batch. Very long texts are one row of work; empty
batches leave an empty generation. A search finds what operators.search.search() finds on the newest rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Term, parse_query, token_line
from ..sources import archive
from ..sources.scratch import cut

_BLOCKS = "token string, field int, ids array<string>, counts array<int>, places array<array<int>>"
#: Rows of a list that may be broadcast.
BROADCAST_ROWS = 400_000
#: Rows of a token in one block after a compaction.
BLOCK_ROWS = 50_000
#: Bytes of text whose words are sorted at once.
SLICE_BYTES = 1 << 22


def _broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _grouped(ids: pa.Array, lines: pa.Array, field: int) -> pa.RecordBatch:
    """The blocks of one field: words sorted by word and row, so each word's rows, and each row's places of a word, stand together."""
    lists = pc.split_pattern(pc.utf8_trim(lines, " "), " ")
    words, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    place = np.arange(len(words)) - (lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py())[row] if len(words) else np.zeros(0, int)
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy()
    kept = np.flatnonzero(pc.not_equal(words, "").to_numpy(zero_copy_only=False))
    order = kept[np.lexsort((row[kept], code[kept]))]
    new_word = np.append(True, np.diff(code[order]) != 0)[: len(order)]
    posting = np.flatnonzero(new_word | np.append(True, np.diff(row[order]) != 0)[: len(order)])
    block = np.flatnonzero(new_word[posting])
    ends, bounds = (pa.array(np.append(x, n).astype(np.int32)) for x, n in ((posting, len(order)), (block, len(posting))))
    places = pa.ListArray.from_arrays(ends, pa.array(place[order].astype(np.int32)))
    lists = [pa.ListArray.from_arrays(bounds, x) for x in (ids.take(pa.array(row[order[posting]])), pa.array(np.diff(ends.to_numpy())), places)]
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[order[posting[block]]])), pa.array(np.full(len(block), field, np.int32)), *lists], ["token", "field", "ids", "counts", "places"])


def blocks_of(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The blocks of rows, made without a shuffle: tokens are grouped where the texts are."""
    lines = rows.select(F.col(key).cast("string").alias("id"), *(token_line(c).alias(f"_{i}") for i, c in enumerate(columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, SLICE_BYTES // (1 + batch.nbytes // max(1, batch.num_rows)))
            for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
                for field in range(part.num_columns - 1):
                    yield _grouped(part.column(0), part.column(field + 1), field)

    return lines.where("id IS NOT NULL").mapInArrow(run, _BLOCKS)


def _holds(word: str, prefix: bool) -> Column:
    return F.col("token").startswith(word) if prefix else F.col("token") == word


def _shifted(by: int) -> Column:
    return F.transform("positions", lambda p: p - by)


def _words(terms: list[Term]) -> list[tuple[str, bool]]:
    """Every word of the terms, and whether it stands for all words that begin so."""
    return sorted({(w, t.kind == "prefix" and i == len(t.words) - 1) for t in terms for i, w in enumerate(t.words)})


class SearchIndex:
    """Postings and ids below a folder. Generations are numbered by the caller in order of batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _generations(self) -> list[int]:
        """Those that count, oldest first: finished ones from the last compaction on."""
        where, fs = archive.path_of(self.spark, f"{self.path}/ids")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        done = sorted(int(n.split("=")[1]) for n in names if n.startswith("generation=") and archive.finished(self.spark, f"{self.path}/ids/{n}"))
        base = [g for g in done if fs.exists(archive.path_of(self.spark, f"{self.path}/bases/{g}")[0])]
        return [g for g in done if not base or g >= base[-1]]

    def _write(self, postings: DataFrame, ids: DataFrame, generation: int) -> None:
        salt = F.xxhash64("ids")
        ranged = postings.repartitionByRange("token", salt).sortWithinPartitions("token", salt)
        ranged.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/postings/generation={generation}")
        ids.write.mode("overwrite").parquet(f"{self.path}/ids/generation={generation}")  # last: its success mark makes the postings count

    def add(self, rows: DataFrame, key: str, columns: str | list[str], generation: int) -> None:
        """Take in new and changed rows, and rows that are gone, as rows with null texts."""
        columns = [columns] if isinstance(columns, str) else columns
        self._write(cut(blocks_of(rows, key, columns), "postings"), rows.select(F.col(key).cast("string").alias("id")).where("id IS NOT NULL").distinct(), generation)

    def _read(self, kind: str, schema: str, generations: list[int]) -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, generation int").parquet(f"{self.path}/{kind}")
        return rows.where(F.col("generation").isin(generations))

    def _postings(self, generations: list[int], wanted: Column, places: bool = True) -> DataFrame:
        """token, generation, field, id, n and, if asked for, positions."""
        blocks = self._read("postings", _BLOCKS, generations).where(wanted)
        each = F.explode(F.arrays_zip("ids", "counts", *(["places"] if places else []))).alias("p")
        kept = [F.col("p.ids").alias("id"), F.col("p.counts").alias("n"), *([F.col("p.places").alias("positions")] if places else [])]
        return blocks.select("token", "generation", "field", each).select("token", "generation", "field", *kept)

    def _live(self, hits: DataFrame, generations: list[int]) -> DataFrame:
        """Without hits whose row a later generation has; only the hits' ids and the generations after the oldest are looked at."""
        if len(generations) < 2:
            return hits
        newer = self._read("ids", "id string", generations[1:]).select(F.col("id").alias("_id"), F.col("generation").alias("_later"))
        return hits.join(_broadcast(newer), (F.col("id") == F.col("_id")) & (F.col("_later") > F.col("generation")), "left_anti")

    def postings(self, words: list[str] | None = None) -> DataFrame:
        """token, id, field, n and positions that count, of some tokens or of all."""
        generations = self._generations()
        rows = self._postings(generations, F.lit(True) if words is None else F.col("token").isin(words))
        return self._live(rows, generations).select("token", "id", "field", "n", "positions")

    def search(self, text: str) -> DataFrame:
        """id and hits of the rows of which one field holds every term of the text: words, "phrases" and prefixes*. hits counts the terms' occurrences in such fields."""
        terms = parse_query(text)
        if not terms:
            raise ValueError("a search needs a word")
        generations, words = self._generations(), _words(terms)
        if not generations:
            return self.spark.createDataFrame([], "id string, hits long")
        own = ["id", "generation", "field"]
        rows = self._postings(generations, reduce(lambda a, b: a | b, [_holds(*w) for w in words]), any(len(t.words) > 1 for t in terms))
        if len(words) > 1:  # the rows of the rarest word first: the others' postings need not be shuffled but for these
            sizes = rows.agg(*(F.count(F.when(_holds(*w), 1)).alias(f"_{i}") for i, w in enumerate(words))).first()
            rarest = min(range(len(words)), key=lambda i: sizes[i])
            if sizes[rarest] <= BROADCAST_ROWS < sum(sizes):
                rows = rows.join(F.broadcast(rows.where(_holds(*words[rarest])).select(*own).distinct()), own, "left_semi")
        counts, needs = [], []
        for t, term in enumerate(terms):
            last = len(term.words) - 1
            if not last:
                counts.append(F.sum(F.when(_holds(term.words[0], term.kind == "prefix"), F.col("n"))).alias(f"_t{t}"))
                needs.append(F.col(f"_t{t}"))
                continue
            held = [F.flatten(F.collect_list(F.when(_holds(w, term.kind == "prefix" and i == last), _shifted(i)))) for i, w in enumerate(term.words)]  # one text's places
            counts += [h.alias(f"_t{t}_{i}") for i, h in enumerate(held)]
            needs.append(F.size(reduce(F.array_intersect, [F.col(f"_t{t}_{i}") for i in range(last + 1)])))
        found = rows.groupBy(*own).agg(*counts).select(*own, *(F.coalesce(n, F.lit(0)).cast("long").alias(f"_n{i}") for i, n in enumerate(needs)))
        found = found.where(reduce(lambda a, b: a & b, [F.col(f"_n{i}") > 0 for i in range(len(needs))]))
        found = found.select(*own, reduce(lambda a, b: a + b, [F.col(f"_n{i}") for i in range(len(needs))]).alias("hits"))
        return self._live(found, generations).groupBy("id").agg(F.sum("hits").alias("hits"))

    def compact(self, generation: int) -> None:
        """Rewrite all that counts as one new generation; older ones may then be deleted."""
        generations = self._generations()
        ids = cut(self._read("ids", "id string", generations).select("id").distinct(), "ids")
        parts = 1 + ids.count() // BLOCK_ROWS  # so a block holds about that many rows, however frequent its token
        live = self.postings().select("token", "id", "field", "n", "positions")
        blocks = live.groupBy("token", "field", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("_part")).agg(F.collect_list("id").alias("ids"), F.collect_list("n").alias("counts"), F.collect_list("positions").alias("places"))
        self._write(cut(blocks.drop("_part"), "postings"), ids, generation)
        where, fs = archive.path_of(self.spark, f"{self.path}/bases/{generation}")
        fs.create(where, True).close()
