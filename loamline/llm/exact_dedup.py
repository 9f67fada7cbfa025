"""Exact dedup by a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of a text, one row a digest, with the batch that brought it. A new
batch is first reduced to one row a digest (the one with the largest doc_id), then anti-joined with the index by a
sort-merge join that reads the index's buckets without a shuffle, and what is new is appended. A second table, bucketed alike, takes how
often a batch repeats what the index has, so group sizes count all batches. A kept text of an earlier batch wins over later copies. A
batch that is added again under its own name, as after a failure, gets the same answer and counts once.

Null texts count as empty, and empty texts are equal to each other; very long texts are read whole. Null doc_ids are smaller than all others. Of
rows that repeat both doc_id and text exactly one is kept. Extra columns are ignored, and kept by drop_exact_copies whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, free_names, join_skewed, matching, shared_path, written

DIGEST = "text_digest"


def digest_of(text_col: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, text_digest) of every row, written once: the text is read and hashed a single time."""
    return written(docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_key"), digest_of(text_col).alias(DIGEST)), "digests")


class DigestIndex:
    """Bucketed tables of digests (text_digest, batch, keep_id, n) and of their later repeats (text_digest, batch, n); `path` makes them persist across sessions.

    One program at a time adds to an index.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.path = path or shared_path(spark, "digest-index")
        name = uuid.uuid4().hex
        self.table, self.repeats = f"digest_index_{name}", f"digest_repeats_{name}"
        for table, columns in ((self.table, "batch STRING, keep_id BIGINT, n BIGINT"), (self.repeats, "batch STRING, n BIGINT")):
            spark.sql(
                f"CREATE TABLE {table} ({DIGEST} BINARY, {columns}) USING parquet "
                f"CLUSTERED BY ({DIGEST}) SORTED BY ({DIGEST}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{'digests' if table == self.table else 'repeats'}'"
            )

    def rows(self) -> DataFrame:
        """text_digest, batch, keep_id and group_size (over all batches) of every known text."""
        again = self.spark.table(self.repeats).groupBy(DIGEST).agg(F.sum("n").alias("again"))
        size = (F.col("n") + F.coalesce("again", F.lit(0))).alias("group_size")
        return self.spark.table(self.table).join(again.hint("merge"), DIGEST, "left").select(DIGEST, "batch", "keep_id", size)

    def _append(self, rows: DataFrame, table: str) -> None:
        rows.repartition(self.buckets, DIGEST).write.format("parquet").bucketBy(self.buckets, DIGEST).sortBy(DIGEST).mode("append").saveAsTable(table)

    def add(self, best: DataFrame, batch: str) -> None:
        """Take in one batch: (text_digest, keep_id, n) rows, one a digest. Digests that the index doesn't have are appended, repeats of others counted."""
        known, named = self.spark.table(self.table), F.lit(batch).alias("batch")
        first = known.limit(1).count() == 0
        fresh = best.join(known.select(DIGEST).hint("merge"), DIGEST, "left_anti")
        self._append(fresh.select(DIGEST, named, "keep_id", "n"), self.table)
        if first:
            return
        told = self.spark.table(self.repeats).where(F.col("batch") == batch).select(DIGEST)
        older = best.join(self.spark.table(self.table).where(F.col("batch") != batch).select(DIGEST).hint("merge"), DIGEST, "left_semi")
        self._append(older.join(told.hint("merge"), DIGEST, "left_anti").select(DIGEST, named, "n"), self.repeats)

    def close(self) -> None:
        """Forget the tables' names; their files stay at `path`."""
        for table in (self.table, self.repeats):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def _resolved(docs: DataFrame, index: DigestIndex | None, batch: str | None) -> tuple[DataFrame, DataFrame]:
    """The batch's fingerprints, and per digest keep_id, group_size, n (its rows in this batch) and row_key of the row that stays (null where an earlier batch has it), both written."""
    own, batch = index is None, batch or uuid.uuid4().hex
    index = index or DigestIndex(docs.sparkSession)
    prints = fingerprints(docs)
    best = prints.groupBy(DIGEST).agg(F.max(F.struct("doc_id", "row_key")).alias("best"), F.count("*").alias("n"))
    best = written(best.select(DIGEST, F.col("best.doc_id").alias("keep_id"), F.col("best.row_key").alias("keep_row"), "n"), "batch-digests")
    index.add(best.drop("keep_row"), batch)
    stays = F.when(F.col("batch") == batch, F.col("keep_row")).alias("keep_row")
    found = written(best.select(DIGEST, "keep_row", "n").join(index.rows().hint("merge"), DIGEST).select(DIGEST, "keep_id", stays, "group_size", "n"), "resolved")
    if own:  # nobody adds to it later
        index.close()
        delete(docs.sparkSession, index.path)
    return prints, found


def exact_groups(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256; the batch is added to the index on the way."""
    prints, found = _resolved(docs, index, batch)
    out = join_skewed(prints, found, DIGEST, "n")
    kept = F.coalesce(F.col("row_key") == F.col("keep_row"), F.lit(False))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex(DIGEST)).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another kept row has; all columns stay."""
    prints, found = _resolved(docs, None, None)
    repeats = prints.groupBy("doc_id", DIGEST).count().where("count > 1").limit(1).count() > 0
    copied = written(found.where("n > 1").select(DIGEST, "keep_id", "n"), "copied")
    losing = join_skewed(prints, copied, DIGEST, "n").where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    names = free_names(docs.columns, "id", "no_id", "digest")
    losing = written(losing.select(F.coalesce("doc_id", F.lit(0)).alias(names[0]), F.col("doc_id").isNull().alias(names[1]), F.col(DIGEST).alias(names[2])), "losing")
    marked = docs.withColumns(dict(zip(names, (F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), digest_of()), strict=True)))
    left = matching(marked, losing, names, keep=False)
    if repeats:
        left = left.dropDuplicates(names)
    return left.select(docs.columns)
