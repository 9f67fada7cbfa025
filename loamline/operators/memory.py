"""Read memory: records whose bytes have not changed since the last sync are not mapped again.

A record (a chain of messages, a conversation, an item) is remembered as the digest of its bytes and its effects: the rows it made, each with the content
hash that the row held afterwards, and the sightings of people it named. It is skipped when its digest is the same and every one of its rows still has that hash; its effects are then replayed:
the rows count as seen and unchanged, the people are merged. A record is read in full when

* its bytes, or the mapper's signature, are new,
* a row of it was changed or lost since (by whomever),
* another record made one of its rows as well when it was last read (`contended`): what the row holds then depends on both, or
* another record of this read changes a row that it would vouch for. Such records are taken out of the skipped ones and the batch is folded again with
  them; where that does not settle in a few passes, everything is read.

A record that cannot be mapped is counted and never remembered, so it is tried again. With these rules an incremental sync leaves the same rows, changes, counts and
people as a full one. Nothing here gathers a record's or a row's partners: memory is three flat tables, and who owns a row is an aggregate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..sources import archive
from . import merge

#: heads, refs and people; row and hash are digests of 96 bits, since they are what memory mostly holds.
HEADS = "record string, digest string, contended boolean"
REFS = "record string, row string, hash string"
PEOPLE = "record string, id string, name string, at long"
#: Passes in which records are taken out of the skipped ones before everything is read.
PASSES = 3


@dataclass(frozen=True)
class Mapped:
    """What a mapper makes of records: rows (record, the row keys, version, tombstone, content, arrival), the records it could not map (record, code), and sightings of people (record, id, name, at)."""

    rows: DataFrame
    failed: DataFrame
    people: DataFrame


@dataclass(frozen=True)
class Memory:
    """heads: one row a record; refs: the rows that it alone made, with their hashes; people: its sightings.

    Only records with a head that isn't contended are ever skipped, so what refs and people say of others is never read.
    """

    heads: DataFrame
    refs: DataFrame
    people: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Memory:
        return Memory(spark.createDataFrame([], HEADS), spark.createDataFrame([], REFS), spark.createDataFrame([], PEOPLE))

    @staticmethod
    def load(spark: SparkSession, root: str, source: str) -> Memory:
        """What a source's last sync remembered; nothing where there was none."""
        if not archive.versions(spark, root, f"_memory/{source}/heads"):
            return Memory.empty(spark)
        heads = archive.current(spark, root, f"_memory/{source}/heads")
        of = heads.select("refs_version", "people_version").first()
        if of is None:
            return Memory.empty(spark)
        return Memory(heads.select("record", "digest", "contended"), *(archive.current(spark, root, f"_memory/{source}/{part}", version) for part, version in (("refs", of[0]), ("people", of[1]))))

    def save(self, root: str, source: str) -> None:
        """Publish, after the rows: memory that vouches for rows which are not there yet would only cost a full read. The heads come last and name the versions of the other two."""
        refs, people = (archive.publish(getattr(self, part), root, f"_memory/{source}/{part}") for part in ("refs", "people"))
        archive.publish(self.heads.withColumns({"refs_version": F.lit(refs), "people_version": F.lit(people)}), root, f"_memory/{source}/heads")


@dataclass(frozen=True)
class Sync:
    """What a sync found. The rows are written; counts, people and memory are plans, and save() writes the memory.

    rows: all stored and new rows with `change`; people: merged sightings; counts: change and n; memory: what to remember; skipped, read: numbers of records; failed: record and code.
    """

    rows: DataFrame
    people: DataFrame
    counts: DataFrame
    memory: Memory
    skipped: DataFrame
    failed: DataFrame


@dataclass(frozen=True)
class Source:
    """How a source's records become rows. signature names the decoder, mapper and scrub rules: another one makes every digest new."""

    mapper: Callable[[DataFrame], Mapped]
    keys: list[str]
    version: str
    deleted: str
    content: list[str]
    arrival: str
    signature: str = "1"

    def row(self) -> Column:
        return _short(content_hash(*(F.col(k) for k in self.keys)))

    def hash(self) -> Column:
        """Of a stored row: it covers the keys and all that an upsert looks at."""
        return _short(content_hash(*(F.col(c) for c in (*self.keys, self.version, self.deleted, *self.content))))


def _short(digest: Column) -> Column:
    """96 bits of a digest as 16 letters."""
    return F.base64(F.unhex(F.substring(digest, 1, 24)))


def unchanged(records: DataFrame, memory: Memory, stored: DataFrame, source: Source) -> DataFrame:
    """record of those that may be skipped: known bytes, no contended row, and every row as the record left it."""
    same = records.join(memory.heads.where(~F.col("contended")).select("record", "digest"), ["record", "digest"], "left_semi").select("record")
    moved = memory.refs.select("record", "hash").join(stored.select(source.hash().alias("hash")), "hash", "left_anti").select("record").distinct()
    return same.join(moved, "record", "left_anti")


def remembered(made: DataFrame, vouched: DataFrame | None, merged: DataFrame, read: DataFrame, people: DataFrame, source: Source) -> Memory:
    """The memory of records read in full. made: record and keys of the rows that these made; vouched: (record, row) of the rows of skipped ones, None where none was; merged: rows with the
    least and greatest record that made each (`_low`, `_high`), so a row that a third of all records make is no group anywhere; read: record and digest of the cleanly mapped.
    """
    rows = merged.where("_low IS NOT NULL").select(*source.keys, source.row().alias("row"), F.col("_low").alias("record"), (F.col("_low") != F.col("_high")).alias("shared"), source.hash().alias("hash"))
    if vouched is not None:
        rows = rows.join(vouched.select("row").distinct().withColumn("_other", F.lit(True)), "row", "left").withColumn("shared", F.col("shared") | F.col("_other").isNotNull())
    key = F.xxhash64(source.row()).alias("key")  # two rows with one key make a record contended that is not: it is read, no more
    contended = made.select("record", key).join(rows.where("shared").select(key), "key", "left_semi").select("record").distinct().withColumn("_contended", F.lit(True))
    heads = read.join(contended, "record", "left").select("record", "digest", F.col("_contended").isNotNull().alias("contended"))
    return Memory(heads, rows.where("NOT shared").select("record", "row", "hash"), people.select("record", "id", "name", "at"))


def sync(records: DataFrame, memory: Memory, stored: DataFrame, source: Source, cut: Callable[[DataFrame, str], DataFrame], full: bool = False, complete: bool = True) -> Sync:
    """One sync of a source. records: (record, body), one row each, in which a null body is a record that cannot be read; stored: rows with the source's keys, version, tombstone and content.

    cut(df, name) writes an intermediate table and reads it again. full reads everything but remembers all the same. A read that is not complete forgets no record it didn't meet; a complete one does, but the rows stay.
    """
    shape = [*source.keys, source.version, source.deleted, *source.content]
    digest = _short(F.sha2(F.concat_ws("\0", F.lit(source.signature), F.coalesce("body", F.lit(""))), 256))
    now = cut(records.select("record", digest.alias("digest"), "body"), "records")
    heads = now.select("record", "digest")
    none = memory.heads.isEmpty()
    skipped = cut(heads.select("record").limit(0) if full or none else unchanged(heads, memory, stored, source), "skipped")
    for left in range(PASSES, -1, -1):
        some = not skipped.isEmpty()  # nothing meets an empty table
        fresh = now.join(skipped, "record", "left_anti") if some else now
        mapped = source.mapper(fresh.select("record", "body"))
        rows = cut(mapped.rows, "mapped")
        folded = merge.fold_statements(rows, source.keys, source.version, source.arrival, source.deleted, source.content, {"_low": F.min("record"), "_high": F.max("record")})
        merged = cut(merge.upsert(stored.select(*shape), folded, source.keys, source.version, source.deleted, source.content, ["_low", "_high"]), "merged")
        vouched = memory.refs.select("record", "row").join(skipped, "record", "left_semi") if some else None
        if vouched is None:
            replayed = 0
            break
        changed = F.col("change").isin("new", "edited", "deleted").alias("_changed")
        met = vouched.join(merged.where("change <> 'kept'").select(source.row().alias("row"), changed), "row", "left")  # every row of this read is there
        replayed, clashes = met.agg(F.count_if(F.col("_changed").isNull()), F.count_if("_changed")).first()
        if not clashes:
            break
        clash = met.where("_changed").select("record").distinct()
        skipped = cut(skipped.join(clash, "record", "left_anti") if left > 1 else skipped.limit(0), "skipped")
    failed = mapped.failed.select("record", "code")
    people = mapped.people.select("record", "id", "name", "at")
    clean = fresh.select("record", "digest").join(failed, "record", "left_anti")
    new = remembered(rows.select("record", *source.keys), vouched, merged, clean, people, source)
    kept = memory.heads.join(clean, "record", "left_anti").join(failed, "record", "left_anti")
    kept = kept.join(heads.select("record"), "record", "left_semi") if complete else kept
    kept = kept.select("record", "digest", "contended")
    old = [d.join(kept.select("record"), "record", "left_semi") for d in (memory.refs, memory.people)]
    after = new if none else Memory(kept.unionByName(new.heads), old[0].unionByName(new.refs), old[1].unionByName(new.people))
    counts = merged.where("change <> 'kept'").groupBy("change").agg(F.count("*").alias("n"))
    if replayed:
        seen = now.sparkSession.range(1).select(F.lit("unchanged").alias("change"), F.lit(replayed).cast("long").alias("n"))
        counts = counts.unionByName(seen).groupBy("change").agg(F.sum("n").alias("n"))
    sightings = people.unionByName(memory.people.join(skipped, "record", "left_semi").select(people.columns)) if some else people
    return Sync(merged.drop("_low", "_high"), merge.people(sightings, ["id"], "at", "name"), counts, after, skipped, failed)
