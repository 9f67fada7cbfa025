"""Watching a landing folder: batches of statements become upserts and a change feed.

State lives in published table versions and the query's checkpoint, so a restart goes on where it stopped. There is no
watermark: a statement counts by its version, however late it comes.

A batch first writes its changes as a feed table under its own number, then commits the parts of the table that it touches together with that number, then hands
the feed over. A batch that is repeated after a failure finds its number committed and reads the changes from its feed, so none is lost; where it was not committed, both are made anew.
"""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..operators.index import SearchIndex
from ..sources import archive


def _shared(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/loamline-checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def index_key(keys: list[str]) -> Column:
    """How the search index names a row: its keys, joined by a separator."""
    return F.concat_ws("\x1f", *keys)


def watch(
    source: DataFrame,
    root: str,
    name: str,
    keys: list[str],
    version: str,
    deleted: str,
    content: list[str],
    emit: Callable[[DataFrame, int], None],
    checkpoint: str,
    arrival: str,
    emit_initial: bool = False,
    trigger: str | None = None,
    index: SearchIndex | None = None,
    index_columns: tuple[str, ...] = (),
):
    """Start the query that merges each batch into the published table `name` and hands its changes to `emit`.

    The first batch is a silent baseline unless emit_initial. `emit` gets each batch's changes and its number; a batch whose emit failed is handed
    over again, under the same number and with the same changes. Other writers may change the table meanwhile: a batch is merged again with the parts they
    touched. A search index is kept along, by index_key() of the keys and over the named columns. Without a trigger the query ends when the source is read up.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        feed = f"{root}/_feeds/{name}/batch={number}"
        folded = merge.fold_statements(batch, keys, version, arrival, deleted, content).persist()
        parts = [r[0] for r in folded.select(archive.part_of(keys)).distinct().collect()]  # at most PARTS
        shape = merge.change_feed(merge.upsert(folded.limit(0), folded, keys, version, deleted, content)).schema

        def merged(stored: DataFrame | None) -> DataFrame | None:
            """The parts' rows after this batch; what changes goes to the feed before they are committed."""
            rows = merge.upsert(folded.limit(0) if stored is None else stored, folded, keys, version, deleted, content).persist()
            changes = merge.change_feed(rows)
            (changes if stored is not None or emit_initial else changes.limit(0)).write.mode("overwrite").parquet(feed)
            if index is not None:  # taken in before the rows are committed: a batch that is repeated writes the same generation again
                text = [F.when(F.col(deleted).isNull(), F.col(c)).alias(c) for c in index_columns]
                index.add(changes.select(index_key(keys).alias("key"), *text), "key", list(index_columns), number)
            return rows.drop("change") if not changes.isEmpty() else None

        if number > (-1 if (last := archive.done(spark, root, name, checkpoint)) is None else last):  # else committed before a failure: only the feed is handed over again
            archive.update(spark, root, name, keys, parts, merged, (checkpoint, number))
        folded.unpersist()
        told = spark.read.schema(shape).parquet(feed)
        if not told.isEmpty():
            emit(told, number)

    writer = source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def landing(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A streaming read of a landing folder, at most `files` new files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def since(changes: DataFrame, cursor: int, order: str) -> tuple[DataFrame, int]:
    """The changes after a cursor, and the next cursor."""
    new = changes.where(F.col(order) > cursor)
    return new, new.agg(F.max(order)).first()[0] or cursor


def wait_since(read: Callable[[], DataFrame], cursor: int, order: str, timeout: float, pause: float = 0.2) -> tuple[DataFrame, int, bool]:
    """The changes after a cursor as soon as there are any, the next cursor, and whether the time ran out before. `read` gives the feed as it stands."""
    until = time.monotonic() + timeout
    while True:
        new, after = since(read(), cursor, order)
        if after != cursor:
            return new, after, False
        if time.monotonic() >= until:
            return new, cursor, True
        time.sleep(min(pause, max(0.0, until - time.monotonic())))


def json_lines(path: str) -> Callable[[DataFrame, int], None]:
    """A sink of change feeds: a folder of JSON Lines for each batch, which a repeated batch overwrites with the same lines."""

    def emit(changes: DataFrame, number: int) -> None:
        changes.select(F.to_json(F.struct(*changes.columns)).alias("value")).write.mode("overwrite").text(f"{path}/batch={number}")

    return emit


def joined_back(changes: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Changes with the full item that each is about; a deleted one shows the item as last stored."""
    return changes.select(*keys, "change").join(items, keys, "left")


def changed_sources(prints: DataFrame, seen: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Sources whose fingerprint isn't the one of their last run: the others need no read."""
    return prints.join(seen.select(key, fingerprint), [key, fingerprint], "left_anti")


def each_source(sources: dict[str, Callable[[], None]]) -> dict[str, str]:
    """Run each source's sync; one that fails doesn't keep the others from being committed. The failed ones, with their error, are to be tried again."""
    failed = {}
    for name, run in sources.items():
        try:
            run()
        except Exception as e:  # a source's own failure, whatever it is
            failed[name] = str(e).splitlines()[0] if str(e) else type(e).__name__
    return failed


def _to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all there is and return what its last batch left, written as Parquet by the executors and read again."""
    spark, path = stream.sparkSession, _shared(stream.sparkSession, "result")
    spark.createDataFrame([], stream.schema).write.parquet(path)
    sink = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    sink.option("checkpointLocation", _shared(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _file_stream(spark: SparkSession, path: str) -> DataFrame:
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else landing(spark, path, spark.read.parquet(path).schema)


def newest_versions(spark: SparkSession, path: str) -> DataFrame:
    """The newest version's last body of each (user_id, event_type), kept by the stream's own state."""
    k = F.get_json_object("props", "$.k").cast("long") % 5
    s = _file_stream(spark, path).select("user_id", "event_type", F.struct(k.alias("version"), F.col("event_id").alias("arrival"), F.round("value", 3).alias("body")).alias("s"))
    return _to_end(s.groupBy("user_id", "event_type").agg(F.max("s").alias("s")), "complete").select("user_id", "event_type", "s.version", "s.body")


def counted(spark: SparkSession, path: str) -> DataFrame:
    return _to_end(_file_stream(spark, path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")), "complete")
