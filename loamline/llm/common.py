"""Shared pieces of the corpus operators: written intermediate tables, skew-safe joins, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in HOT_PARTS of all rows, so there are at most HOT_PARTS hot keys.
HOT_PARTS = 1024
#: Rows of an id list or rule table that may be broadcast; longer ones are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder will do in local mode (tests); on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/loamline-shared"
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loamline-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it again, so a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._loamline_path = path
    return back


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder wherever it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    path = getattr(df, "_loamline_path", None)
    if path:
        delete(df.sparkSession, path)


def join_skewed(left: DataFrame, right: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """left JOIN right on key, where right has one row a key and in column n that key's number of left rows.

    Keys with more than 1/HOT_PARTS of all rows are joined by a broadcast, which cannot hold more than HOT_PARTS rows;
    the others meet in a shuffle where none is large. right should be a written table: it is read three times.
    Null keys match nothing. The columns of right other than key are added; n is dropped.
    """
    total, most = right.agg(F.sum(n), F.max(n)).first()
    limit = max(64, (total or 0) // HOT_PARTS)
    if (most or 0) <= limit:  # no key is hot
        return left.join(right.drop(n), key, how)
    hot = right.where(F.col(n) > limit).drop(n)
    cold = right.where(F.col(n) <= limit).drop(n)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return rest.unionByName(left.join(F.broadcast(hot), key))


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """A name for each wanted one that no column has, whatever its case, so that a caller's columns are never replaced."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; it reads no more than it needs to know that."""
    return df.limit(rows + 1).count() <= rows


def matching(df: DataFrame, ids: DataFrame, on: list[str], keep: bool = True) -> DataFrame:
    """The rows of df whose `on` columns are (keep) or are not in ids: broadcast where ids has few rows, else shuffled."""
    right = F.broadcast(ids) if small_enough(ids) else ids
    if not keep:
        return df.join(right, on, "left_anti").select(df.columns)
    return df.join(right, on, "left_semi").select(df.columns)


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `limit` bytes in one string column, so work arrays stay small."""
    lengths = batch.column(column).fill_null("").cast(pa.large_string())
    sizes = pc.binary_length(lengths).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def give_back() -> None:
    """Give freed memory back to the system: a Python worker outlives its task, and an executor's workers share its memory with the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc keeps it otherwise
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """What runs inside gets its Arrow batches in at most so many bytes, for a task and its Python worker each hold one whole. A limit that the session sets stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key)


def map_slices(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = 1 << 20) -> DataFrame:
    """mapInArrow with fn on byte-bounded slices."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, limit):
                yield fn(part)
            pa.default_memory_pool().release_unused()
        give_back()

    return df.mapInArrow(run, schema)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, many small runs in one table, from batches sorted by those keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(batch.schema.get_field_index(k))[batch.num_rows - 1].as_py() for k in keys]
        cut = batch.num_rows
        lists = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        while cut and all(c[cut - 1].as_py() == v for c, v in zip(lists, last, strict=True)):
            cut -= 1
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            first = [held[0].column(held[0].schema.get_field_index(k))[0].as_py() for k in keys] if held else last
            if first != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def unit_hash(*cols: Column | str) -> Column:
    """A uniform number in (0, 1) that depends only on the columns' values."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
