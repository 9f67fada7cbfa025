"""An agenda in two steps over stored calendar rows.

Stored rows lie in parts by their key, sorted by it; beside them an index of days: for each stretch of BUCKET_DAYS the keys, and their parts, of rows that touch it. An agenda first reads the
buckets of its range, a day wider at both ends because an all-day row and a timed row of one event may lie on different sides of an edge, and so has the candidate keys. It then reads
whole groups, every source's rows of these keys, live and removed, from these keys' parts alone; merges them; and only then asks whether the merged event overlaps the range and is
visible. A row in the range may be outvoted by one that is not.

Rows need a key and times; a row without a start and without a start date is in no agenda. A long event stands in each bucket that it touches. Ranges that hold nothing give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import cut
from . import calendar as C

DAY = 86_400_000_000
BUCKET_DAYS = 8
PARTS = 64
#: Candidate keys that may be broadcast.
BROADCAST_ROWS = 400_000


def part_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


class DayIndex:
    """Stored rows of several sources and their index of days, below a folder."""

    def __init__(self, spark: SparkSession, path: str, key: str = "key"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def write(self, sources: dict[str, DataFrame]) -> None:
        """Store each source's rows (key, start, end, all_day, start_date, end_date and more)."""
        entries = None
        for name, rows in sources.items():
            parted = rows.withColumn("part", part_of(self.key))
            parted.repartition(PARTS, "part").sortWithinPartitions("part", self.key).write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/rows/{name}")
            whole = F.coalesce("all_day", F.lit(False)) & F.col("start_date").isNotNull()
            first = F.when(whole, F.col("start_date")).otherwise(F.floor(F.col("start") / DAY))
            last = F.when(whole, F.greatest(F.col("end_date") - 1, F.col("start_date"))).otherwise(F.floor((F.greatest(F.col("end") - 1, F.col("start"))) / DAY))
            span = parted.select(self.key, "part", F.floor(first / BUCKET_DAYS).alias("_a"), F.floor(F.coalesce(last, first) / BUCKET_DAYS).alias("_b")).where("_a IS NOT NULL")
            touched = span.select(F.explode(F.sequence(F.col("_a").cast("int"), F.greatest("_a", "_b").cast("int"))).alias("bucket"), "part", self.key)
            entries = touched if entries is None else entries.unionByName(touched)
        entries.distinct().repartition("bucket").sortWithinPartitions("bucket", self.key).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/days")

    def candidates(self, first: int, last: int) -> DataFrame:
        """key and part of the groups with a row near the days [first, last]: the scan reads the buckets of these days only."""
        days = self.spark.read.parquet(f"{self.path}/days")
        low, high = (first - 1) // BUCKET_DAYS, (last + 1) // BUCKET_DAYS
        return days.where(F.col("bucket").between(low, high)).select(self.key, "part").distinct()

    def groups(self, name: str, keys: DataFrame, parts: list[int]) -> DataFrame:
        """A source's rows of the keys, read from their parts."""
        rows = self.spark.read.parquet(f"{self.path}/rows/{name}").where(F.col("part").isin(parts)).drop("part")
        return rows.join(keys, self.key, "left_semi")

    def agenda(self, merge: Callable[..., DataFrame], names: list[str], since: int, until: int, shown: Column) -> DataFrame:
        """The merged events of [since, until) (microseconds, whole UTC days for all-day ones) that are not removed and `shown`, with day and position: their place in the order of their day."""
        first, last = since // DAY, (until - 1) // DAY
        keys = self.candidates(first, last)
        parts = sorted(r[0] for r in keys.select("part").distinct().collect())  # at most PARTS
        few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        keys = F.broadcast(keys.select(self.key)) if few else keys.select(self.key)
        events = cut(merge(*(self.groups(n, keys, parts) for n in names)), "agenda")  # few rows; the merge's expressions would be inlined into every test below
        found = events.where(~F.col("removed") & C.overlaps(F.lit(since), F.lit(until), F.lit(first), F.lit(last)) & shown)
        midnight = F.col("start_date") * DAY
        day = F.greatest(F.floor(F.when(F.coalesce("all_day", F.lit(False)), midnight).otherwise(F.col("start")) / DAY), F.lit(first))
        return found.withColumn("day", day).withColumn("position", F.row_number().over(C.Window.partitionBy("day").orderBy(*C.agenda_order(midnight))))
