"""The two-step agenda against merging everything."""

import time

from pyspark.sql import functions as F

from loamline.operators import agenda, calendar
from loamline.plans import diary


def whole(a, b, since, until):
    """All events of both calendars merged, then filtered."""
    rows = diary.merged(a, b)
    first, last = since // agenda.DAY, (until - 1) // agenda.DAY
    return {r["key"] for r in rows.where(~F.col("removed") & calendar.overlaps(F.lit(since), F.lit(until), F.lit(first), F.lit(last))).select("key").collect()}


def two_steps(index, since, until):
    named = lambda x, y: diary.merged(x, y).withColumn("principal", F.lit("p"))
    return index.agenda(named, ["a", "b"], since, until, F.lit(True))


def test_equals_merging_everything(spark, small, tmp_path):
    a, b = diary.sources(spark, small)
    index = agenda.DayIndex(spark, str(tmp_path / "index"))
    index.write({"a": a, "b": b})
    start = 788_918_400_000_000
    for since, until in ((start, start + agenda.DAY), (start + 3 * agenda.DAY, start + 40 * agenda.DAY), (0, agenda.DAY)):
        assert {r["key"] for r in two_steps(index, since, until).collect()} == whole(a, b, since, until)


def test_reads_only_its_buckets_and_parts(spark, tmp_path):
    """Two hundred weekly series of 250 occurrences in two calendars: 100,000 rows; a week's agenda reads the week."""
    k = F.col("id")
    start = (k % 250) * 7 * agenda.DAY + F.floor(k / 250) * 1_000_000
    none = lambda kind: F.lit(None).cast(kind)
    rows = spark.range(50_000).select(
        k.alias("key"), none("long").alias("last_modified"), F.lit(1).cast("long").alias("fresh_at"), none("long").alias("removed_at"), start.alias("start"), (start + 3_600_000_000).alias("end"), none("boolean").alias("all_day"), F.floor(start / agenda.DAY).alias("start_date"), (F.floor(start / agenda.DAY) + 1).alias("end_date"),
        none("boolean").alias("cancelled"), none("long").alias("detail_as_of"), F.concat(F.lit("s"), k.cast("string")).alias("subject"), none("boolean").alias("online"), F.lit("").alias("body"),
    )
    index = agenda.DayIndex(spark, str(tmp_path / "index"))
    index.write({"a": rows, "b": rows.withColumn("fresh_at", F.lit(2).cast("long"))})
    since = 100 * 7 * agenda.DAY
    plan = index.candidates(since // agenda.DAY, since // agenda.DAY + 6)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters" in plan
    files = index.candidates(since // agenda.DAY, since // agenda.DAY + 6)
    assert files.count() < 1_000  # of 50,000 keys
    began = time.monotonic()
    found = two_steps(index, since, since + 7 * agenda.DAY)
    assert {r["key"] % 250 for r in found.collect()} == {100} and found.count() == 200 and time.monotonic() - began < 60
    source = index.groups("a", index.candidates(700, 706).select("key"), [3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "part#" in source.split("PartitionFilters")[1] and "Cartesian" not in source
