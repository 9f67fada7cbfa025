"""Calendar batches: which stored event a copy belongs to, what it says, and what a read that didn't see an event means.

The state is three tables. rows: one row a source, account and event key, in which every unit (subject, times, ...) has its own clock. matches: the key of every
source id ever seen; it never changes, save by an upgrade. reads: for each day the latest read that covered it, and the parts of days at a read's
edges. A row's removal is not stored but follows from these: it is removed if a read after its last sighting covered its start, or the
source said so later than it saw it. So sightings, silence and lists of gone ids may arrive in any order; only times count.

Key of a copy: its match; else by global id where it has one, else by a composite hash of subject and times. Copies of two sources with one composite hash, one with a global id and one without, are
one event if each side has exactly one with that hash (this batch and stored live rows counted); the row under the composite key then moves to the global one. Twins of a side without
global ids get keys of their own. The rule is symmetric, so it doesn't matter which source comes first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000_000
UNITS = ("subject", "location", "times", "cancelled")
_TIMES = "struct<start:long,end:long,all_day:boolean,start_date:long,end_date:long>"
_KINDS = {"subject": "string", "location": "string", "times": _TIMES, "cancelled": "boolean"}
_WHO = ["source", "account_id"]
ROWS = "source string, account_id string, event_key string, source_id string, global_id string, composite string, event_type string, " + ", ".join(f"{u} {k}, {u}_clock long" for u, k in _KINDS.items()) + ", seen_at long, gone_at long"
MATCHES = "source string, account_id string, source_id string, event_key string, method string"
READS = "source string, account_id string, day long, since long, until long, at long"


@dataclass(frozen=True)
class State:
    rows: DataFrame
    matches: DataFrame
    reads: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> State:
        return State(*(spark.createDataFrame([], s) for s in (ROWS, MATCHES, READS)))


@dataclass(frozen=True)
class Batch:
    """events: source, account_id, source_id, global_id, event_type, subject, location, start, end, all_day, start_date, end_date, cancelled, clock (of what it says), at (of the read).
    windows: source, account_id, since, until, at of reads that saw all there is in a range. gone: source, account_id, source_id, at of ids that a source knows to be gone."""

    events: DataFrame
    windows: DataFrame
    gone: DataFrame


def valid() -> Column:
    """Whether an event can be stored: it has a source id and times in order."""
    return F.coalesce((F.col("source_id") != "") & (F.col("end") >= F.col("start")), F.lit(False))


def _keyed(events: DataFrame) -> DataFrame:
    """events with `composite`, and `own_key`, the key that a copy would get by itself."""
    composite = F.substring(F.sha2(F.concat_ws("\0", F.lower(F.trim(F.coalesce("subject", F.lit("")))), F.col("start").cast("string"), F.col("end").cast("string")), 256), 1, 24)
    when = F.when(F.coalesce("all_day", F.lit(False)), F.concat(F.lit("d"), F.col("start_date").cast("string"))).otherwise(F.col("start").cast("string"))
    return events.withColumn("composite", composite).withColumn("global_id", F.coalesce("global_id", F.lit(""))).withColumn("own_key", F.when(F.col("global_id") != "", F.concat("global_id", F.lit("|"), when)).otherwise(F.col("composite")))


def covered_days(windows: DataFrame) -> DataFrame:
    """The reads of windows by days: a whole day, or the part of it at an edge."""
    some = windows.where("until > since")
    day = F.explode(F.sequence(F.expr(f"since div {DAY}"), F.expr(f"(until - 1) div {DAY}"))).alias("day")  # as many as the window has days
    parts = some.select(*_WHO, "since", "until", "at", day)
    return parts.select(*_WHO, "day", F.greatest("since", F.col("day") * DAY).alias("since"), F.least("until", (F.col("day") + 1) * DAY).alias("until"), "at")


def compacted_reads(reads: DataFrame) -> DataFrame:
    """Of the reads of one stretch of a day the latest; older whole days say no more than the latest one."""
    return reads.groupBy(*_WHO, "day", "since", "until").agg(F.max("at").alias("at"))


def with_removed(rows: DataFrame, reads: DataFrame) -> DataFrame:
    """rows with removed_at: the first time after the last sighting at which a read covered the start without seeing the event, or the source called it gone; null while it is live. Series masters are only removed by name."""
    start = F.col("times.start")
    place = F.when(F.coalesce("times.all_day", F.lit(False)), F.col("times.start_date") * DAY).otherwise(start)
    held = rows.withColumn("_start", place).withColumn("day", F.expr(f"_start div {DAY}"))
    read = reads.select(*_WHO, "day", F.col("since").alias("_since"), F.col("until").alias("_until"), F.col("at").alias("_at"))
    missed = held.where("event_type <> 'master'").select(*_WHO, "event_key", "day", "_start", "seen_at").join(read, [*_WHO, "day"]).where("_start >= _since AND _start < _until AND _at > seen_at")
    missed = missed.groupBy(*_WHO, "event_key").agg(F.min("_at").alias("_missed"))
    gone = F.when((F.col("gone_at") > F.col("seen_at")) & (F.col("event_type") != "master"), F.col("gone_at"))
    return held.join(missed, [*_WHO, "event_key"], "left").withColumn("removed_at", F.least(gone, "_missed")).drop("_start", "day", "_missed")


def resolve(events: DataFrame, state: State, cut: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(source, account_id, source_id, event_key, method) of the events that have no match yet, and the rows (source, account_id, event_key) that move, with their new key `to`.

    events is one row a source id, with composite and own_key. Both results are read from one table that cut(df, name) wrote.
    """
    one = [*_WHO, "composite"]
    live = with_removed(state.rows, state.reads).where("removed_at IS NULL").select(*_WHO, "event_key", "source_id", "composite", F.col("global_id"))
    fresh = events.join(state.matches, [*_WHO, "source_id"], "left_anti")
    here = events.groupBy(*one).agg(F.count("*").alias("n")).unionByName(live.join(events, [*_WHO, "source_id"], "left_anti").groupBy(*one).agg(F.count("*").alias("n")))
    own = here.groupBy(*one).agg(F.sum("n").alias("own"))
    bare = F.col("global_id") == ""
    sides = live.groupBy(*one).agg(F.count("*").alias("all"), F.count_if(bare).alias("bare"), F.min(F.when(bare, F.col("event_key"))).alias("bare_key"), F.min(F.when(~bare, F.col("event_key"))).alias("global_key"))
    wanted = fresh.select(*one).distinct()
    others = wanted.join(sides.withColumnRenamed("source", "_other"), ["account_id", "composite"]).where("_other <> source").groupBy(*one).agg(
        F.sum("all").alias("all"), F.sum("bare").alias("bare"), F.min(F.when(F.col("bare") > 0, F.struct("_other", "bare_key"))).alias("_bare"), F.min(F.when(F.col("all") > F.col("bare"), F.struct("_other", "global_key"))).alias("_global")
    )
    seen = fresh.join(own, one).join(others, one, "left")
    has_global = F.col("global_id") != ""
    seen = seen.withColumns({
        "_n": F.coalesce(F.when(has_global, F.col("bare")).otherwise(F.col("all") - F.col("bare")), F.lit(0)),
        "_from": F.when(has_global, F.col("_bare._other")).otherwise(F.col("_global._other")), "_key": F.when(has_global, F.col("_bare.bare_key")).otherwise(F.col("_global.global_key")),
    })
    taken = state.rows.select(F.col("source").alias("_from"), "account_id", F.col("event_key").alias("own_key"), F.lit(True).alias("_taken"))  # the row would meet another of its source
    mine = events.where(has_global).select(*_WHO, F.col("own_key").alias("_key"), F.lit(True).alias("_mine")).distinct()  # a copy of this batch has that key already
    seen = seen.join(taken, ["_from", "account_id", "own_key"], "left").join(mine, [*_WHO, "_key"], "left")
    alone = (F.col("_n") == 1) & (F.col("all") == 1) & (F.col("own") == 1)
    joins = alone & F.when(has_global, F.col("_taken").isNull()).otherwise(F.col("_mine").isNull())
    key = F.when(joins & ~has_global, F.col("_key")).when(~has_global & (F.col("own") > 1), F.concat("composite", F.lit("#"), "source_id")).otherwise(F.col("own_key"))
    method = F.when((F.col("_n") > 0) & ~alone, "ambiguous").when(joins & ~has_global, "upgraded").when(has_global, "global").otherwise("composite")
    moves = F.when(joins & has_global, F.struct(F.col("_from").alias("source"), "account_id", F.col("_key").alias("event_key"), F.col("own_key").alias("to")))
    found = cut(seen.select(*_WHO, "source_id", key.alias("event_key"), method.alias("method"), moves.alias("_move")), "found")
    return found.drop("_move"), found.where("_move IS NOT NULL").select("_move.*")


def _moved(rows: DataFrame, moves: DataFrame) -> DataFrame:
    return rows.join(moves, [*_WHO, "event_key"], "left").withColumn("event_key", F.coalesce("to", "event_key")).drop("to")


def _stated(unit: str) -> Column:
    """A unit's statement: later clocks win, of equal ones the longer and then the greater value; a null states nothing."""
    size = F.length(unit) if _KINDS[unit] == "string" else F.lit(0)
    return F.when(F.col(unit).isNotNull(), F.struct(F.col(f"{unit}_clock").alias("clock"), size.alias("size"), F.col(unit).alias("value")))


def captured(rows: DataFrame) -> DataFrame:
    """One row a key from any number of copies, whatever their order: every unit by its own clock. Copies meet before they are sorted: most keys have few, so sorting each task's own first would combine little and spill much."""
    best = rows.repartition(*_WHO, "event_key").groupBy(*_WHO, "event_key").agg(
        F.min("source_id").alias("source_id"), F.max("global_id").alias("global_id"), F.max_by("composite", F.struct("times_clock", "composite")).alias("composite"), F.max("event_type").alias("event_type"),
        *(F.max(_stated(u)).alias(f"_{u}") for u in UNITS), F.max("seen_at").alias("seen_at"), F.max("gone_at").alias("gone_at"),
    )
    units = [c for u in UNITS for c in (F.col(f"_{u}.value").alias(u), F.col(f"_{u}.clock").alias(f"{u}_clock"))]
    return best.select(*_WHO, "event_key", "source_id", "global_id", "composite", "event_type", *units, "seen_at", "gone_at")


def apply(state: State, batch: Batch, cut: Callable[[DataFrame, str], DataFrame]) -> tuple[State, DataFrame]:
    """The state after a batch, written by cut(df, name), and the events that were refused. A refused event with a source id spares its row: the source still reports it, only this copy is of no use."""
    refused = batch.events.where(~valid())
    good = _keyed(batch.events.where(valid()))
    latest = cut(good.select(*_WHO, "source_id", "global_id", "composite", "own_key", "clock", "at").repartition("source_id").groupBy(*_WHO, "source_id").agg(F.max_by(F.struct("global_id", "composite", "own_key"), F.struct("clock", "at", "own_key")).alias("e")).select(*_WHO, "source_id", "e.*"), "latest")
    found, moves = resolve(latest, state, cut)
    matches = cut(_moved(state.matches, moves).unionByName(found), "matches")
    times = F.struct("start", "end", "all_day", "start_date", "end_date").cast(_TIMES)
    copies = good.withColumn("times", times).withColumns({f"{u}_clock": F.col("clock") for u in UNITS}).join(matches.select(*_WHO, "source_id", "event_key"), [*_WHO, "source_id"])
    copies = copies.select(*_WHO, "event_key", "source_id", "global_id", "composite", "event_type", *(c for u in UNITS for c in (u, f"{u}_clock")), F.col("at").alias("seen_at"), F.lit(None).cast("long").alias("gone_at"))
    rows = captured(_moved(state.rows, moves).unionByName(copies))
    names = matches.select(*_WHO, "source_id", "event_key")
    spared = refused.where("source_id <> ''").select(*_WHO, "source_id", "at").join(names, [*_WHO, "source_id"]).groupBy(*_WHO, "event_key").agg(F.max("at").alias("_spared"))
    gone = batch.gone.join(names, [*_WHO, "source_id"]).groupBy(*_WHO, "event_key").agg(F.max("at").alias("_gone"))
    rows = rows.join(spared, [*_WHO, "event_key"], "left").join(gone, [*_WHO, "event_key"], "left")
    rows = rows.withColumns({"seen_at": F.greatest("seen_at", "_spared"), "gone_at": F.greatest("gone_at", "_gone")}).drop("_spared", "_gone")
    return State(cut(rows, "rows"), matches, cut(compacted_reads(state.reads.unionByName(covered_days(batch.windows))), "reads")), refused
