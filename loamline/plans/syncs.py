"""Syncs that remember what they read. Orders stand for records: their lines, as JSON, are the bytes; the rows they make are kept by owner and line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import batches, memory
from ..sources.archive import table
from ..sources.scratch import cut
from .registry import query

_BODY = "array<struct<line:int,part:long,supplier:long,quantity:double,flag:string,version:int>>"


def _records(spark: SparkSession, sf: str, later: bool) -> DataFrame:
    """The source as it stands at a first and at a later sync. Late orders are new later, those before them have new bytes, and orders with status P cannot be read at first."""
    o, n = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    moved = F.lit(later) & (F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), (F.col("l_quantity") + moved.cast("int")).alias("quantity"), F.col("l_returnflag").alias("flag"), (moved.cast("int") + 1).alias("version"))
    there = o.where(F.lit(later) | (F.col("o_orderdate") < F.lit("2001-05-01").cast("timestamp_ntz")))
    held = there.join(n, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_orderstatus").agg(F.to_json(F.sort_array(F.collect_list(line))).alias("lines"))  # an order's lines
    return held.select(F.col("o_orderkey").cast("string").alias("record"), F.when(F.lit(later) | (F.col("o_orderstatus") != "P"), F.col("lines")).alias("body"))


def lines_of(records: DataFrame) -> memory.Mapped:
    """Rows by owner and line: cheap lines belong to their part, so several orders make one row; all others to their order. The suppliers are the people named."""
    read = records.withColumn("l", F.from_json("body", _BODY))
    rows = read.where("l IS NOT NULL").select("record", F.explode("l").alias("l"))
    order = F.col("record").cast("long")
    owner = F.when(F.col("l.quantity") < 3, -F.col("l.part")).otherwise(order)
    dead = F.when((F.col("l.flag") == "R") & (F.col("l.line") == 1), order)
    named = F.concat(F.lit("Supplier "), F.col("l.supplier").cast("string"))
    return memory.Mapped(
        rows.select("record", owner.alias("owner"), F.col("l.line").alias("line"), F.col("l.version").alias("version"), dead.alias("deleted_at"), F.col("l.quantity").alias("quantity"), ((order * 10 + F.col("l.line")) * 100_000_000 + F.col("l.part") * 100 + F.col("l.quantity").cast("long")).alias("arrival")),
        read.where("l IS NULL").select("record", F.lit("unreadable").alias("code")),
        rows.select("record", F.col("l.supplier").cast("string").alias("id"), named.alias("name"), order.alias("at")),
    )


LINES = memory.Source(lines_of, ["owner", "line"], "version", "deleted_at", ["quantity"], "arrival")
_STORED = "owner long, line int, version int, deleted_at long, quantity double"


def _synced(spark: SparkSession, sf: str) -> tuple[memory.Sync, memory.Sync]:
    first = memory.sync(_records(spark, sf, False), memory.Memory.empty(spark), spark.createDataFrame([], _STORED), LINES, cut)
    known = memory.Memory(*(cut(part, "memory") for part in (first.memory.heads, first.memory.refs, first.memory.people)))
    return first, memory.sync(_records(spark, sf, True), known, first.rows.drop("change"), LINES, cut)


_SIDE = """{0} AS (SELECT CASE WHEN q < 3 THEN -l_partkey ELSE l_orderkey END AS owner, l_linenumber AS line, v AS version, CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN l_orderkey END AS deleted_at, q AS quantity, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 100 + q AS arrival
  FROM (SELECT *, l_quantity + {2} AS q, 1 + {2} AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE {1})),
  {0}m AS (SELECT owner, line, max(version) AS version FROM {0} GROUP BY 1, 2),
  {0}f AS (SELECT owner, line, version, max_by(deleted_at, arrival) FILTER (deleted_at IS NOT NULL) AS deleted_at, max_by(quantity, arrival) AS quantity FROM {0} JOIN {0}m USING (owner, line, version) GROUP BY 1, 2, 3)"""
_BOTH = (
    "WITH " + _SIDE.format("o", "o_orderdate < TIMESTAMP '2001-05-01' AND o_orderstatus <> 'P'", "0") + ", " + _SIDE.format("n", "true", "CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01' THEN 1 ELSE 0 END")
    + """, j AS (SELECT owner, line, o.version AS ov, o.deleted_at AS od, o.quantity AS oq, n.version AS nv, CASE WHEN o.deleted_at IS NOT NULL AND n.deleted_at IS NULL AND n.version <= o.version THEN o.deleted_at ELSE n.deleted_at END AS nd, n.quantity AS nq FROM of o FULL JOIN nf n USING (owner, line)),
    x AS (SELECT *, CASE WHEN nv IS NULL THEN 'kept' WHEN ov IS NULL THEN 'new' WHEN nv < ov OR (nq IS NOT DISTINCT FROM oq AND nd IS NOT DISTINCT FROM od) THEN 'unchanged' WHEN nd IS NOT NULL AND od IS NULL THEN 'deleted' ELSE 'edited' END AS change FROM j)"""
)


@query(_BOTH + " SELECT owner, line, CASE WHEN change IN ('kept', 'unchanged') THEN ov ELSE nv END AS version, CASE WHEN change IN ('kept', 'unchanged') THEN od ELSE nd END AS deleted_at, CASE WHEN change IN ('kept', 'unchanged') THEN oq ELSE nq END AS quantity FROM x")
def sync_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that a later sync leaves which maps only new and changed records: the same as after a full one."""
    return _synced(spark, sf)[1].rows.drop("change")


@query(_BOTH + " SELECT change, count(*) AS n FROM x WHERE change <> 'kept' GROUP BY change")
def sync_replayed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What the later sync counts: skipped records' rows are seen and unchanged."""
    return _synced(spark, sf)[1].counts


@query("SELECT CAST(l_suppkey AS VARCHAR) AS id, min(l_orderkey) AS first_seen, max(l_orderkey) AS last_seen, 'Supplier ' || l_suppkey AS name FROM lineitem GROUP BY l_suppkey")
def sync_replayed_people(spark: SparkSession, sf: str) -> DataFrame:
    """The people of the later sync: read ones and those that skipped records named."""
    return _synced(spark, sf)[1].people


_SINCE, _UNTIL = 883_612_800_000_000, 915_148_800_000_000  # 1998


def _copies(spark: SparkSession, sf: str, source: str, at: int) -> DataFrame:
    """Orders as a calendar's copies of events; one calendar knows global ids and lacks every third event, the other has these and every second one."""
    k, start = F.col("o_orderkey"), micros("o_orderdate") + F.col("o_orderkey") % 4 * 3_600_000_000
    teams = source == "teams"
    rows = table(spark, sf, "orders").where(k % 3 != 0 if teams else (k % 3 == 0) | (k % 2 == 0))
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        F.lit(source).alias("source"), F.lit("a").alias("account_id"), F.concat(F.lit(source[0]), k.cast("string")).alias("source_id"), (F.concat(F.lit("G"), k.cast("string")) if teams else F.lit("")).alias("global_id"), F.lit("single").alias("event_type"),
        F.concat(F.lit("S"), (F.col("o_custkey") % 20).cast("string")).alias("subject"), none("string").alias("location"), start.alias("start"), (start + F.when(k % 97 == 0, -1).otherwise(3_600_000_000)).alias("end"), none("boolean").alias("all_day"), none("long").alias("start_date"), none("long").alias("end_date"),
        (F.col("o_orderstatus") == "F").alias("cancelled"), F.lit(at).cast("long").alias("clock"), F.lit(at).cast("long").alias("at"),
    )


@query(
    f"""WITH o AS (SELECT *, 'S' || (o_custkey % 20) AS subject, epoch_us(o_orderdate) + o_orderkey % 4 * 3600000000 AS "start" FROM orders WHERE o_orderkey % 97 <> 0),
    e AS (SELECT *, substr(sha256(lower(subject) || chr(0) || "start" || chr(0) || ("start" + 3600000000)), 1, 24) AS composite, 'G' || o_orderkey || '|' || "start" AS gkey FROM o),
    t AS (SELECT * FROM e WHERE o_orderkey % 3 <> 0), m AS (SELECT *, count(*) OVER (PARTITION BY composite) AS own FROM e WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0),
    g AS (SELECT composite, count(*) AS n, min(gkey) AS gkey FROM t GROUP BY 1)
    SELECT 'teams' AS source, gkey AS event_key, subject, 'global' AS method, CASE WHEN "start" >= {_SINCE} AND "start" < {_UNTIL} THEN 2 END AS removed_at FROM t
    UNION ALL SELECT 'mail', CASE WHEN own = 1 AND g.n = 1 THEN g.gkey WHEN own > 1 THEN composite || '#m' || o_orderkey ELSE composite END, subject, CASE WHEN own = 1 AND g.n = 1 THEN 'upgraded' WHEN g.n > 0 THEN 'ambiguous' ELSE 'composite' END, NULL FROM m LEFT JOIN g USING (composite)"""
)
def calendar_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Two calendars' batches: keys joined where both sides are unique, refused copies left out, and a later read of a year that no longer saw the first calendar's events."""
    none = batches.Batch(_copies(spark, sf, "teams", 1), spark.createDataFrame([], "source string, account_id string, since long, until long, at long"), spark.createDataFrame([], "source string, account_id string, source_id string, at long"))
    first, _ = batches.apply(batches.State.empty(spark), none, cut)
    read = spark.createDataFrame([("teams", "a", _SINCE, _UNTIL, 2)], none.windows.schema)
    state, _ = batches.apply(first, batches.Batch(_copies(spark, sf, "mail", 2), read, none.gone), cut)
    rows = batches.with_removed(state.rows, state.reads)
    return rows.join(state.matches.select("source", "account_id", "source_id", "method"), ["source", "account_id", "source_id"]).select("source", "event_key", "subject", "method", "removed_at")
