"""Upserts, clocked capture, merges of sources, absence, graphs. Events of one key in order of time stand for its statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import graph, merge
from ..sources.archive import table
from .registry import query

_ST = """WITH s AS (SELECT user_id, event_type, event_id AS arrival, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS version, CASE WHEN value > 85 THEN event_id END AS deleted_at, round(value, 3) AS body FROM events)"""


def statements(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long") % 5
    return table(spark, sf, "events").select(
        "user_id", "event_type", F.col("event_id").alias("arrival"), k.alias("version"), F.when(F.col("value") > 85, F.col("event_id")).alias("deleted_at"), F.round("value", 3).alias("body")
    )


KEYS = ["user_id", "event_type"]


@query(
    _ST + """, m AS (SELECT user_id, event_type, max(version) AS version FROM s GROUP BY 1, 2), t AS (SELECT s.* FROM s JOIN m USING (user_id, event_type, version))
    SELECT user_id, event_type, version, max_by(deleted_at, arrival) FILTER (deleted_at IS NOT NULL) AS deleted_at, max_by(body, arrival) AS body FROM t GROUP BY 1, 2, 3"""
)
def upsert_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The rows that version-gated statements leave: newest version, last arrival, sticky tombstone."""
    return merge.fold_statements(statements(spark, sf), KEYS, "version", "arrival", "deleted_at", ["body"])


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    """The first half of all arrivals is stored, the second comes as a batch."""
    s = statements(spark, sf)
    half = s.agg(F.floor(F.max("arrival") / 2).alias("half"))  # one row
    s = s.crossJoin(F.broadcast(half))
    stored, batch = (merge.fold_statements(s.where(side), KEYS, "version", "arrival", "deleted_at", ["body"]) for side in ("arrival <= half", "arrival > half"))
    return merge.upsert(stored, batch, KEYS, "version", "deleted_at", ["body"])


_FOLD = """{0}m AS (SELECT user_id, event_type, max(version) AS version FROM s WHERE {1} GROUP BY 1, 2),
  {0} AS (SELECT user_id, event_type, version, max_by(deleted_at, arrival) FILTER (deleted_at IS NOT NULL) AS deleted_at, max_by(body, arrival) AS body FROM s JOIN {0}m USING (user_id, event_type, version) WHERE {1} GROUP BY 1, 2, 3)"""
_MERGED = (
    _ST + ", " + _FOLD.format("o", "arrival <= (SELECT max(event_id) // 2 FROM events)") + ", " + _FOLD.format("n", "arrival > (SELECT max(event_id) // 2 FROM events)")
    + """, j AS (SELECT user_id, event_type, o.version AS ov, o.deleted_at AS od, o.body AS ob, n.version AS nv, CASE WHEN o.deleted_at IS NOT NULL AND n.deleted_at IS NULL AND n.version <= o.version THEN o.deleted_at ELSE n.deleted_at END AS nd, n.body AS nb FROM o FULL JOIN n USING (user_id, event_type)),
    x AS (SELECT *, CASE WHEN nv IS NULL THEN 'kept' WHEN ov IS NULL THEN 'new' WHEN nv < ov OR (nb IS NOT DISTINCT FROM ob AND nd IS NOT DISTINCT FROM od) THEN 'unchanged' WHEN nd IS NOT NULL AND od IS NULL THEN 'deleted' ELSE 'edited' END AS change FROM j),
    r AS (SELECT user_id, event_type, change, CASE WHEN change IN ('kept', 'unchanged') THEN ov ELSE nv END AS version, CASE WHEN change IN ('kept', 'unchanged') THEN od ELSE nd END AS deleted_at, CASE WHEN change IN ('kept', 'unchanged') THEN ob ELSE nb END AS body FROM x)"""
)


@query(_MERGED + " SELECT * FROM r")
def upsert_batch(spark: SparkSession, sf: str) -> DataFrame:
    """One batch merged into stored rows, with what happened to each."""
    return _merged(spark, sf)


@query(_MERGED + " SELECT user_id, event_type, change, deleted_at IS NOT NULL AS is_deleted FROM r WHERE change IN ('new', 'edited', 'deleted')")
def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    return merge.change_feed(_merged(spark, sf)).select(*KEYS, "change", F.col("deleted_at").isNotNull().alias("is_deleted"))


@query(_MERGED + " SELECT change, count(*) AS n FROM r GROUP BY change")
def sync_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).groupBy("change").agg(F.count("*").alias("n"))


@query(
    _ST + """, u AS (SELECT user_id, version AS clock, event_type AS subject, CASE WHEN arrival % 3 = 0 THEN NULL ELSE repeat('b', CAST(arrival % 11 AS INT)) END AS note FROM s)
    SELECT user_id, max_by(subject, (clock, length(subject), subject)) AS subject, max_by(note, (clock, length(note), note)) FILTER (note IS NOT NULL) AS note, max(clock) AS subject_clock, max(clock) FILTER (note IS NOT NULL) AS note_clock FROM u GROUP BY user_id"""
)
def clocked_capture(spark: SparkSession, sf: str) -> DataFrame:
    """Every field takes its own latest statement; longer ones win a tie; silence states nothing."""
    s = statements(spark, sf)
    u = s.select("user_id", F.col("version").alias("clock"), F.col("event_type").alias("subject"), F.when(F.col("arrival") % 3 != 0, F.repeat(F.lit("b"), (F.col("arrival") % 11).cast("int"))).alias("note"))
    return merge.capture(u, ["user_id"], "clock", {"subject": F.length("subject"), "note": F.length("note")})


_TWO = """WITH a AS (SELECT doc_id AS k, n_chars AS clock, nullif(lang, 'fr') AS lang, source FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id AS k, 2 * (doc_id % 3000) AS clock, lang, nullif(source, 'src1') AS source FROM documents WHERE doc_id % 4 <> 0 OR doc_id % 3 = 0),
  j AS (SELECT k, coalesce(b.clock - a.clock > 5, false) OR a.clock IS NULL AS bb, a.lang AS al, b.lang AS bl, a.source AS asrc, b.source AS bs FROM a FULL JOIN b USING (k))"""


@query(
    _TWO + """ SELECT k, CASE WHEN bb THEN 'b' ELSE 'a' END AS base, CASE WHEN bb THEN coalesce(bl, al) ELSE coalesce(al, bl) END AS lang, CASE WHEN bb THEN coalesce(bs, asrc) ELSE coalesce(asrc, bs) END AS source,
    concat_ws(',', CASE WHEN (CASE WHEN bb THEN bl ELSE al END) IS NULL AND (CASE WHEN bb THEN al ELSE bl END) IS NOT NULL THEN 'lang' END, CASE WHEN (CASE WHEN bb THEN bs ELSE asrc END) IS NULL AND (CASE WHEN bb THEN asrc ELSE bs END) IS NOT NULL THEN 'source' END) AS filled,
    concat_ws(',', CASE WHEN al <> bl THEN 'lang' END, CASE WHEN asrc <> bs THEN 'source' END) AS overridden FROM j"""
)
def two_source_merge(spark: SparkSession, sf: str) -> DataFrame:
    """One entity from two sources: the later clock is the base, gaps are filled, differences named."""
    d = table(spark, sf, "documents")
    a = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("k"), F.col("n_chars").alias("clock"), F.nullif("lang", F.lit("fr")).alias("lang"), "source")
    b = d.where("doc_id % 4 <> 0 OR doc_id % 3 = 0").select(F.col("doc_id").alias("k"), (F.col("doc_id") % 3000 * 2).alias("clock"), "lang", F.nullif("source", F.lit("src1")).alias("source"))
    return merge.two_sources(a, b, ["k"], "clock", ["lang", "source"], 5)


@query(
    """WITH v AS (SELECT o_orderkey AS k, epoch_us(o_orderdate) AS received, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' ELSE 'seen' END AS s, CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey % 40 END AS missed_at FROM orders),
    j AS (SELECT *, CASE WHEN s = 'seen' THEN 'seen' WHEN missed_at IS NULL OR missed_at >= 30 THEN 'missed_once' WHEN received >= 980000000000000 THEN 'gone' ELSE 'evicted' END AS v FROM v),
    h AS (SELECT count(*) FILTER (v = 'gone') > 20 AND count(*) FILTER (v = 'gone') > 0.1 * count(*) AS held FROM j)
    SELECT k AS o_orderkey, CASE WHEN held AND v IN ('gone', 'evicted') THEN 'withheld' ELSE v END AS verdict FROM j, h"""
)
def absence_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that two reads miss are gone or evicted, unless too many would be."""
    o = table(spark, sf, "orders").select("o_orderkey", micros("o_orderdate").alias("received"))
    seen = o.where("o_orderkey % 5 <> 0")
    misses = o.where("o_orderkey % 10 = 0").select("o_orderkey", (F.col("o_orderkey") % 40).alias("missed_at"))
    return merge.absence(o, seen, misses, "o_orderkey", 30, "received", 980_000_000_000_000).select("o_orderkey", "verdict")


@query(
    """SELECT l.c_custkey, CASE WHEN s.c_custkey IS NOT NULL THEN NULL WHEN l.c_custkey % 4 = 0 THEN 11 ELSE 99 END AS removed_at FROM customer l
    LEFT JOIN (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0) s USING (c_custkey)"""
)
def removal_mark(spark: SparkSession, sf: str) -> DataFrame:
    """A complete read marks what it didn't see and lifts the mark of what it did."""
    stored = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, 11).alias("removed_at"))
    seen = table(spark, sf, "orders").where("o_orderstatus = 'F' AND o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return merge.mark_removed(stored, seen, ["c_custkey"], True, F.lit(99))


@query("SELECT DISTINCT d.doc_id, sha256(d.text) AS digest FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents p WHERE p.doc_id % 2 = 0 AND p.source = d.source AND p.text = d.text)")
def admit_digest(spark: SparkSession, sf: str) -> DataFrame:
    """Observations whose content was not published yet for their source."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return merge.admit(d, d.where("doc_id % 2 = 0"), ["source"], "digest").select("doc_id", "digest")


@query("SELECT user_id, max_by(event_id, (epoch_us(ts), event_id)) AS current, max_by(event_id, (epoch_us(ts), event_id)) FILTER (event_type <> 'error') AS last_good FROM events GROUP BY user_id")
def current_last_good(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("t", micros("ts"))
    return merge.current_and_last_good(e, ["user_id"], "t", F.col("event_type") != "error", "event_id")


@query(
    """WITH j AS (SELECT c_custkey, c_acctbal > 0 AS cache_live, o.n IS NOT NULL AS server_seen, coalesce(o.open, 0) > 0 AS server_live, c_custkey % 6 AS missed, c_custkey % 9 AS swept FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS open FROM orders GROUP BY 1) o ON o_custkey = c_custkey)
    SELECT c_custkey, CASE WHEN server_seen THEN 'both' ELSE 'cache' END AS provenance, CASE WHEN cache_live THEN 'live' WHEN server_live AND swept > missed THEN 'live' ELSE 'absent' END AS state FROM j"""
)
def state_reduce(spark: SparkSession, sf: str) -> DataFrame:
    """The state of a row that a cache and a server tell of: a live server sighting after the first miss lifts an absence."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("open"))
    j = table(spark, sf, "customer").join(o, "c_custkey", "left")
    lifted = (F.coalesce("open", F.lit(0)) > 0) & (F.col("c_custkey") % 9 > F.col("c_custkey") % 6)
    return j.select("c_custkey", F.when(F.col("n").isNotNull(), "both").otherwise("cache").alias("provenance"), F.when(F.col("c_acctbal") > 0, "live").when(lifted, "live").otherwise("absent").alias("state"))


@query(
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 5 = 0)
    SELECT c_custkey, CASE WHEN c_custkey IN (SELECT k FROM b) THEN 'present' WHEN c_custkey IN (SELECT k FROM a) THEN 'missing_once' ELSE 'gone' END AS state FROM customer"""
)
def census_gone(spark: SparkSession, sf: str) -> DataFrame:
    """Missing from two whole enumerations, the later one last, means gone."""
    o = table(spark, sf, "orders")
    first, second = (o.where(f"o_orderkey % {n} = 0").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn(name, F.lit(True)) for n, name in ((3, "a"), (5, "b")))
    rows = table(spark, sf, "customer").select("c_custkey").join(first, "c_custkey", "left").join(second, "c_custkey", "left")
    return rows.select("c_custkey", F.when(F.col("b"), "present").when(F.col("a"), "missing_once").otherwise("gone").alias("state"))


# graphs: a part's parent is its number divided by three


@query(
    """WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 > 0 THEN p_partkey // 3 END AS parent FROM part), w(id, at_id, depth) AS (SELECT id, id, 0 FROM n UNION ALL
      SELECT w.id, n.parent, depth + 1 FROM w JOIN n ON n.id = w.at_id JOIN n p ON p.id = n.parent WHERE depth < 16)
    SELECT id, max_by(at_id, depth) AS root, max(depth) AS depth FROM w GROUP BY id"""
)
def folder_roots(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 > 0, F.floor(F.col("p_partkey") / 3)).alias("parent"))
    return graph.roots(n.where("parent IS NULL OR parent <> id"), "id", "parent")


@query(
    """WITH RECURSIVE e AS (SELECT doc_id AS a, greatest(doc_id - 1 - doc_id % 5, doc_id // 40 * 40) AS b FROM documents), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r(node, seen) AS (SELECT DISTINCT a, a FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.seen WHERE s.b < r.node OR true)
    SELECT node, min(seen) AS component FROM r GROUP BY node"""
)
def reply_components(spark: SparkSession, sf: str) -> DataFrame:
    """Threads as components of reply links: a document answers one of the five before it, the first of every forty answers none."""
    first = F.floor(F.col("doc_id") / 40) * 40
    edges = table(spark, sf, "documents").select(F.col("doc_id").alias("a"), F.greatest(F.col("doc_id") - 1 - F.col("doc_id") % 5, first).alias("b"))
    return graph.components(edges, "a", "b", rounds=40)


@query(
    """WITH m AS (SELECT doc_id, sha256(text) AS id, source < 'src5' AS is_current, n_chars + doc_id % 3 AS seen FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY is_current DESC, seen DESC, doc_id DESC) AS rn FROM m)
    SELECT a.doc_id AS copy_id, b.doc_id AS standing_id FROM r a JOIN r b ON a.id = b.id AND b.rn = 1 WHERE a.rn > 1 AND NOT a.is_current"""
)
def copy_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of older sets that a better row with the same id stands for."""
    m = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("id"), (F.col("source") < "src5").alias("is_current"), (F.col("n_chars") + F.col("doc_id") % 3).alias("seen"))
    best = m.groupBy("id").agg(F.max_by("doc_id", F.struct(F.col("is_current"), "seen", "doc_id")).alias("standing_id"))
    return m.where("not is_current").join(best, "id").where("doc_id <> standing_id").select(F.col("doc_id").alias("copy_id"), "standing_id")


@query(
    """WITH g AS (SELECT o_custkey, epoch_us(o_orderdate) AS received, epoch_us(min(o_orderdate) OVER (PARTITION BY o_custkey)) + 86400000000 * 400 AS sent FROM orders)
    SELECT o_custkey, CASE WHEN max(received) - min(received) <= 60000000 THEN max(received) ELSE coalesce(min(received) FILTER (received >= sent - 900000000), min(received)) END AS chosen FROM g GROUP BY o_custkey"""
)
def received_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Copies that disagree by over a minute are dated by the earliest clock that is not before the sending."""
    o = table(spark, sf, "orders").select("o_custkey", micros("o_orderdate").alias("received"))
    sent = o.groupBy("o_custkey").agg((F.min("received") + 86_400_000_000 * 400).alias("sent"))
    late = F.when(F.col("received") >= F.col("sent") - 900_000_000, F.col("received"))
    agree = F.max("received") - F.min("received") <= 60_000_000
    return o.join(sent, "o_custkey").groupBy("o_custkey").agg(F.when(agree, F.max("received")).otherwise(F.coalesce(F.min(late), F.min("received"))).alias("chosen"))
