"""Captures of recaps and their items, and account links. Orders stand for calls, their lines for copies of recaps and for items, customers for accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import recaps as R
from ..sources.archive import table
from .registry import query

_ARRIVAL = "(l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 100 + CAST(l_quantity AS BIGINT)"
#: A copy of a recap, and the stored recap of every third order, as SQL that both engines read.
_COPY = {
    "recap_id": "CASE WHEN l_linenumber = 3 THEN concat('R', l_partkey) ELSE '' END", "headline": "CASE WHEN l_partkey % 2 = 0 THEN concat('H', l_partkey) ELSE '' END", "short_summary": "CASE WHEN l_partkey % 3 = 0 THEN concat('S', l_suppkey) END",
    "attendance_status": "CASE WHEN l_returnflag = 'R' THEN 'missed' ELSE '' END", "attendees_count": "CASE WHEN l_quantity > 25 THEN CAST(l_quantity AS BIGINT) ELSE 0 END", "is_missed": "l_returnflag = 'R'", "has_recap": "CASE WHEN l_linenumber > 4 THEN true END",
    "ical_uid": "CASE WHEN l_suppkey % 4 = 0 THEN concat('U', l_suppkey) ELSE '' END", "link_method": "CASE WHEN l_suppkey % 8 = 0 THEN 'window' ELSE '' END", "recording_url": "CASE WHEN l_partkey % 5 = 0 THEN concat('https://r.example.com/', l_partkey) ELSE '' END",
    "duration_seconds": "CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS BIGINT) ELSE 0 END",
}
_STORED = {
    "recap_id": "'R0'", "headline": "CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE '' END", "short_summary": "''", "attendance_status": "''", "attendees_count": "CAST(o_orderkey % 4 AS BIGINT)", "is_missed": "o_orderstatus = 'P'", "has_recap": "false", "ical_uid": "CASE WHEN o_orderkey % 2 = 0 THEN 'U0' ELSE '' END",
    "link_method": "CASE WHEN o_orderkey % 2 = 0 THEN 'ical_uid' ELSE 'guess' END", "recording_url": "CASE WHEN o_orderkey % 9 = 0 THEN 'https://r.example.com/0' ELSE '' END", "duration_seconds": "CAST(5 AS BIGINT)",
}
_KINDS = {c: "boolean" for c in R.FLAGS} | {c: "long" for c in ("attendees_count", "duration_seconds", "recording_start_at", "recording_end_at", *R.TIMES)}
_TOLD = list(_COPY)


def _filled(df: DataFrame, known: dict[str, str], start: str) -> DataFrame:
    """df with all fields of a recap: the known ones, the start of the recording, and nothing for the others."""
    cols = {c: F.expr(known[c]) if c in known else F.lit(None).cast(_KINDS.get(c, "string")) for c in R.RECAP}
    return df.withColumns({c: v.cast(_KINDS.get(c, "string")) for c, v in (cols | {"recording_start_at": micros(start)}).items()})


_LASTS = ", ".join(
    f"max_by({c}, arrival) FILTER ({c} {'<> 0' if c == 'attendees_count' else chr(60) + chr(62) + ' ' + chr(39) * 2}) AS {c}" for c in ("recap_id", "headline", "short_summary", "attendance_status", "attendees_count")
)


@query(
    f"""WITH s AS (SELECT o_orderkey AS call_id, 0 AS arrival, true AS kept, {', '.join(f'{v} AS {k}' for k, v in _STORED.items())}, epoch_us(o_orderdate) AS recording_start_at FROM orders WHERE o_orderkey % 3 = 0),
    b AS (SELECT l_orderkey AS call_id, 1 + {_ARRIVAL} AS arrival, false AS kept, {', '.join(f'{v} AS {k}' for k, v in _COPY.items())}, epoch_us(l_shipdate) AS recording_start_at FROM lineitem),
    a AS (SELECT * FROM s UNION ALL SELECT * FROM b),
    g AS (SELECT call_id, {_LASTS}, bool_or(coalesce(is_missed, false)) AS is_missed, bool_or(coalesce(has_recap, false)) AS has_recap, max_by(ical_uid, arrival) FILTER (kept OR ical_uid <> '') AS ical_uid,
      max_by(CASE WHEN kept THEN link_method WHEN link_method = '' THEN 'ical_uid' ELSE link_method END, arrival) FILTER (kept OR ical_uid <> '') AS link_method, max_by(recording_url, arrival) FILTER (recording_url <> '') AS url,
      max_by(recording_start_at, arrival) FILTER (recording_url <> '') AS us, max_by(duration_seconds, arrival) FILTER (recording_url <> '') AS ud, max_by(recording_start_at, arrival) AS ns, max_by(duration_seconds, arrival) FILTER (duration_seconds <> 0) AS nd,
      bool_or(kept) AS had, bool_or(NOT kept) AS told FROM a GROUP BY 1),
    r AS (SELECT call_id, coalesce(recap_id, '') AS recap_id, coalesce(headline, '') AS headline, coalesce(short_summary, '') AS short_summary, coalesce(attendance_status, '') AS attendance_status, coalesce(attendees_count, 0) AS attendees_count, is_missed, has_recap, coalesce(ical_uid, '') AS ical_uid,
      coalesce(link_method, '') AS link_method, coalesce(url, '') AS recording_url, CASE WHEN url IS NULL THEN coalesce(nd, 0) ELSE ud END AS duration_seconds, CASE WHEN url IS NULL THEN ns ELSE us END AS recording_start_at, had, told FROM g)
    SELECT r.call_id, {', '.join('r.' + c for c in _TOLD)}, r.recording_start_at, CASE WHEN NOT told THEN 'kept' WHEN NOT had THEN 'new' WHEN ({', '.join('r.' + c for c in (*_TOLD, 'recording_start_at'))}) = ({', '.join('s.' + c for c in (*_TOLD, 'recording_start_at'))}) THEN 'unchanged' ELSE 'changed' END AS change
    FROM r LEFT JOIN s ON s.call_id = r.call_id"""
)
def recap_capture(spark: SparkSession, sf: str) -> DataFrame:
    """Stored recaps after a batch of copies that each know a part."""
    o, n = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    account, never = F.lit("a").alias("account_id"), F.lit(1).cast("long")
    stored = _filled(o.where("o_orderkey % 3 = 0"), _STORED, "o_orderdate").select(account, F.col("o_orderkey").alias("call_id"), *R.RECAP, never.alias("first_seen_at"), never.alias("updated_at"))
    copies = _filled(n.withColumn("arrival", F.expr(_ARRIVAL)), _COPY, "l_shipdate").select(account, F.col("l_orderkey").alias("call_id"), *R.RECAP, "arrival")
    return R.capture_recaps(stored, copies, "arrival", F.lit(2).cast("long")).select("call_id", *_TOLD, "recording_start_at", "change")


_TITLE = "concat('Title ', l_partkey % 3)"


@query(
    f"""WITH i AS (SELECT *, CASE WHEN l_linestatus = 'O' THEN 'action' ELSE 'mention' END AS kind, l_linenumber % 3 AS ordinal, {_TITLE} AS title, concat('o', l_suppkey % 5) AS owner, {_ARRIVAL} AS arrival FROM lineitem),
    k AS (SELECT *, substr(sha256(concat_ws('|', kind, 'recap', ordinal, lower(title), 'do it')), 1, 16) AS item_key FROM i),
    o AS (SELECT l_orderkey AS call_id, kind, item_key, max_by(owner, arrival) AS owner, max_by(CASE WHEN l_suppkey % 9 = 0 THEN 1 END IS NOT NULL, arrival) AS dead FROM k WHERE l_returnflag <> 'N' GROUP BY 1, 2, 3),
    n AS (SELECT l_orderkey AS call_id, kind, item_key, max_by(owner, arrival) AS owner FROM k WHERE l_returnflag <> 'R' AND l_orderkey % 2 = 0 GROUP BY 1, 2, 3), sets AS (SELECT DISTINCT call_id, kind FROM n),
    x AS (SELECT coalesce(o.call_id, n.call_id) AS call_id, coalesce(o.kind, n.kind) AS kind, coalesce(o.item_key, n.item_key) AS item_key, o.owner AS oo, n.owner AS no, coalesce(o.dead, false) AS dead FROM o FULL JOIN n ON o.call_id = n.call_id AND o.kind = n.kind AND o.item_key = n.item_key)
    SELECT call_id, kind, item_key, coalesce(no, oo) AS owner_name, CASE WHEN oo IS NULL THEN 'new' WHEN no IS NOT NULL THEN CASE WHEN oo = no AND NOT dead THEN 'unchanged' ELSE 'changed' END WHEN (call_id, kind) IN (SELECT (call_id, kind) FROM sets) AND NOT dead THEN 'superseded' ELSE 'kept' END AS change,
    CASE WHEN no IS NOT NULL THEN NULL WHEN dead THEN 1 WHEN (call_id, kind) IN (SELECT (call_id, kind) FROM sets) THEN 2 END AS superseded_at FROM x"""
)
def recap_items_applied(spark: SparkSession, sf: str) -> DataFrame:
    """Items of calls after a newer read: sets that were read lose what is not in them any more."""
    n = table(spark, sf, "lineitem").withColumn("arrival", F.expr(_ARRIVAL))
    fields = {c: F.lit(None).cast("string") for c in R.ITEM} | {"title": F.expr(_TITLE), "text": F.lit(" Do \t it"), "owner_name": F.concat(F.lit("o"), (F.col("l_suppkey") % 5).cast("string")), "ordinal": F.col("l_linenumber") % 3}
    items = n.select("l_returnflag", "l_suppkey", "arrival", F.lit("a").alias("account_id"), F.col("l_orderkey").alias("call_id"), F.when(F.col("l_linestatus") == "O", "action").otherwise("mention").alias("kind"), F.lit("recap").alias("origin"), *(v.alias(c) for c, v in fields.items()))
    old = items.where("l_returnflag <> 'N'").withColumn("item_key", R.item_key(F.col("kind"), F.col("origin"), F.col("ordinal"), F.col("title"), F.col("text")))
    keys = [*R.CALL, "kind", "origin", "item_key"]
    stored = old.groupBy(*keys).agg(F.max(F.struct("arrival", *R.ITEM, "l_suppkey")).alias("s")).select(*keys, *(F.col(f"s.{c}").alias(c) for c in R.ITEM), F.lit(1).cast("long").alias("first_seen_at"), F.when(F.col("s.l_suppkey") % 9 == 0, F.lit(1).cast("long")).alias("superseded_at"))
    read = items.where("l_returnflag <> 'R' AND call_id % 2 = 0")
    return R.apply_items(stored, read, "arrival", F.lit(2).cast("long")).select("call_id", "kind", "item_key", "owner_name", "change", "superseded_at")


@query(
    """WITH i AS (SELECT c_custkey AS a, CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 1 WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN c_custkey + 2 ELSE c_custkey END AS u FROM customer WHERE c_custkey % 23 <> 0),
    p AS (SELECT c_custkey AS p, c_custkey AS u FROM customer WHERE c_custkey % 7 <> 0 UNION SELECT c_custkey, c_custkey + 2 FROM customer WHERE c_custkey % 11 = 0),
    l AS (SELECT c_custkey AS a, CASE WHEN c_custkey % 13 = 0 OR c_custkey % 25 = 0 THEN c_custkey + 1 ELSE c_custkey END AS p, CASE WHEN c_custkey % 13 = 0 THEN 'config' ELSE 'address' END AS method, c_custkey % 26 <> 0 AS active FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 13 = 0),
    own AS (SELECT u, min(a) AS a FROM i WHERE u IS NOT NULL GROUP BY u HAVING count(*) = 1), m AS (SELECT a, min(p) AS p FROM own JOIN p USING (u) GROUP BY a HAVING count(DISTINCT p) = 1), c AS (SELECT a, p FROM m QUALIFY count(*) OVER (PARTITION BY p) = 1),
    x AS (SELECT coalesce(i.a, l.a) AS a, l.p AS lp, method, coalesce(active, false) AS active, c.p AS match, i.a IS NULL OR coalesce(method = 'config', false) AS fixed FROM i FULL JOIN l ON l.a = i.a LEFT JOIN c ON c.a = coalesce(i.a, l.a)),
    y AS (SELECT *, CASE WHEN match NOT IN (SELECT lp FROM x WHERE fixed AND active) THEN match END AS wish FROM x),
    z AS (SELECT *, CASE WHEN fixed OR (active AND lp IS NOT DISTINCT FROM wish) THEN 'kept' WHEN active AND wish IS NOT NULL THEN 'relinked' WHEN active THEN 'unlinked' WHEN wish IS NOT NULL THEN 'linked' WHEN match IS NOT NULL THEN 'refused' ELSE 'kept' END AS change FROM y)
    SELECT 'm' || a AS account_id, 'p' || CASE WHEN change IN ('linked', 'relinked') THEN wish ELSE lp END AS principal_id, CASE WHEN change IN ('linked', 'relinked') THEN 'address' ELSE method END AS method, CASE WHEN change IN ('linked', 'relinked') THEN true WHEN change = 'unlinked' THEN false ELSE active END AS active, change FROM z"""
)
def account_autolink(spark: SparkSession, sf: str) -> DataFrame:
    """Mail accounts linked to the chat account that alone has their address; ended where that is no more; the operator's rows stay."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    text = lambda before, col, after="": F.concat(F.lit(before), col.cast("string"), F.lit(after))
    address = F.when(k % 10 == 0, k + 1).when(k % 17 == 0, None).when(k % 19 == 0, k + 2).otherwise(k)
    looked = c.where("c_custkey % 23 <> 0").select(text("m", k).alias("account_id"), text(" U", address, "@Example.com").alias("address"))
    profiles = c.where("c_custkey % 7 <> 0").select(text("p", k).alias("principal_id"), text("u", k, "@example.com").alias("address")).unionByName(c.where("c_custkey % 11 = 0").select(text("p", k).alias("principal_id"), text("u", k + 2, "@example.com ").alias("address")))
    links = c.where("c_custkey % 5 = 0 OR c_custkey % 13 = 0").select(text("m", k).alias("account_id"), text("p", F.when((k % 13 == 0) | (k % 25 == 0), k + 1).otherwise(k)).alias("principal_id"), F.when(k % 13 == 0, "config").otherwise("address").alias("method"), (k % 26 != 0).alias("active"))
    return R.link_accounts(looked, profiles, links)
