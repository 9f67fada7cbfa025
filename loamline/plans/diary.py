"""Calendar queries: orders stand for events, customers for accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import calendar as C
from ..operators.agenda import DayIndex
from ..sources.archive import table
from ..sources.scratch import cut, folder
from .registry import query

_HOUR, _DAY = 3_600_000_000, 86_400_000_000
_ROWS = """SELECT o_orderkey AS key, {modified} AS last_modified, {fresh} AS fresh_at, CASE WHEN o_orderkey % {gone} = 0 THEN CAST(o_orderkey % 90 AS BIGINT) * 1000000 END AS removed_at, epoch_us(o_orderdate) + {shift} AS "start",
    epoch_us(o_orderdate) + {shift} + CASE WHEN o_orderkey % 3 = 0 THEN 86400000000 ELSE 3600000000 END AS "end", CASE o_orderkey % {flag} WHEN 0 THEN true WHEN 1 THEN false END AS all_day, epoch_us(o_orderdate) // 86400000000 AS start_date,
    epoch_us(o_orderdate) // 86400000000 + 1 AS end_date, CASE o_orderstatus WHEN '{status}' THEN true WHEN 'P' THEN false END AS cancelled, CASE WHEN o_orderkey % 2 = {detail} THEN CAST(o_orderkey % 7 AS BIGINT) END AS detail_as_of,
    CASE WHEN o_orderkey % {text} = 0 THEN '' ELSE '{name}' || o_custkey END AS subject, CASE WHEN o_totalprice > {price} THEN true END AS online, CASE WHEN o_orderkey % {text} = 1 THEN '' ELSE '{name} body' END AS body FROM orders WHERE o_orderkey % {skip} <> 1 OR o_orderkey % {all} = 1"""
A = {"modified": "CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 50 AS BIGINT) * 1000000 END", "fresh": "CAST(5 AS BIGINT)", "gone": 9, "shift": 0, "flag": 4, "status": "F", "detail": 0, "text": 3, "name": "A", "price": 200000, "skip": 6, "all": 10**15}
B = {"modified": "CAST(o_orderkey % 55 AS BIGINT) * 1000000", "fresh": "CAST(o_orderkey % 8 AS BIGINT)", "gone": 15, "shift": 3600000000, "flag": 5, "status": "O", "detail": 1, "text": 4, "name": "B", "price": 150000, "skip": 7, "all": 6}
_MERGED = f"""WITH a AS ({_ROWS.format(**A)}), b AS ({_ROWS.format(**B)}),
  j AS (SELECT key, a.key IS NOT NULL AS ia, b.key IS NOT NULL AS ib, a, b, greatest(a.removed_at, b.removed_at) AS gone_at FROM a FULL JOIN b USING (key)),
  r AS (SELECT *, gone_at IS NOT NULL AND NOT (coalesce(ia AND a.removed_at IS NULL AND a.last_modified > gone_at + 5000000, false) OR coalesce(ib AND b.removed_at IS NULL AND b.last_modified > gone_at + 5000000, false)) AS removed FROM j),
  t AS (SELECT key, removed, ia AND (removed OR a.removed_at IS NULL) AS ta, ib AND (removed OR b.removed_at IS NULL) AS tb, a, b FROM r),
  m AS (SELECT key, removed, CASE WHEN ta AND tb THEN CASE WHEN coalesce(abs(b.last_modified - a.last_modified) > 5000000, false) THEN b.last_modified > a.last_modified WHEN coalesce(b.fresh_at, 0) <> coalesce(a.fresh_at, 0) THEN coalesce(b.fresh_at, 0) > coalesce(a.fresh_at, 0) ELSE true END ELSE tb END AS bb,
    CASE WHEN ta THEN a END AS a, CASE WHEN tb THEN b END AS b FROM t),
  o AS (SELECT key, removed, bb, CASE WHEN bb THEN b ELSE a END AS x, CASE WHEN bb THEN a ELSE b END AS y FROM m),
  w AS (SELECT *, coalesce(x.all_day IS NULL AND y.all_day AND (x."end" - x."start") / 3.6e9 >= 23 AND abs((x."end" - x."start") / 3.6e9 - round((x."end" - x."start") / 3.6e9 / 24) * 24) <= 1 AND abs(x."start" - y."start") <= 50400000000, false) AS whole,
    coalesce(y.detail_as_of > x.detail_as_of, y.detail_as_of IS NOT NULL AND x.detail_as_of IS NULL) AS dother FROM o),
  e AS (SELECT key, CASE WHEN bb THEN 'b' ELSE 'a' END AS base, removed, coalesce(nullif(x.subject, ''), nullif(y.subject, '')) AS subject, CASE WHEN whole THEN y."start" ELSE x."start" END AS "start", CASE WHEN whole THEN y."end" ELSE x."end" END AS "end",
    CASE WHEN whole THEN y.start_date ELSE x.start_date END AS start_date, CASE WHEN whole THEN y.end_date ELSE x.end_date END AS end_date, CASE WHEN whole THEN true ELSE coalesce(x.all_day, CASE WHEN NOT y.all_day THEN false END) END AS all_day,
    coalesce(x.cancelled, CASE WHEN y.cancelled THEN true END) AS cancelled, coalesce(x.online, y.online) AS online, CASE WHEN dother THEN coalesce(nullif(y.body, ''), nullif(x.body, '')) ELSE coalesce(nullif(x.body, ''), nullif(y.body, '')) END AS body, x, y, whole FROM w),
  ev AS (SELECT key, base, removed, subject, "start", "end", start_date, end_date, all_day, cancelled, online, body,
    concat_ws(',', CASE WHEN nullif(x.subject, '') IS NULL AND nullif(y.subject, '') IS NOT NULL THEN 'subject' END, CASE WHEN x.all_day IS NULL AND all_day IS NOT NULL THEN 'all_day' END, CASE WHEN x.cancelled IS NULL AND cancelled IS NOT NULL THEN 'cancelled' END, CASE WHEN x.online IS NULL AND online IS NOT NULL THEN 'online' END) AS filled,
    concat_ws(',', CASE WHEN nullif(x.subject, '') <> nullif(y.subject, '') THEN 'subject' END, CASE WHEN x."start" <> y."start" THEN 'start' END, CASE WHEN x."end" <> y."end" THEN 'end' END, CASE WHEN x.cancelled <> y.cancelled THEN 'cancelled' END, CASE WHEN x.online <> y.online THEN 'online' END) AS overridden FROM e)"""


def _source(spark: SparkSession, sf: str, of: dict, modified: F.Column, fresh: F.Column) -> DataFrame:
    k, at = F.col("o_orderkey"), micros("o_orderdate")
    start = at + of["shift"]
    return table(spark, sf, "orders").where((k % of["skip"] != 1) | (k % of["all"] == 1)).select(
        k.alias("key"), modified.alias("last_modified"), fresh.alias("fresh_at"), F.when(k % of["gone"] == 0, k % 90 * 1_000_000).alias("removed_at"), start.alias("start"), (start + F.when(k % 3 == 0, _DAY).otherwise(_HOUR)).alias("end"),
        F.when(k % of["flag"] == 0, True).when(k % of["flag"] == 1, False).alias("all_day"), F.floor(at / _DAY).alias("start_date"), (F.floor(at / _DAY) + 1).alias("end_date"),
        F.when(F.col("o_orderstatus") == of["status"], True).when(F.col("o_orderstatus") == "P", False).alias("cancelled"), F.when(k % 2 == of["detail"], k % 7).alias("detail_as_of"),
        F.when(k % of["text"] == 0, "").otherwise(F.concat(F.lit(of["name"]), F.col("o_custkey").cast("string"))).alias("subject"), F.when(F.col("o_totalprice") > of["price"], True).alias("online"), F.when(k % of["text"] == 1, "").otherwise(f"{of['name']} body").alias("body"),
    )


def sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two calendars; every order is in one of them at least."""
    k = F.col("o_orderkey")
    return _source(spark, sf, A, F.when(k % 5 > 0, k % 50 * 1_000_000), F.lit(5).cast("long")), _source(spark, sf, B, k % 55 * 1_000_000, k % 8)


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    return C.merge_events(a, b, ["key"], ["subject"], ["online"], ["body"])


def events(spark: SparkSession, sf: str) -> DataFrame:
    return merged(*sources(spark, sf))


@query(_MERGED + " SELECT * FROM ev")
def event_merge(spark: SparkSession, sf: str) -> DataFrame:
    """One event from two calendars by the rules of removal, base, filling, all-day blocks, details and overrides."""
    return events(spark, sf)


@query(
    _MERGED + """ SELECT key, row_number() OVER (ORDER BY CASE WHEN coalesce(all_day, false) THEN start_date * 86400000000 ELSE "start" END, coalesce(all_day, false) DESC, subject NULLS FIRST, key) AS position FROM ev
    WHERE NOT removed AND NOT coalesce(cancelled, false) AND contains(lower(concat_ws(chr(0), subject, body)), '1')
    AND CASE WHEN coalesce(all_day, false) THEN start_date <= 9150 AND (end_date > 9131 OR start_date >= 9131) ELSE "start" < 790560000000000 AND ("end" > 788918400000000 OR "start" = 788918400000000) END"""
)
def agenda_days(spark: SparkSession, sf: str) -> DataFrame:
    """An agenda: timed and all-day overlap, visibility, a needle in the texts, and its order."""
    from pyspark.sql import Window

    rows = cut(events(spark, sf), "events").where("not removed").withColumns({"event_type": F.lit("single"), "response": F.lit(None).cast("string"), "organizer": F.col("body"), "location": F.lit(None).cast("string"), "principal": F.lit("p")})
    seen = rows.where(C.overlaps(F.lit(788_918_400_000_000), F.lit(790_560_000_000_000), F.lit(9131), F.lit(9150)) & C.visible("1"))
    order = C.agenda_order(F.col("start_date") * _DAY)
    return seen.select("key", F.row_number().over(Window.orderBy(*order)).cast("long").alias("position"))  # one person's days: few rows


@query(
    _MERGED + """, v AS (SELECT *, greatest(CASE WHEN coalesce(all_day, false) THEN start_date ELSE "start" // 86400000000 END, 9131) AS day FROM ev
    WHERE NOT removed AND NOT coalesce(cancelled, false) AND key % 23 <> 0 AND key % 29 <> 0 AND CASE WHEN coalesce(all_day, false) THEN start_date <= 9149 AND (end_date > 9131 OR start_date >= 9131) ELSE "start" < 790560000000000 AND ("end" > 788918400000000 OR "start" = 788918400000000) END)
    SELECT key, day, CAST(row_number() OVER (PARTITION BY day ORDER BY CASE WHEN coalesce(all_day, false) THEN start_date * 86400000000 ELSE "start" END, coalesce(all_day, false) DESC, subject NULLS FIRST, key) AS INT) AS position FROM v"""
)
def agenda_two_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The agenda of nineteen days from stored rows: candidates by an index of days, their whole groups merged, masters, declined and cancelled events left out last."""
    index = DayIndex(spark, folder(spark, "agenda"))
    a, b = sources(spark, sf)
    index.write({"a": a, "b": b})
    k = F.col("key")
    kinds = {"event_type": F.when(k % 23 == 0, "master").otherwise("single"), "response": F.when(k % 29 == 0, "declined"), "organizer": F.lit(None).cast("string"), "location": F.lit(None).cast("string"), "principal": F.lit("p")}
    found = index.agenda(lambda x, y: merged(x, y).withColumns(kinds), ["a", "b"], 788_918_400_000_000, 790_560_000_000_000, C.visible())
    return found.select("key", "day", "position")


_LINKS = """links AS (SELECT 'a' || c_custkey AS account_id, 'p' || (c_custkey % 20) AS principal_id, CASE WHEN c_custkey % 4 = 0 THEN 1 END AS unlinked_at FROM customer WHERE c_custkey % 3 > 0)"""


def links(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").where(k % 3 > 0).select(F.concat(F.lit("a"), k.cast("string")).alias("account_id"), F.concat(F.lit("p"), (k % 20).cast("string")).alias("principal_id"), F.when(k % 4 == 0, 1).alias("unlinked_at"))


@query(f"WITH {_LINKS} SELECT coalesce(l.principal_id, 'a' || o_custkey) AS principal, count(*) AS events FROM orders LEFT JOIN links l ON l.account_id = 'a' || o_custkey AND unlinked_at IS NULL GROUP BY 1")
def principal_events(spark: SparkSession, sf: str) -> DataFrame:
    """Accounts grouped under the person they are actively linked to."""
    rows = table(spark, sf, "orders").select(F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("account_id"))
    return C.with_principal(rows, links(spark, sf)).groupBy("principal").agg(F.count("*").alias("events"))


@query(
    """WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey % 2 AS kind, CASE WHEN l_returnflag = 'A' THEN 'recap' ELSE 'catchup' END AS origin FROM lineitem WHERE l_quantity <= 45)
    SELECT l_orderkey, l_linenumber, kind, origin FROM i WHERE origin = 'recap' OR NOT EXISTS (SELECT 1 FROM i j WHERE j.l_orderkey = i.l_orderkey AND j.kind = i.kind AND j.origin = 'recap')"""
)
def recap_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of the recap where a call has any of the kind, else those of the catch-up; superseded ones are out."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 2).alias("kind"), F.when(F.col("l_returnflag") == "A", "recap").otherwise("catchup").alias("origin"), F.when(F.col("l_quantity") > 45, 1).alias("superseded_at"))
    return C.preferred_items(items, ["l_orderkey", "kind"]).select("l_orderkey", "l_linenumber", "kind", "origin")


@query(
    """WITH r AS (SELECT o_custkey AS g, o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'teams' ELSE 'outlook' END AS source, epoch_us(o_orderdate) + (o_orderkey % 30) * 3600000000 AS "at", epoch_us(o_orderdate) AS d, o_orderkey % 5 = 0 AS dated FROM orders),
    t AS (SELECT *, "at" // 86400000000 * 86400000000 AS date_start FROM r WHERE NOT dated), s AS (SELECT DISTINCT g, d, source FROM r WHERE dated)
    SELECT 'p' AS principal, g AS global_id, date_start, source, min_by(key, ("at" - date_start, key)) AS key FROM t WHERE EXISTS (SELECT 1 FROM s WHERE s.g = t.g AND s.d = t.date_start) AND NOT EXISTS (SELECT 1 FROM s WHERE s.g = t.g AND s.d = t.date_start AND s.source = t.source)
    GROUP BY g, date_start, source"""
)
def occurrence_join(spark: SparkSession, sf: str) -> DataFrame:
    """Timed and date keys of one global id that are the same occurrence."""
    k, at = F.col("o_orderkey"), micros("o_orderdate")
    r = table(spark, sf, "orders").select(F.lit("p").alias("principal"), F.col("o_custkey").alias("global_id"), k.alias("key"), F.when(k % 2 == 0, "teams").otherwise("outlook").alias("source"), (at + k % 30 * _HOUR).alias("at"), at.alias("date_start"), (k % 5 == 0).alias("dated"))
    return C.join_occurrences(r.where("not dated").drop("dated", "date_start"), r.where("dated").select("principal", "global_id", "source", "date_start"))


@query(
    """WITH s AS (SELECT o_custkey % 40 AS k, epoch_us(o_orderdate) AS a, epoch_us(o_orderdate) + 86400000000 * (1 + o_orderkey % 30) AS b FROM orders), c AS (SELECT * FROM s WHERE b > 800000000000000 AND a < 802000000000000),
    r AS (SELECT k, a, b, greatest(800000000000000, coalesce(max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 800000000000000)) AS reach FROM c),
    w AS (SELECT k, max(CASE WHEN a > reach THEN 1 ELSE 0 END) = 0 AND max(b) >= 802000000000000 AS covered FROM r GROUP BY k) SELECT DISTINCT s.k, coalesce(w.covered, false) AS covered FROM s LEFT JOIN w USING (k)"""
)
def spans_contain(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the union of an account's windows holds a whole range."""
    at = micros("o_orderdate")
    spans = table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("k"), at.alias("start"), (at + _DAY * (1 + F.col("o_orderkey") % 30)).alias("end"))
    return C.contains_range(spans, ["k"], F.lit(800_000_000_000_000), F.lit(802_000_000_000_000))


@query(
    """WITH e AS (SELECT p_partkey AS key, p_brand || '; ' || lower(p_type) || ' ;https://join/' || p_partkey AS location, p_type AS sname, CASE WHEN p_size > 25 THEN 'S' || p_size ELSE '' END AS saddr, upper(p_brand) AS rname, CASE WHEN p_size % 2 = 0 THEN 'Resource' ELSE 'Required' END AS rtype, 'R' || p_size AS raddr FROM part),
    x AS (SELECT key, 0 AS f, n AS i, trim(s) AS name, 'text' AS kind, NULL AS address FROM (SELECT key, unnest(string_split(location, ';')) AS s, generate_subscripts(string_split(location, ';'), 1) AS n FROM e) WHERE NOT regexp_matches(lower(trim(s)), '^https?://')
      UNION ALL SELECT key, 1, 0, sname, 'structured', nullif(saddr, '') FROM e UNION ALL SELECT key, 2, 0, rname, 'resource', raddr FROM e WHERE rtype = 'Resource')
    SELECT key, min_by(name, (f, i)) AS name, coalesce(min_by(kind, (f, i)) FILTER (kind <> 'text'), 'text') AS kind, min_by(address, (f, i)) FILTER (address IS NOT NULL) AS address FROM x WHERE name <> '' GROUP BY key, lower(name)"""
)
def event_rooms(spark: SparkSession, sf: str) -> DataFrame:
    """Rooms of location text, structured locations and resources, once by name."""
    p, text = table(spark, sf, "part"), lambda a, b: F.concat(F.lit(a), b.cast("string"))
    e = p.select(
        F.col("p_partkey").alias("key"), F.concat("p_brand", F.lit("; "), F.lower("p_type"), F.lit(" ;https://join/"), F.col("p_partkey").cast("string")).alias("location"),
        F.array(F.struct(F.col("p_type").alias("name"), F.when(F.col("p_size") > 25, text("S", F.col("p_size"))).otherwise("").alias("address"))).alias("locations"),
        F.array(F.struct(F.upper("p_brand").alias("name"), F.when(F.col("p_size") % 2 == 0, "Resource").otherwise("Required").alias("type"), text("R", F.col("p_size")).alias("address"))).alias("attendees"),
    )
    return C.rooms(e)


@query(
    """SELECT c_custkey, CASE WHEN o = '' THEN false WHEN lower(o) = 'ana lee' THEN true WHEN lower(o) <> 'ana' THEN false WHEN c_nationkey % 2 = 0 THEN NULL ELSE true END AS mine FROM
    (SELECT c_custkey, c_nationkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' ANA Lee' WHEN 2 THEN 'Ana' WHEN 3 THEN 'ana' ELSE 'Ben' END AS o, trim(CASE c_custkey % 5 WHEN 1 THEN 'ANA Lee' ELSE '' END) AS x FROM customer) q, LATERAL (SELECT trim(q.o) AS t) l
    WHERE true""".replace("o = ''", "l.t = ''").replace("lower(o)", "lower(l.t)")
)
def owner_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Whose an action item is: a full name, a first name, or unknown where two share it."""
    k = F.col("c_custkey") % 5
    owner = F.when(k == 0, "").when(k == 1, " ANA Lee").when(k == 2, "Ana").when(k == 3, "ana").otherwise("Ben")
    people = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("Ana Lee"), F.lit("Ana Roe"))).otherwise(F.array(F.lit("Ana Lee"), F.lit("Ben Oh")))
    return table(spark, sf, "customer").select("c_custkey", C.owner_is_me(F.lit("Ana Lee"), owner, people).alias("mine"))


@query(
    """WITH e AS (SELECT DISTINCT 'p' || (o_custkey % 5) AS principal, 'k' || (o_orderkey % 500) AS key FROM orders), i AS (SELECT *, 'ev_' || substr(sha256(principal || chr(0) || key), 1, 10) AS id FROM e),
    r AS (SELECT 'k' || n AS ref FROM range(3, 9) t(n) UNION ALL SELECT substr(sha256('p1' || chr(0) || 'k7'), 1, 0) || 'ev_' || substr(sha256('p1' || chr(0) || 'k7'), 1, 10) UNION ALL SELECT 'ev_' || c FROM (VALUES ('0'), ('a'), ('7f')) v(c)),
    x AS (SELECT DISTINCT ref, principal, key, id, 'exact' AS match FROM r JOIN i ON ref = key OR ref = id), p AS (SELECT ref, principal, key, id, 'prefix' AS match FROM r JOIN i ON starts_with(id, ref) AND length(ref) BETWEEN 4 AND 12 WHERE ref NOT IN (SELECT ref FROM x)),
    f AS (SELECT * FROM x UNION ALL SELECT * FROM p), n AS (SELECT *, count(*) OVER (PARTITION BY ref) AS candidates, row_number() OVER (PARTITION BY ref ORDER BY principal, key) AS rn FROM f) SELECT ref, principal, key, match, candidates FROM n WHERE rn <= 10"""
)
def event_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Events by key, by short id, or by the beginning of one, with how many there are."""
    import hashlib

    e = table(spark, sf, "orders").select(F.concat(F.lit("p"), (F.col("o_custkey") % 5).cast("string")).alias("principal"), F.concat(F.lit("k"), (F.col("o_orderkey") % 500).cast("string")).alias("key"))
    refs = [f"k{n}" for n in range(3, 9)] + ["ev_" + hashlib.sha256(b"p1\0k7").hexdigest()[:10], "ev_0", "ev_a", "ev_7f"]
    return C.find_events(e, spark.createDataFrame([(r,) for r in refs], "ref string"))
