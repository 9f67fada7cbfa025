"""Listings: filters, enrichment, top-k, names. Events stand for messages, customers for senders, nations for teams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..functions.times import looks_all_day, micros
from ..operators import joins, ranking
from ..sources.archive import table, with_optional
from .registry import query

NTZ = lambda s: F.lit(s).cast("timestamp_ntz")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Events with sender, sender's team and the number in the payload."""
    e, c, n = (table(spark, sf, x) for x in ("events", "customer", "nation"))
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    out = e.join(c.select("c_custkey", "c_name", "c_nationkey"), F.col("user_id") == F.col("c_custkey"), "left")
    return out.join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left")


@query(
    """WITH m AS (SELECT event_id, epoch_us(ts) AS ts_us, event_type, c_name AS sender, n_name AS team FROM events
      LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey
      WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND event_type <> 'error')
    SELECT *, (SELECT count(*) FROM m) > 50 AS truncated FROM m ORDER BY ts_us DESC, event_id DESC LIMIT 50"""
)
def messages_newest(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 newest messages of a half-open window, with sender and team, and whether there are more."""
    rows = messages(spark, sf).where(P.every(P.half_open(F.col("ts"), NTZ("2024-01-05"), NTZ("2024-01-20")), F.col("event_type") != "error"))
    rows = rows.select("event_id", micros("ts").alias("ts_us"), "event_type", F.col("c_name").alias("sender"), F.col("n_name").alias("team"))
    return ranking.top(rows, 50, F.desc("ts_us"), F.desc("event_id"))


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-10' AND event_type NOT IN ('error', 'signup')")
def filter_window_halfopen(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.where(P.half_open(F.col("ts"), NTZ("2024-01-03"), NTZ("2024-01-10")) & ~F.col("event_type").isin("error", "signup")).select("event_id", "user_id", "event_type")


@query(
    """SELECT o_custkey, count(*) AS orders, epoch_us(max(o_orderdate)) AS last_us FROM orders GROUP BY o_custkey
    HAVING max(o_orderdate) >= TIMESTAMP '2001-01-01' AND max(o_orderdate) <= TIMESTAMP '2001-06-01'"""
)
def filter_window_closed(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations by their last message; this window includes its end."""
    by = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_orderdate").alias("last"))
    return by.where(P.closed(F.col("last"), NTZ("2001-01-01"), NTZ("2001-06-01"))).select("o_custkey", "orders", micros("last").alias("last_us"))


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE lower(c_name) = lower('customer#000000007') OR lower(n_name) = 'nation_3' OR c_custkey = 11")
def name_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.where(P.same_name("CUSTOMER#000000007", F.col("c_name")) | P.same_name("Nation_3", F.col("n_name")) | (F.col("c_custkey") == 11)).select("c_custkey", "c_name", "n_name")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00001')")
def sender_filter(spark: SparkSession, sf: str) -> DataFrame:
    """'00001' is no customer's id, so it is a part of the name."""
    c = table(spark, sf, "customer")
    return P.sent_by(c, "00001", "c_custkey", "c_name").select("c_custkey", "c_name")


@query("SELECT doc_id, lang FROM documents WHERE text LIKE '%\\%\\%\\%%' ESCAPE '\\'")
def substring_escape(spark: SparkSession, sf: str) -> DataFrame:
    """LIKE's wildcards are plain characters in a substring filter."""
    return table(spark, sf, "documents").where(P.contains(F.col("text"), "%%%")).select("doc_id", "lang")


@query("SELECT p_partkey, p_type FROM part WHERE p_type >= 'S' AND p_type < 'T'")
def prefix_range(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.col("p_type").startswith("S")).select("p_partkey", "p_type")


@query("SELECT event_type, CASE WHEN event_type IN ('view', 'click') THEN 'chats' WHEN event_type LIKE 'pur%' THEN 'meetings' ELSE 'channels' END AS scope, count(*) AS n FROM events GROUP BY 1, 2")
def scope_class(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    scope = F.when(t.isin("view", "click"), "chats").when(t.startswith("pur"), "meetings").otherwise("channels")
    return table(spark, sf, "events").groupBy("event_type", scope.alias("scope")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderpriority LIKE '1-%' OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS mentions FROM orders")
def mention_flag(spark: SparkSession, sf: str) -> DataFrame:
    """The row's own flag, or a child row that says so."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.with_exists(o, returned, "o_orderkey", "child").select("o_orderkey", (F.col("o_orderpriority").startswith("1-") | F.col("child")).alias("mentions"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE (SELECT l_returnflag FROM lineitem WHERE l_orderkey = o_orderkey
      ORDER BY l_shipdate DESC, l_linenumber DESC, l_returnflag DESC LIMIT 1) END AS kind FROM orders"""
)
def mention_kind(spark: SparkSession, sf: str) -> DataFrame:
    """The newest child's kind, found by one aggregation instead of a query a row."""
    newest = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max_by("l_returnflag", F.struct("l_shipdate", "l_linenumber", "l_returnflag")).alias("flag"))
    return table(spark, sf, "orders").join(newest, "o_orderkey", "left").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "final").otherwise(F.col("flag")).alias("kind"))


@query("SELECT lang, count(*) AS undated FROM (SELECT lang, nullif(n_chars % 7, 0) AS clock FROM documents) WHERE clock IS NULL GROUP BY lang")
def undated_count(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that any date window leaves out because they have no date."""
    rows = table(spark, sf, "documents").select("lang", F.nullif(F.col("n_chars") % 7, F.lit(0)).alias("clock"))
    return rows.where("clock IS NULL").groupBy("lang").agg(F.count("*").alias("undated"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 79) || '…' ELSE text END AS text, length(text) > 80 AS text_truncated, NULL::VARCHAR AS title FROM documents")
def fields_bound(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen fields, a bounded text with a mark, and a column old archives lack."""
    d = with_optional(table(spark, sf, "documents"), {"title": F.lit(None).cast("string")})
    return d.select("doc_id", T.bounded(F.col("text"), 80).alias("text"), (F.length("text") > 80).alias("text_truncated"), "title")


@query(
    """SELECT s_suppkey, CASE WHEN n.n_name <> '' AND t <> '' THEN n.n_name || ' › ' || t ELSE coalesce(nullif(t, ''), nullif(n.n_name, '')) END AS name
    FROM (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS t FROM supplier) JOIN nation n ON n_nationkey = s_nationkey"""
)
def composed_name(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").withColumn("t", F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")))
    return s.join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", T.composed_name(F.col("n_name"), F.col("t")).alias("name"))


@query("WITH t AS (SELECT event_id, epoch_us(ts) AS ts_us FROM events ORDER BY ts DESC, event_id DESC LIMIT 30) SELECT *, row_number() OVER (ORDER BY ts_us, event_id) AS position FROM t")
def topk_chrono(spark: SparkSession, sf: str) -> DataFrame:
    """The newest 30, told in the order in which they happened."""
    few = table(spark, sf, "events").select("event_id", micros("ts").alias("ts_us")).orderBy(F.desc("ts_us"), F.desc("event_id")).limit(30)
    return ranking.first_per(few.withColumn("_all", F.lit(1)), ["_all"], 30, F.asc("ts_us"), F.asc("event_id")).select("event_id", "ts_us", F.col("position").cast("long").alias("position"))


@query(
    """SELECT p_partkey, p_name, tier FROM (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'red' THEN 0 WHEN starts_with(lower(p_name), 'red') THEN 1
      WHEN contains(lower(p_name), 'red') THEN 2 END AS tier FROM part) WHERE tier IS NOT NULL ORDER BY tier, p_partkey DESC LIMIT 40"""
)
def tier_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Equal names, then beginnings, then parts."""
    rows = table(spark, sf, "part").select("p_partkey", "p_name", ranking.name_tier(F.col("p_name"), "Red").alias("tier"))
    return rows.where("tier IS NOT NULL").orderBy("tier", F.desc("p_partkey")).limit(40)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 100")
def offset_page(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 100, 25, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query(
    """SELECT * FROM (SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, round(c_acctbal, 2) AS balance FROM customer
      UNION ALL SELECT 'supplier', s_suppkey, s_name, round(s_acctbal, 2) FROM supplier) ORDER BY balance DESC, kind, id LIMIT 60"""
)
def people_top(spark: SparkSession, sf: str) -> DataFrame:
    """People of two sources in one order."""
    c = table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("balance"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.round("s_acctbal", 2).alias("balance"))
    return ranking.union_top([c, s], 60, F.desc("balance"), F.asc("kind"), F.asc("id"))


@query(
    """SELECT event_id, user_id, coalesce(nullif(c_name, ''), 'user ' || user_id) AS sender, n_name AS team, r_name AS region, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
    LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"""
)
def enrich_left(spark: SparkSession, sf: str) -> DataFrame:
    """Every message with the names around it; a sender nobody knows keeps the row."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("n_nationkey").alias("nk"), "r_name")
    rows = messages(spark, sf).join(n, F.col("n_nationkey") == F.col("nk"), "left")
    sender = T.first_known(F.col("c_name"), F.concat(F.lit("user "), F.col("user_id").cast("string")))
    return rows.select("event_id", "user_id", sender.alias("sender"), F.col("n_name").alias("team"), F.col("r_name").alias("region"), "k")


@query(
    """SELECT c.conv_id, c.turn, c.role, p.role AS parent_role, length(p.text) AS parent_length FROM conversations c
    LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1"""
)
def self_parent(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role"), F.length("text").cast("long").alias("parent_length"))
    return c.join(p, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "parent_role", "parent_length")


@query(
    """SELECT o_orderkey, count(l_orderkey) AS children, coalesce(string_agg(l_linenumber || ':' || l_returnflag || l_linestatus, ',' ORDER BY l_linenumber, l_returnflag, l_linestatus), '') AS lines
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def children_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Parents with their children as an ordered array; here printed."""
    child = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag", "l_linestatus")
    rows = joins.with_children(table(spark, sf, "orders").select("o_orderkey"), child, "o_orderkey", "l_linenumber", ["l_returnflag", "l_linestatus"], "lines")
    line = F.transform("lines", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_returnflag"], x["l_linestatus"]))
    return rows.select("o_orderkey", F.size("lines").cast("long").alias("children"), F.array_join(line, ",").alias("lines"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority LIKE '1%')")
def anti_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without a finished order of the first priority."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'F' AND o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderstatus, position FROM (VALUES (7, 0), (3, 1), (32, 2), (5, 3), (999999999, 4)) k(o_orderkey, position) JOIN orders USING (o_orderkey)")
def key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return joins.lookup(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), [(7,), (3,), (32,), (5,), (999999999,)], ["o_orderkey"], "o_orderkey long").select("o_orderkey", "o_orderstatus", "position")


@query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id = 3) OR (conv_id = 5 AND turn = 0) OR (conv_id = 8 AND role = 'user')")
def thread_members(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of a thread by three ways to belong to it."""
    c = table(spark, sf, "conversations")
    return c.where("(conv_id = 3) OR (conv_id = 5 AND turn = 0) OR (conv_id = 8 AND role = 'user')").select("conv_id", "turn", "role")


@query("SELECT event_id, CAST(timezone('Pacific/Auckland', timezone('UTC', ts)) AS DATE)::VARCHAR AS day FROM events")
def local_day_of(spark: SparkSession, sf: str) -> DataFrame:
    """The local day of a UTC clock."""
    shown = F.convert_timezone(F.lit("UTC"), F.lit("Pacific/Auckland"), F.col("ts"))
    return table(spark, sf, "events").select("event_id", F.to_date(shown).cast("string").alias("day"))


@query(
    """SELECT o_orderkey, l >= 23 AND abs(l - round(l / 24) * 24) <= 1 AS all_day FROM (SELECT o_orderkey, (o_orderkey % 60) * 1.0 AS l FROM orders)"""
)
def all_day_look(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of 0 to 59 hours that look like whole days."""
    o = table(spark, sf, "orders").withColumn("end", F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 60).cast("int")))
    return o.select("o_orderkey", looks_all_day(F.col("o_orderdate"), F.col("end")).alias("all_day"))


@query(
    """SELECT doc_id, sha256(regexp_replace(regexp_replace(s, '^\\s*((re|fw|fwd|aw|wg|sv)[ \t]*:\\s*)*', '', 'i'), '\\s+$', '')) AS digest, starts_with(s, 'R') AS marked FROM
    (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Re: FW: ' WHEN 1 THEN ' AW : sv:' WHEN 2 THEN 'Regarding: ' ELSE '' END || text AS s FROM documents)"""
)
def subject_norm(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as subjects, told by their digest."""
    k = F.col("doc_id") % 4
    mark = F.when(k == 0, "Re: FW: ").when(k == 1, " AW : sv:").when(k == 2, "Regarding: ").otherwise("")
    s = table(spark, sf, "documents").select("doc_id", F.concat(mark, "text").alias("s"))
    return s.select("doc_id", F.sha2(T.normal_subject(F.col("s")), 256).alias("digest"), F.col("s").startswith("R").alias("marked"))


@query("SELECT doc_id, lower(regexp_replace(trim(s), '^<(.*)>$', '\\1')) AS message_id FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ' <' || upper(source) || '.' || doc_id || '@X> ' ELSE source || '@y' END AS s FROM documents)")
def message_id_norm(spark: SparkSession, sf: str) -> DataFrame:
    s = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" <"), F.upper("source"), F.lit("."), F.col("doc_id").cast("string"), F.lit("@X> "))).otherwise(F.concat("source", F.lit("@y")))
    return table(spark, sf, "documents").select("doc_id", T.normal_message_id(s).alias("message_id"))


@query("SELECT event_id, 'ev_' || substr(sha256(event_id || chr(0) || event_type), 1, 10) AS short_id, sha256(event_id || chr(0) || user_id || chr(0) || coalesce(nullif(event_type, 'error'), chr(1))) AS hash FROM events")
def short_ids(spark: SparkSession, sf: str) -> DataFrame:
    i, u, t = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("event_type")
    return table(spark, sf, "events").select("event_id", T.short_id("ev_", 10, i, t).alias("short_id"), T.content_hash(i, u, F.nullif(t, F.lit("error"))).alias("hash"))


@query(
    """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html,
      '(?is)<(script|style)\\b.*?</(script|style)\\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages"""
)
def markup_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.markup_text(F.col("html")).alias("text"))


@query(
    """SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page,
    'https://teams.example/l/' || url_encode(url) AS link FROM pages"""
)
def link_parts(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", F.parse_url(url, F.lit("PROTOCOL")).alias("scheme"), F.parse_url(url, F.lit("HOST")).alias("host"), F.coalesce(F.parse_url(url, F.lit("QUERY"), F.lit("page")), F.lit("")).alias("page"), T.deep_link("https://teams.example/l", url).alias("link")
    )


@query(
    """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(?i)bearer\\s+[A-Za-z0-9._~+/=-]+', 'Bearer [removed]', 'g'), 'eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]*', '[removed]', 'g'),
      '(?i)([?&](?:sig|tempauth)=)[^&\\s"]+', '\\1[removed]', 'g'), '(?i)((?:token|secret|password|api_key|authorization)"?\\s*[:=]\\s*"?)[^"\\s,}]+', '\\1[removed]', 'g') AS text
    FROM (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' Authorization: BEARER abc.def' WHEN 1 THEN ' {"Password": "x y"}' WHEN 2 THEN ' http://h/?a=1&SIG=q%2F&b=2' WHEN 3 THEN ' eyJhbGciOiJI.eyJzdWIi.sig_' ELSE ' SECRET=1' END AS s FROM documents)"""
)
def scrub_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, with one more secret of each kind at its end, scrubbed."""
    k = F.col("doc_id") % 5
    more = F.when(k == 0, " Authorization: BEARER abc.def").when(k == 1, ' {"Password": "x y"}').when(k == 2, " http://h/?a=1&SIG=q%2F&b=2").when(k == 3, " eyJhbGciOiJI.eyJzdWIi.sig_").otherwise(" SECRET=1")
    return table(spark, sf, "documents").select("doc_id", T.scrubbed(F.concat("text", more)).alias("text"))


@query("SELECT event_id, CASE WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS text FROM (SELECT event_id, event_id * 37 % 9000 AS s FROM events)")
def duration_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", T.duration_text(F.col("event_id") * 37 % 9000).alias("text"))
