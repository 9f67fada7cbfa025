"""From landing records to rows, and the user's summary commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import scrubbed
from ..functions.times import micros
from ..operators import merge, purge
from ..sources import mappers
from ..sources.archive import table
from ..sources.scratch import cut
from .registry import query


@query("WITH l AS (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id) SELECT user_id, event_id, round(value, 3) AS value FROM l JOIN events USING (user_id, event_id) WHERE event_type <> 'error'")
def log_merge(spark: SparkSession, sf: str) -> DataFrame:
    """A write log merged: the newest write of a key wins, a deletion too."""
    w = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("deleted"), F.round("value", 3).alias("value"))
    return mappers.newest_live(w, ["user_id"], "event_id", "deleted", ["value"])


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://blog.')")
def key_prefix_scan(spark: SparkSession, sf: str) -> DataFrame:
    return mappers.under(table(spark, sf, "pages").select("page_id", "url"), "url", "https://blog.")


def _chains(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    m = F.struct(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), F.col("role").alias("from"), F.col("text").alias("content"), F.lit("RichText/Html").alias("messagetype"), (F.col("turn") + 1).alias("version"))
    return c.groupBy("conv_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), m)))).alias("json"))


@query("SELECT conv_id, turn::VARCHAR AS message_key, conv_id || '-' || turn AS id, role AS sender, length(text) AS length, turn + 1 AS version, NULL::BIGINT AS deletetime FROM conversations")
def reply_chain_map(spark: SparkSession, sf: str) -> DataFrame:
    """Records that hold a map of messages become one row a message."""
    m = mappers.reply_chain(_chains(spark, sf), "json")
    return m.select("conv_id", "message_key", "id", F.col("from").alias("sender"), F.length("content").cast("long").alias("length"), "version", "deletetime")


@query(
    """WITH m AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY conv_id, role), c AS (SELECT conv_id, count(*) AS n, string_agg(role, ', ' ORDER BY t) AS names FROM m GROUP BY conv_id)
    SELECT conv_id::VARCHAR AS id, CASE WHEN conv_id % 2 = 0 THEN 'topic' ELSE 'chat' END AS kind, CASE WHEN conv_id % 3 = 0 THEN 'Title ' || conv_id ELSE names END AS name, n AS members FROM c"""
)
def conversation_map(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])).alias("members"))
    record = F.struct(F.col("conv_id").cast("string").alias("id"), F.when(F.col("conv_id") % 2 == 0, "Topic").otherwise("Chat").alias("kind"), F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Title "), F.col("conv_id").cast("string"))).otherwise("").alias("title"), "members")
    rows = mappers.conversation(c.select(F.to_json(record).alias("json")), "json")
    return rows.select("id", "kind", "name", F.size("members").cast("long").alias("members"))


@query("SELECT conv_id::VARCHAR AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS position, role, length(text) AS length FROM conversations")
def session_messages(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("messages"))
    rows = mappers.session(c.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), "messages")).alias("json")), "json")
    return rows.select("id", "position", "role", F.length("text").cast("long").alias("length"))


@query(
    """WITH h AS (SELECT source, sha256(doc_id || chr(0) || n_chars) AS h FROM documents), p AS (SELECT source, CAST('0x' || substr(h, 1, 15) AS BIGINT) AS a, CAST('0x' || substr(h, 16, 15) AS BIGINT) AS b, CAST('0x' || substr(h, 31, 15) AS BIGINT) AS c, CAST('0x' || substr(h, 46, 15) AS BIGINT) AS d FROM h)
    SELECT source, sha256(concat_ws(':', sum(a), sum(b), sum(c), sum(d), count(*))) AS fingerprint, count(*) AS files FROM p GROUP BY source"""
)
def source_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return mappers.fingerprint(table(spark, sf, "documents"), ["source"], F.col("doc_id"), F.col("n_chars"))


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type = 'purchase'")
def json_lines_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    lines = mappers.json_lines(table(spark, sf, "events").where("event_type = 'purchase'").select("event_id", "event_type", "user_id"))
    return lines.select(F.from_json("value", F.lit("struct<event_id: long, event_type: string, user_id: long>")).alias("r")).select("r.*")


@query(
    """WITH a AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations), g AS (SELECT *, sum(CASE WHEN p = role THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM a)
    SELECT conv_id, CAST(run AS BIGINT) AS run, role, min(turn) AS first_turn, count(*) AS entries, length(string_agg(text, chr(10) ORDER BY turn)) AS length FROM g GROUP BY conv_id, run, role"""
)
def transcript_stitch(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring entries of one speaker become one paragraph."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("fresh", F.coalesce((F.lag("role").over(by) != F.col("role")).cast("int"), F.lit(1))).withColumn("run", F.sum("fresh").over(by))
    told = c.groupBy("conv_id", "run", "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("entries"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return told.select("conv_id", "run", "role", "first_turn", "entries", F.length("text").cast("long").alias("length"))


@query(
    """WITH m AS (SELECT o_orderkey AS id, o_orderpriority AS folder FROM orders UNION SELECT l_orderkey, '2-HIGH' FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45),
    f AS (SELECT DISTINCT o_orderpriority AS folder FROM orders WHERE o_orderpriority NOT LIKE '5%')
    SELECT coalesce(f.folder, 'unknown') AS folder, count(*) AS items, count(*) FILTER (o_orderstatus = 'O') AS unread FROM m JOIN orders ON o_orderkey = id LEFT JOIN f ON f.folder = m.folder GROUP BY 1"""
)
def folder_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Items and unread items by folder, an item counted in every folder it is in; folders nobody lists are 'unknown'."""
    o, l = table(spark, sf, "orders"), table(spark, sf, "lineitem")  # noqa: E741
    members = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("folder")).union(l.where("l_returnflag = 'A' AND l_quantity > 45").select("l_orderkey", F.lit("2-HIGH"))).distinct()
    listed = o.where("o_orderpriority NOT LIKE '5%'").select(F.col("o_orderpriority").alias("folder"), F.lit(True).alias("known")).distinct()
    rows = members.join(o.select(F.col("o_orderkey").alias("id"), "o_orderstatus"), "id").join(listed, "folder", "left")
    name = F.when(F.col("known"), F.col("folder")).otherwise("unknown")
    return rows.groupBy(name.alias("folder")).agg(F.count("*").alias("items"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("unread"))


@query(
    """SELECT c.c_nationkey AS account, c.people, coalesce(s.suppliers, 0) AS suppliers, coalesce(o.orders, 0) AS orders, o.newest FROM (SELECT c_nationkey, count(*) AS people FROM customer GROUP BY 1) c
    LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) s ON s_nationkey = c_nationkey
    LEFT JOIN (SELECT c_nationkey, count(*) AS orders, epoch_us(max(o_orderdate)) AS newest FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) o ON o.c_nationkey = c.c_nationkey"""
)
def account_status(spark: SparkSession, sf: str) -> DataFrame:
    """What an account holds, each kind counted before the join."""
    c, s, o = (table(spark, sf, x) for x in ("customer", "supplier", "orders"))
    people = c.groupBy(F.col("c_nationkey").alias("account")).agg(F.count("*").alias("people"))
    suppliers = s.groupBy(F.col("s_nationkey").alias("account")).agg(F.count("*").alias("suppliers"))
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("d"))  # customers are joined to sums, not to orders
    orders = per.join(c, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("account")).agg(F.sum("n").alias("orders"), micros(F.max("d")).alias("newest"))
    return people.join(suppliers, "account", "left").join(orders, "account", "left").na.fill(0, ["suppliers", "orders"])


@query(
    """WITH a AS (SELECT o_orderkey AS k, epoch_us(o_orderdate) AS "start", CASE WHEN o_orderstatus = 'P' THEN 1 END AS cancelled, o_orderkey % 100 AS clock FROM orders WHERE o_orderkey % 3 <> 0),
    b AS (SELECT o_orderkey AS k, epoch_us(o_orderdate) + 3600000000 * (o_orderkey % 5) AS "start", CASE WHEN o_orderstatus = 'F' THEN 0 END AS cancelled, (o_orderkey * 7) % 100 AS clock FROM orders WHERE o_orderkey % 4 <> 0 OR o_orderkey % 3 = 0),
    m AS (SELECT k, CASE WHEN a.clock IS NULL OR coalesce(b.clock - a.clock > 5, false) THEN coalesce(b."start", a."start") ELSE coalesce(a."start", b."start") END AS "start",
      CASE WHEN a.clock IS NULL OR coalesce(b.clock - a.clock > 5, false) THEN coalesce(b.cancelled, a.cancelled) ELSE coalesce(a.cancelled, b.cancelled) END AS cancelled FROM a FULL JOIN b USING (k))
    SELECT k, "start", "start" + 5400000000 AS "end" FROM m WHERE coalesce(cancelled, 0) = 0 AND "start" < epoch_us(TIMESTAMP '1996-02-01') AND "start" + 5400000000 > epoch_us(TIMESTAMP '1996-01-01')"""
)
def agenda(spark: SparkSession, sf: str) -> DataFrame:
    """The merged events of a range. Overlap and visibility are judged after the merge, on what the event became."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), micros("o_orderdate").alias("start"), "o_orderstatus")
    a = o.where("k % 3 <> 0").select("k", "start", F.when(F.col("o_orderstatus") == "P", 1).alias("cancelled"), (F.col("k") % 100).alias("clock"))
    b = o.where("k % 4 <> 0 OR k % 3 = 0").select("k", (F.col("start") + F.col("k") % 5 * 3_600_000_000).alias("start"), F.when(F.col("o_orderstatus") == "F", 0).alias("cancelled"), (F.col("k") * 7 % 100).alias("clock"))
    m = merge.two_sources(a, b, ["k"], "clock", ["start", "cancelled"], 5).withColumn("end", F.col("start") + 5_400_000_000)
    low, high = (micros(F.lit(d).cast("timestamp_ntz")) for d in ("1996-01-01", "1996-02-01"))
    return m.where(P.overlaps(F.col("start"), F.col("end"), low, high) & (F.coalesce("cancelled", F.lit(0)) == 0)).select("k", "start", "end")


_ITEMS = """r AS (SELECT event_id, event_id % 50 AS k, event_type, value > 50 AS is_read, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, 'c' || (event_id % 100) AS thread FROM events),
    i AS (SELECT event_id, CAST(event_id AS VARCHAR) AS id, event_type AS type, NULL AS subtype, CASE WHEN k <> 2 THEN is_read END AS is_read, CASE WHEN k NOT IN (3, 4) THEN CAST(epoch_us(CAST(replace(replace(stamp, 'T', ' '), 'Z', '') AS TIMESTAMP)) AS BIGINT) END AS "at", CASE WHEN k <> 5 THEN thread END AS conversation_id,
      CAST(event_id AS VARCHAR) AS message_id, concat_ws(',', CASE WHEN k = 2 THEN 'is_read' END, CASE WHEN k = 3 THEN 'at' END, CASE WHEN k = 5 THEN 'conversation_id' END) AS losses FROM r WHERE k NOT IN (0, 1, 6, 7))"""


def _feed_items(spark: SparkSession, sf: str) -> DataFrame:
    """Events as records of an activity feed, one in fifty of each kind of broken one."""
    k, quoted = F.col("event_id") % 50, lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    key = F.when(k == 6, '{"deep": 1}').otherwise(F.col("event_id").cast("string"))
    field = lambda name, value: F.concat(F.lit(f'"{name}": '), value)
    fields = [
        F.when(k != 1, field("activityId", key)), field("activityType", quoted(F.col("event_type"))), field("activitySubtype", F.lit('""')), field("isRead", F.when(k == 2, '"maybe"').otherwise((F.col("value") > 50).cast("string"))),
        field("timestamp", F.when(k == 3, '"soon"').when(k == 4, "null").otherwise(quoted(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")))), field("sourceThreadId", F.when(k == 5, '["c1"]').otherwise(quoted(F.concat(F.lit("c"), (F.col("event_id") % 100).cast("string"))))),
        field("sourceMessageId", F.lit('""')), field("messageId", F.col("event_id").cast("string")), field("unknown", F.lit("[1, {}]")),
    ]
    body = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    return table(spark, sf, "events").select("event_id", F.when(k == 0, "{broken").when(k == 7, "[1]").otherwise(body).alias("record"))


@query("WITH " + _ITEMS + ' SELECT event_id, id, type, is_read, "at", conversation_id, message_id, losses FROM i')
def activity_map(spark: SparkSession, sf: str) -> DataFrame:
    """Activity items from records of no fixed schema, with the fields that could not be read."""
    items, _ = mappers.activity(_feed_items(spark, sf), "record")
    return items.select("event_id", "id", "type", "is_read", F.unix_micros("at").alias("at"), "conversation_id", "message_id", F.array_join("losses", ",").alias("losses"))


@query("SELECT CASE event_id % 50 WHEN 0 THEN 'unreadable' WHEN 7 THEN 'not_an_object' WHEN 6 THEN 'unusable_id' ELSE 'no_id' END AS code, count(*) AS n FROM events WHERE event_id % 50 IN (0, 1, 6, 7) GROUP BY 1")
def activity_unmapped(spark: SparkSession, sf: str) -> DataFrame:
    """Records that are no activity items, by code."""
    return mappers.activity(_feed_items(spark, sf), "record")[1].groupBy("code").agg(F.count("*").alias("n"))


@query(
    "WITH " + _ITEMS + """, f AS (SELECT * FROM i WHERE type IN ('click', 'purchase') AND NOT coalesce(is_read, false) ORDER BY "at" DESC NULLS LAST, id DESC LIMIT 300),
    c AS (SELECT 'c' || n_nationkey AS id, n_name AS display_name, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'c' || n_regionkey END AS team_id FROM nation),
    m AS (SELECT 'c' || (o_orderkey % 100) AS conversation_id, CAST(o_orderkey AS VARCHAR) AS message_id, o_orderpriority AS text, CAST(o_custkey AS VARCHAR) AS sender_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Stated ' || o_custkey ELSE '' END AS stated FROM orders WHERE o_orderkey % 100 <> 9)
    SELECT f.id, f.type, f.is_read, f."at", f.conversation_id, CASE WHEN t.id IS NOT NULL THEN t.display_name || ' › ' || c.display_name ELSE c.display_name END AS conversation, f.message_id, coalesce(m.text, '') AS text, coalesce(m.sender_id, '') AS sender_id, coalesce(nullif(m.stated, ''), p.c_name, '') AS sender, (SELECT count(*) FROM i WHERE type IN ('click', 'purchase') AND NOT coalesce(is_read, false)) > 300 AS truncated
    FROM f LEFT JOIN m USING (conversation_id, message_id) LEFT JOIN customer p ON CAST(p.c_custkey AS VARCHAR) = m.sender_id LEFT JOIN c ON c.id = f.conversation_id LEFT JOIN c t ON t.id = c.team_id AND c.team_id <> '' AND c.team_id <> c.id"""
)
def activity_newest(spark: SparkSession, sf: str) -> DataFrame:
    """The newest three hundred unread clicks and purchases with message, sender and conversation; messages of one conversation are a system's."""
    from ..operators import chat

    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    items, _ = mappers.activity(_feed_items(spark, sf), "record")
    messages = table(spark, sf, "orders").select(F.concat(F.lit("c"), (k % 100).cast("string")).alias("conversation_id"), k.cast("string").alias("id"), F.col("o_orderpriority").alias("content_text"), c.alias("sender_id"), F.when(k % 2 == 0, F.concat(F.lit("Stated "), c)).otherwise("").alias("sender_name"))
    people = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    named = lambda column: F.concat(F.lit("c"), F.col(column).cast("string"))
    conversations = table(spark, sf, "nation").select(named("n_nationkey").alias("id"), F.col("n_name").alias("display_name"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(named("n_regionkey")).alias("team_id"))
    return chat.activity_list(items, messages, people, conversations, 300, ["click", "purchase"], True, ("c9",), cut).withColumn("at", F.unix_micros("at"))


_RECORDS = """SELECT 's' || (o_custkey % 2) AS source, o_orderpriority AS database, CASE WHEN o_custkey % 50 = 0 THEN 'auth' ELSE 'st' || (o_custkey % 5) END AS store,
    CASE WHEN o_orderkey % 10 = 0 THEN '{"token":"t' || (o_orderkey % 400) || '","n":' || (o_orderkey % 200) || '}' WHEN o_orderkey % 97 = 0 THEN '{"token":"[removed]","n":' || (o_orderkey % 100) || '}' ELSE 'k' || o_orderkey END AS key,
    CASE WHEN o_orderkey % 3 > 0 THEN 'v' || o_orderkey END AS value, CASE WHEN o_orderkey % 3 > 0 THEN 'h' || o_orderkey ELSE '' END AS content_hash, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey END AS removed_at FROM orders"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as raw records; some keys hold tokens, of which some are of one form when scrubbed."""
    k, text = F.col("o_orderkey"), lambda before, c, end="": F.concat(F.lit(before), c.cast("string"), F.lit(end))
    key = F.when(k % 10 == 0, F.concat(text('{"token":"t', k % 400), text('","n":', k % 200, "}"))).when(k % 97 == 0, text('{"token":"[removed]","n":', k % 100, "}")).otherwise(text("k", k))
    return table(spark, sf, "orders").select(
        text("s", F.col("o_custkey") % 2).alias("source"), F.col("o_orderpriority").alias("database"), F.when(F.col("o_custkey") % 50 == 0, "auth").otherwise(text("st", F.col("o_custkey") % 5)).alias("store"), key.alias("key"),
        F.when(k % 3 > 0, text("v", k)).alias("value"), F.when(k % 3 > 0, text("h", k)).otherwise("").alias("content_hash"), F.when(k % 7 == 0, k).alias("removed_at"),
    )


@query(
    f"""WITH r AS ({_RECORDS}), p AS (SELECT *, store = 'auth' AND (value IS NOT NULL OR content_hash <> '') AS purged FROM r)
    SELECT source, database, store, key, CASE WHEN NOT purged THEN value END AS value, CASE WHEN purged THEN '' ELSE content_hash END AS content_hash, CASE WHEN purged THEN coalesce(removed_at, 5) ELSE removed_at END AS removed_at, purged FROM p"""
)
def purge_denied(spark: SparkSession, sf: str) -> DataFrame:
    """Records after a store's name was put on the list of denied ones."""
    return purge.denied(_records(spark, sf), F.col("store") == "auth", F.lit(5).cast("long"))


@query(
    f"""WITH r AS ({_RECORDS}), k AS (SELECT *, regexp_replace(key, '"t[0-9]+"', '"[removed]"') AS clean FROM r), c AS (SELECT * FROM k WHERE key = clean),
    g AS (SELECT source, database, store, clean, min(removed_at) AS removed_at FROM k WHERE key <> clean GROUP BY 1, 2, 3, 4)
    SELECT source, database, store, key, value, content_hash, removed_at, false AS purged FROM c
    UNION ALL SELECT source, database, store, clean, NULL, '', coalesce(removed_at, 5), true FROM g WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.source = g.source AND c.database = g.database AND c.store = g.store AND c.key = g.clean)"""
)
def purge_unscrubbed_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Records after keys are scrubbed as well: rows that meet under one key become one."""
    return purge.unscrubbed_keys(_records(spark, sf), scrubbed, F.lit(5).cast("long"))[0]
