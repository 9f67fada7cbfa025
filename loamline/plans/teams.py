"""Chat queries: customers stand for channels, nations for teams, orders for messages, line items for the activity feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import chat as C
from ..sources.archive import table
from .registry import query

_CHAT = """WITH conv AS (SELECT 'a' || (c_nationkey % 2) AS account, 'c' || c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'Chat' ELSE 'Topic' END AS kind, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 't' || c_nationkey END AS team_id,
    CAST(c_custkey * 1000000000000 % 800000000000000 AS BIGINT) AS last_message_at, CASE WHEN c_acctbal > 0 THEN CAST(c_custkey % 30 AS BIGINT) * 31000000000000 END AS read_horizon_at FROM customer
    UNION ALL SELECT 'a' || (n_nationkey % 2), 't' || n_nationkey, CASE WHEN n_regionkey < 2 THEN 'Space' ELSE 'Chat' END, CASE WHEN n_regionkey = 3 THEN 'Same' ELSE n_name END, '', CAST(n_nationkey * 10 AS BIGINT), CAST(NULL AS BIGINT) FROM nation),
  msg AS (SELECT 'a' || (c_nationkey % 2) AS account, 'c' || o_custkey AS conversation_id, 'm' || o_orderkey AS message_id, epoch_us(o_orderdate) AS sent_at, o_orderpriority LIKE '1%' AS own, CASE WHEN o_orderstatus = 'P' THEN 1 END AS deleted_at,
    CASE WHEN o_custkey % 4 = 0 THEN 'Chat' ELSE 'Topic' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'm' || o_orderkey ELSE 'm' || (o_orderkey - 1) END AS reply_chain_id, o_orderkey % 17 = 0 AS own_mention,
    CASE o_orderkey % 5 WHEN 0 THEN 'Event/Call' WHEN 1 THEN 'ThreadActivity/AddMember' WHEN 2 THEN 'Control/Typing' ELSE 'RichText/Html' END AS message_type, CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey END AS number FROM orders JOIN customer ON c_custkey = o_custkey),
  act AS (SELECT m.account, m.conversation_id, m.message_id, CASE l_returnflag WHEN 'A' THEN 'mention' WHEN 'N' THEN 'reply' ELSE 'mentionInChat' END AS type, CASE WHEN l_linenumber % 2 = 0 THEN 'Person' ELSE 'channel' END AS subtype FROM lineitem JOIN msg m ON m.message_id = 'm' || l_orderkey)"""


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    text = lambda a, b: F.concat(F.lit(a), b.cast("string"))
    k, team = F.col("c_custkey"), F.col("n_nationkey")
    channels = c.select(
        text("a", F.col("c_nationkey") % 2).alias("account"), text("c", k).alias("id"), F.when(k % 4 == 0, "Chat").otherwise("Topic").alias("kind"), F.col("c_name").alias("name"), F.when(k % 3 == 0, "").otherwise(text("t", F.col("c_nationkey"))).alias("team_id"),
        (k * 1_000_000_000_000 % 800_000_000_000_000).alias("last_message_at"), F.when(F.col("c_acctbal") > 0, k % 30 * 31_000_000_000_000).alias("read_horizon_at"),
    )
    spaces = n.select(
        text("a", team % 2).alias("account"), text("t", team).alias("id"), F.when(F.col("n_regionkey") < 2, "Space").otherwise("Chat").alias("kind"), F.when(F.col("n_regionkey") == 3, "Same").otherwise(F.col("n_name")).alias("name"), F.lit("").alias("team_id"),
        (team * 10).cast("long").alias("last_message_at"), F.lit(None).cast("long").alias("read_horizon_at"),
    )
    return channels.unionByName(spaces)


def messages(spark: SparkSession, sf: str) -> DataFrame:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    text = lambda a, b: F.concat(F.lit(a), b.cast("string"))
    kind = F.when(k % 5 == 0, "Event/Call").when(k % 5 == 1, "ThreadActivity/AddMember").when(k % 5 == 2, "Control/Typing").otherwise("RichText/Html")
    return o.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).select(
        text("a", F.col("c_nationkey") % 2).alias("account"), text("c", F.col("o_custkey")).alias("conversation_id"), text("m", k).alias("message_id"), micros("o_orderdate").alias("sent_at"), F.col("o_orderpriority").startswith("1").alias("own"),
        F.when(F.col("o_orderstatus") == "P", 1).alias("deleted_at"), F.when(F.col("o_custkey") % 4 == 0, "Chat").otherwise("Topic").alias("kind"), F.when(k % 3 == 0, "").when(k % 3 == 1, text("m", k)).otherwise(text("m", k - 1)).alias("reply_chain_id"),
        (k % 17 == 0).alias("own_mention"), kind.alias("message_type"), F.when(k % 6 > 0, k).alias("number"),
    )


def activity(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(
        F.concat(F.lit("m"), F.col("l_orderkey").cast("string")).alias("message_id"), F.when(F.col("l_returnflag") == "A", "mention").when(F.col("l_returnflag") == "N", "reply").otherwise("mentionInChat").alias("type"), F.when(F.col("l_linenumber") % 2 == 0, "Person").otherwise("channel").alias("subtype")
    )
    return items.join(messages(spark, sf).select("account", "conversation_id", "message_id"), "message_id")


_TEAMS = _CHAT + """, t AS (SELECT t.account, t.id, t.name, (SELECT count(*) FROM conv x WHERE x.account = t.account AND x.team_id = t.id AND x.id <> t.id) AS channels, t.kind,
    (SELECT max(x.last_message_at) FROM conv x WHERE x.account = t.account AND (x.team_id = t.id OR x.id = t.id)) AS last_activity FROM conv t),
  u AS (SELECT c.account, CASE WHEN c.team_id <> '' THEN c.team_id ELSE c.id END AS id, count(*) AS unread FROM msg m JOIN conv c ON c.account = m.account AND c.id = m.conversation_id
    WHERE c.read_horizon_at IS NOT NULL AND m.sent_at > c.read_horizon_at AND m.deleted_at IS NULL AND NOT m.own GROUP BY 1, 2),
  teams AS (SELECT t.account, t.id, t.name, t.channels, t.last_activity, coalesce(u.unread, 0) AS unread FROM t LEFT JOIN u ON u.account = t.account AND u.id = t.id WHERE lower(t.kind) = 'space' OR t.channels > 0)"""


@query(_TEAMS + " SELECT * FROM teams")
def teams_list(spark: SparkSession, sf: str) -> DataFrame:
    """Spaces and inferred teams with their channels, newest activity and unread messages."""
    return C.teams(conversations(spark, sf), messages(spark, sf))


@query(
    _TEAMS + """, w AS (SELECT * FROM (VALUES ('same'), ('t1'), ('nation_4'), ('nobody')) v(wanted)), n AS (SELECT id, min(name) AS name FROM teams GROUP BY id),
    h AS (SELECT wanted, id, name, count(*) OVER (PARTITION BY wanted) AS matches, row_number() OVER (PARTITION BY wanted ORDER BY name, id) AS r FROM w JOIN n ON n.id = w.wanted OR lower(n.name) = lower(w.wanted))
    SELECT wanted, id, name, matches, matches > 3 AS more FROM h WHERE r <= 3"""
)
def team_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """Names and ids of teams; a shared name lists its candidates."""
    wanted = spark.createDataFrame([("same",), ("t1",), ("nation_4",), ("nobody",)], "wanted string")
    return C.resolve_teams(C.teams(conversations(spark, sf), messages(spark, sf)), wanted, 3)


@query(_CHAT + " SELECT c.id FROM conv c WHERE c.account = 'a1' AND (c.team_id = 't3' OR c.id = 't3')")
def team_scope(spark: SparkSession, sf: str) -> DataFrame:
    """One team: its own conversation and its channels, of one account."""
    return conversations(spark, sf).where("account = 'a1' AND (team_id = 't3' OR id = 't3')").select("id")


@query(
    _CHAT + """ SELECT message_id, own_mention OR EXISTS (SELECT 1 FROM act a WHERE a.message_id = m.message_id AND a.account = m.account AND a.conversation_id = m.conversation_id AND a.type LIKE 'mention%') AS mentions_me,
    own_mention OR EXISTS (SELECT 1 FROM act a WHERE a.message_id = m.message_id AND a.account = m.account AND a.conversation_id = m.conversation_id AND a.type LIKE 'mention%' AND lower(a.subtype) = 'person') AS direct_mention,
    lower(kind) IN ('topic', 'space') AND (reply_chain_id = '' OR reply_chain_id = message_id) AS thread_root,
    message_type NOT LIKE 'Event/%' AND message_type NOT LIKE 'ThreadActivity/%' AND message_type NOT IN ('Control/Typing', 'Control/ClearTyping') AS authored FROM msg m"""
)
def message_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.flags(messages(spark, sf), activity(spark, sf))
    return rows.select("message_id", "mentions_me", "direct_mention", "thread_root", "authored")


@query(
    _CHAT + """ SELECT account, count(*) FILTER (deleted_at IS NULL) AS items, count(*) FILTER (deleted_at IS NULL AND own) AS my_items, count(*) FILTER (deleted_at IS NOT NULL) AS deleted FROM msg
    WHERE sent_at >= 800000000000000 AND sent_at < 950000000000000 AND message_type = 'RichText/Html' GROUP BY account"""
)
def chat_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return C.evidence(messages(spark, sf), F.lit(800_000_000_000_000), F.lit(950_000_000_000_000))


@query(
    _CHAT + """, n AS (SELECT *, CASE WHEN sent_at < 800000000000000 THEN -1 WHEN sent_at >= 950000000000000 THEN 1 ELSE 0 END AS side FROM msg WHERE number IS NOT NULL),
    q AS (SELECT account, conversation_id, number AS q FROM n WHERE side = 0 UNION ALL SELECT account, conversation_id, max_by(number, (sent_at, number)) FROM n WHERE side = -1 GROUP BY 1, 2 UNION ALL SELECT account, conversation_id, min_by(number, (sent_at, number)) FROM n WHERE side = 1 GROUP BY 1, 2),
    g AS (SELECT account, conversation_id, greatest(0, q - lag(q) OVER (PARTITION BY account, conversation_id ORDER BY q) - 1) AS gap FROM q)
    SELECT account, conversation_id, CAST(coalesce(sum(gap), 0) AS BIGINT) AS missing FROM g GROUP BY 1, 2"""
)
def gaps_around_range(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers missing in a range and next to it: the nearest numbered message on either side counts."""
    return C.sequence_gaps(messages(spark, sf), ["account", "conversation_id"], "number", "sent_at", F.lit(800_000_000_000_000), F.lit(950_000_000_000_000))


@query(_CHAT + " SELECT account, min(sent_at) AS oldest, max(sent_at) AS newest, count(DISTINCT conversation_id) AS groups FROM msg WHERE deleted_at IS NULL GROUP BY account")
def message_window(spark: SparkSession, sf: str) -> DataFrame:
    """Oldest and newest message of an account, and in how many conversations."""
    return messages(spark, sf).where("deleted_at IS NULL").groupBy("account").agg(F.min("sent_at").alias("oldest"), F.max("sent_at").alias("newest"), F.count_distinct("conversation_id").alias("groups"))


@query(
    """WITH s AS (SELECT 't' AS tenant_id, 'u' || c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'de' END AS locale, 5 AS first_seen_at, 6 AS last_synced_at FROM customer WHERE c_acctbal > 0),
    b AS (SELECT 't' AS tenant_id, 'u' || c_custkey AS user_id, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'fr' END AS locale FROM customer WHERE c_nationkey < 15)
    SELECT tenant_id, user_id, coalesce(nullif(b.locale, ''), s.locale, b.locale) AS locale, coalesce(first_seen_at, 9) AS first_seen_at, CASE WHEN b.locale IS NOT NULL THEN 9 ELSE last_synced_at END AS last_synced_at FROM s FULL JOIN b USING (tenant_id, user_id)"""
)
def account_upsert(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.lit("t").alias("tenant_id"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id"), "c_custkey", "c_acctbal", "c_nationkey")
    stored = c.where("c_acctbal > 0").select("tenant_id", "user_id", F.when(F.col("c_custkey") % 3 == 0, "").otherwise("de").alias("locale"), F.lit(5).alias("first_seen_at"), F.lit(6).alias("last_synced_at"))
    batch = c.where("c_nationkey < 15").select("tenant_id", "user_id", F.when(F.col("c_custkey") % 2 == 0, "").otherwise("fr").alias("locale"))
    return C.upsert_accounts(stored, batch, F.lit(9))


@query(
    """WITH s AS (SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 10 END AS h, CASE WHEN c_custkey % 3 > 0 THEN 'x' || c_custkey ELSE '' END AS m FROM customer WHERE c_acctbal > 0),
    b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) || '!' ELSE c_name END AS title, CASE WHEN c_custkey % 2 > 0 THEN c_custkey % 20 END AS h, CASE WHEN c_custkey % 6 = 0 THEN 'y' ELSE '' END AS m FROM customer WHERE c_nationkey < 18),
    j AS (SELECT id, s.id IS NOT NULL AS old, b.id IS NOT NULL AS fresh, s.title AS st, b.title AS bt, s.h AS sh, coalesce(b.h, s.h) AS bh, s.m AS sm, CASE WHEN s.id IS NOT NULL AND coalesce(b.m, '') = '' AND coalesce(b.h, s.h) IS NOT DISTINCT FROM s.h THEN s.m ELSE b.m END AS bm FROM s FULL JOIN b USING (id))
    SELECT id, CASE WHEN fresh THEN bt ELSE st END AS title, CASE WHEN fresh THEN bh ELSE sh END AS read_horizon_at, CASE WHEN fresh THEN bm ELSE sm END AS read_horizon_client_message_id,
    CASE WHEN NOT fresh THEN 'kept' WHEN NOT old THEN 'new' WHEN bt IS NOT DISTINCT FROM st AND bh IS NOT DISTINCT FROM sh AND bm IS NOT DISTINCT FROM sm THEN 'unchanged' ELSE 'edited' END AS change FROM j"""
)
def conversation_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A known read marker is not forgotten by a snapshot without one."""
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    names = ["id", "title", "read_horizon_at", "read_horizon_client_message_id"]
    stored = c.where("c_acctbal > 0").select(k, "c_name", F.when(k % 4 > 0, k % 10), F.when(k % 3 > 0, F.concat(F.lit("x"), k.cast("string"))).otherwise("")).toDF(*names)
    batch = c.where("c_nationkey < 18").select(k, F.when(k % 5 == 0, F.concat(F.upper("c_name"), F.lit("!"))).otherwise(F.col("c_name")), F.when(k % 2 > 0, k % 20), F.when(k % 6 == 0, "y").otherwise("")).toDF(*names)
    return C.upsert_conversations(stored, batch, ["id"], ["title"])


@query(
    """WITH s AS (SELECT event_id AS id, event_type AS type, event_id % 2 = 0 AS is_read FROM events WHERE event_id % 3 > 0), b AS (SELECT event_id AS id, CASE WHEN value > 50 THEN 'other' ELSE event_type END AS type, event_id % 4 < 2 AS is_read FROM events WHERE event_id % 5 > 0)
    SELECT change, count(*) AS n FROM (SELECT CASE WHEN b.id IS NULL THEN 'kept' WHEN s.id IS NULL THEN 'new' WHEN s.type = b.type AND s.is_read = b.is_read THEN 'unchanged' ELSE 'edited' END AS change FROM s FULL JOIN b USING (id)) GROUP BY change"""
)
def activity_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e, k = table(spark, sf, "events"), F.col("event_id")
    stored = e.where(k % 3 > 0).select(k.alias("id"), F.col("event_type").alias("type"), (k % 2 == 0).alias("is_read"))
    batch = e.where(k % 5 > 0).select(k.alias("id"), F.when(F.col("value") > 50, "other").otherwise(F.col("event_type")).alias("type"), (k % 4 < 2).alias("is_read"))
    return C.gated(stored, batch, ["id"], ["type", "is_read"]).groupBy("change").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT p_partkey AS k, p_name AS value, 5 AS updated_at, CASE WHEN p_partkey % 7 = 0 THEN 4 END AS removed_at FROM part WHERE p_size < 40), b AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN p_name ELSE p_brand END AS value FROM part WHERE p_size > 10),
    j AS (SELECT k, s.k IS NOT NULL AS old, b.k IS NOT NULL AS fresh, s.value AS sv, b.value AS bv, updated_at, removed_at FROM s FULL JOIN b USING (k)),
    c AS (SELECT *, CASE WHEN NOT fresh THEN 'kept' WHEN NOT old THEN 'new' WHEN (bv IS NOT NULL AND bv IS DISTINCT FROM sv) OR removed_at IS NOT NULL THEN 'edited' ELSE 'unchanged' END AS change FROM j)
    SELECT k, CASE WHEN fresh AND bv IS NOT NULL THEN bv ELSE sv END AS value, CASE WHEN change IN ('new', 'edited') THEN 9 ELSE updated_at END AS updated_at, CASE WHEN NOT fresh THEN removed_at END AS removed_at, change FROM c"""
)
def record_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A value that didn't decode never overwrites; a sighting lifts a removal."""
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    stored = p.where("p_size < 40").select(k.alias("k"), F.col("p_name").alias("value"), F.lit(5).alias("updated_at"), F.when(k % 7 == 0, 4).alias("removed_at"))
    batch = p.where("p_size > 10").select(k.alias("k"), F.when(k % 3 == 1, F.col("p_name")).when(k % 3 == 2, F.col("p_brand")).alias("value"))
    return C.upsert_records(stored, batch, ["k"], "value", "removed_at", F.lit(9))
