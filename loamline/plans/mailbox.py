"""The mailbox: orders stand for messages, line items for recipients and further folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import mail as M
from ..operators import merge as R
from ..sources.archive import table
from .registry import query

_MAIL = """WITH mail AS (SELECT o_orderkey AS id, 'a' || ((o_orderkey // 8) % 3) AS account, 'm' || o_orderkey AS message_id, CASE WHEN o_orderkey % 4 IN (1, 2) THEN 'm' || (o_orderkey - 1) ELSE '' END AS in_reply_to,
    CASE WHEN o_orderkey % 5 = 0 THEN 'c' || (o_orderkey // 40) ELSE '' END AS conversation_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS folder_key, o_orderpriority || (o_custkey % 50) AS subject_norm,
    'Clerk ' || (o_custkey % 40) AS sender_name, 'Clerk' || (o_custkey % 40) || '@x' AS sender_address, epoch_us(o_orderdate) AS received_at, o_orderstatus = 'F' AS is_read, CASE WHEN o_totalprice > 250000 THEN 'flagged' ELSE '' END AS flag,
    o_orderkey % 7 = 0 AS has_attachments, CASE WHEN o_orderkey % 11 = 0 THEN 1 END AS gone_at, CASE WHEN o_orderkey % 13 = 0 THEN 1 END AS evicted_at FROM orders),
  recipients AS (SELECT DISTINCT l_orderkey AS id, 'Clerk' || (l_suppkey % 40) || '@X' AS address, CASE WHEN l_suppkey % 3 > 0 THEN 'Supplier ' || (l_suppkey % 40) ELSE '' END AS name FROM lineitem),
  members AS (SELECT DISTINCT l_orderkey AS id, 2 AS folder_key, l_linenumber % 2 = 0 AS is_read FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45),
  folders AS (SELECT a.account, f.* FROM (SELECT DISTINCT account FROM mail) a, (VALUES (1, 'Inbox', 'inbox'), (2, 'Reports', 'other'), (3, 'Sent Items', 'sent'), (4, 'INBOX', 'archive')) f(folder_key, name, kind))"""
FOLDERS = [(1, "Inbox", "inbox"), (2, "Reports", "other"), (3, "Sent Items", "sent"), (4, "INBOX", "archive")]


def mail(spark: SparkSession, sf: str) -> DataFrame:
    k, c, text = F.col("o_orderkey"), F.col("o_custkey"), lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p))
    return table(spark, sf, "orders").select(
        k.alias("id"), text("a", F.floor(k / 8) % 3).alias("account"), text("m", k).alias("message_id"), F.when((k % 4).isin(1, 2), text("m", k - 1)).otherwise("").alias("in_reply_to"),
        F.when(k % 5 == 0, text("c", F.floor(k / 40))).otherwise("").alias("conversation_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("folder_key"), F.concat("o_orderpriority", (c % 50).cast("string")).alias("subject_norm"),
        text("Clerk ", c % 40).alias("sender_name"), text("Clerk", c % 40, "@x").alias("sender_address"), micros("o_orderdate").alias("received_at"), (F.col("o_orderstatus") == "F").alias("is_read"),
        F.when(F.col("o_totalprice") > 250000, "flagged").otherwise("").alias("flag"), (k % 7 == 0).alias("has_attachments"), F.when(k % 11 == 0, 1).alias("gone_at"), F.when(k % 13 == 0, 1).alias("evicted_at"),
    )


def recipients(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("l_suppkey") % 40
    name = F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("Supplier "), s.cast("string"))).otherwise("")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("Clerk"), s.cast("string"), F.lit("@X")).alias("address"), name.alias("name")).distinct()


def members(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where("l_returnflag = 'A' AND l_quantity > 45").select(F.col("l_orderkey").alias("id"), F.lit(2).alias("folder_key"), (F.col("l_linenumber") % 2 == 0).alias("is_read")).distinct()


def folders(spark: SparkSession, sf: str) -> DataFrame:
    listed = spark.createDataFrame(FOLDERS, "folder_key int, name string, kind string")
    return mail(spark, sf).select("account").distinct().crossJoin(F.broadcast(listed))  # four rows


@query(
    _MAIL + """ SELECT id, account FROM mail m WHERE gone_at IS NULL AND evicted_at IS NULL AND flag = 'flagged' AND (lower(sender_name) LIKE '%clerk1%' OR lower(sender_address) LIKE '%clerk1%')
    AND received_at >= 700000000000000 AND (NOT is_read OR EXISTS (SELECT 1 FROM members u WHERE u.id = m.id AND NOT u.is_read))"""
)
def mail_list(spark: SparkSession, sf: str) -> DataFrame:
    """Unread, flagged, by sender, since a time; neither gone nor evicted."""
    rows = M.filtered(mail(spark, sf), folders(spark, sf), members(spark, sf), sender="clerk1", unread=True, flagged=True, since=F.lit(700_000_000_000_000))
    return rows.select("id", "account")


@query(
    _MAIL + """ SELECT id FROM mail m WHERE account = 'a1' AND has_attachments AND evicted_at IS NULL AND ((folder_key IN (1, 4) AND NOT is_read) OR EXISTS (SELECT 1 FROM members u WHERE u.id = m.id AND u.folder_key IN (1, 4) AND NOT u.is_read))"""
)
def mail_folder_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """'inbox' is a name of two folders here, so the kind doesn't count; unread is judged in these folders."""
    rows = M.filtered(mail(spark, sf), folders(spark, sf), members(spark, sf), account="a1", folder="inbox", unread=True, attachments=True, gone=True)
    return rows.select("id")


@query(_MAIL + " SELECT id FROM mail m WHERE gone_at IS NULL AND evicted_at IS NULL AND (folder_key = 2 OR EXISTS (SELECT 1 FROM members u WHERE u.id = m.id AND u.folder_key = 2))")
def mail_folder_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """No folder is named 'other', so the kind counts; further folders of a message do too."""
    return M.filtered(mail(spark, sf), folders(spark, sf), members(spark, sf), folder="Other").select("id")


@query(_MAIL + " SELECT id FROM mail m WHERE gone_at IS NULL AND evicted_at IS NULL AND NOT EXISTS (SELECT 1 FROM folders f WHERE f.account = m.account AND f.folder_key = m.folder_key)")
def mail_folder_unknown(spark: SparkSession, sf: str) -> DataFrame:
    return M.filtered(mail(spark, sf), folders(spark, sf), members(spark, sf), folder="unknown").select("id")


@query(_MAIL + " SELECT account, folder_key, name, CASE kind WHEN 'inbox' THEN 0 WHEN 'sent' THEN 3 WHEN 'archive' THEN 4 ELSE 5 END AS kind_rank FROM folders")
def mail_folder_order(spark: SparkSession, sf: str) -> DataFrame:
    f = folders(spark, sf)
    return f.select("account", "folder_key", "name", M.kind_rank(F.col("kind")).alias("kind_rank"))


_PAIRS = _MAIL + ", p AS (SELECT id, account, folder_key, 'p' || (id // 4) AS message_id, received_at AS seen_at FROM mail), c AS (SELECT account, message_id, max_by(id, (seen_at, id)) AS stands_for FROM p WHERE folder_key <= 2 GROUP BY 1, 2)"


def _pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Messages of which up to four share a Message-ID; folders 1 and 2 are the current set."""
    m = mail(spark, sf).select("id", "account", "folder_key", F.concat(F.lit("p"), F.floor(F.col("id") / 4).cast("string")).alias("message_id"), F.col("received_at").alias("seen_at"))
    return m, folders(spark, sf).where("folder_key <= 2").select("account", "folder_key")


@query(_PAIRS + " SELECT p.id, c.stands_for FROM p JOIN c USING (account, message_id) WHERE folder_key > 2")
def mail_copies(spark: SparkSession, sf: str) -> DataFrame:
    return M.copies(*_pairs(spark, sf))


@query(_PAIRS + " SELECT p.id FROM p LEFT JOIN c USING (account, message_id) WHERE folder_key <= 2 OR c.stands_for IS NULL")
def mail_not_copy(spark: SparkSession, sf: str) -> DataFrame:
    return M.without_copies(*_pairs(spark, sf)).select("id")


@query(
    _MAIL.replace("WITH mail", "WITH RECURSIVE mail") + """, seed AS (SELECT * FROM mail WHERE id % 100 = 0 OR id % 100 = 33),
  conv AS (SELECT s.id AS seed, m.id, 0 AS rank FROM seed s JOIN mail m ON m.account = s.account AND m.conversation_id = s.conversation_id AND m.id <> s.id WHERE s.conversation_id <> ''),
  links AS (SELECT r.id AS a, p.id AS b FROM mail r JOIN mail p ON p.account = r.account AND p.message_id = r.in_reply_to WHERE r.in_reply_to <> ''), sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  walk(seed, id) AS (SELECT id, id FROM seed UNION SELECT w.seed, b.b FROM walk w JOIN sides b ON b.a = w.id), reply AS (SELECT seed, id, 1 AS rank FROM walk WHERE id <> seed),
  addr AS (SELECT id, lower(sender_address) AS address FROM mail UNION SELECT id, lower(address) FROM recipients),
  subj AS (SELECT DISTINCT s.id AS seed, m.id, 2 AS rank FROM seed s JOIN addr x ON x.id = s.id JOIN mail m ON m.account = s.account AND m.subject_norm = s.subject_norm AND m.id <> s.id JOIN addr y ON y.id = m.id AND y.address = x.address),
  every AS (SELECT * FROM conv UNION ALL SELECT * FROM reply UNION ALL SELECT * FROM subj), best AS (SELECT seed, min(rank) AS rank FROM every GROUP BY seed),
  found AS (SELECT seed, id, rank FROM every JOIN best USING (seed, rank) UNION ALL SELECT s.id, s.id, coalesce(b.rank, 2) FROM seed s LEFT JOIN best b ON b.seed = s.id),
  ranked AS (SELECT f.*, received_at, row_number() OVER (PARTITION BY seed ORDER BY f.id = seed DESC, received_at DESC, f.id DESC) AS n, count(*) OVER (PARTITION BY seed) AS c FROM found f JOIN mail m ON m.id = f.id)
  SELECT seed, id, CAST(row_number() OVER (PARTITION BY seed ORDER BY received_at, id) AS INT) AS position, CASE rank WHEN 0 THEN 'conversation' WHEN 1 THEN 'reply_chain' ELSE 'subject' END AS "grouping", c > 5 AS truncated FROM ranked WHERE n <= 5"""
)
def mail_thread(spark: SparkSession, sf: str) -> DataFrame:
    """The threads of every hundredth message and of those that end in 33, at most five messages each."""
    m = mail(spark, sf)
    return M.threads(m, recipients(spark, sf), m.where("id % 100 = 0 OR id % 100 = 33").select("id"), cap=5)


_SIDES = """, named AS (SELECT account, id, is_read, CASE WHEN id % 7 = 0 THEN '' WHEN id % 11 = 0 THEN 'shared' || id // 22 ELSE 'm' || id END AS mid FROM mail),
  s AS (SELECT account, id AS detail_key, mid AS message_id, id % 50 AS state_seen_at, CASE WHEN id % 3 = 0 THEN '' ELSE 'body ' || id END AS body, is_read FROM named WHERE NOT is_read OR id % 4 >= 2),
  n AS (SELECT account, CASE WHEN id % 3 = 1 THEN id ELSE id + 1000000 END AS detail_key, CASE WHEN id % 5 = 0 AND mid <> '' THEN mid || 'x' WHEN id % 13 = 0 THEN '' ELSE mid END AS message_id, id % 70 AS state_seen_at, 'new ' || id AS body, id % 2 = 0 AS is_read FROM named WHERE id % 4 < 2),
  so AS (SELECT account, message_id, min(detail_key) AS was FROM s WHERE message_id <> '' AND NOT EXISTS (SELECT 1 FROM n WHERE n.account = s.account AND n.detail_key = s.detail_key) GROUP BY 1, 2 HAVING count(*) = 1),
  no AS (SELECT account, message_id, min(detail_key) AS detail_key FROM n WHERE message_id <> '' AND NOT EXISTS (SELECT 1 FROM s WHERE n.account = s.account AND n.detail_key = s.detail_key) GROUP BY 1, 2 HAVING count(*) = 1),
  r AS (SELECT account, was, detail_key FROM so JOIN no USING (account, message_id)), k AS (SELECT n.*, coalesce(r.was, n.detail_key) AS was FROM n LEFT JOIN r USING (account, detail_key)),
  j AS (SELECT coalesce(s.account, k.account) AS account, s.message_id AS sm, k.message_id AS nm, s.detail_key AS sd, k.detail_key AS nd, s.state_seen_at AS st, k.state_seen_at AS nt, s.body AS sb, k.body AS nb, s.is_read AS sr, k.is_read AS nr,
    coalesce(s.message_id <> '' AND k.message_id <> '' AND s.message_id <> k.message_id, false) AS swap FROM s FULL JOIN k ON k.account = s.account AND k.was = s.detail_key),
  l AS (SELECT *, swap OR coalesce(nt > st, sd IS NULL) AS later FROM j),
  o AS (SELECT *, coalesce(nd, sd) AS detail_key, CASE WHEN swap THEN nm ELSE coalesce(nullif(sm, ''), nm, sm) END AS message_id, CASE WHEN later THEN nt ELSE st END AS state_seen_at, CASE WHEN swap THEN nb ELSE coalesce(nullif(sb, ''), nb, sb) END AS body, CASE WHEN later THEN nr ELSE sr END AS is_read FROM l),
  c AS (SELECT account, detail_key, message_id, state_seen_at, body, is_read, sd AS was, CASE WHEN nd IS NULL THEN NULL WHEN sd IS NULL THEN 'new' WHEN swap THEN 'replaced'
    WHEN detail_key IS DISTINCT FROM sd OR message_id IS DISTINCT FROM sm OR state_seen_at IS DISTINCT FROM st OR body IS DISTINCT FROM sb OR is_read IS DISTINCT FROM sr THEN 'updated' ELSE 'unchanged' END AS change FROM o)"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Unread messages and half of the others are stored; another read brings half of the mailbox, a third of it under the same detail keys, some with another Message-ID or none."""
    m, k = mail(spark, sf), F.col("id")
    mid = F.when(k % 7 == 0, "").when(k % 11 == 0, F.concat(F.lit("shared"), F.floor(k / 22).cast("string"))).otherwise(F.concat(F.lit("m"), k.cast("string")))
    other = F.when((k % 5 == 0) & (mid != ""), F.concat(mid, F.lit("x"))).when(k % 13 == 0, "").otherwise(mid)
    stored = m.where(~F.col("is_read") | (k % 4 >= 2)).select("account", k.alias("detail_key"), mid.alias("message_id"), (k % 50).alias("state_seen_at"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("body "), k.cast("string"))).alias("body"), "is_read")
    batch = m.where(k % 4 < 2).select("account", F.when(k % 3 == 1, k).otherwise(k + 1_000_000).alias("detail_key"), other.alias("message_id"), (k % 70).alias("state_seen_at"), F.concat(F.lit("new "), k.cast("string")).alias("body"), (k % 2 == 0).alias("is_read"))
    return stored, batch


@query(_MAIL + _SIDES + " SELECT * FROM c")
def mail_commit(spark: SparkSession, sf: str) -> DataFrame:
    """Another read of half of the mailbox: matched by detail key, then by Message-ID, some replaced."""
    return M.commit(*_sides(spark, sf), ["body"], ["is_read"])


@query(
    _MAIL + _SIDES + """, sk AS (SELECT account, detail_key, 'to ' || body AS address FROM s WHERE detail_key % 6 <> 0), nk AS (SELECT account, detail_key, 'cc ' || body AS address FROM n),
  mine AS (SELECT sk.account, c.detail_key, address FROM sk JOIN c ON c.account = sk.account AND c.was = sk.detail_key WHERE change IS NULL OR change <> 'replaced')
  SELECT * FROM mine UNION ALL SELECT nk.* FROM nk JOIN c USING (account, detail_key) WHERE change IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mine WHERE mine.account = nk.account AND mine.detail_key = nk.detail_key)"""
)
def mail_commit_recipients(spark: SparkSession, sf: str) -> DataFrame:
    """The recipients that the same commit leaves, under the messages' new keys."""
    stored, batch = _sides(spark, sf)
    kids = lambda df, word: df.select("account", "detail_key", F.concat(F.lit(word), "body").alias("address"))
    return M.commit_children(kids(stored, "to ").where("detail_key % 6 <> 0"), kids(batch, "cc "), M.commit(stored, batch, ["body"], ["is_read"]))


@query(
    _MAIL + """, t AS (SELECT id, sender_address AS address, sender_name AS name, received_at FROM mail WHERE gone_at IS NULL UNION ALL SELECT r.id, address, name, received_at FROM recipients r JOIN mail m ON m.id = r.id WHERE gone_at IS NULL)
  SELECT lower(address) AS address, max_by(name, (received_at, name)) FILTER (name <> '') AS name, count(DISTINCT id) AS messages, min(received_at) AS first_seen, max(received_at) AS last_seen FROM t GROUP BY 1"""
)
def mail_correspondents(spark: SparkSession, sf: str) -> DataFrame:
    return M.correspondents(mail(spark, sf), recipients(spark, sf))


@query(
    _MAIL + """, t AS (SELECT id, CASE WHEN id % 37 = 0 THEN received_at + (id % 5 - 2) * 86400000000 ELSE received_at END AS "at" FROM mail), w AS (SELECT * FROM t WHERE "at" >= 800000000000000 AND "at" < 900000000000000)
  SELECT id, "at", (SELECT count(*) FROM w) > 200 AS truncated FROM w ORDER BY "at" DESC, id DESC LIMIT 200"""
)
def mail_chosen_times(spark: SparkSession, sf: str) -> DataFrame:
    """The newest two hundred messages of a range by their chosen times: some stored times were corrected, into the range or out of it."""
    m = mail(spark, sf)
    chosen = m.where("id % 37 = 0").select("id", (F.col("received_at") + (F.col("id") % 5 - 2) * 86_400_000_000).alias("chosen_at"))
    return M.newest_chosen(m, chosen, 200, 800_000_000_000_000, 900_000_000_000_000).select("id", "at", "truncated")


@query(
    _MAIL + """, s AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'g' || id END AS graph, sender_address, CASE WHEN id % 9 > 0 THEN received_at END AS received_at, subject_norm, account FROM mail WHERE id % 5 > 0),
  n AS (SELECT 'g' || id AS item, sender_address, CASE WHEN id % 7 > 0 THEN received_at END AS received_at, CASE WHEN id % 6 > 0 THEN subject_norm ELSE 'changed' END AS subject_norm, account FROM mail WHERE id % 3 > 0 OR id % 5 = 0),
  d0 AS (SELECT n.item, s.id FROM n JOIN s ON s.graph = n.item),
  n1 AS (SELECT * FROM n WHERE item NOT IN (SELECT item FROM d0) AND received_at IS NOT NULL), s1 AS (SELECT * FROM s WHERE graph IS NULL AND received_at IS NOT NULL),
  m1 AS (SELECT * FROM (SELECT account, sender_address, received_at, subject_norm, count(*) AS c, min(item) AS item FROM n1 GROUP BY 1, 2, 3, 4) JOIN (SELECT account, sender_address, received_at, subject_norm, count(*) AS k, min(id) AS id FROM s1 GROUP BY 1, 2, 3, 4) USING (account, sender_address, received_at, subject_norm)),
  u1 AS (SELECT n1.item FROM n1 JOIN m1 USING (account, sender_address, received_at, subject_norm) WHERE c > 1 OR k > 1), d1 AS (SELECT item, id FROM m1 WHERE c = 1 AND k = 1),
  n2 AS (SELECT * FROM n1 WHERE item NOT IN (SELECT item FROM d1)), s2 AS (SELECT * FROM s1 WHERE id NOT IN (SELECT id FROM d1)),
  m2 AS (SELECT * FROM (SELECT account, sender_address, received_at, count(*) AS c, min(item) AS item FROM n2 GROUP BY 1, 2, 3) JOIN (SELECT account, sender_address, received_at, count(*) AS k, min(id) AS id FROM s2 GROUP BY 1, 2, 3) USING (account, sender_address, received_at)),
  u2 AS (SELECT n2.item FROM n2 JOIN m2 USING (account, sender_address, received_at) WHERE c > 1 OR k > 1), d2 AS (SELECT item, id FROM m2 WHERE c = 1 AND k = 1),
  d AS (SELECT *, 'in_place' AS state FROM d0 UNION ALL SELECT *, 'matched' FROM d1 UNION ALL SELECT *, 'matched' FROM d2)
  SELECT n.item, d.id, coalesce(d.state, CASE WHEN n.item IN (SELECT item FROM u1 UNION SELECT item FROM u2) THEN 'deferred' ELSE 'new' END) AS state FROM n LEFT JOIN d USING (item)"""
)
def mail_window_admission(spark: SparkSession, sf: str) -> DataFrame:
    """A server's window of mail against the stored mail: by id, then by sender, time and subject, then without the subject, each only where both sides are unique."""
    m, k = mail(spark, sf), F.col("id")
    graph = F.concat(F.lit("g"), k.cast("string"))
    stored = m.where(k % 5 > 0).select("id", F.when(k % 4 == 0, graph).alias("graph"), "account", "sender_address", F.when(k % 9 > 0, F.col("received_at")).alias("received_at"), "subject_norm")
    window = m.where((k % 3 > 0) | (k % 5 == 0)).select(graph.alias("item"), "account", "sender_address", F.when(k % 7 > 0, F.col("received_at")).alias("received_at"), F.when(k % 6 > 0, F.col("subject_norm")).otherwise("changed").alias("subject_norm"))
    return R.admit_window(stored, window, "id", "item", "graph", [["account", "sender_address", "received_at", "subject_norm"], ["account", "sender_address", "received_at"]])
