"""Counts, windows, set operations, intervals and joins by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.times import micros
from ..operators import coverage, intervals, joins, merge
from ..sources.archive import table
from .registry import query

HOUR = 3_600_000_000
DAY = 24 * HOUR


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("ts_us"))


_E = "WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS ts_us FROM events)"


@query(
    _E + """, h AS (SELECT user_id, max(ts_us) AS horizon FROM e WHERE event_type = 'view' GROUP BY user_id)
    SELECT e.user_id, count(*) AS unread, min(ts_us) AS oldest, max(ts_us) AS newest, max_by(event_id, ts_us) AS newest_id FROM e JOIN h USING (user_id) WHERE ts_us > horizon AND event_type <> 'click' GROUP BY e.user_id"""
)
def unread_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """What came after each user's last view, their own clicks aside."""
    e = events(spark, sf)
    horizon = e.where("event_type = 'view'").groupBy("user_id").agg(F.max("ts_us").alias("horizon"))
    rows = e.join(horizon, "user_id").where(P.unread(F.col("ts_us"), F.col("horizon"), F.col("event_type") == "click"))
    return rows.groupBy("user_id").agg(F.count("*").alias("unread"), F.min("ts_us").alias("oldest"), F.max("ts_us").alias("newest"), F.max_by("event_id", "ts_us").alias("newest_id"))


@query("SELECT c.conv_id, length(c.text) AS root_length, count(r.turn) AS replies, max(r.turn) AS last_turn FROM conversations c LEFT JOIN conversations r ON r.conv_id = c.conv_id AND r.turn > 0 WHERE c.turn = 0 GROUP BY c.conv_id, c.text")
def reply_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    replies = c.where("turn > 0").groupBy("conv_id").agg(F.count("*").alias("replies"), F.max("turn").alias("last_turn"))
    roots = c.where("turn = 0").select("conv_id", F.length("text").cast("long").alias("root_length"))
    return roots.join(replies, "conv_id", "left").withColumn("replies", F.coalesce("replies", F.lit(0)))


@query("SELECT l_shipmode_key AS store, count(*) - count(removed) AS live, count(removed) AS removed, max(seen) AS last_update FROM (SELECT l_suppkey % 7 AS l_shipmode_key, CASE WHEN l_returnflag = 'R' THEN 1 END AS removed, epoch_us(l_shipdate) AS seen FROM lineitem) GROUP BY 1")
def live_removed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 7).alias("store"), F.when(F.col("l_returnflag") == "R", 1).alias("removed"), micros("l_shipdate").alias("seen"))
    return rows.groupBy("store").agg((F.count("*") - F.count("removed")).alias("live"), F.count("removed").alias("removed"), F.max("seen").alias("last_update"))


@query("SELECT count(*) AS messages, count(DISTINCT user_id) AS senders, count(DISTINCT CASE WHEN event_type = 'error' THEN user_id END) AS failing, count(DISTINCT CASE WHEN value > 50 THEN user_id END) AS heavy, count(DISTINCT CAST(ts AS DATE)) AS days FROM events")
def breadth(spark: SparkSession, sf: str) -> DataFrame:
    """Several distinct counts in one pass."""
    e = table(spark, sf, "events")
    who = lambda c: F.countDistinct(F.when(c, F.col("user_id")))
    return e.agg(F.count("*").alias("messages"), F.countDistinct("user_id").alias("senders"), who(F.col("event_type") == "error").alias("failing"), who(F.col("value") > 50).alias("heavy"), F.countDistinct(F.to_date("ts")).alias("days"))


@query(_E + " SELECT user_id, min(ts_us) AS first_seen, max(ts_us) AS last_seen, max_by(name, (ts_us, name)) FILTER (name <> '') AS name FROM (SELECT user_id, ts_us, CASE event_type WHEN 'error' THEN '' ELSE event_type END AS name FROM e) GROUP BY user_id")
def people_latest(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).withColumn("name", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")))
    return merge.people(e, ["user_id"], "ts_us", "name")


@query("SELECT lang, n_chars, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY lang, n_chars HAVING count(*) > 1")
def having_dupes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT conv_id, string_agg(role || '=' || length(text), ' ' ORDER BY turn) AS told, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id")
def ordered_concat(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("parts"), F.countDistinct("role").alias("roles"))
    return c.select("conv_id", F.array_join(F.transform("parts", lambda x: F.concat(x["role"], F.lit("="), x["n"].cast("string"))), " ").alias("told"), "roles")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY first_turn) AS participants FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def participants_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct participants by first appearance."""
    parts = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("p"))
    return parts.select("conv_id", F.array_join(F.array_distinct(F.transform("p", lambda x: x["role"])), ",").alias("participants"))


@query(
    _E + """, q AS (SELECT user_id, event_id // 50 AS number FROM e WHERE event_type <> 'error'), d AS (SELECT DISTINCT user_id, number FROM q WHERE number > 0),
    l AS (SELECT *, number - lag(number) OVER (PARTITION BY user_id ORDER BY number) - 1 AS step FROM d)
    SELECT user_id, CAST(coalesce(sum(step), 0) AS BIGINT) AS missing, count(*) AS numbers FROM l GROUP BY user_id"""
)
def sequence_gap(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).where("event_type <> 'error'").select("user_id", F.floor(F.col("event_id") / 50).alias("number"))
    return intervals.sequence_gaps(rows, ["user_id"], "number")


@query(
    """SELECT o_custkey, count(DISTINCT date_trunc('month', o_orderdate)) AS occurrences, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS shared_key,
    epoch_us(min(o_orderdate)) AS first_start, epoch_us(max(o_orderdate)) AS last_start FROM orders GROUP BY o_custkey"""
)
def series_bounds(spark: SparkSession, sf: str) -> DataFrame:
    one = F.when(F.countDistinct("o_orderpriority") == 1, F.min("o_orderpriority"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.countDistinct(F.date_trunc("month", "o_orderdate")).alias("occurrences"), one.alias("shared_key"), micros(F.min("o_orderdate")).alias("first_start"), micros(F.max("o_orderdate")).alias("last_start"))


@query("SELECT o_orderstatus, max(epoch_us(l_shipdate) - epoch_us(o_orderdate)) // 1000 AS max_delay_ms, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
def max_delay(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("o_orderstatus").agg(F.floor(F.max(micros("l_shipdate") - micros("o_orderdate")) / 1000).alias("max_delay_ms"), F.count("*").alias("n"))


@query(
    """WITH m AS (SELECT 'a' AS side, c_nationkey AS folder, c_custkey AS id FROM customer UNION ALL SELECT 'b', s_nationkey, s_suppkey FROM supplier)
    SELECT folder, count(*) AS items, count(*) FILTER (side = 'a') AS from_a, count(DISTINCT id) AS ids FROM m GROUP BY folder"""
)
def union_parts(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.lit("a").alias("side"), F.col("c_nationkey").alias("folder"), F.col("c_custkey").alias("id"))
    b = table(spark, sf, "supplier").select(F.lit("b").alias("side"), F.col("s_nationkey").alias("folder"), F.col("s_suppkey").alias("id"))
    return a.unionByName(b).groupBy("folder").agg(F.count("*").alias("items"), F.count(F.when(F.col("side") == "a", 1)).alias("from_a"), F.countDistinct("id").alias("ids"))


@query("SELECT user_id AS account FROM events UNION SELECT o_custkey FROM orders UNION SELECT s_suppkey FROM supplier")
def union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """The accounts that any table names."""
    e, o, s = table(spark, sf, "events").select(F.col("user_id").alias("account")), table(spark, sf, "orders").select("o_custkey"), table(spark, sf, "supplier").select("s_suppkey")
    return e.union(o).union(s).distinct()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'")
def seen_diff(spark: SparkSession, sf: str) -> DataFrame:
    seen = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey").join(seen, "o_orderkey", "left_anti").distinct()


@query(
    _E + """, m AS (SELECT user_id, event_type AS name, max_by(event_id, (ts_us, event_id)) AS entry FROM e GROUP BY user_id, event_type)
    SELECT user_id, string_agg(name || ':' || entry, ',' ORDER BY name) AS attendees FROM m GROUP BY user_id"""
)
def list_union(spark: SparkSession, sf: str) -> DataFrame:
    """Two sources' lists united by name; the newest entry of a name stays."""
    e = events(spark, sf)
    rows = e.where("event_id % 2 = 0").unionByName(e.where("event_id % 2 = 1"))
    kept = rows.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts_us", "event_id")).alias("entry"))
    lists = kept.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(F.col("event_type").alias("n"), "entry"))).alias("l"))
    return lists.select("user_id", F.array_join(F.transform("l", lambda x: F.concat(x["n"], F.lit(":"), x["entry"].cast("string"))), ",").alias("attendees"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing, json_valid(props) AS valid FROM events")
def json_get(spark: SparkSession, sf: str) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, sf, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"), v.isNotNull().alias("valid"))


@query("SELECT conv_id, n AS position, v AS turn FROM (SELECT conv_id, list(turn ORDER BY turn) AS l FROM conversations GROUP BY conv_id), LATERAL (SELECT unnest(l) AS v, unnest(range(len(l))) AS n)")
def json_each(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON list as rows with positions."""
    lists = table(spark, sf, "conversations").groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list("turn"))).alias("json"))
    rows = lists.select("conv_id", F.posexplode(F.from_json("json", "array<long>")).alias("position", "turn"))
    return rows.select("conv_id", F.col("position").cast("long").alias("position"), "turn")


# spans: each event covers some hours from its time


def spans(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).where("event_type IN ('view', 'click')")
    return e.select("user_id", F.col("ts_us").alias("start"), (F.col("ts_us") + (F.col("event_id") % 30) * HOUR).alias("end"))


_S = _E + f", s AS (SELECT user_id, ts_us AS \"start\", ts_us + (event_id % 30) * {HOUR} AS \"end\" FROM e WHERE event_type IN ('view', 'click'))"
_MERGE = """, f AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM {0} WHERE "start" < "end"),
    g AS (SELECT *, sum(CASE WHEN b IS NULL OR "start" > b THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM f),
    m AS (SELECT user_id, min("start") AS "start", max("end") AS "end" FROM g GROUP BY user_id, island)"""
LOW, HIGH = 1_704_500_000_000_000, 1_705_500_000_000_000


@query(_S + _MERGE.format("s") + ' SELECT user_id, "start", "end" FROM m')
def span_merge(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merge_spans(spans(spark, sf), ["user_id"])


@query(_S + f', c AS (SELECT user_id, greatest("start", {LOW}) AS "start", least("end", {HIGH}) AS "end" FROM s) SELECT * FROM c WHERE "start" < "end"')
def span_clip(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.clip_spans(spans(spark, sf), LOW, HIGH)


def ranges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id").distinct().withColumns({"low": F.lit(LOW), "high": F.lit(HIGH)})


_CLIPPED = f', c AS (SELECT user_id, greatest("start", {LOW}) AS "start", least("end", {HIGH}) AS "end" FROM s WHERE "start" < {HIGH} AND "end" > {LOW})'


@query(
    _S + _CLIPPED + _MERGE.format("c")
    + f""", u AS (SELECT DISTINCT user_id FROM e), p AS (SELECT user_id, "end" AS h, lead("start", 1, {HIGH}) OVER (PARTITION BY user_id ORDER BY "start") AS t FROM m
      UNION ALL SELECT user_id, {LOW}, coalesce((SELECT min("start") FROM m WHERE m.user_id = u.user_id), {HIGH}) FROM u)
    SELECT user_id, h AS start_hole, t AS end_hole FROM p WHERE h < t"""
)
def span_holes(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.holes(spans(spark, sf), ["user_id"], ranges(spark, sf))


@query(
    _S + _CLIPPED + _MERGE.format("c")
    + f""", l AS (SELECT u.user_id, CAST(coalesce(sum("end" - "start"), 0) AS BIGINT) AS covered_length FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN m USING (user_id) GROUP BY u.user_id)
    SELECT user_id, covered_length, CASE WHEN covered_length = 0 THEN 'not_covered' WHEN covered_length = {HIGH - LOW} THEN 'covered' ELSE 'partial' END AS state FROM l"""
)
def span_state(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.settle(spans(spark, sf), ["user_id"], ranges(spark, sf)).select("user_id", "covered_length", "state")


@query(
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, max(event_id) AS as_of FROM events WHERE event_type = 'signup' GROUP BY 1, 2),
    r AS (SELECT user_id, CAST(unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-12', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT user_id FROM events))
    SELECT r.user_id, r.day::VARCHAR AS day, as_of IS NOT NULL AS covered, as_of FROM r LEFT JOIN d ON d.user_id = r.user_id AND d.day = r.day"""
)
def day_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's days of a range, and whether a verified day row covers them."""
    e = table(spark, sf, "events")
    days = F.explode(F.sequence(F.lit("2024-01-05").cast("date"), F.lit("2024-01-12").cast("date")))
    wanted = e.select("user_id").distinct().select("user_id", days.alias("day"))
    verified = e.where("event_type = 'signup'").select("user_id", F.to_date("ts").alias("day"), F.col("event_id").alias("as_of"))
    return coverage.days_covered(wanted, verified, ["user_id"], "day").select("user_id", F.col("day").cast("string").alias("day"), "covered", "as_of")


@query(_E + " SELECT user_id, max(gap) AS worst_gap, count(*) AS reads FROM (SELECT user_id, ts_us - lag(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us) AS gap FROM e WHERE event_type = 'view') GROUP BY user_id")
def read_gap(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.worst_gap(events(spark, sf).where("event_type = 'view'"), ["user_id"], "ts_us")


# joins by time

_P = _E + ", l AS (SELECT event_id AS left_id, user_id, ts_us AS l_at FROM e WHERE event_type = 'purchase'), r AS (SELECT event_id AS right_id, user_id, ts_us AS r_at FROM e WHERE event_type = 'error')"


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf)
    left = e.where("event_type = 'purchase'").select(F.col("event_id").alias("left_id"), "user_id", F.col("ts_us").alias("l_at"))
    return left, e.where("event_type = 'error'").select(F.col("event_id").alias("right_id"), "user_id", F.col("ts_us").alias("r_at"))


@query(
    _P + f""" SELECT left_id, CASE WHEN count(DISTINCT right_id) = 1 THEN min(right_id) END AS right_id, count(DISTINCT right_id) AS candidates
    FROM l JOIN r ON r.user_id = l.user_id AND r_at BETWEEN l_at - {6 * HOUR} AND l_at + {6 * HOUR} GROUP BY left_id"""
)
def band_unique(spark: SparkSession, sf: str) -> DataFrame:
    """A match by time tolerance that counts only where it is the only one."""
    left, right = _sides(spark, sf)
    return joins.unique_match(joins.band_join(left, right, ["user_id"], "l_at", "r_at", 6 * HOUR, 6 * HOUR), "left_id", "right_id")


@query(
    _P + f""", p AS (SELECT l.left_id, count(DISTINCT right_id) AS n FROM l LEFT JOIN r ON r.user_id = l.user_id AND r_at BETWEEN l_at - {6 * HOUR} AND l_at + {6 * HOUR} GROUP BY l.left_id)
    SELECT CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'one' ELSE 'ambiguous' END AS matched, count(*) AS n FROM p GROUP BY 1"""
)
def band_census(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _sides(spark, sf)
    found = joins.unique_match(joins.band_join(left, right, ["user_id"], "l_at", "r_at", 6 * HOUR, 6 * HOUR), "left_id", "right_id")
    n = F.coalesce("candidates", F.lit(0))
    state = F.when(n == 0, "none").when(n == 1, "one").otherwise("ambiguous")
    return left.join(found, "left_id", "left").groupBy(state.alias("matched")).agg(F.count("*").alias("n"))


@query(
    _P + f""", p AS (SELECT left_id, right_id, l_at, r_at FROM l JOIN r ON r.user_id = l.user_id AND r_at BETWEEN l_at - {4 * DAY} AND l_at + {DAY}),
    q AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY (r_at > l_at), CASE WHEN r_at > l_at THEN r_at ELSE -r_at END, right_id) AS rn FROM p)
    SELECT left_id, right_id, r_at > l_at AS after_start FROM q WHERE rn = 1"""
)
def asof_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The window a recording belongs to: the latest start not after it, else the earliest after it."""
    left, right = _sides(spark, sf)
    return joins.latest_start(joins.band_join(left, right, ["user_id"], "l_at", "r_at", 4 * DAY, DAY), "left_id", "l_at", "r_at", "right_id")


@query(
    _P + f""", q AS (SELECT left_id, right_id, abs(r_at - l_at) AS gap, row_number() OVER (PARTITION BY left_id ORDER BY abs(r_at - l_at), right_id) AS rn
      FROM l JOIN r ON r.user_id = l.user_id AND abs(r_at - l_at) <= {DAY}) SELECT left_id, right_id, gap FROM q WHERE rn = 1"""
)
def nearest_owner(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _sides(spark, sf)
    return joins.nearest(joins.band_join(left, right, ["user_id"], "l_at", "r_at", DAY, DAY), "left_id", F.abs(F.col("r_at") - F.col("l_at")), "right_id")


@query(
    """WITH a AS (SELECT conv_id, list(length(text) ORDER BY turn) AS times FROM conversations GROUP BY conv_id), x AS (SELECT conv_id, unnest(times) AS t, unnest(range(len(times))) AS i FROM a)
    SELECT conv_id, min_by(i, (abs(t - 300), i)) AS nearest, count(*) AS entries FROM x GROUP BY conv_id"""
)
def nearest_in_array(spark: SparkSession, sf: str) -> DataFrame:
    """The element of an array whose value is nearest to a wanted one."""
    arrays = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: x["n"]).alias("times"))
    rows = arrays.select("conv_id", F.posexplode("times").alias("i", "t"))
    return rows.groupBy("conv_id").agg(F.min_by(F.col("i").cast("long"), F.struct(F.abs(F.col("t") - 300), "i")).alias("nearest"), F.count("*").alias("entries"))


@query(
    """WITH d AS (SELECT doc_id, source, n_chars FROM documents), p AS (SELECT a.doc_id, b.doc_id AS other, abs(a.n_chars - b.n_chars) AS gap FROM d a JOIN d b ON a.source = b.source AND a.doc_id <> b.doc_id AND b.n_chars BETWEEN a.n_chars - 40 AND a.n_chars + 20),
    q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gap, other) AS position FROM p) SELECT doc_id, other, gap, CAST(position AS INT) AS position FROM q WHERE position <= 3"""
)
def related_window(spark: SparkSession, sf: str) -> DataFrame:
    """Up to three related items within an uneven window, nearest first."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    other = d.select(F.col("doc_id").alias("other"), "source", F.col("n_chars").alias("o_chars"))
    pairs = joins.band_join(d, other, ["source"], "n_chars", "o_chars", 40, 20).where("doc_id <> other").withColumn("gap", F.abs(F.col("n_chars") - F.col("o_chars")))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("gap", "other"))
    return pairs.withColumn("position", rank).where("position <= 3").select("doc_id", "other", "gap", "position")


# sources and their health

_RUNS = "WITH r AS (SELECT event_id AS id, 'src' || user_id % 40 AS source, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'view' THEN 'skipped_interval' WHEN 'click' THEN 'unchanged' ELSE 'failed' END AS result, value FROM events)"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    result = F.when(t == "purchase", "ok").when(t == "view", "skipped_interval").when(t == "click", "unchanged").otherwise("failed")
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("src"), (F.col("user_id") % 40).cast("string")).alias("source"), result.alias("result"), "value")


@query(
    _RUNS + """, c AS (SELECT * FROM r WHERE result NOT IN ('skipped_interval', 'unchanged')), l AS (SELECT source, max_by(result, id) AS last_result, max(id) FILTER (result = 'ok') AS last_ok, count(*) AS runs FROM c GROUP BY source)
    SELECT *, CASE WHEN last_result = 'ok' THEN 'ok' WHEN last_ok IS NOT NULL THEN 'failing' ELSE 'never_succeeded' END AS state FROM l"""
)
def source_health(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.health(runs(spark, sf), ["source"], "id", "result", ["skipped_interval", "unchanged"])


@query(_RUNS + " SELECT source, arg_max(result, CASE result WHEN 'failed' THEN 3 WHEN 'unchanged' THEN 2 WHEN 'skipped_interval' THEN 1 ELSE 0 END) AS result, count(*) AS items FROM r GROUP BY source")
def coverage_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs(spark, sf).withColumn("items", F.lit(1))
    return coverage.worst_state(rows, ["source"], "result", {"failed": 3, "unchanged": 2, "skipped_interval": 1, "ok": 0}, "items")


@query(_RUNS + ", a AS (SELECT source, max(id) FILTER (result = 'ok' AND value > 80) AS newest FROM r GROUP BY source) SELECT min(coalesce(newest, -1)) AS stalest, count(*) AS accounts, CAST(count(*) FILTER (newest IS NULL) AS BIGINT) AS never FROM a")
def stalest_success(spark: SparkSession, sf: str) -> DataFrame:
    r = runs(spark, sf)
    return coverage.stalest(r.where("result = 'ok' AND value > 80"), r.select("source").distinct(), "source", "id", F.lit(-1))


@query(
    """WITH c AS (SELECT o_custkey AS user_id, epoch_us(max(o_orderdate)) - 700000000000000 AS stated FROM orders GROUP BY o_custkey), m AS (SELECT user_id, epoch_us(max(ts)) AS newest FROM events GROUP BY user_id)
    SELECT user_id, stated, newest FROM c LEFT JOIN m USING (user_id) WHERE newest IS NULL OR stated > newest"""
)
def behind_conversations(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg((micros(F.max("o_orderdate")) - 700_000_000_000_000).alias("stated"))
    return coverage.behind(c, events(spark, sf), "user_id", "stated", "ts_us")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS ordinal FROM orders")
def part_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.numbered(table(spark, sf, "orders"), ["o_custkey"], F.asc("o_orderdate"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey", "ordinal")


_ISLANDS = """{0}b AS (SELECT *, max("end") OVER (PARTITION BY account, role ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({1}) WHERE "start" < "end"),
    {0}i AS (SELECT *, sum(CASE WHEN before IS NULL OR "start" > before THEN 1 ELSE 0 END) OVER (PARTITION BY account, role ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM {0}b),
    {0} AS (SELECT account, role, min("start") AS "start", max("end") AS "end" FROM {0}i GROUP BY account, role, island)"""
_COVER = (
    _E + f""", g AS (SELECT u.user_id AS account, r.role, {LOW} AS low, {HIGH} AS high, CASE u.user_id % 6 WHEN 0 THEN {LOW} - 1 WHEN 1 THEN {HIGH} - 1000 ELSE {HIGH} + 1 END AS now, r.role = 'inbox' OR u.user_id % 11 <> 0 AS synced,
      CASE u.user_id % 7 WHEN 0 THEN 'partial' WHEN 1 THEN 'older_copy_only' ELSE 'exact' END AS copies, {LOW} + u.user_id % 10 * 100000000000 AS lacking_through, u.user_id % 13 = 0 AS failing, u.user_id % 17 = 0 AS stale, {HIGH} + (u.user_id % 3 - 1) * 1000000000 AS fresh_at, u.user_id % 4 * 3600000000 AS shift
      FROM (SELECT DISTINCT user_id FROM e) u, (VALUES ('inbox'), ('sent')) r(role)),
    reads AS (SELECT user_id AS account, CASE WHEN event_id % 2 = 0 THEN 'inbox' ELSE 'sent' END AS role, ts_us - event_id % 9 * 43200000000 AS "start", ts_us AS "end" FROM e WHERE event_type <> 'purchase' AND event_id % 5 <> 0), """
    + _ISLANDS.format("ledger", "SELECT * FROM reads") + ", " + _ISLANDS.format("k", """SELECT l.account, l.role, l."start" + CASE WHEN l.role = 'sent' THEN g.shift ELSE 0 END AS "start", l."end" FROM ledger l JOIN g USING (account, role)""")
    + ", " + _ISLANDS.format("v", """SELECT user_id AS account, CASE WHEN event_id % 2 = 0 THEN 'inbox' ELSE 'sent' END AS role, ts_us - 172800000000 AS "start", ts_us AS "end" FROM e WHERE event_type = 'purchase'""")
    + ", " + _ISLANDS.format("p", f"""SELECT account, role, greatest("start", {LOW}) AS "start", least("end", {HIGH}) AS "end" FROM (SELECT * FROM k UNION ALL SELECT * FROM v)""")
    + f""", gj AS (SELECT *, CASE WHEN lacking_through + 1000000 > low AND lacking_through + 1000000 < high THEN lacking_through + 1000000 ELSE high END AS judged FROM g),
    ks AS (SELECT account, role, sum(greatest(0, least("end", {HIGH}) - greatest("start", {LOW}))) AS cached, max("end") AS cache_end FROM k GROUP BY 1, 2),
    vs AS (SELECT account, role, sum(greatest(0, least("end", high) - greatest("start", low))) AS served, sum(greatest(0, least("end", judged) - greatest("start", low))) AS sj FROM v JOIN gj USING (account, role) GROUP BY 1, 2),
    ps AS (SELECT account, role, min("start") AS cf, max("end") AS cu, sum("end" - "start") AS len FROM p GROUP BY 1, 2),
    h AS (SELECT account, role, "end" AS h0, lead("start", 1, {HIGH}) OVER (PARTITION BY account, role ORDER BY "start") AS h1 FROM p UNION ALL SELECT g.account, g.role, {LOW}, coalesce(ps.cf, {HIGH}) FROM g LEFT JOIN ps USING (account, role)),
    hs AS (SELECT h.account, h.role, bool_or(h0 < cache_end) AS hb, bool_or(h0 >= cache_end) AS ha FROM h LEFT JOIN ks USING (account, role) WHERE h0 < h1 GROUP BY 1, 2),
    a AS (SELECT gj.*, coalesce(len, 0) AS len, coalesce(cached, 0) AS cached, coalesce(served, 0) AS served, cache_end, cf, cu, hb, ha, synced AND low < now AS asked, copies = 'partial' AND coalesce(sj, 0) < judged - low AS unsettled
      FROM gj LEFT JOIN ks USING (account, role) LEFT JOIN vs USING (account, role) LEFT JOIN ps USING (account, role) LEFT JOIN hs USING (account, role))
    SELECT account, role, CASE WHEN NOT asked OR len = 0 THEN 'not_covered' WHEN len = high - low AND NOT unsettled THEN 'covered' ELSE 'partial' END AS state, CASE WHEN asked AND len > 0 THEN cf END AS covered_from, CASE WHEN asked AND len > 0 THEN cu END AS covered_until,
      CASE WHEN asked AND len > 0 THEN CASE WHEN cached = len AND served < len THEN 'cache' WHEN served = len AND cached < len THEN 'server' ELSE 'both' END END AS basis,
      CASE WHEN NOT synced THEN 'folder_not_synced' WHEN NOT asked THEN 'future' ELSE concat_ws(',', CASE WHEN high > now THEN 'in_progress' END, CASE WHEN cache_end IS NULL AND len < high - low THEN 'no_complete_read' END,
        CASE WHEN hb THEN CASE WHEN copies = 'older_copy_only' THEN 'only_older_cache_copy' ELSE 'before_cache' END END, CASE WHEN ha THEN CASE WHEN failing THEN 'source_failing' WHEN stale THEN 'after_cache_fresh' WHEN high > fresh_at THEN 'after_last_read' ELSE 'after_newest_mail' END END,
        CASE WHEN unsettled THEN 'folder_copies_disagree' END) END AS reasons FROM a"""
)


@query(_COVER)
def mail_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Each mailbox's coverage of a range by role: spans that complete reads recorded, the server's spans, the basis, and the reasons in their order."""
    e = events(spark, sf)
    role = F.when(F.col("event_id") % 2 == 0, "inbox").otherwise("sent")
    reads = e.where("event_type <> 'purchase'").select(F.col("user_id").alias("account"), role.alias("role"), (F.col("ts_us") - F.col("event_id") % 9 * 43_200_000_000).alias("start"), F.col("ts_us").alias("end"), (F.col("event_id") % 5 != 0).alias("complete"))
    half = F.col("end") % 2 == 0  # an earlier sync's reads, already in the ledger, and a later one's
    ledger = coverage.record_spans(reads.limit(0), reads.where(half), ["account", "role"])
    ledger = coverage.record_spans(ledger, reads.where(~half), ["account", "role"])
    server = e.where("event_type = 'purchase'").select(F.col("user_id").alias("account"), role.alias("role"), (F.col("ts_us") - 172_800_000_000).alias("start"), F.col("ts_us").alias("end"))
    u = F.col("account")
    asked = e.select(F.col("user_id").alias("account")).distinct().withColumn("role", F.explode(F.array(F.lit("inbox"), F.lit("sent")))).withColumns({
        "low": F.lit(LOW), "high": F.lit(HIGH), "now": F.when(u % 6 == 0, LOW - 1).when(u % 6 == 1, HIGH - 1000).otherwise(HIGH + 1), "synced": (F.col("role") == "inbox") | (u % 11 != 0), "copies": F.when(u % 7 == 0, "partial").when(u % 7 == 1, "older_copy_only").otherwise("exact"),
        "lacking_through": LOW + u % 10 * 100_000_000_000, "failing": u % 13 == 0, "stale": u % 17 == 0, "fresh_at": HIGH + (u % 3 - 1) * 1_000_000_000, "shift": u % 4 * 3_600_000_000,
    })
    return coverage.mail_entries(asked, ledger, server).withColumn("reasons", F.array_join("reasons", ","))
