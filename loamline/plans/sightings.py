"""Observations, references, sessions, transcripts, counts, titles and the kept search index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import sources as O
from ..operators.index import SearchIndex
from ..sources.archive import table
from ..sources.scratch import folder
from .registry import query

_TOKENS = "list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"


def observed(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("id"), (F.col("p_size") % 4).alias("source_id"), (k % 3).alias("capture_id"), F.col("p_brand").alias("application"), F.col("p_type").alias("surface"), F.col("p_name").alias("title"), F.when(k % 5 > 0, k * 1000).alias("modified_at"),
        F.when(k % 2 == 0, F.concat(F.lit("u"), k.cast("string"))).otherwise("").alias("url"), F.when(k % 3 == 0, F.concat(F.lit("w"), k.cast("string"))).alias("web_url"), F.concat(F.lit("f"), k.cast("string")).alias("friendly"),
    )


_OBS = "WITH o AS (SELECT p_partkey AS id, p_size % 4 AS source_id, p_partkey % 3 AS capture_id, p_brand AS application, p_name AS title, CASE WHEN p_partkey % 5 > 0 THEN p_partkey * 1000 END AS modified_at FROM part)"


@query(_OBS + f" SELECT id FROM o WHERE capture_id = source_id % 3 AND application LIKE 'Brand%' AND application = (SELECT min(p_brand) FROM part) AND list_contains({_TOKENS.format('title')}, 'widget') AND modified_at >= 20000 AND modified_at < 1800000")
def document_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Observations of the current captures, by application, words and window."""
    o = observed(spark, sf)
    captures = o.select("source_id", "capture_id", (F.col("capture_id") == F.col("source_id") % 3).alias("is_current")).distinct()
    least = o.agg(F.min("application").alias("_least"))  # one row
    rows = O.documents(o, captures, text="WIDGET", since=F.lit(20_000), until=F.lit(1_800_000))
    return rows.crossJoin(F.broadcast(least)).where("application = _least").select("id")


@query("SELECT p_partkey AS id, f AS field, v AS value FROM (SELECT p_partkey, unnest(['url', 'web_url', 'friendly']) AS f, unnest([CASE WHEN p_partkey % 2 = 0 THEN 'u' || p_partkey ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN 'w' || p_partkey END, 'f' || p_partkey]) AS v FROM part) WHERE v <> ''")
def document_references(spark: SparkSession, sf: str) -> DataFrame:
    return O.references(observed(spark, sf), ["url", "web_url", "friendly"], "id")


@query("SELECT kind, source, count(*) AS n FROM (SELECT 'mail' AS kind, o_orderstatus AS source FROM orders UNION ALL SELECT 'event', event_type FROM events UNION ALL SELECT 'person', c_mktsegment FROM customer) GROUP BY 1, 2")
def provenance_kinds(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"mail": table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("source")), "event": table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source")), "person": table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("source"))}
    return O.provenance(kinds).groupBy("kind", "source").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT user_id, epoch_us(min(ts)) AS began, epoch_us(max(ts)) AS active FROM events GROUP BY user_id) SELECT user_id FROM s WHERE active >= epoch_us(TIMESTAMP '2024-01-20') AND began < epoch_us(TIMESTAMP '2024-01-03')")
def sessions_in_window(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy("user_id").agg(micros(F.min("ts")).alias("began"), micros(F.max("ts")).alias("active"))
    low, high = (micros(F.lit(d).cast("timestamp_ntz")) for d in ("2024-01-20", "2024-01-03"))
    return O.sessions_in(s, F.col("began"), F.col("active"), low, high).select("user_id")


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c, k = table(spark, sf, "conversations"), F.col("conv_id") * 100 + F.col("turn")
    parts = c.select(
        (F.col("conv_id") % 3).alias("account_id"), F.col("conv_id").alias("call_id"), k.alias("part_key"), F.when(F.col("role") == "system", "unresolved").otherwise("exact").alias("ref_quality"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("https://H"), (F.col("conv_id") % 4).cast("string"), F.lit(".example.com/r/"), k.cast("string"))).alias("recording"),
    )
    fetches = c.where("turn % 3 = 0").select((F.col("conv_id") % 3).alias("account_id"), k.alias("part_key"), F.when(F.col("turn") == 0, "fetched").otherwise("failed").alias("state"), k.alias("attempted_at"))
    return parts, fetches


@query(
    """SELECT count(DISTINCT conv_id) AS calls, count(*) FILTER (role <> 'system') AS parts, count(*) FILTER (role <> 'system' AND turn % 2 = 0) AS fetchable, count(*) FILTER (role <> 'system' AND turn = 0) AS fetched,
    (SELECT max(conv_id * 100 + turn) FROM conversations WHERE turn % 3 = 0) AS last_fetch_at FROM conversations"""
)
def transcript_status(spark: SparkSession, sf: str) -> DataFrame:
    return O.transcript_status(*_parts(spark, sf))


@query("SELECT 'h' || (conv_id % 4) || '.example.com' AS host, count(*) AS parts FROM conversations WHERE turn % 2 = 0 GROUP BY 1")
def transcript_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return O.hosts(_parts(spark, sf)[0], "recording")


@query("SELECT user_id, code, count(*) AS n FROM (SELECT user_id, CASE event_id % 4 WHEN 0 THEN 'invalid' WHEN 1 THEN event_type END AS code FROM events UNION ALL SELECT user_id, 'late' FROM events WHERE event_id % 4 = 1) WHERE code IS NOT NULL GROUP BY 1, 2")
def losses_by_code(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 4
    rows = table(spark, sf, "events").select("user_id", F.when(k == 0, "{broken").when(k == 1, F.to_json(F.array("event_type", F.lit("late")))).when(k == 2, "[]").alias("losses"))
    return O.losses(rows, ["user_id"], "losses")


@query("SELECT 'mail' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'people', count(*) FROM customer UNION ALL SELECT 'notes', count(*) FROM documents")
def overview_counts(spark: SparkSession, sf: str) -> DataFrame:
    return O.overview({"mail": table(spark, sf, "orders"), "people": table(spark, sf, "customer"), "loop": None, "notes": table(spark, sf, "documents")})


@query(
    f"""WITH n AS (SELECT c_custkey, c_name, n_name || ' › ' || c_name AS composed FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT c_custkey, CASE WHEN lower(c_name) = 'nation_1' OR lower(composed) = 'nation_1' THEN 0 WHEN starts_with(lower(c_name), 'nation_1') OR starts_with(lower(composed), 'nation_1') THEN 1 WHEN contains(lower(c_name), 'nation_1') OR contains(lower(composed), 'nation_1') THEN 2 ELSE 3 END AS tier
    FROM n WHERE contains(lower(c_name), 'nation_1') OR contains(lower(composed), 'nation_1') OR contains(' ' || array_to_string({_TOKENS.format("(c_name || ' ' || composed)")}, ' ') || ' ', ' nation 1 ')"""
)
def title_search(spark: SparkSession, sf: str) -> DataFrame:
    """Names and composed names by tier: equal, beginning, containing, all words."""
    n = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return O.titles(n.select("c_custkey", "c_name", F.concat("n_name", F.lit(" › "), "c_name").alias("composed")), "c_custkey", ["c_name", "composed"], "Nation_1")


@query(
    f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN text || ' license license' ELSE text END AS t FROM documents), w AS (SELECT doc_id, {_TOKENS.format('t')} AS w FROM d)
    SELECT doc_id::VARCHAR AS id, CAST(len(list_filter(w, lambda x: x = 'license')) + len(list_filter(w, lambda x: x = 'the')) AS BIGINT) AS hits FROM w WHERE list_contains(w, 'license') AND list_contains(w, 'the')"""
)
def search_kept_index(spark: SparkSession, sf: str) -> DataFrame:
    """All documents are indexed; then a third is removed and a third changed; the search reads the index alone."""
    index = SearchIndex(spark, folder(spark, "search-index"))
    d = table(spark, sf, "documents").select("doc_id", "text")
    index.add(d, "doc_id", "text", 1)
    index.add(d.where("doc_id % 3 < 2").select("doc_id", F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" license license"))).alias("text")), "doc_id", "text", 2)
    return index.search("the LICENSE")
