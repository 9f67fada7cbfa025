"""Full-text queries over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.times import micros
from ..operators import federation
from ..operators import search as S
from ..sources.archive import table
from .registry import query

_TOKENS = "list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"
_W = f"WITH d AS (SELECT doc_id, lang, source, text, n_chars, {_TOKENS.format('text')} AS w FROM documents)"
_LINE = "(' ' || array_to_string(w, ' ') || ' ')"


@query(_W + " SELECT doc_id, lang FROM d WHERE list_contains(w, 'the') AND list_contains(w, 'worthless')")
def search_and(spark: SparkSession, sf: str) -> DataFrame:
    return S.search(table(spark, sf, "documents"), "The worthless", ["text"]).select("doc_id", "lang")


@query(_W + f" SELECT doc_id, lang FROM d WHERE contains({_LINE}, ' licensed under the ') AND list_contains(w, 'apache')")
def search_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return S.search(table(spark, sf, "documents"), '"Licensed under the" apache', ["text"]).select("doc_id", "lang")


@query(_W + " SELECT doc_id, lang FROM d WHERE len(list_filter(w, lambda x: starts_with(x, 'worth'))) > 0 OR len(list_filter(w, lambda x: starts_with(x, 'licen'))) > 0")
def search_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(T.found("text", T.parse_query("worth*")) | T.found("text", T.parse_query("licen*"))).select("doc_id", "lang")


@query(
    f"""WITH c AS (SELECT conv_id, turn, role, {_TOKENS.format('text')} AS w FROM conversations), h AS (SELECT * FROM c WHERE list_contains(w, 'the') OR list_contains(w, 'de'))
    SELECT conv_id, count(*) AS matches, min(turn) AS turn, min_by(role, turn) AS role FROM h GROUP BY conv_id"""
)
def search_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """One hit a conversation: its first matching turn and how many match."""
    c = table(spark, sf, "conversations")
    hits = c.where(T.found("text", T.parse_query("the")) | T.found("text", T.parse_query("de")))
    return S.collapse(hits, ["conv_id"], "turn", ["role"])


@query(_W + ", h AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id DESC) AS rn FROM d WHERE list_contains(w, 'the')) SELECT doc_id, source FROM h WHERE rn = 1")
def search_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Hits with equal content once, as their newest row."""
    hits = S.search(table(spark, sf, "documents"), "the", ["text"]).withColumn("digest", F.sha2("text", 256))
    return S.dedupe(hits, "digest", F.desc("doc_id")).select("doc_id", "source")


@query(
    _W + """, s AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'license')) AS f0, len(list_filter(w, lambda x: x = 'the')) AS f1 FROM d),
    g AS (SELECT count(*) AS docs, avg(n) AS av, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM s)
    SELECT doc_id, round(ln((docs - d0 + 0.5) / (d0 + 0.5) + 1) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * n / av)) + ln((docs - d1 + 0.5) / (d1 + 0.5) + 1) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / av)), 6) AS score
    FROM s, g WHERE f0 > 0 AND f1 > 0"""
)
def search_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return S.bm25(table(spark, sf, "documents"), "doc_id", "text", "license the").select("doc_id", F.round("score", 6).alias("score"))


def _parts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    docs = S.search(table(spark, sf, "documents"), "the", ["text"]).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 > 0, F.col("n_chars")).alias("at"), F.substring("text", 1, 20).alias("title"))
    turns = S.search(table(spark, sf, "conversations"), "the", ["text"]).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.length("text").cast("long").alias("at"), F.col("role").alias("title"))
    pages = S.search(table(spark, sf, "pages"), "the", ["html"]).select(F.col("page_id").alias("id"), F.length("html").cast("long").alias("at"), F.substring("url", 1, 20).alias("title"))
    return {"documents": docs, "conversations": turns, "pages": pages}


_FED = f"""WITH a AS (SELECT 'documents' AS source, 0 AS source_rank, doc_id::VARCHAR AS id, CASE WHEN doc_id % 9 > 0 THEN n_chars END AS "at", substr(text, 1, 20) AS title FROM documents WHERE list_contains({_TOKENS.format('text')}, 'the')
  UNION ALL SELECT 'conversations', 1, (conv_id * 100 + turn)::VARCHAR, length(text), role FROM conversations WHERE list_contains({_TOKENS.format('text')}, 'the')
  UNION ALL SELECT 'pages', 2, page_id::VARCHAR, length(html), substr(url, 1, 20) FROM pages WHERE list_contains({_TOKENS.format('html')}, 'the')),
  h AS (SELECT * FROM a ORDER BY "at" DESC NULLS LAST, source_rank, id LIMIT 75)"""


@query(_FED + " SELECT * FROM h")
def search_federated(spark: SparkSession, sf: str) -> DataFrame:
    """The 75 newest hits of three sources in one order; unknown times come last."""
    return S.federated(_parts(spark, sf), 75)[0]


@query(_FED + ", m AS (SELECT source, count(*) AS matched FROM a GROUP BY source), r AS (SELECT source, count(*) AS n FROM h GROUP BY source) SELECT source, matched, coalesce(n, 0) AS returned, matched > coalesce(n, 0) AS truncated FROM m LEFT JOIN r USING (source)")
def search_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What each source matched and returned."""
    return S.federated(_parts(spark, sf), 75)[1]


@query(f"SELECT page_id FROM pages WHERE list_contains({_TOKENS.format('url')}, 'blog') OR (list_contains({_TOKENS.format('html')}, 'blog'))")
def search_columns(spark: SparkSession, sf: str) -> DataFrame:
    """A term may match in either column; a phrase never spans two."""
    return S.search(table(spark, sf, "pages"), "blog", ["url", "html"]).select("page_id")


@query(f"SELECT event_type, count(*) AS n, epoch_us(max(ts)) AS newest FROM events WHERE list_contains({_TOKENS.format('props')}, '7') GROUP BY event_type")
def search_payload(spark: SparkSession, sf: str) -> DataFrame:
    hits = S.search(table(spark, sf, "events"), "7", ["props"])
    return hits.groupBy("event_type").agg(F.count("*").alias("n"), micros(F.max("ts")).alias("newest"))


def _seven(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Every source's hits for "the" (mail, notes and loop: for a word of theirs) after a time."""
    hits = lambda name, query, column: S.search(table(spark, sf, name), query, [column])
    k = F.col("conv_id") * 100 + F.col("turn")
    chats = hits("conversations", "the", "text").select(k.alias("id"), F.length("text").cast("long").alias("at"), F.col("role").alias("title"))
    mail = hits("orders", "urgent", "o_orderpriority").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 500).alias("at"), F.col("o_orderpriority").alias("title"))
    pages = hits("pages", "the", "html").select(F.col("page_id").alias("id"), F.length("html").cast("long").alias("at"), F.substring("url", 1, 20).alias("title"))
    docs = hits("documents", "the", "text").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 > 0, F.col("n_chars")).alias("at"), F.substring("text", 1, 20).alias("title"))
    notes = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("at"), F.col("p_type").alias("title"))
    return {"chats": chats.where("title = 'user'"), "transcripts": chats.where("title = 'assistant'"), "mail": mail, "content": pages, "documents": docs, "notes": notes}


_SEVEN = f"""WITH c AS (SELECT conv_id * 100 + turn AS id, CAST(length(text) AS BIGINT) AS "at", role AS title FROM conversations WHERE list_contains({_TOKENS.format('text')}, 'the')),
  a AS (SELECT 'chats' AS source, 0 AS source_rank, CAST(id AS VARCHAR) AS id, "at", title FROM c WHERE title = 'user' UNION ALL SELECT 'transcripts', 2, CAST(id AS VARCHAR), "at", title FROM c WHERE title = 'assistant'
    UNION ALL SELECT 'mail', 1, CAST(o_orderkey AS VARCHAR), o_orderkey % 500, o_orderpriority FROM orders WHERE list_contains({_TOKENS.format('o_orderpriority')}, 'urgent')
    UNION ALL SELECT 'content', 3, CAST(page_id AS VARCHAR), length(html), substr(url, 1, 20) FROM pages WHERE list_contains({_TOKENS.format('html')}, 'the')
    UNION ALL SELECT 'documents', 5, CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 9 > 0 THEN n_chars END, substr(text, 1, 20) FROM documents WHERE list_contains({_TOKENS.format('text')}, 'the')
    UNION ALL SELECT 'notes', 6, CAST(p_partkey AS VARCHAR), p_size, p_type FROM part),
  w AS (SELECT * FROM a WHERE "at" >= 40), h AS (SELECT * FROM w ORDER BY "at" DESC NULLS LAST, source_rank, id LIMIT 100)"""


def _planned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    parts = {name: part.where("at >= 40") for name, part in _seven(spark, sf).items()}
    return federation.search_sources(federation.plan_search({"since"}), parts, 100, 150)


@query(_SEVEN + ' SELECT source, id, "at", title FROM h')
def search_planned(spark: SparkSession, sf: str) -> DataFrame:
    """The newest hundred hits of the sources that have times; one source of seven has none and is never read."""
    return _planned(spark, sf)[0].select("source", "id", "at", "title")


@query(
    _SEVEN + """ SELECT s.source, (SELECT count(*) FROM h WHERE h.source = s.source) AS returned, CASE WHEN n <= 150 THEN n END AS matched, least(n, 151) AS matched_at_least, least(n, 151) > (SELECT count(*) FROM h WHERE h.source = s.source) AS truncated
  FROM (SELECT x.source, count(w.id) AS n FROM (VALUES ('chats'), ('mail'), ('transcripts'), ('content'), ('documents'), ('notes')) x(source) LEFT JOIN w USING (source) GROUP BY 1) s"""
)
def search_floors(spark: SparkSession, sf: str) -> DataFrame:
    """What each planned source matched: exactly up to 150 hits, beyond that at least so many."""
    return _planned(spark, sf)[1]
