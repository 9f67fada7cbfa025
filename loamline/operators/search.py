"""Search over token arrays: filters, one hit a part, dedupe by digest, BM25, several sources together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Term, found, may_match, parse_query, pattern_of
from .ranking import newest_per


def search(df: DataFrame, text: str, columns: list[str], filtered: bool = False) -> DataFrame:
    """The rows of which one column at least matches the whole search text. A blank text lists all rows where another filter was given, else it is an error."""
    terms = parse_query(text)
    if not terms:
        if not filtered:
            raise ValueError("a search needs a word or a filter")
        return df
    hit = found(columns[0], terms)
    for c in columns[1:]:
        hit = hit | found(c, terms)
    return df.where(hit)


def collapse(hits: DataFrame, part: list[str], order: str, fields: list[str]) -> DataFrame:
    """One row a part: its first hit's fields and the number of hits."""
    first = F.min(F.struct(order, *fields)).alias("_first")
    return hits.groupBy(*part).agg(F.count("*").alias("matches"), first).select(*part, "matches", *(F.col(f"_first.{c}").alias(c) for c in (order, *fields)))


def dedupe(hits: DataFrame, digest: str, *order: Column) -> DataFrame:
    return newest_per(hits, [digest], *order)


def bm25(df: DataFrame, key: str, column: str, text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and score of the rows that have every term. One pass counts all rows' tokens and the rows with each word (sums of one row); the other scores the rows that have all words."""
    words = sorted({w for t in parse_query(text) for w in t.words})
    low = F.lower(F.col(column))
    length = F.coalesce(F.regexp_count(F.col(column), F.lit(r"[\p{L}\p{N}]+")), F.lit(0))
    pattern = {w: pattern_of(Term("word", (w,))) for w in words}
    has = [F.coalesce(low.contains(w) & low.rlike(pattern[w]), F.lit(False)) for w in words]
    sums = df.select(length.alias("_n"), *(h.alias(f"_h{i}") for i, h in enumerate(has))).agg(F.count("*").alias("_docs"), F.avg("_n").alias("_avg"), *(F.count_if(f"_h{i}").alias(f"_d{i}") for i in range(len(words))))
    rows = df.where(reduce(lambda x, y: x & y, [may_match(column, parse_query(text)), *has])).select(key, length.alias("_n"), *(F.regexp_count(low, F.lit(pattern[w])).alias(f"_f{i}") for i, w in enumerate(words)))
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log((F.col("_docs") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5) + 1)
        f = F.col(f"_f{i}")
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_n") / F.col("_avg")))
    return rows.crossJoin(F.broadcast(sums)).select(key, score.alias("score"))  # one row


def federated(parts: dict[str, DataFrame], limit: int) -> tuple[DataFrame, DataFrame]:
    """The newest hits of several sources in one order, and a row a source with what it matched and returned.

    Each part has id, at (null: unknown) and title. Known times come first, newest first; then source and id. Counts are exact.
    """
    tagged = [p.select(F.lit(name).alias("source"), F.lit(i).alias("source_rank"), F.col("id").cast("string").alias("id"), "at", "title") for i, (name, p) in enumerate(parts.items())]
    order = [F.col("at").desc_nulls_last(), F.col("source_rank").asc(), F.col("id").asc()]
    every = tagged[0].orderBy(*order).limit(limit)
    for t in tagged[1:]:
        every = every.unionByName(t.orderBy(*order).limit(limit))
    hits = every.orderBy(*order).limit(limit)
    counts = tagged[0].groupBy("source").count()
    for t in tagged[1:]:
        counts = counts.unionByName(t.groupBy("source").count())
    returned = hits.groupBy("source").agg(F.count("*").alias("returned"))
    counts = counts.withColumnRenamed("count", "matched").join(returned, "source", "left").withColumn("returned", F.coalesce("returned", F.lit(0)))
    return hits, counts.withColumn("truncated", F.col("matched") > F.col("returned"))
