"""What was observed where: captures, references, provenance, sessions, transcripts, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import matches, parse_query, tokens


def documents(observed: DataFrame, captures: DataFrame, source: int | None = None, application: str | None = None, surface: str | None = None, text: str = "", since=None, until=None) -> DataFrame:
    """The observations that belong to their source's current capture, by source, application, surface, words of the title, and a half-open window of modified_at; undated ones are in no window."""
    own = observed.join(captures.where("is_current").select("source_id", "capture_id"), ["source_id", "capture_id"], "left_semi")
    words = None
    if text:
        terms = parse_query(text)
        if not terms:
            raise ValueError("a document search needs searchable text")
        words = matches(tokens("title"), terms)
    return own.where(
        P.every(
            F.lit(True), None if source is None else F.col("source_id") == source, None if application is None else F.col("application") == application, None if surface is None else F.col("surface") == surface, words, P.half_open(F.col("modified_at"), since, until)
        )
    )


def references(observed: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, field, value): the references of all columns as rows, empty ones left out. The table is read once."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns))).alias("_p")
    return observed.select(key, pairs).select(key, "_p.field", "_p.value").where("value <> ''")


def provenance(kinds: dict[str, DataFrame]) -> DataFrame:
    """kind, id and source of every kind of item."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "source") for kind, df in kinds.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sessions_in(sessions: DataFrame, began: Column, active: Column, since=None, until=None) -> DataFrame:
    """Sessions whose activity reaches the start of a window and that began before its end."""
    return sessions.where(P.every(F.lit(True), None if since is None else active >= since, None if until is None else F.coalesce(began, active) < until))


def transcript_status(parts: DataFrame, fetches: DataFrame) -> DataFrame:
    """One row: calls, parts (those that resolve), fetchable and fetched ones, and the last attempt."""
    keys = ["account_id", "part_key"]
    rows = parts.join(fetches.select(*keys, "state", "attempted_at"), keys, "left")
    resolved = F.col("ref_quality") != "unresolved"
    fetchable = resolved & F.col("recording").isNotNull()
    sums = rows.agg(
        F.count_distinct("account_id", "call_id").alias("calls"), F.count(F.when(resolved, 1)).alias("parts"), F.count(F.when(fetchable, 1)).alias("fetchable"), F.count(F.when(fetchable & (F.col("state") == "fetched"), 1)).alias("fetched")
    )
    return sums.crossJoin(F.broadcast(fetches.agg(F.max("attempted_at").alias("last_fetch_at"))))  # one row each


def hosts(parts: DataFrame, url: str) -> DataFrame:
    """host and parts of the places that recordings lie at, most first."""
    host = F.lower(F.parse_url(F.col(url), F.lit("HOST")))
    return parts.where(host.isNotNull()).groupBy(host.alias("host")).agg(F.count("*").alias("parts"))


def losses(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, code and n from a column of JSON arrays of codes; what doesn't parse counts as the code 'invalid'."""
    codes = F.coalesce(F.from_json(column, F.lit("array<string>")), F.when(F.col(column).isNotNull() & (F.col(column) != ""), F.array(F.lit("invalid"))), F.array().cast("array<string>"))
    return rows.select(*keys, F.explode(codes).alias("code")).groupBy(*keys, "code").agg(F.count("*").alias("n"))


def overview(kinds: dict[str, DataFrame]) -> DataFrame:
    """kind and n: how many rows of each kind an archive holds; kinds it lacks are None and left out."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in kinds.items() if df is not None]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def titles(rows: DataFrame, key: str, names: list[str], text: str) -> DataFrame:
    """key and tier of the rows of which one name matches: 0 equal, 1 begins with the text, 2 contains it, 3 all its words are words of the names."""
    terms = parse_query(text)
    if not terms:
        raise ValueError("a title search needs a word")
    want, tier = text.lower(), F.lit(None).cast("int")
    words = matches(tokens(F.concat_ws(" ", *names)), terms)
    one = lambda f: F.exists(F.array(*(F.lower(n) for n in names)), lambda x: F.coalesce(f(x), F.lit(False)))
    tier = F.when(one(lambda x: x == want), 0).when(one(lambda x: x.startswith(want)), 1).when(one(lambda x: x.contains(want)), 2).when(words, 3)
    return rows.select(key, *names, tier.alias("tier")).where("tier IS NOT NULL").select(key, "tier")
