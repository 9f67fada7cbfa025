"""Health of sources from a run log, worst states, silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import clip_spans, holes, merge_spans


def health(runs: DataFrame, keys: list[str], order: str, result: str, keeps: list[str], ok: str = "ok") -> DataFrame:
    """The state after replaying runs in order: ok, failing (was ok once), never_succeeded; results in `keeps` leave the state as it was."""
    counted = runs.where(~F.col(result).isin(*keeps))
    last = counted.groupBy(*keys).agg(F.max_by(result, order).alias("last_result"), F.max(F.when(F.col(result) == ok, F.col(order))).alias("last_ok"), F.count("*").alias("runs"))
    state = F.when(F.col("last_result") == ok, "ok").when(F.col("last_ok").isNotNull(), "failing").otherwise("never_succeeded")
    return last.withColumn("state", state)


def worst_state(entries: DataFrame, keys: list[str], state: str, ranks: dict[str, int], items: str) -> DataFrame:
    """The worst state of a key's entries and the sum of their items."""
    rank = F.lit(-1)
    for name, r in ranks.items():
        rank = F.when(F.col(state) == name, r).otherwise(rank)
    return entries.groupBy(*keys).agg(F.max_by(state, rank).alias(state), F.sum(items).alias(items))


def stalest(successes: DataFrame, accounts: DataFrame, account: str, at: str, never: Column) -> DataFrame:
    """Each account's newest success (`never` where it has none), and of these the oldest."""
    newest = accounts.join(successes.groupBy(account).agg(F.max(at).alias("newest")), account, "left")
    return newest.agg(F.min(F.coalesce("newest", never)).alias("stalest"), F.count("*").alias("accounts"), F.sum(F.col("newest").isNull().cast("long")).alias("never"))


def days_covered(days: DataFrame, verified: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Each key's days with whether a verified day row covers them and how old the verification is."""
    best = verified.groupBy(*keys, day).agg(F.max("as_of").alias("as_of"))
    return days.join(best, [*keys, day], "left").withColumn("covered", F.col("as_of").isNotNull())


def first_last(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(at).alias("oldest"), F.max(at).alias("newest"), F.count("*").alias("items"))


def behind(conversations: DataFrame, messages: DataFrame, key: str, stated: str, at: str) -> DataFrame:
    """Conversations whose stated last message is later than the newest one stored."""
    newest = messages.groupBy(key).agg(F.max(at).alias("newest"))
    return conversations.join(newest, key, "left").where(F.col("newest").isNull() | (F.col(stated) > F.col("newest")))


def numbered(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Ordinals from 1 within a key."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def record_spans(ledger: DataFrame, reads: DataFrame, keys: list[str]) -> DataFrame:
    """The spans that complete reads are known to have held whole: those of the ledger and of new reads (start, end, complete), merged as they are appended, so the ledger stays as short as what it says."""
    new = reads.where(F.coalesce("complete", F.lit(False))).select(*keys, "start", "end")
    return merge_spans(ledger.select(*keys, "start", "end").unionByName(new), keys)


def mail_entries(ranges: DataFrame, cache: DataFrame, server: DataFrame) -> DataFrame:
    """Whether the archive holds all mail of an account and role in [low, high): state, covered_from, covered_until, basis and reasons.

    ranges has one row a key (account, role) with low, high, now, synced (the archive holds such a folder), copies (exact, partial or older_copy_only), lacking_through, failing, stale, fresh_at
    and shift; times are microseconds. cache and server are spans (start, end) that the application's cache and the server are known to have held whole. Sent mail
    counts by when it was sent, up to `shift` after it was drafted, so its cached spans start that much later. The basis is the source that alone covers what is covered, else both. Reasons stand in a fixed order:
    a folder never synced or a range that has not begun end the matter; then the range's end, holes before the cache's reach, what is behind it, and copies of a folder that disagree,
    which the server's spans settle up to just past the last message in dispute.
    """
    keys = ["account", "role"]
    shifted = cache.join(ranges.select(*keys, "shift"), keys).withColumn("start", F.when(F.col("role") == "sent", F.col("start") + F.col("shift")).otherwise(F.col("start")))
    cache = merge_spans(shifted.select(*keys, "start", "end"), keys)
    server = merge_spans(server.select(*keys, "start", "end"), keys)
    bounds = ranges.select(*keys, "low", "high", "lacking_through")
    disputed = F.col("lacking_through") + 1_000_000
    bounds = bounds.withColumn("judged", F.when((disputed > F.col("low")) & (disputed < F.col("high")), disputed).otherwise(F.col("high")))
    part = lambda high: F.greatest(F.lit(0), F.least(F.col("end"), high) - F.greatest(F.col("start"), F.col("low")))
    held = cache.join(bounds, keys).groupBy(*keys).agg(F.sum(part(F.col("high"))).alias("_cache"), F.max("end").alias("_cache_end"))
    served = server.join(bounds, keys).groupBy(*keys).agg(F.sum(part(F.col("high"))).alias("_server"), F.sum(part(F.col("judged"))).alias("_judged"))
    every = cache.unionByName(server)
    inside = merge_spans(clip_spans(every.join(bounds, keys), F.col("low"), F.col("high")).select(*keys, "start", "end"), keys)
    pieces = inside.groupBy(*keys).agg(F.min("start").alias("covered_from"), F.max("end").alias("covered_until"), F.sum(F.col("end") - F.col("start")).alias("_length"))
    gaps = holes(every, keys, bounds.select(*keys, "low", "high")).join(held.select(*keys, "_cache_end"), keys, "left")
    gaps = gaps.groupBy(*keys).agg(F.max(F.col("start_hole") < F.col("_cache_end")).alias("_before"), F.max(F.col("start_hole") >= F.col("_cache_end")).alias("_after"))
    rows = ranges.join(bounds.select(*keys, "judged"), keys)
    for other in (held, served, pieces, gaps):
        rows = rows.join(other, keys, "left")
    length, cached, on_server, judged = (F.coalesce(c, F.lit(0)) for c in ("_length", "_cache", "_server", "_judged"))
    asked = F.col("synced") & (F.col("low") < F.col("now"))
    no_cache = F.col("_cache_end").isNull()
    unsettled = (F.col("copies") == "partial") & (judged < F.col("judged") - F.col("low"))
    tail = F.when(F.col("failing"), "source_failing").when(F.col("stale"), "after_cache_fresh").when(F.col("high") > F.col("fresh_at"), "after_last_read").otherwise("after_newest_mail")
    some = [
        F.when(F.col("high") > F.col("now"), "in_progress"), F.when(no_cache & (length < F.col("high") - F.col("low")), "no_complete_read"),
        F.when(F.col("_before"), F.when(F.col("copies") == "older_copy_only", "only_older_cache_copy").otherwise("before_cache")), F.when(F.col("_after"), tail), F.when(unsettled, "folder_copies_disagree"),
    ]
    reasons = F.when(~F.col("synced"), F.array(F.lit("folder_not_synced"))).when(~asked, F.array(F.lit("future"))).otherwise(F.array_compact(F.array(*some)))
    whole = (length == F.col("high") - F.col("low")) & ~unsettled
    state = F.when(~asked | (length == 0), "not_covered").when(whole, "covered").otherwise("partial")
    basis = F.when((cached == length) & (on_server < length), "cache").when((on_server == length) & (cached < length), "server").otherwise("both")
    shown = asked & (length > 0)
    return rows.select(*keys, state.alias("state"), F.when(shown, F.col("covered_from")).alias("covered_from"), F.when(shown, F.col("covered_until")).alias("covered_until"), F.when(shown, basis).alias("basis"), reasons.alias("reasons"))
