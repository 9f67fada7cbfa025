"""Calendar: one event from two sources, agendas, principals, recaps, rooms, owners."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import short_id

#: References that are held against every event's id one by one.
PREFIX_REFS = 100
SKEW, ALL_DAY_WINDOW = 5_000_000, 14 * 3_600_000_000


def principals(links: DataFrame) -> DataFrame:
    """(account_id, principal_id) of the active links, of several of one account the smallest; an account without one is its own principal."""
    return links.where("unlinked_at IS NULL").groupBy("account_id").agg(F.min("principal_id").alias("principal_id"))


def with_principal(rows: DataFrame, links: DataFrame, account: str = "account_id") -> DataFrame:
    known = principals(links).select(F.col("account_id").alias("_account"), "principal_id")
    return rows.join(known, F.col(account) == F.col("_account"), "left").withColumn("principal", F.coalesce("principal_id", account)).drop("_account", "principal_id")


def merge_events(a: DataFrame, b: DataFrame, keys: list[str], texts: Sequence[str], flags: Sequence[str], details: Sequence[str], prefer: str = "b") -> DataFrame:
    """One event a key from at most one row of each source, with base, removed, filled and overridden.

    Rows have last_modified, fresh_at, removed_at, start, end, all_day, start_date, end_date, cancelled, detail_as_of and the named columns; times are microseconds.
    Removed: all rows are, or no live row was edited later than the removal by more than the skew; a live event drops its removed rows.
    Base: the row modified later by more than the skew, else that of the fresher cache, else `prefer`. Texts and flags of the base, where it knows them, else the
    other's. The all-day block is the base's where it knows the flag; a known false is filled alone, a true with its dates and
    times only where the base looks all-day and starts within 14 hours of it. Only a true cancellation is filled. Details come from the row with the later detail_as_of,
    else the base, and empty ones are filled. What both state differently is overridden.
    """
    columns = ["last_modified", "fresh_at", "removed_at", "start", "end", "all_day", "start_date", "end_date", "cancelled", "detail_as_of", *texts, *flags, *details]
    side = lambda df, m: df.select(*keys, *(F.col(c).alias(f"_{m}_{c}") for c in columns), F.lit(True).alias(f"_{m}"))
    rows = side(a, "a").join(side(b, "b"), keys, "full")
    of = lambda m, c: F.col(f"_{m}_{c}")
    gone = {m: F.col(f"_{m}") & of(m, "removed_at").isNotNull() for m in "ab"}
    live = {m: F.col(f"_{m}") & of(m, "removed_at").isNull() for m in "ab"}
    last_gone = F.greatest(*(F.when(gone[m], of(m, "removed_at")) for m in "ab"))
    edited = reduce(lambda x, y: x | y, (F.coalesce(live[m] & (of(m, "last_modified") > last_gone + SKEW), F.lit(False)) for m in "ab"))
    rows = rows.withColumn("removed", last_gone.isNotNull() & ~edited)
    for m in "ab":  # a live event drops its removed rows
        rows = rows.withColumn(f"_{m}", F.coalesce(F.col(f"_{m}") & (F.col("removed") | of(m, "removed_at").isNull()), F.lit(False)))
    gap = of("b", "last_modified") - of("a", "last_modified")
    fresher = F.coalesce(of("b", "fresh_at"), F.lit(0)) - F.coalesce(of("a", "fresh_at"), F.lit(0))
    ranked = F.when(F.coalesce(F.abs(gap) > SKEW, F.lit(False)), gap > 0).when(fresher != 0, fresher > 0).otherwise(F.lit(prefer == "b"))
    rows = rows.withColumn("_base_b", F.when(F.col("_a") & F.col("_b"), ranked).otherwise(F.col("_b")))
    taking = lambda m, c: F.when(F.col(f"_{m}"), of(m, c))
    base = lambda c: F.when(F.col("_base_b"), taking("b", c)).otherwise(taking("a", c))
    other = lambda c: F.when(F.col("_base_b"), taking("a", c)).otherwise(taking("b", c))
    hours = (base("end") - base("start")) / F.lit(3.6e9)
    looks = (hours >= 23) & (F.abs(hours - F.round(hours / 24) * 24) <= 1)
    whole = base("all_day").isNull() & other("all_day") & looks & (F.abs(base("start") - other("start")) <= ALL_DAY_WINDOW)
    rows = rows.withColumn("_whole", F.coalesce(whole, F.lit(False)))
    block = lambda c: F.when(F.col("_whole"), other(c)).otherwise(base(c))
    detail_other = F.coalesce(other("detail_as_of") > base("detail_as_of"), other("detail_as_of").isNotNull() & base("detail_as_of").isNull())
    first, second = (lambda c: F.when(detail_other, other(c)).otherwise(base(c))), (lambda c: F.when(detail_other, base(c)).otherwise(other(c)))
    empty = lambda c: F.nullif(c, F.lit(""))
    out = {c: F.coalesce(empty(base(c)), empty(other(c))) for c in texts}
    out |= {c: block(c) for c in ("start", "end", "start_date", "end_date")}
    out["all_day"] = F.when(F.col("_whole"), F.lit(True)).otherwise(F.coalesce(base("all_day"), F.when(~other("all_day"), F.lit(False))))
    out["cancelled"] = F.coalesce(base("cancelled"), F.when(other("cancelled"), F.lit(True)))
    out |= {c: F.coalesce(base(c), other(c)) for c in flags}
    out |= {c: F.coalesce(empty(first(c)), empty(second(c))) for c in details}
    filled = [F.when(empty(base(c)).isNull() & empty(other(c)).isNotNull(), F.lit(c)) for c in texts]
    filled += [F.when(base(c).isNull() & out[c].isNotNull(), F.lit(c)) for c in ("all_day", "cancelled", *flags)]
    differ = [F.when(empty(base(c)) != empty(other(c)), F.lit(c)) for c in texts] + [F.when(base(c) != other(c), F.lit(c)) for c in ("start", "end", "cancelled", *flags)]
    return rows.select(*keys, F.when(F.col("_base_b"), "b").otherwise("a").alias("base"), "removed", *(v.alias(c) for c, v in out.items()), F.concat_ws(",", *filled).alias("filled"), F.concat_ws(",", *differ).alias("overridden"))


def overlaps(since: Column, until: Column, since_date: Column, until_date: Column) -> Column:
    """Whether an event touches [since, until): an all-day one by its dates, others, unknown ones too, by their times."""
    days = (F.col("start_date") <= until_date) & ((F.col("end_date") > since_date) | (F.col("start_date") >= since_date))
    times = (F.col("start") < until) & ((F.col("end") > since) | (F.col("start") == since))
    return F.when(F.coalesce("all_day", F.lit(False)), days).otherwise(times)


def visible(needle: str = "", masters: bool = False, cancelled: bool = False, declined: bool = False) -> Column:
    """Neither a series master, nor cancelled, nor declined, unless asked for; with a needle in subject, organizer or location."""
    out = F.lit(True)
    if not masters:
        out &= F.coalesce(F.col("event_type") != "master", F.lit(True))
    if not cancelled:
        out &= ~F.coalesce("cancelled", F.lit(False))
    if not declined:
        out &= F.coalesce(F.col("response") != "declined", F.lit(True))
    return out & F.lower(F.concat_ws("\0", "subject", "organizer", "location")).contains(needle.lower()) if needle else out


def agenda_order(midnight: Column) -> list[Column]:
    """By start (all-day ones at their local midnight), all-day first, then subject, key and principal."""
    all_day = F.coalesce("all_day", F.lit(False))
    return [F.when(all_day, midnight).otherwise(F.col("start")).asc(), all_day.desc(), F.col("subject").asc(), F.col("key").asc(), F.col("principal").asc()]


def preferred_items(items: DataFrame, keys: list[str], origin: str = "origin", first: str = "recap") -> DataFrame:
    """Per key the live items of the first origin where there are any, else the others'."""
    live = items.where("superseded_at IS NULL")
    has = live.groupBy(*keys).agg(F.max(F.col(origin) == first).alias("_first"))
    return live.join(has, keys).where(~F.col("_first") | (F.col(origin) == first)).drop("_first")


def join_occurrences(timed: DataFrame, dated: DataFrame, day: int = 86_400_000_000) -> DataFrame:
    """(principal, global_id, source, key, date): timed keys that are the same occurrence as a date key of their global id: their instant lies in the date's UTC day.

    Of a source's timed keys on a date the one nearest to midnight joins, and only where the date group has no row of that source.
    """
    at = timed.withColumn("date_start", F.floor(F.col("at") / day) * day)
    has = dated.select("principal", "global_id", "date_start", F.col("source").alias("_source")).distinct()
    near = at.join(dated.select("principal", "global_id", "date_start").distinct(), ["principal", "global_id", "date_start"])
    free = near.join(has.withColumnRenamed("_source", "source"), ["principal", "global_id", "date_start", "source"], "left_anti")
    return free.groupBy("principal", "global_id", "date_start", "source").agg(F.min_by("key", F.struct(F.col("at") - F.col("date_start"), F.col("key"))).alias("key"))


def contains_range(spans: DataFrame, keys: list[str], since: Column, until: Column) -> DataFrame:
    """keys and covered: whether the union of a key's spans holds all of [since, until)."""
    order = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    clipped = spans.where((F.col("end") > since) & (F.col("start") < until))
    reach = clipped.withColumn("_reach", F.greatest(since, F.coalesce(F.max("end").over(order), since)))
    whole = reach.groupBy(*keys).agg((F.max((F.col("start") > F.col("_reach")).cast("int")) == 0).alias("_joined"), F.max("end").alias("_end"))
    return spans.select(*keys).distinct().join(whole, keys, "left").select(*keys, F.coalesce(F.col("_joined") & (F.col("_end") >= until), F.lit(False)).alias("covered"))


def rooms(events: DataFrame) -> DataFrame:
    """key, name, kind and address: pieces of the location text, entries of `locations` and resources of `attendees`, once by case-folded name.

    The first spelling stands; a structured or resource entry replaces the kind of a text one, and the first known address is kept. Links are no rooms.
    """
    piece = F.posexplode(F.split(F.coalesce("location", F.lit("")), ";")).alias("_at", "name")
    text = events.select("key", F.lit(0).alias("_from"), piece).select("key", "_from", "_at", F.trim("name").alias("name"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("address")).where(~F.lower("name").rlike("^https?://"))
    entry = lambda column, kind, rank: events.select("key", F.lit(rank).alias("_from"), F.posexplode(column).alias("_at", "_e")).select("key", "_from", "_at", F.trim("_e.name").alias("name"), F.lit(kind).alias("kind"), F.nullif("_e.address", F.lit("")).alias("address"), *(["_e.type"] if kind == "resource" else []))
    listed = entry("locations", "structured", 1).unionByName(entry("attendees", "resource", 2).where(F.lower("type") == "resource").drop("type"))
    rows = text.unionByName(listed).where("name <> ''").withColumn("_order", F.struct("_from", "_at"))
    named = F.when(F.col("kind") != "text", F.col("_order"))
    return rows.groupBy("key", F.lower("name").alias("_name")).agg(F.min_by("name", "_order").alias("name"), F.coalesce(F.min_by("kind", named), F.lit("text")).alias("kind"), F.min_by("address", F.when(F.col("address").isNotNull(), F.col("_order"))).alias("address")).drop("_name")


def owner_is_me(own: Column, owner: Column, people: Column) -> Column:
    """true, false or null: a full name is me; a lone first name is, unless another person of the meeting has it too, which leaves it unknown."""
    own_name, name = F.lower(F.trim(own)), F.lower(F.trim(owner))
    first = F.split(own_name, r"\s+")[0]
    others = F.exists(people, lambda p: (F.split(F.lower(F.trim(p)), r"\s+")[0] == first) & (F.regexp_replace(F.lower(F.trim(p)), r"\s+", " ") != own_name))
    return F.when((F.coalesce(own_name, F.lit("")) == "") | (F.coalesce(name, F.lit("")) == ""), F.lit(False)).when(name == own_name, F.lit(True)).when(name != first, F.lit(False)).when(F.coalesce(others, F.lit(False)), F.lit(None)).otherwise(F.lit(True))


def find_events(events: DataFrame, refs: DataFrame, most: int = 10) -> DataFrame:
    """ref, principal, key, match and candidates: events whose key or id a text is, else those whose id begins with it; of several at most `most` are listed."""
    own = events.select("principal", "key").distinct().withColumn("id", short_id("ev_", 10, F.col("principal"), F.col("key")))
    exact = refs.join(own, F.col("ref") == F.col("key")).unionByName(refs.join(own, F.col("ref") == F.col("id"))).distinct().withColumn("match", F.lit("exact"))
    short = refs.where(F.length("ref").between(4, 12))
    few = short.limit(PREFIX_REFS + 1).count() <= PREFIX_REFS
    if few:  # a handful of references meets each id once
        begins = own.join(F.broadcast(short), F.col("id").startswith(F.col("ref")))
    else:
        sized = own.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(4), F.lit(12)), lambda n: F.substring("id", F.lit(1), n))))
        begins = short.join(sized, F.col("ref") == F.col("_p")).drop("_p")
    begins = begins.withColumn("match", F.lit("prefix")).join(exact.select("ref").distinct(), "ref", "left_anti").select(exact.columns)
    by = Window.partitionBy("ref")
    found = exact.unionByName(begins).withColumn("candidates", F.count("*").over(by)).withColumn("_n", F.row_number().over(by.orderBy("principal", "key")))
    return found.where(F.col("_n") <= most).select("ref", "principal", "key", "match", "candidates")
