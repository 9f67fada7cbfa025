"""Recaps of meetings and their items, captured from copies that each know a part; accounts linked by address. Every rule is one aggregate by key or a join of such."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash

CALL = ["account_id", "call_id"]
#: The fields of a recap by how they are captured: an empty text, null time or zero number says nothing; a flag that was true stays so.
TEXTS = ("recap_id", "headline", "short_summary", "outline", "summary_sections", "speakers", "topics", "attendance_status", "organizer_id")
TIMES = ("meeting_start_at", "meeting_end_at", "expires_at")
NUMBERS = ("attendees_count",)
FLAGS = ("has_catchup", "has_recap", "is_missed", "has_conf_room")
LINK = ("ical_uid", "link_method")
RECORDING = ("recording_url", "recording_start_at", "recording_end_at", "duration_seconds")
RECAP = (*TEXTS, *TIMES, *NUMBERS, *FLAGS, *LINK, *RECORDING)
ITEM = ("title", "text", "owner_name", "speaker_name", "at", "mentioned_by", "highlights", "ordinal")


#: How many rows meet in a task, which sorts them by their call in some 300 bytes each: few, as long as a shuffle of no more than DIRECT tasks does (up to so many Spark writes rows as they come, without holding them); then up to LARGE_TASK, 400 MB.
SMALL_TASK, LARGE_TASK, DIRECT = 50_000, 1_250_000, 200


def _empty(name: str) -> str | int | bool | None:
    """The value with which a field says nothing, besides null."""
    return False if name in FLAGS else 0 if name in (*NUMBERS, "duration_seconds") else None if name in TIMES or name.endswith("_at") else ""


def _stated(name: str) -> Column:
    """The field, null where it says nothing."""
    return F.col(name) if _empty(name) is None else F.nullif(F.col(name), F.lit(_empty(name))).alias(name)


def _filled(name: str, value: Column) -> Column:
    """The value as a recap keeps it, which has nulls for times alone."""
    return value if _empty(name) is None else F.coalesce(value, F.lit(_empty(name)))


def _last(value: Column, said: Column) -> Column:
    """The value of the last copy that says it; of copies that came together the greater value."""
    return F.max(F.when(said, F.struct("_new", "_order", value.alias("v"))))["v"]


def _by_call(rows: DataFrame) -> DataFrame:
    """All rows of a call in one task. They meet before they are sorted: most calls have few, so to fold each task's own first would combine little, and what it folds is wider than the rows and spills."""
    n = rows.count()
    return rows.repartition(max(1, min(DIRECT, -(-n // SMALL_TASK)), -(-n // LARGE_TASK)), *CALL)


def capture_recaps(stored: DataFrame, batch: DataFrame, arrival: str, at: Column) -> DataFrame:
    """One row a call: RECAP, first_seen_at, updated_at and change (new, changed, unchanged, or kept where the batch doesn't tell of the call).

    stored: CALL, RECAP, first_seen_at, updated_at; batch: copies with CALL, RECAP and an order of arrival, any number a call. Copies are applied in that order by the rules of the field lists. The recording moves as
    one: address, times and duration come from the last copy with an address, and without one each from the last that has it. A link's method comes with its id ('ical_uid' unless told). Columns beyond these are left out.
    Both are counted first, so that there are as many tasks as they need.
    """
    fields = [_stated(c) for c in RECAP]
    old = stored.select(*CALL, *fields, "first_seen_at", "updated_at", F.lit(False).alias("_new"), F.lit(None).cast("long").alias("_order"))
    new = batch.select(*CALL, *fields, *(F.lit(None).cast(old.schema[c].dataType).alias(c) for c in ("first_seen_at", "updated_at")), F.lit(True).alias("_new"), F.col(arrival).cast("long").alias("_order"))
    kept, said = ~F.col("_new"), {c: F.col(c).isNotNull() for c in RECAP}
    alone = {c: _last(F.col(c), said[c]) for c in (*TEXTS, *TIMES, *NUMBERS)} | {c: F.max(c) for c in FLAGS}
    method = F.when(kept, F.col("link_method")).otherwise(F.coalesce("link_method", F.lit("ical_uid")))
    linked = _last(F.struct("ical_uid", method.alias("link_method")), kept | said["ical_uid"])
    file = _last(F.struct(*RECORDING), said["recording_url"])
    state = _by_call(old.unionByName(new)).groupBy(*CALL).agg(
        *(c.alias(n) for n, c in alone.items()), linked.alias("_link"), file.alias("_file"), *(_last(F.col(c), said[c]).alias(f"_{c}") for c in RECORDING[1:]),
        F.max(F.when(kept, F.struct(F.lit(1).alias("_one"), *RECAP))).alias("_was"), F.max("_new").alias("_told"), F.max("first_seen_at").alias("first_seen_at"), F.max("updated_at").alias("updated_at"),
    )
    state = state.withColumns({c: F.col(f"_link.{c}") for c in LINK} | {"recording_url": F.col("_file.recording_url")} | {c: F.when(F.col("_file").isNotNull(), F.col(f"_file.{c}")).otherwise(F.col(f"_{c}")) for c in RECORDING[1:]})
    state = state.withColumns({c: _filled(c, F.col(c)) for c in RECAP})
    same = content_hash(*(F.col(c) for c in RECAP)) == content_hash(*(_filled(c, F.col(f"_was.{c}")) for c in RECAP))
    change = F.when(~F.col("_told"), "kept").when(F.col("_was").isNull(), "new").when(same, "unchanged").otherwise("changed")
    state = state.withColumn("change", change)
    moved = F.col("change").isin("new", "changed")
    return state.select(*CALL, *RECAP, F.coalesce("first_seen_at", at).alias("first_seen_at"), F.when(moved, at).otherwise(F.col("updated_at")).alias("updated_at"), "change")


def item_key(kind: Column, origin: Column, ordinal: Column, title: Column, text: Column) -> Column:
    """An item's id within its call: white space and case of its title and text don't count."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))
    return F.substring(F.sha2(F.concat_ws("|", kind, origin, ordinal.cast("string"), norm(title), norm(text)), 256), 1, 16)


def apply_items(stored: DataFrame, batch: DataFrame, arrival: str, at: Column) -> DataFrame:
    """One row an item: CALL, kind, origin, item_key, ITEM, first_seen_at, superseded_at, change (new, changed, unchanged, superseded, kept).

    A set is all items of a call of one kind and origin. For each set of which the batch has an item, stored items that it lacks are superseded, which stays until an item comes again; other sets stay as they are. Of several copies of an
    item in the batch the last counts (ties: the greater).
    """
    group = [*CALL, "kind", "origin"]
    keys = [*group, "item_key"]
    own = batch.withColumn("item_key", item_key(F.col("kind"), F.col("origin"), F.col("ordinal"), F.col("title"), F.col("text")))
    folded = own.groupBy(*keys).agg(F.max(F.struct(F.col(arrival).alias("_at"), *ITEM)).alias("_n"))
    both = stored.select(*keys, F.struct(*ITEM, "first_seen_at", "superseded_at").alias("_o")).join(folded, keys, "full")
    rows = both.join(folded.select(*group).distinct().withColumn("_read", F.lit(True)), group, "left")
    same = content_hash(*(F.col(f"_n.{c}") for c in ITEM)) == content_hash(*(F.col(f"_o.{c}") for c in ITEM))
    live = F.col("_o.superseded_at").isNull()
    change = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNotNull(), F.when(same & live, "unchanged").otherwise("changed")).when(F.col("_read") & live, "superseded").otherwise("kept")
    takes = F.col("_n").isNotNull()
    gone = F.when(change == "superseded", at).when(~takes, F.col("_o.superseded_at"))
    return rows.select(*keys, *(F.when(takes, F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c) for c in ITEM), F.coalesce("_o.first_seen_at", at).alias("first_seen_at"), gone.alias("superseded_at"), change.alias("change"))


def link_accounts(identities: DataFrame, profiles: DataFrame, links: DataFrame) -> DataFrame:
    """account_id, principal_id, method, active and change (linked, relinked, unlinked, refused, kept) of all accounts that were looked at or have a link row.

    identities: account_id, address (a null one where a look found none); profiles: principal_id, address; links: account_id, principal_id, method, active. An account is linked where an address that no other account has is an address
    of exactly one principal, and no other account claims that one. A row of another method than 'address' is the operator's and is never changed; an automatic link whose evidence is gone ends. A principal that keeps another account is refused.
    """
    clean = lambda df, key: df.select(key, F.lower(F.trim("address")).alias("address")).distinct()
    seen = clean(identities, "account_id")
    alone = seen.where("contains(address, '@')").groupBy("address").agg(F.min("account_id").alias("account_id"), F.count("*").alias("n")).where("n = 1")
    met = alone.join(clean(profiles, "principal_id").where("contains(address, '@')"), "address").groupBy("account_id").agg(F.min("principal_id").alias("match"), F.max("principal_id").alias("_other")).where("match = _other")
    claimed = met.groupBy("match").agg(F.min("account_id").alias("account_id"), F.count("*").alias("n")).where("n = 1").select("account_id", "match")
    held = links.select("account_id", "principal_id", "method", F.coalesce("active", F.lit(False)).alias("active"), F.lit(True).alias("_held"))
    rows = seen.select("account_id", F.lit(True).alias("_seen")).distinct().join(held, "account_id", "full").join(claimed, "account_id", "left")
    fixed = F.col("_seen").isNull() | (F.col("_held") & (F.coalesce("method", F.lit("")) != "address"))
    rows = rows.withColumn("_fixed", F.coalesce(fixed, F.lit(False)))
    taken = rows.where("_fixed AND active").select(F.col("principal_id").alias("match"), F.lit(True).alias("_taken")).distinct()
    rows = rows.join(taken, "match", "left")
    active, wish = F.coalesce("active", F.lit(False)), F.when(F.col("_taken").isNull(), F.col("match"))
    change = (
        F.when(F.col("_fixed") | (active & F.col("principal_id").eqNullSafe(F.col("match")) & F.col("_taken").isNull()), "kept")
        .when(active, F.when(wish.isNotNull(), "relinked").otherwise("unlinked"))
        .when(wish.isNotNull(), "linked")
        .when(F.col("match").isNotNull(), "refused")
        .otherwise("kept")
    )
    rows = rows.withColumn("change", change)
    makes = F.col("change").isin("linked", "relinked")
    return rows.select(
        "account_id", F.when(makes, F.col("match")).otherwise(F.col("principal_id")).alias("principal_id"), F.when(makes, "address").otherwise(F.col("method")).alias("method"), F.when(makes, True).when(F.col("change") == "unlinked", False).otherwise(active).alias("active"), "change"
    )
