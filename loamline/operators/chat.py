"""Chat: upserts of accounts, conversations, activity and records; teams; flags of messages; evidence."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.text import composed_name, content_hash, first_known
from .ranking import top


def upsert_accounts(stored: DataFrame, batch: DataFrame, at: Column) -> DataFrame:
    """tenant_id, user_id, locale, first_seen_at, last_synced_at: first_seen_at is kept, a locale is replaced by one that isn't empty."""
    keys = ["tenant_id", "user_id"]
    new = batch.groupBy(*keys).agg(F.max("locale").alias("_locale")).withColumn("_new", F.lit(True))
    both = stored.join(new, keys, "full")
    seen = F.col("_new").isNotNull()
    return both.select(
        *keys, F.coalesce(F.nullif("_locale", F.lit("")), "locale", "_locale").alias("locale"),
        F.coalesce("first_seen_at", at).alias("first_seen_at"), F.when(seen, at).otherwise(F.col("last_synced_at")).alias("last_synced_at"),
    )


def gated(stored: DataFrame, batch: DataFrame, keys: list[str], content: list[str], sticky: Mapping[str, Column] | None = None) -> DataFrame:
    """stored merged with a batch (one row a key) by content hash, with `change`: new, edited, unchanged, or kept where the batch lacks the row.

    sticky names, for columns that a later row must not forget, the value to take, from columns old_<name> and new_<name>.
    """
    sticky = sticky or {}
    old = stored.select(*keys, *(F.col(c).alias(f"old_{c}") for c in content), F.lit(True).alias("_old"))
    new = batch.select(*keys, *(F.col(c).alias(f"new_{c}") for c in content), F.lit(True).alias("_new"))
    both = old.join(new, keys, "full")
    value = {c: sticky.get(c, F.col(f"new_{c}")) for c in content}
    same = content_hash(*value.values()) == content_hash(*(F.col(f"old_{c}") for c in content))
    change = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "new").when(same, "unchanged").otherwise("edited")
    return both.withColumn("change", change).select(*keys, *(F.when(F.col("change") == "kept", F.col(f"old_{c}")).otherwise(v).alias(c) for c, v in value.items()), "change")


def upsert_conversations(stored: DataFrame, batch: DataFrame, keys: list[str], content: list[str], horizon: str = "read_horizon_at", marker: str = "read_horizon_client_message_id") -> DataFrame:
    """Hash-gated; a snapshot that lost the read marker doesn't forget a known one, nor its message id where the time is the same."""
    at = F.coalesce(f"new_{horizon}", f"old_{horizon}")
    kept = (F.coalesce(F.col(f"new_{marker}"), F.lit("")) == "") & at.eqNullSafe(F.col(f"old_{horizon}")) & F.col("_old")
    return gated(stored, batch, keys, [*content, horizon, marker], {horizon: at, marker: F.when(kept, F.col(f"old_{marker}")).otherwise(F.col(f"new_{marker}"))})


def upsert_records(stored: DataFrame, batch: DataFrame, keys: list[str], value: str, removed: str, at: Column) -> DataFrame:
    """Generic records by value: one whose value didn't decode (null) never overwrites; a sighting lifts a removal. `change` is new, edited (value or removal), unchanged or kept."""
    new = batch.select(*keys, F.col(value).alias("_value"), F.lit(True).alias("_new"))
    both = stored.withColumn("_old", F.lit(True)).join(new, keys, "full")
    other = F.col("_value").isNotNull() & ~F.col("_value").eqNullSafe(F.col(value))
    seen, known = F.col("_new").isNotNull(), F.col("_old").isNotNull()
    change = F.when(~seen, "kept").when(~known, "new").when(other | F.col(removed).isNotNull(), "edited").otherwise("unchanged")
    touched = change.isin("new", "edited")
    return both.select(
        *keys, F.when(seen & other, F.col("_value")).otherwise(F.col(value)).alias(value), F.when(touched, at).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(~seen, F.col(removed)).alias(removed), change.alias("change"),
    )


def teams(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """account, id, name, channels, last_activity and unread of each team: a space, or what other conversations name as their team.

    Messages are summed by team before the join; a channel's messages count for its team.
    """
    c = conversations
    channels = c.where("team_id <> '' AND team_id <> id").groupBy("account", F.col("team_id").alias("id")).agg(F.count("*").alias("channels"), F.max("last_message_at").alias("_last"))
    place = c.select("account", F.col("id").alias("conversation_id"), F.when(F.col("team_id") != "", F.col("team_id")).otherwise(F.col("id")).alias("team"), "read_horizon_at")
    new = messages.join(place, ["account", "conversation_id"]).where(P.unread(F.col("sent_at"), F.col("read_horizon_at"), F.col("own"), F.col("deleted_at")))
    unread = new.groupBy("account", F.col("team").alias("id")).agg(F.count("*").alias("unread"))
    rows = c.join(channels, ["account", "id"], "left").where((F.lower("kind") == "space") | F.col("channels").isNotNull()).join(unread, ["account", "id"], "left")
    return rows.select("account", "id", "name", F.coalesce("channels", F.lit(0)).alias("channels"), F.greatest("last_message_at", "_last").alias("last_activity"), F.coalesce("unread", F.lit(0)).alias("unread"))


def resolve_teams(listed: DataFrame, wanted: DataFrame, most: int = 10) -> DataFrame:
    """wanted, id, name, matches and more of the teams whose id or whole name each wanted text is: at most `most` candidates, in order of their name, and whether there are more."""
    names = listed.groupBy("id").agg(F.min("name").alias("name"))
    low = F.lower("wanted")
    by_id = wanted.withColumn("_key", F.col("wanted")).join(names.withColumn("_key", F.col("id")), "_key")
    by_name = wanted.withColumn("_key", low).join(names.withColumn("_key", F.lower("name")), "_key").where("id <> wanted")
    hits = by_id.unionByName(by_name).drop("_key")
    by = Window.partitionBy("wanted")
    ranked = hits.withColumn("matches", F.count("*").over(by)).withColumn("_n", F.row_number().over(by.orderBy("name", "id")))
    return ranked.where(F.col("_n") <= most).select("wanted", "id", "name", "matches", (F.col("matches") > most).alias("more"))


def flags(messages: DataFrame, activity: DataFrame) -> DataFrame:
    """messages with mentions_me, direct_mention, thread_root and authored: their own flag, or a mention in the feed; a direct one is of the person.

    The feed is reduced to a row a message before the join.
    """
    keys = ["account", "conversation_id", "message_id"]
    mention = F.col("type").startswith("mention")
    feed = activity.where(mention).groupBy(*keys).agg(F.max(F.lower("subtype") == "person").alias("_person")).withColumn("_mention", F.lit(True))
    rows = messages.join(feed, keys, "left")
    root = P.channel(F.col("kind"), F.col("conversation_id")) & ((F.col("reply_chain_id") == "") | (F.col("reply_chain_id") == F.col("message_id")))
    return rows.select(
        *messages.columns, (F.col("own_mention") | F.col("_mention").isNotNull()).alias("mentions_me"), (F.col("own_mention") | F.coalesce("_person", F.lit(False))).alias("direct_mention"), root.alias("thread_root"), P.authored(F.col("message_type")).alias("authored"),
    )


def evidence(messages: DataFrame, since: Column, until: Column) -> DataFrame:
    """account, items, my_items and deleted of the authored messages in a half-open window."""
    live = F.col("deleted_at").isNull()
    rows = messages.where(P.half_open(F.col("sent_at"), since, until) & P.authored(F.col("message_type")))
    count = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("account").agg(count(live).alias("items"), count(live & F.col("own")).alias("my_items"), count(~live).alias("deleted"))


def sequence_gaps(messages: DataFrame, keys: list[str], number: str, at: str, since: Column, until: Column) -> DataFrame:
    """keys and missing: numbers absent between a conversation's messages of [since, until), the nearest numbered one before and the nearest after.

    A message without a number is left out, and the nearest numbered one stands in for it.
    """
    side = F.when(F.col(at) < since, -1).when(F.col(at) >= until, 1).otherwise(0)
    rows = messages.where(F.col(number).isNotNull()).withColumn("_side", side)
    inside = rows.where("_side = 0").select(*keys, F.col(number).alias("_q"))
    edges = rows.where("_side <> 0").groupBy(*keys).agg(F.max(F.when(F.col("_side") < 0, F.struct(F.col(at), F.col(number)))).alias("_before"), F.min(F.when(F.col("_side") > 0, F.struct(F.col(at), F.col(number)))).alias("_after"))
    near = edges.select(*keys, F.explode(F.array(F.col(f"_before.{number}"), F.col(f"_after.{number}"))).alias("_q")).where("_q is not null")
    order = Window.partitionBy(*keys).orderBy("_q")
    step = inside.unionByName(near).withColumn("_gap", F.greatest(F.lit(0), F.col("_q") - F.lag("_q").over(order) - 1))
    return step.groupBy(*keys).agg(F.coalesce(F.sum("_gap"), F.lit(0)).cast("long").alias("missing"))


def activity_list(activity: DataFrame, messages: DataFrame, people: DataFrame, conversations: DataFrame, limit: int, types: list[str] | None = None, unread: bool = False, system: tuple[str, ...] = (), cut: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """The newest activity items with the message each points at, its sender, and the conversation's composed name; `truncated` says whether there are more.

    Filters look at the items alone and each joins one row at most, so the first limit + 1 are taken before anything is joined; cut(df, name) writes them, so that items are read once and not by each join. Messages of `system` conversations are not shown.
    """
    some = activity.where(P.every(F.lit(True), F.col("type").isin(types) if types else None, ~F.coalesce("is_read", F.lit(False)) if unread else None))
    few = top(some, limit, F.col("at").desc_nulls_last(), F.col("id").desc())
    few = F.broadcast(cut(few, "newest") if cut else few)
    said = messages.where(~F.col("conversation_id").isin(*system)) if system else messages
    said = said.select("conversation_id", F.col("id").alias("message_id"), "content_text", "sender_id", F.col("sender_name").alias("_stated"))
    keys = ["conversation_id", "message_id"]
    held = few.join(said.join(few.select(*keys), keys, "left_semi"), keys, "left")
    names = people.select(F.col("id").alias("sender_id"), F.col("name").alias("_known"))
    own = conversations.select(F.col("id").alias("conversation_id"), F.col("display_name").alias("_name"), "team_id")
    teams = conversations.select(F.col("id").alias("team_id"), F.col("display_name").alias("_team"))
    rows = held.join(names.join(held.select("sender_id"), "sender_id", "left_semi"), "sender_id", "left").join(own, "conversation_id", "left")
    rows = rows.join(teams, (rows["team_id"] == teams["team_id"]) & (rows["team_id"] != "") & (rows["team_id"] != rows["conversation_id"]), "left").drop(teams["team_id"])
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select("id", "type", "is_read", "at", "conversation_id", composed_name(F.col("_team"), F.col("_name")).alias("conversation"), "message_id", blank("content_text").alias("text"), blank("sender_id").alias("sender_id"), F.coalesce(first_known(F.col("_stated"), F.col("_known")), F.lit("")).alias("sender"), "truncated")
