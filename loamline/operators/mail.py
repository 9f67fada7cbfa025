"""Mail: folders, filters, copies, threads, and the commit of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..sources.scratch import cut
from .ranking import top, union_top

#: Rows of a list that may be broadcast.
BROADCAST_ROWS = 400_000

#: Well-known folder kinds in the order in which folders are listed; others follow, then deleted, then unknown ones.
KINDS = ("inbox", "to_me", "drafts", "sent", "archive")


def kind_rank(kind: Column) -> Column:
    rank = F.lit(5)
    for i, name in enumerate(KINDS):
        rank = F.when(kind == name, i).otherwise(rank)
    return F.when(kind == "deleted", 6).when(kind == "unknown", 7).otherwise(rank)


def resolve_folders(folders: DataFrame, wanted: str, account: str | None = None) -> DataFrame:
    """(account, folder_key) of the folders of that name, or, where none has it, of that kind; case doesn't count."""
    name, kind = F.lower("name") == wanted.lower(), F.lower("kind") == wanted.lower()
    some = folders.where(P.every(name | kind, None if account is None else F.col("account") == account)).withColumn("_rank", F.when(name, 0).otherwise(1))
    best = some.agg(F.min("_rank").alias("_best"))  # one row
    return some.crossJoin(F.broadcast(best)).where("_rank = _best").select("account", "folder_key").distinct()


def memberships(mail: DataFrame, members: DataFrame) -> DataFrame:
    """(id, account, folder_key, is_read): a message's stored folder and the others that list it, each with its own read state."""
    stored = mail.select("id", "account", "folder_key", "is_read")
    other = members.join(mail.select("id", "account"), "id").select("id", "account", "folder_key", "is_read")
    return stored.unionByName(other)


def in_folder(mail: DataFrame, folders: DataFrame, members: DataFrame, wanted: str, account: str | None = None, unread: bool = False) -> DataFrame:
    """The messages in the folders that `wanted` names; with unread, those whose copy in such a folder is unread.

    Where no folder has the name or kind 'unknown', that asks for messages whose folder the archive doesn't hold.
    """
    keys = resolve_folders(folders, wanted, account)
    found = memberships(mail, members).join(F.broadcast(keys), ["account", "folder_key"])  # folders of an archive are few
    found = found.where(~F.col("is_read")) if unread else found
    hits = mail.join(found.select("id").distinct(), "id", "left_semi")
    if wanted.lower() != "unknown":
        return hits
    homeless = mail.join(folders.select("account", "folder_key").distinct(), ["account", "folder_key"], "left_anti").select(mail.columns)
    none = keys.agg((F.count("*") == 0).alias("_none"))  # one row
    return hits.unionByName(homeless.crossJoin(F.broadcast(none)).where("_none").drop("_none"))


def filtered(
    mail: DataFrame, folders: DataFrame, members: DataFrame, account: str | None = None, folder: str | None = None, sender: str | None = None, unread: bool = False, flagged: bool = False, attachments: bool = False,
    gone: bool = False, evicted: bool = False, since=None, until=None,
) -> DataFrame:
    """The messages that all given filters leave. Unread means unread in any folder, or, with a folder, in that one; gone and evicted ones only on demand."""
    rows = mail.where(
        P.every(
            F.lit(True), None if account is None else F.col("account") == account, None if sender is None else P.contains(F.col("sender_name"), sender) | P.contains(F.col("sender_address"), sender),
            F.col("flag") == "flagged" if flagged else None, F.col("has_attachments") if attachments else None, None if gone else F.col("gone_at").isNull(), None if evicted else F.col("evicted_at").isNull(),
            P.half_open(F.col("received_at"), since, until),
        )
    )
    if folder is not None:
        return in_folder(rows, folders, members, folder, account, unread)
    if unread:
        rows = rows.join(memberships(rows, members).where(~F.col("is_read")).select("id").distinct(), "id", "left_semi")
    return rows


def copies(mail: DataFrame, current_folders: DataFrame) -> DataFrame:
    """(id, stands_for): messages of older folder sets that a message of a current set with the same Message-ID stands for; the newest sighting stands."""
    rows = mail.where("message_id <> ''").join(current_folders.withColumn("_current", F.lit(True)), ["account", "folder_key"], "left")
    best = rows.where("_current").groupBy("account", "message_id").agg(F.max_by("id", F.struct("seen_at", "id")).alias("stands_for"))
    return rows.where("_current is null").join(best, ["account", "message_id"]).select("id", "stands_for")


def without_copies(mail: DataFrame, current_folders: DataFrame) -> DataFrame:
    return mail.join(copies(mail, current_folders), "id", "left_anti")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _replies(mail: DataFrame, seeds: DataFrame, rounds: int = 40) -> DataFrame:
    """seed and id of the messages that reply links reach from each seed, both ways, if one of them has another Message-ID than the seed. Each round joins only what the last one found."""
    links = mail.select("account", "id", "message_id", "in_reply_to")
    ends = links.select("account", "id", "message_id", "in_reply_to", F.explode(F.array(F.struct(F.lit("m").alias("kind"), F.col("message_id").alias("name")), F.struct(F.lit("r").alias("kind"), F.col("in_reply_to").alias("name")))).alias("e")).where("e.name <> ''")
    ends = ends.select("account", "id", "message_id", "in_reply_to", "e.kind", "e.name")
    front = seeds.select("seed", "account", F.col("seed").alias("id"), "message_id", "in_reply_to")
    found = front
    for _ in range(rounds):
        named = lambda kind, column, df=front: df.select("seed", "account", F.lit(kind).alias("kind"), F.col(column).alias("name")).where("name <> ''")
        wanted = named("r", "message_id").unionByName(named("m", "in_reply_to")).unionByName(named("m", "message_id")).distinct()  # answers, what it answers, its copies
        near = _few(wanted).join(ends, ["account", "kind", "name"]).select("seed", "account", "id", "message_id", "in_reply_to").distinct()
        front = cut(near.join(found.select("seed", "id"), ["seed", "id"], "left_anti").select("seed", "account", "id", "message_id", "in_reply_to"), "front")
        if front.isEmpty():
            break
        found = cut(found.unionByName(front), "found")
    linked = found.join(seeds.select("seed", F.col("message_id").alias("_own")), "seed").where("message_id <> _own").select("seed").distinct()
    return found.join(linked, "seed", "left_semi").select("seed", "id")


def threads(mail: DataFrame, recipients: DataFrame, seeds: DataFrame, cap: int = 200) -> DataFrame:
    """seed, id, position (oldest first), grouping and truncated: the conversation of each seed (a few ids).

    It is grouped by conversation id where that joins two messages, else by reply links (both ways, transitively, by Message-ID), else by the
    normalised subject with a shared address. The seed is always in; of more than `cap` messages the newest stay.
    """
    seed = cut(seeds.select(F.col("id").alias("seed")).join(mail.withColumnRenamed("id", "seed"), "seed").select("seed", "account", "received_at", "conversation_id", "message_id", "in_reply_to", "subject_norm", "sender_address"), "seeds")
    other = mail.select("id", "account", "received_at", "conversation_id", "message_id", "subject_norm")
    same = lambda *keys: [seed[k] == other[k] for k in keys]
    pick = lambda df, rank: df.where("id <> seed").select("seed", "id", F.lit(rank).alias("rank")).distinct()
    by_conversation = cut(pick(_few(seed.where("conversation_id <> ''")).join(other, same("account", "conversation_id")), 0), "conversations")
    alone = seed.join(by_conversation.select("seed").distinct(), "seed", "left_anti")
    by_reply = cut(pick(_replies(mail, alone), 1), "replies")
    alone = alone.join(by_reply.select("seed").distinct(), "seed", "left_anti").where("subject_norm <> ''")

    address = lambda df: df.where("address <> ''").select("id", F.lower("address").alias("address"))
    alike = mail.select("id", "account", "subject_norm", F.col("sender_address").alias("address")).join(_few(alone.select("account", "subject_norm").distinct()), ["account", "subject_norm"], "left_semi")
    alike = cut(alike, "subjects")  # only messages with a seed's subject meet the recipients
    told = address(recipients.join(_few(alike.select("id")), "id", "left_semi"))
    theirs = alike.select("id", "account", "subject_norm").join(address(alike).unionByName(told).distinct(), "id")
    mine = theirs.join(alone.select(F.col("seed").alias("id")), "id", "left_semi").withColumnRenamed("id", "seed")
    by_subject = pick(mine.join(theirs, ["account", "subject_norm", "address"]), 2)

    every = by_conversation.unionByName(by_reply).unionByName(by_subject)
    best = every.groupBy("seed").agg(F.min("rank").alias("rank"))
    found = every.join(best, ["seed", "rank"]).unionByName(seed.join(best, "seed", "left").select("seed", F.col("seed").alias("id"), F.coalesce("rank", F.lit(2)).alias("rank")))
    dated = found.join(mail.select("id", "received_at"), "id")
    newest = Window.partitionBy("seed").orderBy((F.col("id") == F.col("seed")).desc(), F.desc("received_at"), F.desc("id"))
    probed = dated.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= cap + 1)
    all_of = Window.partitionBy("seed")
    kept = probed.withColumn("truncated", F.max("_n").over(all_of) > cap).where(F.col("_n") <= cap)
    position = F.row_number().over(all_of.orderBy("received_at", "id"))
    return kept.select("seed", "id", position.alias("position"), F.element_at(F.array(*map(F.lit, ("conversation", "reply_chain", "subject"))), F.col("rank") + 1).alias("grouping"), "truncated")


def _rekeyed(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """account, was and detail_key of messages that come back under another detail key: told by a Message-ID that one message on each side has, of those that no detail key matches."""
    keys = ["account", "detail_key"]

    def once(rows: DataFrame, others: DataFrame, name: str) -> DataFrame:
        left = rows.where("message_id <> ''").select(*keys, "message_id").join(others.select(*keys), keys, "left_anti")
        return left.groupBy("account", "message_id").agg(F.count("*").alias("_n"), F.min("detail_key").alias(name)).where("_n = 1").drop("_n")

    return once(stored, batch, "was").join(once(batch, stored, "detail_key"), ["account", "message_id"]).select("account", "was", "detail_key")


def commit(stored: DataFrame, batch: DataFrame, content: list[str], state: list[str]) -> DataFrame:
    """stored merged with a batch of messages, with `was` (the detail key it had) and `change`: new, updated, replaced or unchanged, null where the batch hasn't the message.

    A message is the stored one with its detail key in its account. Else it is the stored one with its Message-ID, if that one isn't in the batch itself and both sides have the Message-ID once; it
    then takes the batch's detail key. Where key and Message-IDs disagree, another message has taken over the key: it replaces what was stored.
    Otherwise content only fills what is empty, and the state follows the later state_seen_at. A batch has a detail key once.
    """
    fields = ["detail_key", "message_id", "state_seen_at", *content, *state]
    side = lambda df, mark: df.select("account", F.col("was"), *(F.col(c).alias(f"{mark}{c}") for c in fields), F.lit(True).alias(f"{mark}in"))
    known = batch.join(_rekeyed(stored, batch), ["account", "detail_key"], "left").withColumn("was", F.coalesce("was", "detail_key"))
    both = side(stored.withColumn("was", F.col("detail_key")), "_o_").join(side(known, "_n_"), ["account", "was"], "full")
    old, new = (lambda c: F.col(f"_o_{c}")), (lambda c: F.col(f"_n_{c}"))
    replaced = F.coalesce((old("message_id") != "") & (new("message_id") != "") & (old("message_id") != new("message_id")), F.lit(False))
    later = replaced | F.coalesce(new("state_seen_at") > old("state_seen_at"), old("in").isNull())
    filled = lambda c: F.when(replaced, new(c)).otherwise(F.coalesce(F.nullif(old(c), F.lit("")), new(c), old(c)))
    out = {"detail_key": F.coalesce(new("detail_key"), old("detail_key")), "message_id": filled("message_id"), "state_seen_at": F.when(later, new("state_seen_at")).otherwise(old("state_seen_at"))}
    out |= {c: filled(c) for c in content}
    out |= {c: F.when(later, new(c)).otherwise(old(c)) for c in state}
    moved = F.lit(False)
    for c, value in out.items():
        moved = moved | ~value.eqNullSafe(old(c))
    change = F.when(new("in").isNull(), F.lit(None)).when(old("in").isNull(), "new").when(replaced, "replaced").when(moved, "updated").otherwise("unchanged")
    return both.select("account", *(v.alias(c) for c, v in out.items()), F.when(old("in"), old("detail_key")).alias("was"), change.alias("change"))


def commit_children(stored: DataFrame, batch: DataFrame, committed: DataFrame) -> DataFrame:
    """The recipients or attachments (account, detail_key and more) of committed messages, under their new keys: a new or replaced message has the batch's, any other its stored ones, or the batch's where none is stored."""
    kept = committed.where("was IS NOT NULL AND (change IS NULL OR change <> 'replaced')").select("account", F.col("was").alias("_was"), F.col("detail_key").alias("_now"))
    mine = stored.join(kept, (stored["account"] == kept["account"]) & (stored["detail_key"] == kept["_was"])).select(stored["account"], F.col("_now").alias("detail_key"), *(stored[c] for c in stored.columns if c not in ("account", "detail_key")))
    read = committed.where("change IS NOT NULL").select("account", "detail_key")
    theirs = batch.join(read, ["account", "detail_key"], "left_semi").join(mine.select("account", "detail_key").distinct(), ["account", "detail_key"], "left_anti")
    return mine.unionByName(theirs.select(mine.columns))


def newest_chosen(mail: DataFrame, chosen: DataFrame, limit: int, since=None, until=None) -> DataFrame:
    """The newest `limit` messages by their chosen time, with `at` and truncated: whether there are more.

    chosen (id, chosen_at) holds the corrected times of the few messages whose copies disagree. The list is two disjoint parts, messages without a correction by received_at, whose range
    reaches the scan, and corrected ones by their own time; each stops at the limit before they meet, so nothing is sorted whole and no time is computed for all.
    """
    few = chosen.select("id", "chosen_at")
    plain = mail.where(P.half_open(F.col("received_at"), since, until)).join(_few(few.select("id")), "id", "left_anti").withColumn("at", F.col("received_at"))
    own = few.where(P.half_open(F.col("chosen_at"), since, until))
    moved = mail.join(_few(own), "id").withColumn("at", F.col("chosen_at")).drop("chosen_at")
    order = [F.col("at").desc(), F.col("id").desc()]
    return top(union_top([plain, moved.select(plain.columns)], limit + 1, *order), limit, *order)


def correspondents(mail: DataFrame, recipients: DataFrame) -> DataFrame:
    """address, name (the newest that isn't empty), messages, first_seen and last_seen over senders and recipients of live mail."""
    live = mail.where("gone_at is null")
    told = live.select("id", F.col("sender_address").alias("address"), F.col("sender_name").alias("name"), "received_at")
    told = told.unionByName(recipients.join(live.select("id", "received_at"), "id").select("id", "address", "name", "received_at"))
    rows = told.where("address <> ''").withColumn("address", F.lower("address"))
    named = F.when(F.col("name") != "", F.struct("received_at", "name"))
    return rows.groupBy("address").agg(F.max_by("name", named).alias("name"), F.count_distinct("id").alias("messages"), F.min("received_at").alias("first_seen"), F.max("received_at").alias("last_seen"))
