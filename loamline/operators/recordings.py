"""Recordings of calls, from the notices that chats hold: notices read, parts of calls, placeholders, references to meetings.

A message has account_id, thread_id, message_id, sent_at (microseconds), kind ('recording' or 'transcript') and content. Everything is an expression or an aggregate that
combines in each task; a call with most of the notices is numbered by slices (ranking.numbered).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .derive import Derivation
from .ranking import numbered

#: A notice's markup, the form of a transcript's address, and the stamp in a file name.
NOTICE = "a struct<_href: string>, OriginalName struct<_v: string>, Identifiers struct<Id: array<struct<_type: string, _value: string>>>, RecordingStatus struct<_status: string>, RecordingContent struct<_contentTypes: string, _timestamp: string, _duration: string, item: array<struct<_type: string, _uri: string>>>, RecordingStorage struct<_type: string>, MeetingICalUid struct<_value: string>"
TRANSCRIPT_URI = r"^https://([^/]+)(/(?:teams|sites|personal)/[^/]+)/_api/v2\.1/drives/([^/]+)/items/([^/]+)/versions/current/media/transcripts/([^/]+)/content$"
STAMP = r"(\d{8})[_-](\d{6})"
TRANSCRIBED_ONLY = "10001"
#: Markup of the usual form (elements in this order, no character or surrounding space that XML would change) is taken apart by one match; all other markup is left to the XML reader. One group a field of PLAIN_FIELDS.
_OTHER = r'[^"<&' + "".join(f"\\x{i:02X}" for i in (*range(32), 127)) + "]*+"  # single characters: a range would be looked up apart
_VALUE = f"(?! ){_OTHER}(?:&(?:amp|lt|gt|quot|apos);{_OTHER})*+(?<! )"
PLAIN_FIELDS = ("a._href", "OriginalName._v", "callId", "chunkIndex", "RecordingStatus._status", "RecordingContent._contentTypes", "RecordingContent._timestamp", "RecordingContent._duration", "onedriveForBusinessTranscript", "onedriveForBusinessVideo", "RecordingStorage._type", "MeetingICalUid._value")
PLAIN = (
    r'^<URIObject(?: type="@")?>(?:<a href="(@)">#</a>)?(?:<OriginalName v="(@)"/>)?'
    r'(?:<Identifiers>(?:<Id type="(?:callId" value="(@)|chunkIndex" value="(@)|(?!callId"|chunkIndex")@" value="@)"/>){1,20}+</Identifiers>)?(?:<RecordingStatus status="(@)"/>)?'
    r'(?:<RecordingContent contentTypes="(@)" timestamp="(@)" duration="(@)">(?:<item type="(?:onedriveForBusinessTranscript" uri="(@)|onedriveForBusinessVideo" uri="(@)|(?!onedriveForBusiness(?:Transcript|Video)")@" uri="@)"/>){0,20}+</RecordingContent>)?'
    r'(?:<RecordingStorage type="(@)"/>)?(?:<MeetingICalUid value="(@)"/>)?</URIObject\s*+>$'
).replace("@", _VALUE).replace("#", _OTHER.replace('"', ">"))
#: Fields that the XML reader finds in a list of pairs: the list, and which member is the value.
_LISTS = {f: ("Identifiers.Id", "_value") for f in ("callId", "chunkIndex")} | {f: ("RecordingContent.item", "_uri") for f in ("onedriveForBusinessTranscript", "onedriveForBusinessVideo")}
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}

#: A call with more notices than SMALL_CALL, and more than one in HOT_PARTS of all, is numbered by slices.
SMALL_CALL, HOT_PARTS = 100_000, 1024
CALL = ["account_id", "call_id"]
PART = [
    *CALL, "part_key", "thread_id", "message_id", "sent_at", "starts_at", "duration_seconds", "content_types", "chunk_index", "transcribe_only", "host", "site_root", "storage_kind", "drive_id", "item_id", "transcript_id", "share_url", "ref_quality", "meeting_ical_uid", "original_name",
]


def _named(pairs: Column, name: str, value: str) -> Column:
    """The value of the last pair of that type, empty where there is none."""
    return F.coalesce(F.try_element_at(F.filter(pairs, lambda p: p["_type"] == name), F.lit(-1))[value], F.lit(""))


def _micros(stamp: Column) -> Column:
    """A time as microseconds; one without a zone is UTC, what is no time is null."""
    return F.unix_micros(F.try_to_timestamp(F.when(stamp.rlike(r"T[0-9:.]+$"), F.concat(stamp, F.lit("Z"))).otherwise(stamp)))


def _seconds(clock: Column) -> Column:
    """h:mm:ss.fff as seconds; anything else is 0."""
    part = lambda i: F.try_element_at(F.split(clock, ":"), F.lit(i)).try_cast("double")
    return F.when(clock.rlike(r"^\d+:\d+:\d+(\.\d*)?$"), part(1) * 3600 + part(2) * 60 + part(3)).otherwise(0.0)


def _unescaped(value: Column) -> Column:
    clean = value
    for entity, char in _ENTITIES.items():
        clean = F.replace(clean, F.lit(entity), F.lit(char))
    return F.when(F.contains(value, F.lit("&")), clean).otherwise(value)


def read_recordings(messages: DataFrame, cut: Callable[[DataFrame, str], DataFrame], also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The parts that successful recording notices name (columns PART), and account_id and message_id of notices that cannot be read or name no call.

    Messages without a notice and notices of another status make neither. A part is known by its drive item, else by its link, else by its message. Markup is taken apart once, by PLAIN or else by the
    XML reader, into one list of PLAIN_FIELDS: filters on what it says, and on the content, meet the written fields. Columns named in `also` are kept.
    """
    own = ["account_id", "thread_id", "message_id", "sent_at", *also]
    mark = "\x01"  # stands in no markup that matches
    read = messages.where("kind = 'recording'").select(*own, "content", F.substr("content", F.greatest(F.locate("<URIObject", "content"), F.lit(1))).alias("_tail"))
    clean = F.startswith("_tail", F.lit("<URIObject")) & ~(F.contains("_tail", F.lit("\uFFFE")) | F.contains("_tail", F.lit("\uFFFF")))
    # what comes after the first notice does not count
    read = read.withColumn("_taken", F.regexp_replace(F.when(clean, F.col("_tail")).otherwise(""), PLAIN.removesuffix("$") + "(?s:.*)$", "".join(f"{mark}${i}" for i in range(1, len(PLAIN_FIELDS) + 1))))
    quick = F.startswith("_taken", F.lit(mark))  # markup that does not match stays as it is and begins with <
    markup = F.regexp_extract("_tail", r"(?s)^<URIObject.*?</URIObject\s*>", 0)
    read = read.select(*own, "_taken", F.contains("content", F.lit("<URIObject")).alias("_any"), F.when(~quick, markup).alias("_markup"))
    plain = F.regexp_replace("_markup", r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)", "&amp;")
    told = F.from_xml(plain, f"{NOTICE}, _bad string", {"attributePrefix": "_", "columnNameOfCorruptRecord": "_bad"})
    read = read.select(*own, "_taken", "_any", "_markup", F.when(F.col("_markup") != "", told).alias("n"))
    slow = [_named(F.col(f"n.{_LISTS[f][0]}"), f, _LISTS[f][1]) if f in _LISTS else F.coalesce(F.col(f"n.{f}"), F.lit("")) for f in PLAIN_FIELDS]
    fields = F.when(quick, F.split(_unescaped(F.col("_taken")), mark, -1)).otherwise(F.array(F.lit(""), *slow))
    fine = quick | (F.coalesce(F.col("_markup") != "", F.lit(False)) & F.col("n._bad").isNull())
    read = read.select(*own, "_any", fine.alias("_ok"), fields.alias("_fields"))
    text = lambda field: F.col("_fields")[PLAIN_FIELDS.index(field) + 1]
    done = text("RecordingStatus._status") == "Success"
    read = read.withColumn("call_id", text("callId"))
    told = F.when(F.col("_any") & (~F.col("_ok") | (done & (F.col("call_id") == ""))), "broken").when(F.col("_any") & done, "part")
    names = ("host", "site_root", "drive_id", "item_id", "transcript_id")
    address = F.split(F.regexp_replace(text("onedriveForBusinessTranscript"), TRANSCRIPT_URI, "".join(f"{mark}${i}" for i in range(1, len(names) + 1)) + mark), mark, -1)
    chunk, types = text("chunkIndex"), text("RecordingContent._contentTypes")
    share = F.coalesce(F.nullif(text("a._href"), F.lit("")), text("onedriveForBusinessVideo"))
    fields = {name: F.when(F.size("_address") == len(names) + 2, F.col("_address")[i]).otherwise("") for i, name in enumerate(names, 1)}
    parts = (
        read.withColumns({"told": told, "_address": address, "share_url": share, "content_types": types, "chunk_index": chunk})
        .withColumns(fields)
        .withColumn("ref_quality", F.when(F.col("drive_id") != "", "drive_item").when(F.col("share_url") != "", "share_only").otherwise("ams_only"))
    )
    key = F.when(F.col("ref_quality") == "drive_item", F.concat(F.lit("d:"), "drive_id", F.lit("/"), "item_id")).when(F.col("ref_quality") == "share_only", F.concat(F.lit("u:"), F.substring(F.sha2("share_url", 256), 1, 16))).otherwise(F.concat(F.lit("m:"), "message_id"))
    fields = parts.withColumns(
        {
            "part_key": key, "starts_at": _micros(text("RecordingContent._timestamp")), "duration_seconds": _seconds(text("RecordingContent._duration")), "transcribe_only": (F.col("chunk_index") == TRANSCRIBED_ONLY) | ~F.contains("content_types", F.lit("Recording")),
            "storage_kind": text("RecordingStorage._type"), "meeting_ical_uid": text("MeetingICalUid._value"), "original_name": text("OriginalName._v"),
        }
    )
    written = cut(fields.select(*PART, *also, "told"), "notices")
    return written.where("told = 'part'").select(*PART, *also), written.where("told = 'broken'").select("account_id", "message_id", *also)


def read_transcripts(messages: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """account_id, call_id, thread_id, message_id and sent_at of transcript notices; their JSON may have its quotes escaped. Columns named in `also` are kept."""
    call = F.get_json_object(F.replace(F.col("content"), F.lit('\\"'), F.lit('"')), "$.callId")
    return messages.where("kind = 'transcript'").select("account_id", call.alias("call_id"), "thread_id", "message_id", "sent_at", *also).where("call_id <> ''")


def assemble(parts: DataFrame, notices: DataFrame, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The parts of every call (PART and ordinal): of the notices of one file the latest counts (ties: the greater message_id), and parts are numbered by start, stamp in the file's name, sending, message.

    A call that only transcript notices tell of, or of which no part has a transcript, gets one more part of quality 'unresolved' after the others. An unknown start comes first.
    """
    rest = ["sent_at", "_tie", "message_id", *(c for c in PART if c not in (*CALL, "part_key", "sent_at", "message_id"))]
    told = notices.select(*CALL, "sent_at", "thread_id", "message_id", *(F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in PART if c not in (*CALL, "sent_at", "thread_id", "message_id")))
    rows = parts.select(*PART, F.lit("").alias("_tie"), F.lit(False).alias("_told")).unionByName(told.select(*PART, F.col("thread_id").alias("_tie"), F.lit(True).alias("_told")))

    def latest(df: DataFrame) -> DataFrame:
        newest = F.max(F.struct(*rest))  # all columns decide: one message with two contents has one result
        return df.groupBy(*CALL, "part_key", "_told").agg(newest.alias("p")).select(*CALL, "part_key", "_told", *(F.col(f"p.{c}").alias(c) for c in rest))

    heard = F.coalesce(F.contains("content_types", F.lit("Transcript")), F.lit(False))
    blank = {c: F.lit("") for c in PART if c not in (*CALL, "thread_id", "message_id", "sent_at")}
    blank |= {"part_key": F.concat(F.lit("call:"), "call_id"), "starts_at": F.lit(None).cast("long"), "duration_seconds": F.lit(0.0), "content_types": F.lit("Transcript"), "transcribe_only": F.lit(False), "ref_quality": F.lit("unresolved")}
    filled = [(F.when(F.col("_told"), blank[c]).otherwise(F.col(c)) if c in blank else F.col(c)).alias(c) for c in PART]
    stamp = F.concat(F.regexp_extract("original_name", STAMP, 1), F.regexp_extract("original_name", STAMP, 2))
    order = [F.col("ref_quality") == "unresolved", F.col("starts_at"), stamp, F.col("sent_at"), F.col("message_id"), F.col("part_key")]
    call = Window.partitionBy(*CALL)

    counts = rows.groupBy(*CALL).agg(F.count("*").alias("_n"))
    total, top = counts.agg(F.sum("_n"), F.max("_n")).first()
    most = max(SMALL_CALL, (total or 0) // HOT_PARTS)
    some = (top or 0) > most
    hot = cut(counts.where(F.col("_n") > most).select(*CALL), "hot-calls") if some else None  # at most HOT_PARTS
    same = lambda df, how: df.join(F.broadcast(hot), CALL, how)
    cold = same(rows, "left_anti") if some else rows
    # a call's rows meet once: what follows is dealt by call as well
    cold = latest(cold.repartition(*CALL)).withColumn("_heard", F.max(~F.col("_told") & heard).over(call)).where("NOT (_told AND _heard)")
    out = cold.select(*filled).withColumn("ordinal", F.row_number().over(call.orderBy(*order)).cast("long"))
    if not some:
        return out
    large = latest(same(rows, "left_semi"))
    known = large.where(~F.col("_told") & heard).select(*CALL).distinct()
    large = large.where("NOT _told").unionByName(large.where("_told").join(known, CALL, "left_anti")).select(*filled)
    return out.unionByName(numbered(large, CALL, order, cut, "ordinal"))


def notices(messages: DataFrame, cut: Callable[[DataFrame, str], DataFrame], also: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """All that a call's parts are derived from, one row a notice (PART and told: 'part' or 'notice'), and the notices that could not be read. Columns named in `also` are kept."""
    parts, broken = read_recordings(messages, cut, also)
    heard = read_transcripts(messages, also)
    return parts.withColumn("told", F.lit("part")).unionByName(heard.withColumn("told", F.lit("notice")), allowMissingColumns=True), broken


def derivation(cut: Callable[[DataFrame, str], DataFrame]) -> Derivation:
    """Parts by call, built again for the calls of which a notice came, went or changed."""
    return Derivation(CALL, [*PART, "told"], lambda rows: assemble(rows.where("told = 'part'"), rows.where("told = 'notice'"), cut))


def counts(parts: DataFrame, broken: DataFrame) -> DataFrame:
    """account_id with its calls, parts (those that resolve), how many of each quality, and notices that could not be read."""
    one = lambda quality: F.count(F.when(F.col("ref_quality") == quality, 1))
    calls = parts.groupBy(*CALL).agg(F.count(F.when(F.col("ref_quality") != "unresolved", 1)).alias("parts"), *(one(q).alias(q) for q in ("drive_item", "share_only", "ams_only", "unresolved")), F.lit(1).alias("calls"), F.lit(0).alias("unparsable"))
    lost = broken.groupBy("account_id").agg(F.count("*").alias("unparsable")).withColumns({c: F.lit(0) for c in ("calls", "parts", "drive_item", "share_only", "ams_only", "unresolved")})
    names = ["calls", "parts", "drive_item", "share_only", "ams_only", "unresolved", "unparsable"]
    return calls.select("account_id", *names).unionByName(lost).groupBy("account_id").agg(*(F.sum(n).alias(n) for n in names))


def resolve(references: DataFrame, parts: DataFrame, occurrences: DataFrame, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """ref, kind, call_id and position of the calls that each reference means, newest first; a reference that means none has one row of nulls.

    A reference is a call's id, else a meeting chat's (every call in it), else an event's key: the calls of that occurrence that were recorded in the event's chat. Parts and events are grouped before they meet the
    references, so a chat with many parts is met once a call. occurrences: event_key, thread_id, call_id.
    """
    at = F.max(F.coalesce("starts_at", "sent_at")).alias("at")
    held = cut(parts.groupBy("call_id", "thread_id").agg(at), "calls")
    events = occurrences.select("event_key", "thread_id", "call_id").distinct().join(held, ["thread_id", "call_id"])
    asked, kinds = references.select("ref").distinct(), ("call", "thread", "event")
    keyed = [rows.select(F.col(key).alias("ref"), F.lit(i).alias("_kind"), "call_id", "at") for i, (rows, key) in enumerate(((held, "call_id"), (held, "thread_id"), (events, "event_key")))]
    met = keyed[0].unionByName(keyed[1]).unionByName(keyed[2]).where("ref <> ''").join(asked, "ref")
    met = cut(met.groupBy("ref", "_kind", "call_id").agg(F.max("at").alias("at")), "met")
    first = met.groupBy("ref").agg(F.min("_kind").alias("_kind"))  # what a reference means is the first kind that has it
    hits = met.join(first, ["ref", "_kind"]).withColumn("kind", F.array(*(F.lit(k) for k in kinds))[F.col("_kind")]).drop("_kind")
    left = asked.join(first, "ref", "left_anti")
    ranked = numbered(hits, ["ref"], [F.col("at").desc(), F.col("call_id")], cut, "position").select("ref", "kind", "call_id", "position")
    none = left.select("ref", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("long").alias("position"))
    return ranked.unionByName(none)
