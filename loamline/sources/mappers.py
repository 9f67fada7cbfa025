"""Landing records to archive rows, and rows back to JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import member_list_name, scrubbed

MESSAGE = "struct<id: string, from: string, content: string, messagetype: string, version: bigint, deletetime: bigint>"


def newest_live(writes: DataFrame, keys: list[str], sequence: str, deleted: str, value: list[str]) -> DataFrame:
    """What a log of writes leaves: per key the write of the greatest sequence, unless it deletes."""
    last = writes.groupBy(*keys).agg(F.max_by(F.struct(deleted, *value), sequence).alias("_last"), F.max(sequence).alias(sequence))
    return last.where(~F.col(f"_last.{deleted}")).select(*keys, sequence, *(F.col(f"_last.{v}").alias(v) for v in value))


def under(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose key starts with a prefix; the condition reaches the scan."""
    return df.where(F.col(key).startswith(prefix))


def reply_chain(records: DataFrame, json: str, message: str = MESSAGE) -> DataFrame:
    """One row a message of records that hold a JSON map of messages; a record that can't be read gives none."""
    fields = F.from_json(F.col(json), F.lit(f"map<string, {message}>"))
    return records.select(*(c for c in records.columns if c != json), F.explode(fields).alias("message_key", "m")).select(*(c for c in records.columns if c != json), "message_key", "m.*")


def conversation(records: DataFrame, json: str) -> DataFrame:
    """Id, kind, members and a name: its title, else its members."""
    v = F.from_json(F.col(json), F.lit("struct<id: string, kind: string, title: string, members: array<string>>"))
    members = F.coalesce(F.col("v.members"), F.array().cast("array<string>"))
    name = F.coalesce(F.nullif("v.title", F.lit("")), member_list_name(members, F.size(members)))
    return records.select(v.alias("v")).where("v.id IS NOT NULL").select("v.id", F.lower("v.kind").alias("kind"), members.alias("members"), name.alias("name"))


def session(records: DataFrame, json: str) -> DataFrame:
    """The messages of agent sessions, in order, from one JSON document a session."""
    v = F.from_json(F.col(json), F.lit("struct<id: string, messages: array<struct<role: string, text: string>>>"))
    return records.select(v.alias("v")).select("v.id", F.posexplode("v.messages").alias("position", "m")).select("id", "position", "m.role", "m.text")


def fingerprint(files: DataFrame, keys: list[str], *parts: Column) -> DataFrame:
    """One digest for a set of files, whatever their order: a source is read again only when it changes.

    Every file's digest is cut into four numbers, and the source's digest is that of their sums and of the number of files: sums combine in each task, so a source with most of the files is no group anywhere.
    """
    line = F.sha2(F.concat_ws("\0", *(p.cast("string") for p in parts)), 256)
    sums = [F.sum(F.conv(F.substring(line, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    return files.groupBy(*keys).agg(F.sha2(F.concat_ws(":", *(s.cast("string") for s in sums), F.count("*").cast("string")), 256).alias("fingerprint"), F.count("*").alias("files"))


#: Fields of an activity item: name, its path in the record (of several the first known one), and its type.
ACTIVITY = (
    ("type", ("activityType",), "string"), ("subtype", ("activitySubtype",), "string"), ("is_read", ("isRead",), "boolean"), ("at", ("timestamp",), "timestamp"), ("conversation_id", ("sourceThreadId",), "string"),
    ("message_id", ("sourceMessageId", "messageId"), "string"), ("reply_chain_id", ("sourceReplyChainId",), "string"), ("app_id", ("teamsAppId",), "string"),
)


def variant_fields(record: Column, fields: tuple) -> tuple[dict[str, Column], Column]:
    """The fields of a parsed record, null where they are absent, empty or of another type, and the names of those whose value is there but of no use."""
    out, losses = {}, []
    for name, paths, kind in fields:
        known, lost = [], F.lit(False)
        for path in paths:
            found = F.try_variant_get(record, f"$.{path}", "variant")
            shape = F.coalesce(F.schema_of_variant(found), F.lit("VOID"))
            plain = ~shape.startswith("OBJECT") & ~shape.startswith("ARRAY")
            value = F.when(plain, F.try_variant_get(record, f"$.{path}", kind))
            known.append(F.nullif(value, F.lit("")) if kind == "string" else value)
            lost = lost | (value.isNull() & (shape != "VOID"))
        out[name] = F.coalesce(*known)
        losses.append(F.when(lost & out[name].isNull(), F.lit(name)))
    return out, F.array_compact(F.array(*losses))


def activity(records: DataFrame, json: str) -> tuple[DataFrame, DataFrame]:
    """Activity items (id and the fields of ACTIVITY, with losses: the fields that could not be read) and what could not be mapped at all: the record's other columns and a code.

    Records are of no fixed schema: each is parsed as a variant and asked field by field, so an unknown field costs nothing and a broken one only itself.
    """
    own = [c for c in records.columns if c != json]
    read = records.select(*own, F.try_parse_json(json).alias("_v"))
    shape = F.coalesce(F.schema_of_variant("_v"), F.lit(""))
    key, unusable = variant_fields(F.col("_v"), (("id", ("activityId",), "string"),))
    code = F.when(F.col("_v").isNull(), "unreadable").when(~shape.startswith("OBJECT"), "not_an_object").when(key["id"].isNull(), F.when(F.size(unusable) > 0, "unusable_id").otherwise("no_id"))
    fields, losses = variant_fields(F.col("_v"), ACTIVITY)
    items = read.where(code.isNull()).select(*own, key["id"].alias("id"), *(c.alias(n) for n, c in fields.items()), losses.alias("losses"))
    return items, read.where(code.isNotNull()).select(*own, code.alias("code"))


def json_lines(df: DataFrame, scrub: list[str] | None = None) -> DataFrame:
    """A JSON text a row, secrets of the named columns removed."""
    df = df.withColumns({c: scrubbed(F.col(c)) for c in scrub or []})
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
