"""Conditions that queries put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def every(*conditions: Column | None) -> Column:
    """All conditions that are given; none means true."""
    given = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, given) if given else F.lit(True)


def half_open(clock: Column, since=None, until=None) -> Column:
    """since <= clock < until, the window of messages."""
    return every(clock >= since if since is not None else None, clock < until if until is not None else None)


def closed(clock: Column, since=None, until=None) -> Column:
    """since <= clock <= until, the window of conversations."""
    return every(clock >= since if since is not None else None, clock <= until if until is not None else None)


def live(deleted_at: Column, include_deleted: bool = False) -> Column | None:
    return None if include_deleted else deleted_at.isNull()


def contains(text: Column, part: str) -> Column:
    """A case-folded substring; %, _ and backslash are literal."""
    return F.lower(text).contains(part.lower())


def same_name(wanted: str, *names: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(n) == wanted.lower() for n in names])


def unread(sent_at: Column, horizon: Column, own: Column, deleted_at: Column | None = None) -> Column:
    """After a known read horizon, not one's own, and live. An unknown horizon makes nothing unread."""
    return every(horizon.isNotNull() & (sent_at > horizon), ~F.coalesce(own, F.lit(False)), None if deleted_at is None else deleted_at.isNull())


def overlaps(start: Column, end: Column, since: Column, until: Column) -> Column:
    """Whether [start, end) meets [since, until); an empty interval counts as its start."""
    return (start < until) & ((end > since) | ((start == end) & (start >= since)))


def sent_by(df: DataFrame, wanted: str, id_col: str, name_col: str) -> DataFrame:
    """The rows whose sender id is the wanted one, where the rows in scope have that id, else those whose sender's name contains it. Both are decided in one plan."""
    same = F.col(id_col).cast("string") == wanted
    exists = df.agg(F.coalesce(F.max(same), F.lit(False)).alias("_known"))  # one row
    return df.crossJoin(F.broadcast(exists)).where(F.when(F.col("_known"), same).otherwise(contains(F.col(name_col), wanted))).drop("_known")


def known(flag: Column, other: Column) -> Column:
    """A three-valued flag: unknown takes the other side's value."""
    return F.coalesce(flag, other)


def channel(kind: Column, conversation_id: Column) -> Column:
    return F.lower(kind).isin("topic", "space") | conversation_id.endswith("@thread.tacv2") | conversation_id.endswith("@thread.skype")


def authored(message_type: Column) -> Column:
    """Written by a person rather than made by the system."""
    return ~message_type.startswith("Event/") & ~message_type.startswith("ThreadActivity/") & ~message_type.isin("Control/Typing", "Control/ClearTyping")
