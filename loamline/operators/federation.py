"""One search over several sources: which of them the filters allow, before anything runs, and counts that stop early."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import union_top

DATES = frozenset({"since", "until"})
CHAT = frozenset({"conversation", "team", "scope", "mentions_me", "kind"})
#: What each source can be filtered by. An account is one of chat or one of mail; a profile is a folder of the mail program.
USABLE: dict[str, frozenset[str]] = {
    "chats": DATES | CHAT | {"from", "chat_account"},
    "mail": DATES | {"from", "folder", "mail_account", "profile"},
    "transcripts": DATES | {"from", "chat_account"},
    "content": DATES,
    "loop": frozenset(),
    "documents": DATES,
    "notes": DATES | {"profile"},
}


class SourceConflict(ValueError):
    """Filters that the wanted source, or any source, cannot use together."""

    code = "filter_source_conflict"

    def __init__(self, message: str, filters: Iterable[str]):
        super().__init__(message)
        self.filters = sorted(filters)


@dataclass(frozen=True)
class SearchPlan:
    """The sources to search, in their order, and for each other one the filters that leave it out."""

    sources: tuple[str, ...]
    left_out: dict[str, tuple[str, ...]]

    def notes(self) -> list[str]:
        return [f"{source} cannot be filtered by {', '.join(filters)} and was not searched" for source, filters in self.left_out.items()]


def plan_search(filters: Iterable[str], source: str = "all") -> SearchPlan:
    """Which sources a search with these filters reads. A named source must be able to use all of them; with "all" those that can are searched and the others are noted."""
    given = frozenset(filters)
    if unknown := given - frozenset().union(*USABLE.values()):
        raise SourceConflict(f"no source has {', '.join(sorted(unknown))}", unknown)
    if source != "all":
        if source not in USABLE:
            raise SourceConflict(f"there is no source {source}", ())
        if bad := given - USABLE[source]:
            raise SourceConflict(f"{source} cannot be filtered by {', '.join(sorted(bad))}", bad)
        return SearchPlan((source,), {})
    left_out = {name: tuple(sorted(given - usable)) for name, usable in USABLE.items() if given - usable}
    sources = tuple(name for name in USABLE if name not in left_out)
    if not sources:
        raise SourceConflict(f"no source can be filtered by {', '.join(sorted(given))} together", given)
    return SearchPlan(sources, left_out)


def floors(parts: dict[str, DataFrame], hits: DataFrame, floor: int) -> DataFrame:
    """source, returned, matched (exact, null beyond the floor), matched_at_least and truncated. No source is counted further than floor + 1 rows."""
    rows = None
    for name, part in parts.items():
        one = part.limit(floor + 1).agg(F.count("*").alias("_n")).select(F.lit(name).alias("source"), "_n")
        rows = one if rows is None else rows.unionByName(one)
    returned = hits.groupBy("source").agg(F.count("*").alias("returned"))
    out = rows.join(returned, "source", "left").withColumn("returned", F.coalesce("returned", F.lit(0).cast("long")))
    exact = F.when(F.col("_n") <= floor, F.col("_n"))
    return out.select("source", "returned", exact.alias("matched"), F.col("_n").alias("matched_at_least"), (F.col("_n") > F.col("returned")).alias("truncated"))


def search_sources(plan: SearchPlan, parts: dict[str, DataFrame], limit: int, floor: int) -> tuple[DataFrame, DataFrame]:
    """The newest hits of the planned sources in one order (known times first, then source order, then id) and their counts. parts maps sources to hits with id, at and title; sources that are not planned are never read."""
    own = {name: parts[name].select(F.lit(name).alias("source"), F.lit(list(USABLE).index(name)).alias("source_rank"), F.col("id").cast("string").alias("id"), "at", "title") for name in plan.sources}
    hits = union_top(list(own.values()), limit, F.col("at").desc_nulls_last(), F.col("source_rank").asc(), F.col("id").asc())
    return hits, floors(own, hits, floor)
