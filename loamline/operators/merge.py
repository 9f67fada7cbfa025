"""Version-gated upserts, clocked capture, two-source merges, absence rules: each one shuffle by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash


def fold_statements(statements: DataFrame, keys: list[str], version: str, arrival: str, deleted: str, content: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """The state that statements leave behind when they are applied in order of arrival.

    Only statements of the greatest version count: the last arrived of them gives the content, the last of them that has a
    tombstone gives the tombstone (an older or equal version never lifts it). Associative, so it runs with partial aggregation.
    more: further aggregates of all statements.
    """
    top = F.struct(F.col(version), F.col(arrival))
    state = statements.groupBy(*keys).agg(
        F.max(version).alias(version),
        F.max_by(F.struct(*content), top).alias("_content"),
        F.max(F.when(F.col(deleted).isNotNull(), F.struct(F.col(version), F.col(arrival), F.col(deleted)))).alias("_dead"),
        *(c.alias(n) for n, c in (more or {}).items()),
    )
    dead = F.when(F.col(f"_dead.{version}") == F.col(version), F.col(f"_dead.{deleted}"))
    return state.select(*keys, version, dead.alias(deleted), *(F.col(f"_content.{c}").alias(c) for c in content), *(more or {}))


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], version: str, deleted: str, content: list[str], told: list[str] | None = None) -> DataFrame:
    """The merged rows with `change`: new, edited, deleted, unchanged or kept (not in the batch). The batch has one row a key.

    An older version is ignored; an equal one needs other content; a stored tombstone stays unless a strictly newer version lacks it.
    told: columns that only the batch has; they are kept, null where it has no row.
    """
    old = stored.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in (version, deleted, *content)), F.lit(True).alias("_old"))
    new = batch.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in (version, deleted, *content)), F.lit(True).alias("_new"), *(told or []))
    both = old.join(new, keys, "full")
    sticky = F.col("_old") & F.col(f"_o_{deleted}").isNotNull() & F.col(f"_n_{deleted}").isNull() & (F.col(f"_n_{version}") <= F.col(f"_o_{version}"))
    both = both.withColumn(f"_n_{deleted}", F.when(sticky, F.col(f"_o_{deleted}")).otherwise(F.col(f"_n_{deleted}")))
    same = content_hash(*(F.col(f"_n_{c}") for c in (*content, deleted))) == content_hash(*(F.col(f"_o_{c}") for c in (*content, deleted)))
    change = (
        F.when(F.col("_new").isNull(), "kept")
        .when(F.col("_old").isNull(), "new")
        .when((F.col(f"_n_{version}") < F.col(f"_o_{version}")) | same, "unchanged")
        .when(F.col(f"_n_{deleted}").isNotNull() & F.col(f"_o_{deleted}").isNull(), "deleted")
        .otherwise("edited")
    )
    both = both.withColumn("change", change)
    takes = F.col("change").isin("new", "edited", "deleted")
    return both.select(*keys, *(F.when(takes, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in (version, deleted, *content)), *(told or []), "change")


def change_feed(merged: DataFrame) -> DataFrame:
    return merged.where(F.col("change").isin("new", "edited", "deleted"))


def capture(statements: DataFrame, keys: list[str], clock: str, units: dict[str, Column]) -> DataFrame:
    """Per unit the value with the latest clock; ties go to the longer value, then to the greater one. A null is no statement.

    Every unit is its own max_by, so the result does not depend on the order of arrival. Each unit's clock is kept beside it.
    """
    picks = []
    for name, measure in units.items():
        stated = F.when(F.col(name).isNotNull(), F.struct(F.col(clock).alias("clock"), measure.alias("measure"), F.col(name).alias("value")))
        picks.append(F.max(stated).alias(name))
    best = statements.groupBy(*keys).agg(*picks)
    return best.select(*keys, *(F.col(f"{n}.value").alias(n) for n in units), *(F.col(f"{n}.clock").alias(f"{n}_clock") for n in units))


def people(sightings: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    """First and last sighting of a key and its newest name that isn't empty."""
    return sightings.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.max_by(name, F.when(F.col(name) != "", F.struct(at, name))).alias(name))


def two_sources(a: DataFrame, b: DataFrame, keys: list[str], clock: str, fields: list[str], skew: int) -> DataFrame:
    """One row a key from at most one row of each source.

    The base is the row whose clock is later by more than `skew`, else a's. Unknown fields of the base are filled from the other row and named
    in `filled`; fields that both state differently are named in `overridden`.
    """
    left = a.select(*keys, *(F.col(c).alias(f"_a_{c}") for c in (clock, *fields)), F.lit(True).alias("_in_a"))
    right = b.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in (clock, *fields)), F.lit(True).alias("_in_b"))
    both = left.join(right, keys, "full")
    base_b = F.col("_in_a").isNull() | (F.col("_in_b") & F.coalesce(F.col(f"_b_{clock}") - F.col(f"_a_{clock}") > skew, F.lit(False)))
    both = both.withColumn("_base_b", F.coalesce(base_b, F.lit(False)))
    pick = lambda c, other=False: F.when(F.col("_base_b") != F.lit(other), F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}"))
    filled = F.concat_ws(",", *(F.when(pick(c).isNull() & pick(c, True).isNotNull(), F.lit(c)) for c in fields))
    overridden = F.concat_ws(",", *(F.when(pick(c) != pick(c, True), F.lit(c)) for c in fields))
    return both.select(
        *keys, F.when(F.col("_base_b"), "b").otherwise("a").alias("base"), *(F.coalesce(pick(c), pick(c, True)).alias(c) for c in fields), filled.alias("filled"), overridden.alias("overridden")
    )


def absence(live: DataFrame, read: DataFrame, misses: DataFrame, key: str, freshness: int, received: str, oldest: int, most: int = 20, share: float = 0.1) -> DataFrame:
    """verdict of each live row after a trusted read: seen, missed_once, gone or evicted.

    A row that a strictly fresher read misses again is gone where the read reaches back to its time, else evicted; if more than
    `most` rows and more than `share` of all would be gone at once, none is marked.
    """
    seen = read.select(key, F.lit(True).alias("_seen"))
    rows = live.join(seen, key, "left").join(misses.select(key, "missed_at"), key, "left")
    again = F.col("missed_at").isNotNull() & (F.col("missed_at") < freshness)
    verdict = F.when(F.col("_seen"), "seen").when(~again, "missed_once").when(F.col(received).isNull(), "missed_once").when(F.col(received) >= oldest, "gone").otherwise("evicted")
    judged = rows.withColumn("verdict", verdict).drop("_seen", "missed_at")
    sums = judged.agg(F.sum((F.col("verdict") == "gone").cast("long")).alias("g"), F.count("*").alias("n"))
    held = F.broadcast(sums.select(((F.col("g") > most) & (F.col("g") > F.lit(share) * F.col("n"))).alias("_held")))  # one row
    return judged.crossJoin(held).withColumn("verdict", F.when(F.col("_held") & F.col("verdict").isin("gone", "evicted"), "withheld").otherwise(F.col("verdict"))).drop("_held")


def mark_removed(stored: DataFrame, seen: DataFrame, keys: list[str], complete: bool, at: Column, removed: str = "removed_at") -> DataFrame:
    """stored with a removal time on live rows that a complete read didn't see; a sighting lifts it; an incomplete read marks nothing."""
    marks = seen.select(*keys).distinct().withColumn("_seen", F.lit(True))
    rows = stored.join(marks, keys, "left")
    gone = F.when(F.col("_seen"), F.lit(None)).when(F.col(removed).isNull() & F.lit(complete), at).otherwise(F.col(removed))
    return rows.withColumn(removed, gone).drop("_seen")


def admit(observations: DataFrame, published: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """The observations that no published row has, by key and digest."""
    return observations.join(published.select(*keys, digest), [*keys, digest], "left_anti")


def current_and_last_good(observations: DataFrame, keys: list[str], at: str, good: Column, value: str) -> DataFrame:
    """The newest value of a key and the newest that is good; of equally new ones the greatest."""
    order = F.struct(at, value)
    return observations.groupBy(*keys).agg(F.max_by(value, order).alias("current"), F.max_by(value, F.when(good, order)).alias("last_good"))


def admit_window(stored: DataFrame, window: DataFrame, key: str, item: str, bound: str, stages: list[list[str]]) -> DataFrame:
    """item, stored key and state of each item of a window that a server has read: what it is of what is stored.

    in_place: a stored row is bound to the item's id. matched: of the items and rows that are left, one of each agrees in all fields of a stage (tried in order; a field that is null on
    either side agrees with nothing). deferred: some agree in a stage, but not one to one, and no later stage settles it; such an item stays apart until more is known. new: nothing agrees.
    Items have one row an id, stored rows one a key. Each stage is one aggregation a side and an equi-join of what is unique, so a hot value costs a count and joins nothing.
    """
    items = window.withColumn("_item", F.col(item))
    done = items.join(stored.where(F.col(bound).isNotNull()).select(F.col(key), F.col(bound).alias("_item")), "_item").select("_item", key, F.lit("in_place").alias("state"))
    doubtful = None
    for fields in stages:
        left = items.join(done.select("_item"), "_item", "left_anti").dropna(subset=fields)
        rows = stored.where(F.col(bound).isNull()).join(done.select(key), key, "left_anti").dropna(subset=fields)
        ours = left.groupBy(*fields).agg(F.count("*").alias("_n"), F.min("_item").alias("_item"))
        theirs = rows.groupBy(*fields).agg(F.count("*").alias("_m"), F.min(key).alias(key))
        met = ours.join(theirs, fields)
        several = left.join(met.where("_n > 1 OR _m > 1").select(*fields), fields, "left_semi").select("_item")
        doubtful = several if doubtful is None else doubtful.unionByName(several)
        done = done.unionByName(met.where("_n = 1 AND _m = 1").select("_item", key, F.lit("matched").alias("state")))
    unsure = doubtful.distinct().withColumn("_unsure", F.lit(True))
    out = items.select("_item").join(done, "_item", "left").join(unsure, "_item", "left")
    return out.select(F.col("_item").alias(item), key, F.coalesce("state", F.when(F.col("_unsure"), "deferred"), F.lit("new")).alias("state"))
