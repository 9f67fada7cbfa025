"""Derived tables that know what they were made from: only groups whose inputs changed are built again.

A derivation turns the input rows of a group (the rows with equal keys) into derived rows that carry the keys. The held table has one row a derived row, with `group` (digest of the keys), `mapper` (version of the rules) and `row`, and one row a group whose `row` is null, with its `stamp` (digest of all
input rows of the group, in whatever order); where older programs gave every row the stamp, it is read as well. Rows and stamps are one table, so they are committed together,
and a refresh from older inputs that commits last is found out by the next one. A group is built again when its stamp or the rules are new; it goes when its inputs are gone.

Stamps are sums, so a group with most of the rows combines in each task. Input rows meet the changed groups in a semi-join whose hot side Spark may split.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..sources import archive


@dataclass(frozen=True)
class Derivation:
    """keys: what makes a group; inputs: the columns that build reads, keys included; mapper: raised when the rules change."""

    keys: list[str]
    inputs: list[str]
    build: Callable[[DataFrame], DataFrame]
    mapper: int = 1


@dataclass(frozen=True)
class Refreshed:
    """held: the whole table; moved: group and its new stamp (null: gone) of the groups that were not left alone; gained, lost: derived rows of these groups that are new, or no more."""

    held: DataFrame
    moved: DataFrame
    gained: DataFrame
    lost: DataFrame


class NewerRules(ValueError):
    """The table was made by newer rules than these."""


def _short(digest: Column) -> Column:
    """128 bits of a digest as 24 letters: digests are most of what a refresh moves."""
    return F.base64(F.unhex(F.substring(digest, 1, 32)))


def _group(d: Derivation) -> Column:
    return _short(content_hash(*(F.col(k) for k in d.keys))).alias("group")


def stamps(inputs: DataFrame, d: Derivation) -> DataFrame:
    """group and stamp of the input rows; repeated rows count, their order does not. Null keys are a group like others."""
    rows = inputs.select(_group(d), content_hash(*(F.col(c) for c in d.inputs)).alias("_row"))
    bits = [F.xxhash64(F.lit(i), "_row") for i in range(3)]
    halves = [h for b in bits for h in (F.shiftrightunsigned(b, 32), b.bitwiseAND(F.lit(0xFFFFFFFF)))]
    parts = [F.sum(h).alias(f"_{i}") for i, h in enumerate(halves)]  # 192 bits of the row's digest, in numbers that no sum of rows overflows
    sums = rows.groupBy("group").agg(*parts, F.count("*").alias("_n"))
    return sums.select("group", _short(content_hash(*(F.col(f"_{i}") for i in range(6)), F.col("_n"))).alias("stamp"))


def moved(now: DataFrame, held: DataFrame, d: Derivation) -> DataFrame:
    """group and stamp of the groups that are new, changed, made by older rules, or gone (no stamp). Only group, stamp and mapper of the held table are read."""
    known = held.where("stamp IS NOT NULL").groupBy("group").agg(F.min("stamp").alias("low"), F.max("stamp").alias("high"), F.min("mapper").alias("rules"))
    same = F.coalesce((F.col("low") == F.col("stamp")) & (F.col("high") == F.col("stamp")) & (F.col("rules") == d.mapper), F.lit(False))
    return now.join(known, "group", "full").where(~same).select("group", "stamp")


def built(inputs: DataFrame, changed: DataFrame, d: Derivation, cut: Callable[[DataFrame, str], DataFrame], whole: bool = False) -> DataFrame:
    """The held form of the changed groups that still have inputs. whole: that is every group, so no input row is asked whether it belongs to one; else each is asked once, however often build reads its rows."""
    fresh = changed.where("stamp IS NOT NULL")
    own = inputs.select(*d.inputs) if whole else cut(inputs.select(_group(d), *d.inputs).join(fresh.select("group"), "group", "left_semi").drop("group"), "own")
    made = d.build(own)
    rows = made.select(_group(d), F.lit(None).cast("string").alias("stamp"), F.struct(*made.columns).alias("row"))
    heads = fresh.select("group", "stamp", F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
    return rows.unionByName(heads).select("group", "stamp", F.lit(d.mapper).alias("mapper"), "row")


def _check(held: DataFrame, d: Derivation) -> None:
    newest = held.agg(F.max("mapper")).first()[0]
    if newest is not None and newest > d.mapper:
        raise NewerRules(f"the table was derived by rules {newest}; this program knows {d.mapper}")


def _rows(held: DataFrame) -> DataFrame:
    return held.where("row IS NOT NULL").select("row.*")


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a of which b has none that is equal."""
    digest = lambda df: df.where("row IS NOT NULL").select(_short(F.sha2(F.to_json("row", {"ignoreNullFields": "false"}), 256)).alias("_d"), "row")
    return digest(a).join(digest(b).select("_d").distinct(), "_d", "left_anti").select("row.*")


def refresh(inputs: DataFrame, held: DataFrame | None, d: Derivation, cut: Callable[[DataFrame, str], DataFrame]) -> Refreshed:
    """The derived table after its inputs changed: equal to one built from all of them. held: None where there is none yet. An input without rows leaves an empty table."""
    now = stamps(inputs, d)
    if held is None:
        first = cut(now, "moved")
        new = cut(built(inputs, first, d, cut, True), "derived")
        return Refreshed(new, first, _rows(new), _rows(new).limit(0))
    _check(held, d)
    changed = cut(moved(now, held, d), "moved")
    new = cut(built(inputs, changed, d, cut), "derived")
    old = held.join(changed.select("group"), "group", "left_semi")
    kept = held.join(changed.select("group"), "group", "left_anti")
    return Refreshed(kept.unionByName(new), changed, _differ(new, old), _differ(old, new))


def rows(held: DataFrame) -> DataFrame:
    """The derived rows alone."""
    return _rows(held)


def publish(inputs: DataFrame, root: str, name: str, d: Derivation, cut: Callable[[DataFrame, str], DataFrame]) -> int | None:
    """Bring the published table `name` up to date: only the parts with moved groups are rewritten. The new version, or None where nothing moved; other writers' parts are kept."""
    spark: SparkSession = inputs.sparkSession
    held = archive.current(spark, root, name) if archive.versions(spark, root, name) else None
    if held is not None:
        _check(held, d)
    now = stamps(inputs, d)
    changed = cut(now if held is None else moved(now, held, d), "moved")
    parts = [r[0] for r in changed.select(archive.part_of(["group"])).distinct().collect()]  # at most PARTS
    if not parts:
        return None
    new = cut(built(inputs, changed, d, cut, held is None), "derived")

    def merged(stored: DataFrame | None) -> DataFrame:
        return new if stored is None else stored.join(changed.select("group"), "group", "left_anti").unionByName(new)

    return archive.update(spark, root, name, ["group"], parts, merged)
