"""Read memory: an incremental sync leaves what a full one leaves, whatever changed."""

import dataclasses
import json
import random

import pytest
from pyspark.sql import functions as F

from loamline.operators import memory
from loamline.sources.scratch import cut

STORED = "owner long, line long, version long, deleted_at long, quantity double"
BODY = "array<struct<owner:long,line:long,version:long,deleted_at:long,quantity:double,arrival:long,who:string>>"

@pytest.fixture(autouse=True, scope="module")
def interpreted(spark):
    """These plans are wide and their rows few: compiling them would take most of the time."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")
    spark.conf.unset("spark.sql.codegen.factoryMode")



def mapper(records):
    """Every element of the body is a statement about a row; a body that is no list cannot be mapped."""
    read = records.withColumn("l", F.from_json("body", BODY))
    rows = read.where("l IS NOT NULL").select("record", F.explode("l").alias("l"))
    fields = ["owner", "line", "version", "deleted_at", "quantity", "arrival"]
    return memory.Mapped(rows.select("record", *(F.col(f"l.{c}").alias(c) for c in fields)), read.where("l IS NULL").select("record", F.lit("unreadable").alias("code")), rows.select("record", F.col("l.who").alias("id"), F.col("l.who").alias("name"), F.col("l.arrival").alias("at")))


SOURCE = memory.Source(mapper, ["owner", "line"], "version", "deleted_at", ["quantity"], "arrival")


def body(rng, record, shared):
    """A record's own rows, and now and then a row that others make as well."""
    rows = [(record * 100 + i, 0) for i in range(rng.randint(0, 3))] + [(-rng.randint(1, 6), 0) for _ in range(rng.random() < shared)]
    return json.dumps([{"owner": o, "line": n, "version": rng.randint(1, 3), "deleted_at": rng.choice([None, None, 5]), "quantity": float(rng.randint(0, 2)), "arrival": record * 10 + i, "who": rng.choice("abc")} for i, (o, n) in enumerate(rows)])


def written(m):
    return memory.Memory(*(cut(x, "memory") for x in (m.heads, m.refs, m.people)))


def plain(df, *drop):
    return sorted(str(tuple(r)) for r in df.drop(*drop).collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_incremental_equals_full(spark, seed):
    rng, shared = random.Random(seed), (0.0, 0.3)[seed]
    records = {r: body(rng, r, shared) for r in range(30)}
    stored, known = spark.createDataFrame([], STORED), memory.Memory.empty(spark)
    for turn in range(3):
        df = spark.createDataFrame([(str(r), b) for r, b in records.items()], "record string, body string")
        full = memory.sync(df, known, stored, SOURCE, cut, full=True)
        part = memory.sync(df, known, stored, SOURCE, cut)
        assert plain(part.rows.where("change <> 'kept' AND change <> 'unchanged'")) == plain(full.rows.where("change <> 'kept' AND change <> 'unchanged'"))
        assert plain(part.rows, "change") == plain(full.rows, "change")
        assert plain(part.counts) == plain(full.counts) and plain(part.people) == plain(full.people)
        if turn and not shared:
            assert part.skipped.count() > 10
        stored, known = part.rows.drop("change"), written(part.memory)
        for r in rng.sample(sorted(records), 6):
            records[r] = rng.choice([body(rng, r, shared), None, "no list"])
        records[100 + turn] = body(rng, 100 + turn, shared)
        del records[rng.choice(sorted(records))]
        if turn == 2:  # another program changes and drops rows
            stored = cut(stored.withColumn("quantity", F.when(F.col("owner") % 7 == 0, F.lit(9.0)).otherwise(F.col("quantity"))).where("owner % 11 <> 0"), "touched")


def test_skipped_records_are_not_mapped(spark):
    seen = []

    def watched(records):
        seen.append(sorted(r["record"] for r in records.collect()))
        return mapper(records)

    source = memory.Source(watched, ["owner", "line"], "version", "deleted_at", ["quantity"], "arrival")
    one = lambda owner, q: json.dumps([{"owner": owner, "line": 0, "version": 1, "deleted_at": None, "quantity": q, "arrival": owner, "who": "a"}])
    frame = lambda rows: spark.createDataFrame(rows, "record string, body string")
    empty = spark.createDataFrame([], STORED)
    first = memory.sync(frame([("a", one(1, 1.0)), ("b", one(2, 1.0)), ("c", "broken")]), memory.Memory.empty(spark), empty, source, cut)
    assert seen == [["a", "b", "c"]] and [tuple(r) for r in first.failed.collect()] == [("c", "unreadable")]
    first = dataclasses.replace(first, memory=written(first.memory))
    again = memory.sync(frame([("a", one(1, 1.0)), ("b", one(2, 1.0)), ("c", "broken")]), first.memory, first.rows, source, cut)
    assert seen[1:] == [["c"]] and {tuple(r) for r in again.counts.collect()} == {("unchanged", 2)}
    # a new record changes a row that a skipped one vouches for: that one is read as well, in a second pass
    seen.clear()
    third = memory.sync(frame([("a", one(1, 1.0)), ("b", one(2, 1.0)), ("d", one(2, 5.0))]), again.memory, again.rows, source, cut)
    assert seen == [["d"], ["b", "d"]]
    assert {(r["record"], r["contended"]) for r in third.memory.heads.collect()} == {("a", False), ("b", True), ("d", True)}
    seen.clear()
    memory.sync(frame([("a", one(1, 1.0)), ("b", one(2, 1.0)), ("d", one(2, 5.0))]), third.memory, third.rows, source, cut)
    assert seen == [["b", "d"]]  # both are always read together, so there is no second pass
    seen.clear()
    other = memory.Source(watched, ["owner", "line"], "version", "deleted_at", ["quantity"], "arrival", signature="2")
    memory.sync(frame([("a", one(1, 1.0))]), third.memory, third.rows, other, cut)
    assert seen == [["a"]]  # another mapper makes every digest new


def test_memory_is_kept(spark, tmp_path):
    root = str(tmp_path)
    assert memory.Memory.load(spark, root, "chat").heads.count() == 0
    one = json.dumps([{"owner": 1, "line": 0, "version": 1, "deleted_at": None, "quantity": 1.0, "arrival": 1, "who": "a"}])
    rows = spark.createDataFrame([("a", one), ("b", "[]")], "record string, body string")
    first = memory.sync(rows, memory.Memory.empty(spark), spark.createDataFrame([], STORED), SOURCE, cut)
    first.memory.save(root, "chat")
    back = memory.Memory.load(spark, root, "chat")
    assert plain(back.heads) == plain(first.memory.heads) and plain(back.refs) == plain(first.memory.refs) and plain(back.people) == plain(first.memory.people)
    assert memory.sync(rows, back, first.rows, SOURCE, cut).skipped.count() == 2
    partly = memory.sync(rows.where("record = 'b'"), back, first.rows, SOURCE, cut, complete=False)
    assert partly.memory.heads.count() == 2
    assert memory.sync(rows.where("record = 'b'"), back, first.rows, SOURCE, cut).memory.heads.count() == 1


def test_a_first_sync_is_remembered_without_moving_rows(spark):
    rows = spark.createDataFrame([(str(r), body(random.Random(r), r, 0.3)) for r in range(9)], "record string, body string")
    first = memory.sync(rows, memory.Memory.empty(spark), spark.createDataFrame([], STORED), SOURCE, cut)
    assert "Exchange" not in first.memory.refs._jdf.queryExecution().executedPlan().toString()
    assert all(len(r.row) == len(r.hash) == 16 for r in first.memory.refs.collect())
