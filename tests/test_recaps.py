"""Recaps and items against a plain loop over copies; account links by hand."""

import random

import pytest
from pyspark.sql import functions as F

from loamline.operators import recaps as R

KINDS = {c: "boolean" for c in R.FLAGS} | {c: "long" for c in ("attendees_count", "duration_seconds", "recording_start_at", "recording_end_at", *R.TIMES)}
COLUMNS = [*R.CALL, *R.RECAP]
SHAPE = ", ".join(f"{c} {KINDS.get(c, 'string')}" for c in COLUMNS)
STORED, COPIES = f"{SHAPE}, first_seen_at long, updated_at long", f"{SHAPE}, arrival long"
EMPTY = {c: False if c in R.FLAGS else None if c in R.TIMES or c.endswith("_at") else 0 if KINDS.get(c) else "" for c in R.RECAP}


@pytest.fixture(autouse=True, scope="module")
def interpreted(spark):
    """Wide plans over few rows: compiling them would take most of the time."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")
    spark.conf.unset("spark.sql.codegen.factoryMode")


def after(state, copy):
    """One copy applied to a recap."""
    out = dict(state or EMPTY)
    for c in (*R.TEXTS, *R.TIMES, *R.NUMBERS):
        out[c] = copy[c] if copy[c] not in (None, "", 0) or (c in R.TIMES and copy[c] is not None) else out[c]
    for c in R.FLAGS:
        out[c] = bool(out[c] or copy[c])
    if copy["ical_uid"]:
        out["ical_uid"], out["link_method"] = copy["ical_uid"], copy["link_method"] or "ical_uid"
    if copy["recording_url"]:
        out |= {c: copy[c] for c in R.RECORDING[:3]} | {"duration_seconds": copy["duration_seconds"] or 0}
    elif not out["recording_url"]:
        out |= {c: copy[c] for c in R.RECORDING[1:3] if copy[c] is not None} | ({"duration_seconds": copy["duration_seconds"]} if copy["duration_seconds"] else {})
    return out


def draw(dice, column):
    if dice.random() < 0.5:
        return None if dice.random() < 0.5 else EMPTY[column]
    kind = KINDS.get(column)
    return dice.random() < 0.5 if kind == "boolean" else dice.randrange(3) if kind else dice.choice(["x", "y", "yy"])


def held(rows):
    return {r["call_id"]: {c: r[c] for c in R.RECAP} for r in rows}


def test_capture_is_a_fold_of_copies(spark):
    dice = random.Random(11)
    want, stored = {}, spark.createDataFrame([], STORED)
    for batch in range(3):
        copies = [{"account_id": "a", "call_id": dice.choice([None, "", "hot", "hot", f"c{dice.randrange(6)}"]), "arrival": i} | {c: draw(dice, c) for c in R.RECAP} for i in range(30)]
        known = {k: dict(v) for k, v in want.items()}
        for copy in copies:
            want[copy["call_id"]] = after(want.get(copy["call_id"]), copy)
        told = {c["call_id"] for c in copies}
        mixed = copies + copies[:3]
        dice.shuffle(mixed)
        got = R.capture_recaps(stored, spark.createDataFrame([tuple(r[c] for c in [*COLUMNS, "arrival"]) for r in mixed], COPIES), "arrival", F.lit(batch).cast("long")).collect()
        assert held(got) == want and len(got) == len(want)
        for r in got:
            k = r["call_id"]
            assert r["change"] == ("kept" if k not in told else "new" if k not in known else "unchanged" if known[k] == want[k] else "changed")
            assert r["updated_at"] == batch or r["change"] in ("kept", "unchanged")
        stored = spark.createDataFrame([tuple(r[c] for c in [*COLUMNS, "first_seen_at", "updated_at"]) for r in got], STORED)
    again = R.capture_recaps(stored, spark.createDataFrame([], COPIES), "arrival", F.lit(9).cast("long"))
    assert held(again.collect()) == want and {r["change"] for r in again.collect()} == {"kept"}


def test_copies_meet_before_they_are_sorted_in_as_many_tasks_as_their_number_asks_for(spark, monkeypatch):
    copies = spark.range(100).selectExpr("'a' AS account_id", "concat('c', id % 40) AS call_id", *(f"CAST({'id' if c == 'headline' else 'NULL'} AS {KINDS.get(c, 'string')}) AS {c}" for c in R.RECAP), "id AS arrival")
    run = lambda: R.capture_recaps(spark.createDataFrame([], STORED), copies, "arrival", F.lit(1).cast("long"))
    monkeypatch.setattr(R, "SMALL_TASK", 9, raising=False)
    plan = run()._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "Sort" not in plan[plan.rindex("Exchange hashpartitioning") :]  # rows are exchanged as they come, not sorted and folded first
    assert "struct<" not in plan[plan.rindex("Exchange hashpartitioning") :]
    assert run().rdd.getNumPartitions() == 12
    monkeypatch.setattr(R, "DIRECT", 4)
    assert run().rdd.getNumPartitions() == 4
    monkeypatch.setattr(R, "LARGE_TASK", 20)
    assert run().rdd.getNumPartitions() == 5
    assert {r["call_id"]: r["headline"] for r in run().collect()} == {f"c{i}": str(i + 80 if i < 20 else i + 40) for i in range(40)}


def test_nulls_of_a_stored_recap_are_no_change(spark):
    stored = spark.createDataFrame([("a", "c", *(None for _ in R.RECAP), 3, 4)], STORED)
    copy = spark.createDataFrame([("a", "c", *(EMPTY[c] for c in R.RECAP), 1)], COPIES)
    (got,) = R.capture_recaps(stored, copy, "arrival", F.lit(9).cast("long")).collect()
    assert {c: got[c] for c in R.RECAP} == EMPTY and (got["change"], got["first_seen_at"], got["updated_at"]) == ("unchanged", 3, 4)


ITEMS = "account_id string, call_id string, kind string, origin string, title string, text string, owner_name string, speaker_name string, at long, mentioned_by string, highlights string, ordinal int"


def item(call, title, owner="o", kind="action", text="t", ordinal=1):
    return ("a", call, kind, "recap", title, text, owner, None, None, None, None, ordinal)


def applied(spark, stored, rows, at):
    batch = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{ITEMS}, arrival long")
    out = R.apply_items(stored, batch, "arrival", F.lit(at).cast("long"))
    rows = out.collect()
    return spark.createDataFrame(rows, out.schema).drop("change"), sorted((r.call_id, r.title or "", r.owner_name, r.superseded_at, r.change) for r in rows)


def test_items_superseded_by_sets(spark):
    none = spark.createDataFrame([], f"account_id string, call_id string, kind string, origin string, item_key string, {ITEMS.split('origin string, ')[1]}, first_seen_at long, superseded_at long")
    first, got = applied(spark, none, [item("c", "One"), item("c", "Two"), item("c", "M", kind="mention"), item("d", "One"), item("c", " one ", owner="late")], 1)
    assert got == [("c", " one ", "late", None, "new"), ("c", "M", "o", None, "new"), ("c", "Two", "o", None, "new"), ("d", "One", "o", None, "new")]
    second, got = applied(spark, first, [item("c", "ONE", owner="late"), item("c", "Three", owner=None)], 2)
    assert got == [("c", "M", "o", None, "kept"), ("c", "ONE", "late", None, "changed"), ("c", "Three", None, None, "new"), ("c", "Two", "o", 2, "superseded"), ("d", "One", "o", None, "kept")]
    third, got = applied(spark, second, [item("c", "Two"), item("c", "ONE", owner="late")], 3)
    assert got == [("c", "M", "o", None, "kept"), ("c", "ONE", "late", None, "unchanged"), ("c", "Three", None, 3, "superseded"), ("c", "Two", "o", None, "changed"), ("d", "One", "o", None, "kept")]
    assert applied(spark, third, [], 4)[1] == [(*r[:4], "kept") for r in got]


def test_links_need_one_address_one_account(spark):
    looked = [("m1", "A@x"), ("m1", "b@x"), ("m2", "c@x"), ("m3", "c@x"), ("m4", "d@x"), ("m5", "e@x"), ("m6", "f@x"), ("m7", None), ("m8", "g@x"), ("m9", "h@x"), ("m10", "i@x"), ("m11", "no address"), (None, None)]
    profiles = [("p1", " a@X "), ("p1", "a@x"), ("p2", "c@x"), ("p4", "d@x"), ("p5", "d@x"), ("p6", "e@x"), ("p6", "f@x"), ("p8", "g@x"), ("p9", "h@x"), ("p10", "i@x"), ("p11", "no address"), ("p12", None)]
    links = [("m7", "p7", "address", True), ("m8", "p0", "address", True), ("m9", "p0", "config", False), ("m0", "p10", "address", True), ("m2", "p2", "address", False)]
    got = R.link_accounts(spark.createDataFrame(looked, "account_id string, address string"), spark.createDataFrame(profiles, "principal_id string, address string"), spark.createDataFrame(links, "account_id string, principal_id string, method string, active boolean"))
    rows = {r.account_id: (r.principal_id, r.method, r.active, r.change) for r in got.collect()}
    none = (None, None, False, "kept")
    assert rows == {
        "m1": ("p1", "address", True, "linked"), "m2": ("p2", "address", False, "kept"), "m3": none, "m4": none, "m5": none, "m6": none, "m7": ("p7", "address", False, "unlinked"), "m8": ("p8", "address", True, "relinked"),
        "m9": ("p0", "config", False, "kept"), "m10": (None, None, False, "refused"), "m11": none, "m0": ("p10", "address", True, "kept"), None: none,
    }


def test_purge_clears_once_and_merges_keys(spark):
    from loamline.functions.text import scrubbed
    from loamline.operators import purge

    shape = "source string, database string, store string, key string, value string, content_hash string, removed_at long, note string"
    rows = [
        ("s", "d", None, '{"token":"a"}', "v", "h", None, "n1"), ("s", "d", None, '{"token":"b"}', "v", "h", 3, "n2"), ("s", "d", "x", '{"token":"a"}', "v", "h", 4, "n3"), ("s", "d", "y", '{"token":"a"}', None, "", None, "n4"), ("s", "d", "y", '{"token":"[removed]"}', "w", "g", None, "n5"),
        ("s", "d", "y", None, "w", "g", None, "n6"), ("t", None, "auth", "k", "w", "g", 2, "n7"), ("t", None, "auth", "k2", None, None, None, "n8"),
    ]
    records = spark.createDataFrame(rows, shape)
    after, counts = purge.unscrubbed_keys(records, scrubbed, F.lit(9).cast("long"))
    got = {tuple(r) for r in after.select(*records.columns, "purged").collect()}
    token = '{"token":"[removed]"}'
    assert got == {(*r, False) for r in rows[4:]} | {("s", "d", None, token, None, "", 3, None, True), ("s", "d", "x", token, None, "", 4, "n3", True)} and after.count() == 6
    assert [tuple(r) for r in counts.collect()] == [("s", 4)]
    assert purge.unscrubbed_keys(after.drop("purged"), scrubbed, F.lit(9).cast("long"))[1].count() == 0
    first = purge.denied(records, F.col("store") == "auth", F.lit(9).cast("long"))
    assert {(r.note, r.value, r.content_hash, r.removed_at) for r in first.where("purged").collect()} == {("n7", None, "", 2)}
    assert purge.denied(first.drop("purged"), F.col("store") == "auth", F.lit(9).cast("long")).where("purged").count() == 0
    assert purge.denied(records.limit(0), F.col("store") == "auth", F.lit(9).cast("long")).count() == 0
