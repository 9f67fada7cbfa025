"""The kept search index and event merges by hand."""

import random

import pytest
from pyspark.sql import functions as F

from loamline.functions import text as T
from loamline.operators import calendar, mail, merge, search
from loamline.operators import index as index_module
from loamline.operators.index import SearchIndex


def test_index_follows_upserts(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "k long, body string")
    index = SearchIndex(spark, str(tmp_path / "index"))
    index.add(rows((1, "Red fox"), (2, "red Dog, red"), (3, None)), "k", "body", 1)
    found = lambda text: sorted((r["id"], r["hits"]) for r in index.search(text).collect())
    assert found("RED") == [("1", 1), ("2", 2)] and found("red fox") == [("1", 2)]
    index.add(rows((1, "blue fox"), (2, None), (4, "red")), "k", "body", 2)
    assert found("red") == [("4", 1)] and found("fox") == [("1", 1)] and found("dog") == []
    index.add(rows((1, "blue fox"), (2, None), (4, "red")), "k", "body", 2)  # the same batch again
    assert found("blue") == [("1", 1)]
    index.compact(3)
    assert found("red") == [("4", 1)] and found("blue") == [("1", 1)] and index.postings().count() == 3 and index._generations() == [3]
    index.add(rows((4, "green")), "k", "body", 4)
    assert found("red") == [] and found("gre*") == [("4", 1)]
    with pytest.raises(ValueError, match="word"):
        index.search(" - ")
    scan = index.search("gre*")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,gre)" in scan and "positions" not in scan.split("ReadSchema")[1].split("\n")[0]


def test_no_index_yet(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "none"))
    assert index.search("word").count() == 0
    index.add(spark.createDataFrame([], "k long, body string"), "k", "body", 1)
    assert index.search("word").count() == 0


WORDS = ["alpha", "beta", "alphabet", "Beta", "beta-alpha", "x", "é", "ÉTÉ", "日本", "a1", "_", "..."]


def test_search_equals_the_scan(spark, tmp_path):
    rng = random.Random(4)
    text = lambda: rng.choice([None, "", " ".join(rng.choices(WORDS, k=rng.randint(1, 12)))])
    rows = {k: (k, text(), text()) for k in range(120)}
    index = SearchIndex(spark, str(tmp_path / "index"))
    schema = "k long, body string, title string"
    index.add(spark.createDataFrame(list(rows.values()), schema), "k", ["body", "title"], 1)
    for generation in (2, 3):
        changed = [(k, text(), text()) for k in rng.sample(range(150), 30)]
        rows |= {r[0]: r for r in changed}
        index.add(spark.createDataFrame(changed, schema), "k", ["body", "title"], generation)
    now = spark.createDataFrame(list(rows.values()), schema)
    for q in ("alpha", '"alpha beta"', "alph*", '"beta alpha" x', "beta-alph*", "alpha alpha", "é*", "日*", '"x x"', "a1 alph* x", '"beta alpha beta"'):
        want = sorted(str(r["k"]) for r in search.search(now, q, ["body", "title"]).collect())
        assert sorted(r["id"] for r in index.search(q).collect()) == want, q
        by_tokens = now.where(T.matches(T.tokens("body"), T.parse_query(q)) | T.matches(T.tokens("title"), T.parse_query(q)))
        assert sorted(str(r["k"]) for r in by_tokens.collect()) == want, q


def test_rarest_word_goes_first(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_module, "BROADCAST_ROWS", 3)
    index = SearchIndex(spark, str(tmp_path / "index"))
    index.add(spark.range(50).select(F.col("id").alias("k"), F.when(F.col("id") % 25 == 0, "the rare word").otherwise("the word").alias("body")), "k", "body", 1)
    found = index.search('rare "the rare"')
    assert "LeftSemi" in found._jdf.queryExecution().executedPlan().toString() and sorted(r["id"] for r in found.collect()) == ["0", "25"]


def event(spark, **values):
    fields = {"key": 1, "last_modified": None, "fresh_at": None, "removed_at": None, "start": 0, "end": 3_600_000_000, "all_day": None, "start_date": 0, "end_date": 1, "cancelled": None, "detail_as_of": None, "subject": "", "online": None, "body": ""}
    kinds = "key long, last_modified long, fresh_at long, removed_at long, start long, end long, all_day boolean, start_date long, end_date long, cancelled boolean, detail_as_of long, subject string, online boolean, body string"
    return spark.createDataFrame([tuple((fields | values).values())], kinds)


def test_event_merge_rules(spark):
    merge = lambda a, b: calendar.merge_events(event(spark, **a), event(spark, **b), ["key"], ["subject"], ["online"], ["body"]).first()
    second = 1_000_000
    assert merge({"last_modified": 10 * second, "subject": "a"}, {"last_modified": 20 * second, "subject": "b"})["subject"] == "b"  # later by more than the skew
    assert merge({"last_modified": 22 * second, "subject": "a", "fresh_at": 5}, {"last_modified": 20 * second, "subject": "b", "fresh_at": 4})["base"] == "a"  # within the skew: the fresher cache
    assert merge({"subject": "a"}, {"subject": "b"})["base"] == "b"
    got = merge({"subject": "a", "cancelled": False, "online": True}, {"subject": ""})
    assert (got["subject"], got["cancelled"], got["online"], got["filled"]) == ("a", None, True, "subject,online")  # an old false says nothing about now
    assert merge({"cancelled": True}, {})["cancelled"] is True
    whole = {"end": 86_400_000_000}
    assert merge({"all_day": True, "start": 5, "end": 86_400_000_005, "start_date": 7}, whole)["start_date"] == 7
    assert merge({"all_day": True, "start": 5, "start_date": 7}, {})["all_day"] is None  # the base doesn't look all-day
    gone = merge({"removed_at": 50 * second, "subject": "a"}, {"last_modified": 54 * second, "subject": ""})
    assert gone["removed"] and gone["subject"] == "a"
    back = merge({"removed_at": 50 * second, "subject": "a"}, {"last_modified": 56 * second, "subject": ""})
    assert not back["removed"] and back["subject"] is None  # a live event drops its removed rows
    assert merge({"detail_as_of": 2, "body": "new"}, {"detail_as_of": 1, "body": "old"})["body"] == "new"


def test_thread_falls_back(spark):
    rows = [
        (1, "a", "m1", "", "", "s", "x@1", 1), (2, "a", "m2", "m1", "", "t", "y@1", 2), (3, "a", "m3", "", "c", "u", "z@1", 3), (4, "a", "m4", "", "c", "v", "w@1", 4),
        (5, "a", "m5", "", "", "same", "P@1", 5), (6, "a", "m6", "", "", "same", "p@1", 6), (7, "a", "m7", "", "", "same", "q@1", 7), (8, "b", "m2", "m1", "", "t", "y@1", 8), (9, "a", "m9", "", "alone", "", "r@1", 9),
    ]
    m = spark.createDataFrame(rows, "id long, account string, message_id string, in_reply_to string, conversation_id string, subject_norm string, sender_address string, received_at long")
    none = spark.createDataFrame([], "id long, address string")
    got = {}
    for r in mail.threads(m, none, m.select("id")).collect():
        got.setdefault((r["seed"], r["grouping"]), []).append((r["position"], r["id"]))
    ids = {k: [i for _, i in sorted(v)] for k, v in got.items()}
    assert ids == {
        (1, "reply_chain"): [1, 2], (2, "reply_chain"): [1, 2], (3, "conversation"): [3, 4], (4, "conversation"): [3, 4], (5, "subject"): [5, 6], (6, "subject"): [5, 6], (7, "subject"): [7], (8, "subject"): [8], (9, "subject"): [9],
    }
    assert {r["truncated"] for r in mail.threads(m, none, m.where("id = 3").select("id"), cap=1).collect()} == {True}


def test_folder_names_come_before_kinds(spark):
    folders = spark.createDataFrame([("a", 1, "Inbox", "inbox"), ("a", 2, "archive", "other"), ("a", 3, "Old", "archive")], "account string, folder_key int, name string, kind string")
    keys = lambda wanted: sorted(r["folder_key"] for r in mail.resolve_folders(folders, wanted).collect())
    assert keys("ARCHIVE") == [2] and keys("inbox") == [1] and keys("other") == [2] and keys("none") == []
    order = [r["kind"] for r in folders.select("kind", mail.kind_rank(F.col("kind")).alias("r")).orderBy("r").collect()]
    assert order == ["inbox", "archive", "other"]


def test_mail_commit_matches_keys_then_message_ids(spark):
    schema = "account string, detail_key long, message_id string, state_seen_at long, body string, is_read boolean"
    go = lambda stored, batch: {(r["detail_key"], r["was"]): (r["message_id"], r["body"], r["is_read"], r["change"]) for r in mail.commit(spark.createDataFrame(stored, schema), spark.createDataFrame(batch, schema), ["body"], ["is_read"]).collect()}
    assert go([("a", 1, "x", 1, "old", False)], [("a", 1, "", 2, "new", True)]) == {(1, 1): ("x", "old", True, "updated")}  # one key, no Message-ID: the same message
    assert go([("a", 1, "x", 5, "old", False)], [("a", 1, "y", 2, "new", True)]) == {(1, 1): ("y", "new", True, "replaced")}  # the key was given to another message
    assert go([("a", 1, "x", 1, "", False)], [("a", 9, "x", 1, "new", True)]) == {(9, 1): ("x", "new", False, "updated")}  # the same message under another key
    assert go([("b", 1, "x", 1, "", False)], [("a", 9, "x", 1, "new", True)]) == {(1, 1): ("x", "", False, None), (9, None): ("x", "new", True, "new")}
    twice = go([("a", 1, "x", 1, "one", False), ("a", 2, "x", 1, "two", False)], [("a", 9, "x", 1, "new", True)])
    assert twice == {(1, 1): ("x", "one", False, None), (2, 2): ("x", "two", False, None), (9, None): ("x", "new", True, "new")}  # not unique: apart
    taken = go([("a", 1, "x", 1, "one", False)], [("a", 1, "x", 1, "new", False), ("a", 9, "x", 1, "copy", True)])
    assert taken == {(1, 1): ("x", "one", False, "unchanged"), (9, None): ("x", "copy", True, "new")}  # the stored one is in the batch itself
    assert go([], []) == {}


def test_window_items_stay_apart_where_fields_are_not_unique(spark):
    stored = spark.createDataFrame([(1, "g1", "a", 5), (2, None, "a", 6), (3, None, "b", 7), (4, None, "b", 7), (5, None, "c", 8), (6, None, "d", None)], "id long, graph string, sender string, at long")
    window = spark.createDataFrame([("g1", "zz", 1), ("g2", "a", 6), ("g3", "b", 7), ("g4", "c", 8), ("g5", "c", 8), ("g6", "d", None), ("g7", "a", 5)], "item string, sender string, at long")
    got = {r["item"]: (r["id"], r["state"]) for r in merge.admit_window(stored, window, "id", "item", "graph", [["sender", "at"]]).collect()}
    assert got == {"g1": (1, "in_place"), "g2": (2, "matched"), "g3": (None, "deferred"), "g4": (None, "deferred"), "g5": (None, "deferred"), "g6": (None, "new"), "g7": (None, "new")}
    settled = merge.admit_window(stored.withColumn("n", F.when(F.col("id") == 5, 1)), window.withColumn("n", F.when(F.col("item") == "g4", 1)), "id", "item", "graph", [["sender", "at"], ["sender", "at", "n"]])
    assert {r["item"]: (r["id"], r["state"]) for r in settled.collect()}["g4"] == (5, "matched")


def test_chosen_times_equal_sorting_everything(spark):
    m = spark.range(300).select("id", (F.col("id") * 7 % 101).alias("received_at"))
    chosen = m.where("id % 10 = 0").select("id", (F.col("received_at") + 50 - F.col("id") % 7).alias("chosen_at"))
    every = m.join(chosen, "id", "left").withColumn("at", F.coalesce("chosen_at", "received_at"))
    for since, until, limit in ((None, None, 20), (30, 90, 1000), (90, None, 5)):
        want = sorted(((r["at"], r["id"]) for r in every.collect() if (since is None or r["at"] >= since) and (until is None or r["at"] < until)), reverse=True)
        got = mail.newest_chosen(m, chosen, limit, since, until)
        rows = [(r["at"], r["id"]) for r in got.collect()]
        assert sorted(rows, reverse=True) == want[:limit] and {r["truncated"] for r in got.collect()} == {len(want) > limit}
    plan = mail.newest_chosen(m, chosen, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") >= 3 and "Sort [at" not in plan.split("TakeOrderedAndProject", 2)[2]
