"""The watch loop over a landing folder."""

import pytest
from pyspark.sql import functions as F

from loamline.operators.index import SearchIndex
from loamline.sources import archive
from loamline.streaming.watch import changed_sources, counted, each_source, joined_back, json_lines, landing, newest_versions, since, wait_since, watch

SCHEMA = "k long, version long, deleted_at long, body string, arrival long"


def test_watch_emits_changes_once(spark, tmp_path):
    land, root, seen = str(tmp_path / "land"), str(tmp_path / "root"), []

    def put(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(land)

    def emit(changes, number):
        seen.extend(sorted((r["k"], r["change"]) for r in changes.collect()))

    def go():
        watch(landing(spark, land, SCHEMA), root, "messages", ["k"], "version", "deleted_at", ["body"], emit, str(tmp_path / "ck"), "arrival").awaitTermination()

    put((1, 1, None, "a", 1), (2, 5, None, "b", 2))
    go()
    assert seen == []  # the first batch is the baseline
    put((1, 2, None, "a2", 3), (2, 4, None, "late", 4), (3, 1, None, "new", 5))
    go()
    assert seen == [(1, "edited"), (3, "new")]
    go()
    assert len(seen) == 2
    put((2, 5, 77, "b", 6))
    go()
    assert seen[-1] == (2, "deleted") and archive.current(spark, root, "messages").where("k = 2").first()["deleted_at"] == 77


def test_a_failed_sink_loses_no_change(spark, tmp_path):
    land, root, seen = str(tmp_path / "land"), str(tmp_path / "root"), []
    fail = [False]

    def put(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(land)

    def emit(changes, number):
        if fail[0]:
            fail[0] = False
            raise RuntimeError("the sink is down")
        seen.extend(sorted((number, r["k"], r["change"]) for r in changes.collect()))

    def go():
        watch(landing(spark, land, SCHEMA), root, "messages", ["k"], "version", "deleted_at", ["body"], emit, str(tmp_path / "ck"), "arrival").awaitTermination()

    put(*((k, 1, None, "a", k) for k in range(100)))
    go()
    put((1, 2, None, "b", 101), (500, 1, None, "new", 102))
    fail[0] = True
    with pytest.raises(Exception, match="sink is down"):
        go()
    assert seen == []
    go()
    assert seen == [(1, 1, "edited"), (1, 500, "new")]
    go()
    assert len(seen) == 2
    found = {r["k"]: r["body"] for r in archive.current(spark, root, "messages").collect()}
    assert len(found) == 101 and found[1] == "b" and found[500] == "new" and found[7] == "a"
    newest = archive.versions(spark, root, "messages")[-1]
    assert len(list((tmp_path / "root" / "messages" / f"v={newest}").glob("_part=*"))) <= 2  # only the parts that changed are written again
    old = archive.current(spark, root, "messages", version=archive.versions(spark, root, "messages")[0])
    assert old.count() == 100 and old.where("k = 1").first()["body"] == "a"


def test_two_writers_take_different_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path)
    archive.check_version(spark, root)
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda k: archive.publish(spark.range(k), root, "t"), range(4)))
    assert len(set(numbers)) == 4 and archive.versions(spark, root, "t") == sorted(numbers)


ROWS = "k long, who string"


def _table(spark, root):
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit("start").alias("who"))
    archive.publish_parts(rows, root, "t", ["k"], list(range(archive.PARTS)), 0)
    return {r["k"]: r["p"] for r in rows.select("k", archive.part_of(["k"]).alias("p")).collect()}


def _set(who, k):
    return lambda stored: stored.select("k", F.when(F.col("k") == k, F.lit(who)).otherwise(F.col("who")).alias("who"))


def _held(spark, root):
    return {r["k"]: r["who"] for r in archive.current(spark, root, "t").collect()}


def test_interleaved_writers_keep_both_changes(spark, tmp_path):
    root = str(tmp_path)
    parts = _table(spark, root)
    other = next(k for k in parts if parts[k] != parts[1])
    base = archive.versions(spark, root, "t")[-1]
    mine = archive.current(spark, root, "t", base, [parts[1]])  # read before the other writer commits
    archive.update(spark, root, "t", ["k"], [parts[other]], _set("other", other))
    archive.publish_parts(_set("mine", 1)(mine), root, "t", ["k"], [parts[1]], base)  # other parts: rebased
    held = _held(spark, root)
    assert held[1] == "mine" and held[other] == "other" and len(held) == 200


def test_writers_of_one_part_merge_again(spark, tmp_path):
    root = str(tmp_path)
    parts = _table(spark, root)
    twin = next(k for k in parts if parts[k] == parts[1] and k != 1)
    base = archive.versions(spark, root, "t")[-1]
    mine = archive.current(spark, root, "t", base, [parts[1]])
    archive.update(spark, root, "t", ["k"], [parts[1]], _set("other", twin))
    with pytest.raises(archive.Conflict):
        archive.publish_parts(_set("mine", 1)(mine), root, "t", ["k"], [parts[1]], base)
    assert _held(spark, root)[1] == "start" and not list((tmp_path / "t").glob("_staged*"))
    tries = []

    def merge(stored):
        tries.append(1)
        if len(tries) == 1:  # another writer commits between the read and the commit
            archive.update(spark, root, "t", ["k"], [parts[1]], _set("third", twin))
        return _set("mine", 1)(stored)

    archive.update(spark, root, "t", ["k"], [parts[1]], merge)
    held = _held(spark, root)
    assert len(tries) == 2 and held[1] == "mine" and held[twin] == "third" and len(held) == 200


def test_many_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path)
    parts = _table(spark, root)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: archive.update(spark, root, "t", ["k"], [parts[k]], _set(f"w{k}", k)), range(8)))
    held = _held(spark, root)
    assert [held[k] for k in range(8)] == [f"w{k}" for k in range(8)] and len(held) == 200
    known = archive.versions(spark, root, "t")
    assert known == list(range(1, 10))  # a chain without gaps
    archive.prune(spark, root, "t", keep=1)
    assert _held(spark, root) == held and archive.versions(spark, root, "t")[-1] == 9


def test_a_claim_left_behind_is_taken_over(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    parts = _table(spark, root)
    assert archive._claim(spark, root, "t", 1)  # a writer that died before its commit
    monkeypatch.setattr(archive, "LEASE", -1.0)
    archive.update(spark, root, "t", ["k"], [parts[1]], _set("mine", 1))
    assert _held(spark, root)[1] == "mine"


def test_parts_of_a_whole_version_are_refused(spark, tmp_path):
    archive.publish(spark.createDataFrame([(1, "a")], ROWS), str(tmp_path), "t")
    with pytest.raises(ValueError, match="whole"):
        archive.publish_parts(spark.createDataFrame([(1, "b")], ROWS), str(tmp_path), "t", ["k"], [3])


def test_the_index_follows_the_watch(spark, tmp_path):
    land, root = str(tmp_path / "land"), str(tmp_path / "root")
    index = SearchIndex(spark, str(tmp_path / "index"))

    def put(*rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(land)
        watch(landing(spark, land, SCHEMA), root, "messages", ["k"], "version", "deleted_at", ["body"], lambda *_: None, str(tmp_path / "ck"), "arrival", index=index, index_columns=("body",)).awaitTermination()

    found = lambda q: sorted(r["id"] for r in index.search(q).collect())
    put((1, 1, None, "red fox", 1), (2, 1, None, "red dog", 2))
    assert found("red") == ["1", "2"] and found('"red fox"') == ["1"]
    put((1, 2, None, "blue fox", 3), (2, 1, 5, "red dog", 4), (3, 1, None, "redder", 5))
    assert found("red") == [] and found("red*") == ["3"] and found("fox blue") == ["1"]


def test_cursor(spark):
    df = spark.range(5)
    new, cursor = since(df, 2, "id")
    assert new.count() == 2 and cursor == 4 and since(df, 9, "id")[1] == 9


def test_cursor_wait(spark):
    reads = []

    def read():
        reads.append(1)
        return spark.range(3 if len(reads) < 3 else 5)

    new, cursor, late = wait_since(read, 2, "id", 30, 0.01)
    assert (new.count(), cursor, late, len(reads)) == (2, 4, False, 3)
    assert wait_since(lambda: spark.range(3), 9, "id", 0.05)[1:] == (9, True)


def test_json_lines_feed_is_idempotent(spark, tmp_path):
    emit = json_lines(str(tmp_path / "feed"))
    changes = spark.createDataFrame([(1, "new"), (2, "edited")], "k long, change string")
    for _ in range(2):
        emit(changes, 4)
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "feed" / "batch=4")).collect()) == ['{"k":1,"change":"new"}', '{"k":2,"change":"edited"}']
    full = joined_back(changes, spark.createDataFrame([(1, "a"), (3, "c")], "k long, body string"), ["k"])
    assert sorted((r["k"], r["change"], r["body"]) for r in full.collect()) == [(1, "new", "a"), (2, "edited", None)]


def test_unchanged_and_failed_sources(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "source string, fingerprint string")
    seen = spark.createDataFrame([("a", "1"), ("b", "old")], "source string, fingerprint string")
    assert sorted(r["source"] for r in changed_sources(now, seen, "source", "fingerprint").collect()) == ["b", "c"]
    done = []

    def broken():
        raise ValueError("locked\nby another")

    assert each_source({"x": lambda: done.append("x"), "y": broken, "z": lambda: done.append("z")}) == {"y": "locked"} and done == ["x", "z"]


def test_results_are_files_not_driver_rows(spark, small):
    for out in (newest_versions(spark, f"{small}/events.parquet"), counted(spark, f"{small}/events.parquet")):
        assert out.inputFiles() and out.count() > 0
