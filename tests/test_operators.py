"""Edge cases of operators and functions."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from loamline.functions import predicates as P
from loamline.functions import text as T
from loamline.functions import times
from loamline.operators import calendar, chat, federation, graph, intervals, joins, merge, ranking, search
from loamline.plans import sqlgate
from loamline.plans.sqlgate import ReadOnlyError, guarded
from loamline.sources import archive, mappers


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect() if cols else df.collect()), key=repr)


def test_query_language():
    assert T.parse_query('a "B c" d* "') == [T.Term("word", ("a",)), T.Term("phrase", ("b", "c")), T.Term("prefix", ("d",))]
    assert T.parse_query("* - '") == []
    assert T.parse_query('x "open end') == [T.Term("word", ("x",)), T.Term("phrase", ("open", "end"))]
    assert T.parse_query("it's") == [T.Term("phrase", ("it", "s"))]


def test_search_matches(spark):
    df = spark.createDataFrame([(1, "Budget review, Q3"), (2, "review of the budget"), (3, None), (4, "")], "id int, t string")
    find = lambda q: [r[0] for r in search.search(df, q, ["t"]).orderBy("id").collect()]
    assert find("budget review") == [1, 2] and find('"budget review"') == [1] and find("bud*") == [1, 2] and find("q") == []
    with pytest.raises(ValueError, match="word or a filter"):
        search.search(df, " ", ["t"])


def test_times():
    now = datetime(2024, 3, 30, 12, tzinfo=UTC)
    assert times.parse_when("90m", now) == datetime(2024, 3, 30, 10, 30, tzinfo=UTC)
    assert times.parse_when("2024-03-31", now, "Europe/Berlin") == datetime(2024, 3, 30, 23, tzinfo=UTC)
    a, b = times.parse_range("tomorrow", now, "Europe/Berlin")
    assert (b - a).total_seconds() == 23 * 3600
    with pytest.raises(ValueError):
        times.parse_duration("5 minutes")


def test_spans(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 7, 7), ("a", 8, 9), ("b", 0, 100), ("b", 5, 6)], "k string, start long, end long")
    assert rows(intervals.merge_spans(df, ["k"]), "k", "start", "end") == [("a", 1, 5), ("a", 8, 9), ("b", 0, 100)]
    ranges = spark.createDataFrame([("a", 0, 10), ("b", 20, 30), ("c", 0, 1)], "k string, low long, high long")
    assert rows(intervals.holes(df, ["k"], ranges), "k", "start_hole", "end_hole") == [("a", 0, 1), ("a", 5, 8), ("a", 9, 10), ("c", 0, 1)]
    assert rows(intervals.settle(df, ["k"], ranges), "k", "state") == [("a", "partial"), ("b", "covered"), ("c", "not_covered")]
    gaps = spark.createDataFrame([("a", 1), ("a", 2), ("a", 5), ("a", 0), ("a", None), ("a", 5)], "k string, n long")
    assert rows(intervals.sequence_gaps(gaps, ["k"], "n"), "missing", "numbers") == [(2, 3)]


def test_band_join_equals_theta_join(spark):
    left = spark.range(300).select((F.col("id") % 7).alias("k"), F.col("id").alias("l"), (F.hash("id") % 1000).cast("long").alias("a"))
    right = spark.range(300).select((F.col("id") % 7).alias("k"), F.col("id").alias("r"), (F.hash("id", F.lit(1)) % 1000).cast("long").alias("b"))
    theta = left.join(right, "k").where((F.col("b") >= F.col("a") - 30) & (F.col("b") <= F.col("a") + 5)).select("l", "r")
    assert rows(joins.band_join(left, right, ["k"], "a", "b", 30, 5), "l", "r") == rows(theta)


def test_children_and_flags(spark):
    p = spark.createDataFrame([(1,), (2,)], "id int")
    c = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "id int, ord int, v string")
    out = dict(joins.with_children(p, c, "id", "ord", ["v"], "kids").select("id", F.col("kids.v")).collect())
    assert out == {1: ["a", "b"], 2: []}
    assert rows(joins.with_exists(p, c, "id", "has")) == [(1, True), (2, False)]


def test_upsert_rules(spark):
    schema = "k int, version long, deleted_at long, body string"
    old = spark.createDataFrame([(1, 2, None, "x"), (2, 2, 9, "x"), (3, 2, 9, "x"), (4, 2, None, "x"), (5, 1, None, "x")], schema)
    new = spark.createDataFrame([(1, 1, None, "y"), (2, 2, None, "x"), (3, 3, None, "x"), (4, 2, 7, "x"), (6, 1, None, "n")], schema)
    out = {r["k"]: (r["change"], r["version"], r["deleted_at"], r["body"]) for r in merge.upsert(old, new, ["k"], "version", "deleted_at", ["body"]).collect()}
    assert out == {
        1: ("unchanged", 2, None, "x"), 2: ("unchanged", 2, 9, "x"), 3: ("edited", 3, None, "x"),
        4: ("deleted", 2, 7, "x"), 5: ("kept", 1, None, "x"), 6: ("new", 1, None, "n"),
    }


def test_fold_equals_one_by_one(spark):
    import random

    rng = random.Random(5)
    said = [(rng.randrange(6), i, rng.randrange(4), rng.choice([None, None, i]), f"b{rng.randrange(3)}") for i in range(200)]
    state: dict[int, tuple] = {}
    for k, _, version, dead, body in said:
        if k in state:
            v, d, _b = state[k]
            if version < v:
                continue
            dead = d if d is not None and dead is None and version <= v else dead
        state[k] = (version, dead, body)
    df = spark.createDataFrame(said, "k int, arrival long, version long, deleted_at long, body string")
    out = {r["k"]: (r["version"], r["deleted_at"], r["body"]) for r in merge.fold_statements(df, ["k"], "version", "arrival", "deleted_at", ["body"]).collect()}
    assert out == state


def test_capture_is_order_free(spark):
    said = [("k", 1, "ab", None), ("k", 2, "c", "old"), ("k", 2, "dd", None), ("k", None, "zzz", "never")]
    units = {"subject": F.length("subject"), "note": F.length("note")}
    a, b = (merge.capture(spark.createDataFrame(x, "k string, clock long, subject string, note string"), ["k"], "clock", units).collect() for x in (said, said[::-1]))
    assert a == b and (a[0]["subject"], a[0]["note"], a[0]["note_clock"]) == ("dd", "old", 2)


def test_absence_withholds_mass_loss(spark):
    live = spark.createDataFrame([(i, 100) for i in range(100)], "k int, received long")
    misses = spark.createDataFrame([(i, 1) for i in range(100)], "k int, missed_at long")
    verdicts = lambda n: {r[0]: r[1] for r in merge.absence(live, live.where(f"k >= {n}"), misses, "k", 2, "received", 50).groupBy("verdict").count().collect()}
    assert verdicts(10) == {"gone": 10, "seen": 90} and verdicts(30) == {"withheld": 30, "seen": 70}


def test_graphs(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(12)] + [(50, 99)], "id long, parent long")
    assert {r["id"]: (r["root"], r["depth"]) for r in graph.roots(nodes, "id", "parent").collect()} == {i: (0, i) for i in range(12)} | {50: (50, 0)}
    edges = spark.createDataFrame([(i + 1, i) for i in range(9)] + [(20, 21), (5, 5)], "a long, b long")
    assert dict(graph.components(edges, "a", "b").collect()) == dict.fromkeys(range(10), 0) | {20: 20, 21: 20}


def test_ranking(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "id long, g long")
    out = ranking.top(df, 4, F.desc("id")).collect()
    assert [r["id"] for r in out] == [9, 8, 7, 6] and all(r["truncated"] for r in out)
    assert not any(r["truncated"] for r in ranking.top(df, 10, F.desc("id")).collect())
    assert rows(ranking.newest_per(df, ["g"], F.desc("id")), "id") == [(7,), (8,), (9,)]


def test_predicates(spark):
    df = spark.createDataFrame([(1, None, False, "50%_a"), (5, 3, None, "50xya"), (2, 3, False, None)], "at int, horizon int, own boolean, t string")
    assert [r["at"] for r in df.where(P.unread(F.col("at"), F.col("horizon"), F.col("own"))).collect()] == [5]
    assert [r["at"] for r in df.where(P.contains(F.col("t"), "%_A")).collect()] == [1]
    assert df.where(P.every()).count() == 3


def test_text_forms(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.normal_subject(F.lit(" RE: Fwd : aw:Hello"))) == "Hello"
    assert one(T.normal_message_id(F.lit(" <A@b> "))) == "a@b"
    assert one(T.bounded(F.lit("äöüß"), 3)) == "äö…"
    assert one(T.composed_name(F.lit("T"), F.lit(""))) == "T" and one(T.composed_name(F.lit("T"), F.lit("C"))) == "T › C"
    assert one(T.content_hash(F.lit(None), F.lit("a"))) != one(T.content_hash(F.lit(""), F.lit("a")))
    assert one(T.scrubbed(F.lit("x Bearer abc.def token=secret1 &sig=zz"))) == "x Bearer [removed] token=[removed] &sig=[removed]"
    assert one(T.member_list_name(F.array(F.lit("a"), F.lit(None), F.lit("b")), F.lit(5))) == "a, b +3"
    assert one(T.markup_text(F.lit("<p>a&amp;lt;b</p><script>x</script>c"))) == "a&lt;b c"


def test_sql_gate(spark, small):
    assert guarded(spark, small, "SELECT 1 AS one FROM region;", ["region"], 2).count() == 2
    for bad in ("DROP TABLE region", "WITH a AS (SELECT 1) INSERT INTO region SELECT * FROM a", "-- x\nCREATE TABLE t AS SELECT 1", "SELECT 1; SELECT 2", "SELECT reflect('java.lang.System', 'getenv', 'PATH')", "SELECT java_method('java.lang.System', 'nanoTime')",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/part.parquet`", "SELECT * FROM part", "SELECT (SELECT count(*) FROM part) AS n FROM region", "SELECT * FROM region WHERE EXISTS (SELECT 1 FROM csv.`/etc/passwd`)", "WITH a AS (SELECT * FROM part) SELECT * FROM a",
        "SELECT input_file_name() FROM region", "SELECT * FROM read_files('/etc')", "SET spark.sql.shuffle.partitions=1", "CACHE TABLE region", "SELECT transform(named_struct('a', reflect('java.lang.System', 'gc')).a) FROM region"):
        with pytest.raises(ReadOnlyError):
            guarded(spark, small, bad, ["region"])


def test_sql_gate_lets_reading_pass(spark, small):
    texts = (
        "WITH r AS (SELECT * FROM region) SELECT r_name, row_number() OVER (ORDER BY r_name) AS n FROM r WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT n_name, CASE WHEN n_nationkey > 3 THEN 1 ELSE 2 END FROM nation",
        "SELECT upper(trim(n_name)) AS a, count(DISTINCT n_regionkey) FILTER (WHERE n_nationkey > 1) AS c FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1 HAVING count(*) > 0 ORDER BY 1 LIMIT 3",
        "SELECT r_name, (SELECT max(n_name) FROM nation WHERE n_regionkey = r_regionkey) AS last FROM region", "SELECT get_json_object('{}', '$.a') AS a, date_trunc('day', current_timestamp()) AS d",
        "SELECT e FROM region LATERAL VIEW explode(sequence(1, 3)) t AS e", "EXPLAIN SELECT * FROM region",
    )
    for text in texts:
        assert guarded(spark, small, text, ["region", "nation"]).count() > 0
    assert guarded(spark, small, "SELECT a.n_name FROM nation a CROSS JOIN nation b", ["nation"], 7).count() == 7
    assert [t.name for t in spark.catalog.listTables() if t.name in ("region", "nation")] == []


def test_publish(spark, tmp_path):
    root = str(tmp_path)
    assert archive.current(spark, root, "people").count() == 0
    assert archive.publish(spark.range(3), root, "people") == 1 and archive.publish(spark.range(5), root, "people") == 2
    assert archive.current(spark, root, "people").count() == 5 and archive.current(spark, root, "people", 1).count() == 3
    (tmp_path / "people" / "v=3").mkdir()  # a version whose writing didn't end is not seen
    assert archive.current(spark, root, "people").count() == 5
    spark.createDataFrame([(99,)], "version int").write.mode("overwrite").json(f"{root}/_schema")
    with pytest.raises(ValueError, match="schema version 99"):
        archive.publish(spark.range(1), root, "people")


def test_optional_columns(spark):
    df = archive.with_optional(spark.range(1), {"id": F.lit(9), "title": F.lit("none")})
    assert df.first().asDict() == {"id": 0, "title": "none"}


def test_sql_page_says_that_there_is_more(spark, small):
    rows, more = sqlgate.page(spark, small, "SELECT n_nationkey FROM nation ORDER BY n_nationkey", ["nation"], 3)
    assert [r[0] for r in rows.collect()] == [0, 1, 2] and more
    rows, more = sqlgate.page(spark, small, "SELECT n_nationkey FROM nation", ["nation"], 25)
    assert rows.count() == 25 and not more and sqlgate.guarded(spark, small, "SELECT * FROM orders", ["orders"]).count() == 1500
    pivot = "SELECT * FROM (SELECT n_regionkey, n_nationkey FROM nation) PIVOT (count(n_nationkey) FOR n_regionkey IN (0, 1))"
    assert tuple(sqlgate.guarded(spark, small, pivot, ["nation"]).first()) == (5, 5)


def test_an_account_has_one_principal(spark):
    links = spark.createDataFrame([("a", "p2", None), ("a", "p1", None), ("b", "p9", 1)], "account_id string, principal_id string, unlinked_at int")
    rows = calendar.with_principal(spark.createDataFrame([("a",), ("b",)], "account_id string"), links)
    assert sorted((r["account_id"], r["principal"]) for r in rows.collect()) == [("a", "p1"), ("b", "b")]


def test_filters_choose_the_sources():
    everything = tuple(federation.USABLE)
    assert federation.plan_search(()).sources == everything and federation.plan_search((), "loop").sources == ("loop",)
    dated = federation.plan_search({"since", "until"})
    assert set(everything) - set(dated.sources) == {"loop"} and dated.notes() == ["loop cannot be filtered by since, until and was not searched"]
    assert federation.plan_search({"folder"}).sources == ("mail",) and federation.plan_search({"team", "since"}).sources == ("chats",)
    assert federation.plan_search({"from"}).sources == ("chats", "mail", "transcripts") and federation.plan_search({"chat_account"}).sources == ("chats", "transcripts")
    for filters, source in (({"folder", "team"}, "all"), ({"since"}, "loop"), ({"team"}, "mail"), ({"mail_account"}, "chats"), ({"colour"}, "all"), ((), "fax")):
        with pytest.raises(federation.SourceConflict) as e:
            federation.plan_search(filters, source)
        assert e.value.code == "filter_source_conflict"


def test_sources_left_out_are_never_read(spark):
    part = lambda n: spark.range(n).select("id", F.col("id").alias("at"), F.lit("t").alias("title"))
    hits, counts = federation.search_sources(federation.plan_search({"folder"}), {"mail": part(30)}, 5, 10)
    assert [r["id"] for r in hits.orderBy(F.desc("at")).collect()] == ["29", "28", "27", "26", "25"]
    assert tuple(counts.first()) == ("mail", 5, None, 11, True)
    assert tuple(federation.search_sources(federation.plan_search({"folder"}), {"mail": part(3)}, 5, 10)[1].first()) == ("mail", 3, 3, 3, False)


def test_activity_without_anything_to_join(spark):
    items = spark.createDataFrame([("1", "mention", None, None, "c1", "9"), ("2", "reply", True, None, None, None)], "id string, type string, is_read boolean, at timestamp, conversation_id string, message_id string")
    none = lambda schema: spark.createDataFrame([], schema)
    got = chat.activity_list(items, none("conversation_id string, id string, content_text string, sender_id string, sender_name string"), none("id string, name string"), none("id string, display_name string, team_id string"), 5)
    assert sorted((r["id"], r["text"], r["sender"], r["conversation"], r["truncated"]) for r in got.collect()) == [("1", "", "", None, False), ("2", "", "", None, False)]


def test_a_fingerprint_ignores_order_and_sees_change(spark):
    f = lambda rows: mappers.fingerprint(spark.createDataFrame(rows, "s string, name string, size long"), ["s"], F.col("name"), F.col("size")).first()["fingerprint"]
    assert f([("a", "x", 1), ("a", "y", 2)]) == f([("a", "y", 2), ("a", "x", 1)]) != f([("a", "x", 1), ("a", "y", 3)])
    assert f([("a", "x", 1)]) != f([("a", "x", 1), ("a", "x", 1)])


def test_recursion_returns_all_rows(spark, small):
    text = "WITH RECURSIVE w AS (SELECT id FROM range(600000) UNION ALL SELECT id + 600000 FROM w WHERE id < 600000) SELECT count(*) AS n, max(id) AS last FROM w"
    assert tuple(guarded(spark, small, text, ["region"]).first()) == (1_200_000, 1_199_999)


def test_newest_activity_parses_its_records_once(spark, small):
    """The few newest items are written, and no join of theirs parses the feed again."""
    from loamline.plans import ingest

    done = ingest.activity_newest(spark, small)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan and any("/newest-" in f for f in done.inputFiles())
