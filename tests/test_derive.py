"""Derived tables: a refresh leaves what a whole build leaves and builds only what moved. Recordings: notices by hand."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loamline.operators import derive, ranking
from loamline.operators import recordings as R
from loamline.plans import derived
from loamline.sources import archive
from loamline.sources.scratch import cut

SHAPE = "k string, item long, size double"


@pytest.fixture(autouse=True, scope="module")
def interpreted(spark):
    """Wide plans over few rows: compiling them would take most of the time."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")
    spark.conf.unset("spark.sql.codegen.factoryMode")


def sums(rows):
    """Groups of odd total have no derived row; others have two."""
    total = rows.groupBy("k").agg(F.sum("item").alias("total"), F.count("*").alias("n"))
    return total.where("total % 2 = 0").select("k", "total", F.explode(F.array(F.lit(0), F.col("n"))).alias("n"))


def plain(df):
    return sorted(repr(r) for r in df.collect())


def test_refresh_equals_full_build(spark):
    dice, rows, held = random.Random(7), [], None
    for step in range(5):
        rows = [r for r in rows if dice.random() > 0.2 and r[0] != f"g{step}"]
        rows += [(dice.choice([None, "", "hot", "hot", *(f"g{i}" for i in range(12))]), dice.randrange(4), dice.choice([None, 1.5])) for _ in range(12)]
        rows += rows[:2]
        dice.shuffle(rows)
        now = spark.createDataFrame(rows, SHAPE)
        before = [] if held is None else plain(derive.rows(held))
        asked = []

        def build(own, asked=asked):
            asked.append({r[0] for r in own.select("k").distinct().collect()})
            return sums(own)

        done = derive.refresh(now, held, derive.Derivation(["k"], ["k", "item", "size"], build), cut)
        assert plain(derive.rows(done.held)) == plain(sums(now))
        if held is not None:
            was = plain(sums(last))
            assert before == was
            held_groups = {g: sorted(repr(r[1:]) for r in prev if r[0] == g) for g in {r[0] for r in prev}}
            new_groups = {g: sorted(repr(r[1:]) for r in rows if r[0] == g) for g in {r[0] for r in rows}}
            assert asked[0] == {g for g, own in new_groups.items() if held_groups.get(g) != own}
            full = plain(sums(now))
            assert plain(done.gained) == [r for r in full if r not in was]
            assert plain(done.lost) == [r for r in was if r not in full]
        held, last, prev = cut(done.held, "held"), now, list(rows)


def test_new_rules_build_all_and_old_ones_refuse(spark):
    now = spark.createDataFrame([("a", 2, None), ("b", 4, None)], SHAPE)
    first = derive.refresh(now, None, derive.Derivation(["k"], ["k", "item", "size"], sums), cut)
    again = derive.refresh(now, first.held, derive.Derivation(["k"], ["k", "item", "size"], sums), cut)
    assert again.moved.count() == 0
    newer = derive.refresh(now, first.held, derive.Derivation(["k"], ["k", "item", "size"], lambda r: sums(r).withColumn("n", F.lit(9).cast("long")), 2), cut)
    assert newer.moved.count() == 2 and {r.n for r in derive.rows(newer.held).collect()} == {9}
    with pytest.raises(derive.NewerRules):
        derive.refresh(now, newer.held, derive.Derivation(["k"], ["k", "item", "size"], sums), cut)


def test_published_table_rewrites_moved_parts(spark, tmp_path):
    root, d = str(tmp_path), derive.Derivation(["k"], ["k", "item", "size"], sums)
    rows = [(f"g{i}", 2 * i, None) for i in range(30)]
    assert derive.publish(spark.createDataFrame(rows, SHAPE), root, "sums", d, cut) == 1
    assert derive.publish(spark.createDataFrame(rows[::-1], SHAPE), root, "sums", d, cut) is None
    rows[3] = ("g3", 8, None)
    assert derive.publish(spark.createDataFrame(rows, SHAPE), root, "sums", d, cut) == 2
    assert plain(derive.rows(archive.current(spark, root, "sums"))) == plain(sums(spark.createDataFrame(rows, SHAPE)))
    kept = rows[:3]  # the others are gone, some parts are empty then
    assert derive.publish(spark.createDataFrame(kept, SHAPE), root, "sums", d, cut) == 3
    assert plain(derive.rows(archive.current(spark, root, "sums"))) == plain(sums(spark.createDataFrame(kept, SHAPE)))
    derive.publish(spark.createDataFrame([], SHAPE), root, "sums", d, cut)
    assert derive.rows(archive.current(spark, root, "sums")).count() == 0
    derive.publish(spark.createDataFrame(rows, SHAPE), root, "sums", d, cut)
    assert plain(derive.rows(archive.current(spark, root, "sums"))) == plain(sums(spark.createDataFrame(rows, SHAPE)))


def test_places_in_one_hot_key(spark):
    dice = random.Random(3)
    rows = [(None if i % 7 == 0 else "hot", dice.randrange(20), i) for i in range(400)]
    got = ranking.numbered(spark.createDataFrame(rows, "k string, at long, id long").repartition(5), ["k"], [F.col("at").desc(), F.col("id")], cut, "place").collect()
    want = {}
    for key in (None, "hot"):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        want |= {r[2]: i for i, r in enumerate(own, 1)}
    assert {r.id: r.place for r in got} == want and len(got) == len(rows)


def notice(call="c", name="r.mp4", status="Success", at="2024-01-01T10:00:00", types="Recording,Transcript", extra="", items="", chunk="0", tail="</URIObject>"):
    return (
        f'<p>x</p><URIObject>{extra}<OriginalName v="{name}"/><Identifiers><Id type="callId" value="{call}"/><Id type="chunkIndex" value="{chunk}"/></Identifiers><RecordingStatus status="{status}"/>'
        f'<RecordingContent contentTypes="{types}" timestamp="{at}" duration="1:02:03.5">{items}</RecordingContent>{tail}'
    )


def said(spark, *rows):
    return spark.createDataFrame([Row(account_id="a", thread_id="t", message_id=m, sent_at=s, kind=k, content=c) for m, s, k, c in rows], "account_id string, thread_id string, message_id string, sent_at long, kind string, content string")


URI = '<item type="onedriveForBusinessTranscript" uri="https://h.example.com/personal/me/_api/v2.1/drives/D/items/I/versions/current/media/transcripts/T/content"/>'


def test_notices_read(spark):
    messages = said(
        spark, ("1", 1, "recording", notice(items=URI)), ("2", 2, "recording", notice(extra='<a href="https://s/?a=1&b=2&amp;c">Play</a>', at="2024-01-01T12:00:00+02:00")), ("3", 3, "recording", notice(at="soon", types="Transcript")), ("4", 4, "recording", notice(status="Failed")),
        ("5", 5, "recording", notice(call="")), ("6", 6, "recording", notice(tail="")), ("7", 7, "recording", "<p>no notice</p>"), ("8", 8, "recording", None), ("9", 9, "recording", "<URIObject><a></URIObject>"), ("10", 10, "recording", notice(status="Failed", call="")),
    )
    parts, broken = R.read_recordings(messages, cut)
    got = {r.message_id: r for r in parts.collect()}
    assert set(got) == {"1", "2", "3"} and {r.message_id for r in broken.collect()} == {"5", "6", "9"}
    one, two, three = got["1"], got["2"], got["3"]
    assert (one.part_key, one.host, one.site_root, one.item_id, one.transcript_id, one.ref_quality) == ("d:D/I", "h.example.com", "/personal/me", "I", "T", "drive_item")
    assert one.starts_at == two.starts_at == 1_704_103_200_000_000 and one.duration_seconds == 3723.5 and not one.transcribe_only
    assert two.share_url == "https://s/?a=1&b=2&c" and two.ref_quality == "share_only"
    assert (three.part_key, three.starts_at, three.ref_quality, three.transcribe_only) == ("m:3", None, "ams_only", True)


def test_parts_assembled(spark):
    link = lambda n: f'<a href="https://s/{n}"></a>'
    messages = said(
        spark, ("1", 1, "recording", notice(extra=link(1), at="2024-01-02T00:00:00")), ("2", 5, "recording", notice(extra=link(1), at="2024-01-03T00:00:00")), ("3", 5, "recording", notice(extra=link(1), at="2024-01-04T00:00:00")),
        ("4", 9, "recording", notice(extra=link(2), at="2024-01-04T00:00:00", name="b_20240101-000000.mp4")), ("5", 2, "recording", notice(call="d", types="Recording", extra=link(3))), ("6", 3, "transcript", '{\\"callId\\":\\"d\\"}'), ("7", 4, "transcript", '{"callId":"d"}'),
        ("8", 4, "transcript", '{"callId":"e"}'), ("9", 4, "transcript", '{"callId":"c"}'), ("x", 4, "transcript", "{broken"), ("y", 4, "transcript", None),
    )
    rows, broken = R.notices(messages, cut)
    parts = R.assemble(rows.where("told = 'part'"), rows.where("told = 'notice'"), cut)
    got = [(r.call_id, r.ordinal, r.message_id, r.ref_quality) for r in parts.orderBy("call_id", "ordinal").collect()]
    assert got == [("c", 1, "3", "share_only"), ("c", 2, "4", "share_only"), ("d", 1, "5", "share_only"), ("d", 2, "7", "unresolved"), ("e", 1, "8", "unresolved")]
    count = R.counts(parts, broken).collect()
    assert [(r.calls, r.parts, r.share_only, r.unresolved, r.unparsable) for r in count] == [(3, 3, 3, 2, 0)]
    none = R.assemble(rows.where("told = ''"), rows.where("told = ''"), cut)
    assert none.count() == 0 and none.columns == [*R.PART, "ordinal"]


def test_references_fall_through(spark):
    parts = spark.createDataFrame([("c1", "t1", 5, 1), ("c1", "t1", None, 9), ("c2", "t1", 7, 1), ("t2", "t3", 1, 1), ("c4", "t2", 1, 1)], "call_id string, thread_id string, starts_at long, sent_at long")
    events = spark.createDataFrame([("e1", "t1", "c2"), ("e1", "t1", "c9"), ("e1", "t2", "c1"), ("c1", "t1", "c2"), ("e2", "t9", "c9"), ("", "t1", "c1")], "event_key string, thread_id string, call_id string")
    refs = spark.createDataFrame([(r,) for r in ("c1", "t1", "t2", "e1", "e2", "nobody", "", None, "t1")], "ref string")
    got = sorted((tuple(r) for r in R.resolve(refs, parts, events, cut).collect()), key=repr)
    want = [("c1", "call", "c1", 1), ("t1", "thread", "c1", 1), ("t1", "thread", "c2", 2), ("t2", "call", "t2", 1), ("e1", "event", "c2", 1), ("e2", None, None, None), ("nobody", None, None, None), ("", None, None, None), (None, None, None, None)]
    assert got == sorted(want, key=repr)


def test_a_stamp_stands_once_a_group(spark):
    now = spark.createDataFrame([("a", 2, None), ("b", 1, None), ("b", 2, None)], SHAPE)
    held = derive.refresh(now, None, derive.Derivation(["k"], ["k", "item", "size"], sums), cut).held.collect()
    assert sorted((r.stamp is None, r.row is None) for r in held) == [(False, True)] * 2 + [(True, False)] * 2 and {len(r.group) for r in held} == {24}


def test_hot_calls_are_assembled_alike(spark, monkeypatch):
    messages = said(spark, *((str(i), i, "recording", notice(call="c" if i < 6 else f"d{i}", types="Recording", at=f"2024-01-0{9 - i}T00:00:00")) for i in range(8)), ("n", 4, "transcript", '{"callId":"c"}'), ("m", 4, "transcript", '{"callId":"d7"}'))
    rows = cut(R.notices(messages, cut)[0], "rows")
    made = lambda: plain(R.assemble(rows.where("told = 'part'"), rows.where("told = 'notice'"), cut))
    once = made()
    monkeypatch.setattr(R, "SMALL_CALL", 3)
    assert made() == once and len(once) == 10


def test_usual_notices_are_taken_apart_without_the_xml_reader(spark, monkeypatch):
    """One match reads the usual form and says what the XML reader says; only markup of another form is left to that."""
    link, who, status = '<a href="https://s/?a=1&amp;b=&lt;2&gt;&quot;&apos;&amp;lt;">Play ]]</a>', '<Identifiers><Id type="callId" value="{0}"/><Id type="chunkIndex" value="10001"/><Id type="x" value="y"/></Identifiers>', '<RecordingStatus status="{0}"/>'
    content = '<RecordingContent contentTypes="Recording" timestamp="2026-01-01T00:00:00.5" duration="1:00:30.5">{0}</RecordingContent>'
    item = '<item type="onedriveForBusiness{0}" uri="https://h/sites/s/_api/v2.1/drives/{1}/items/I/versions/current/media/transcripts/t/content"/>'
    rest = '<RecordingStorage type="P"/><MeetingICalUid value="null"/>'
    usual = [
        who.format("K1") + status.format("Success") + content.format(""), link + '<OriginalName v="é 𝄞.mp4"/>' + who.format("K2") + status.format("Success") + content.format(item.format("Transcript", "D1") + item.format("Video", "D2") + item.format("Transcript", "D3")) + rest,
        who.format("") + status.format("Success") + content.format(""), who.format("K3") + status.format("Failed"), who.format("K4") + status.format("Success"), '<Identifiers><Id type="callId" value="K5"/><Id type="callId" value="K6"/></Identifiers>' + status.format("Success") + content.format(item.format("Video", "D")), "",
    ]
    other = [
        status.format("Success") + who.format("K7") + content.format(""), who.format(" K8 ") + status.format("Success"), who.format("K&9") + status.format("Success"), who.format("K&#65;") + status.format("Success"), who.format("K<") + status.format("Success"), "<b>" + who.format("K10") + status.format("Success") + "</b>",
        who.format("K11") + status.format("Success") + "<RecordingStorage>", who.format("K12") + who.format("K13") + status.format("Success"), who.format("K14\x01") + status.format("Success"), who.format("K\t15") + status.format("Success"), "<!-- c -->" + who.format("K16") + status.format("Success"), link.replace("Play", "]]>") + who.format("K17") + status.format("Success"),
        "<New a='1'/>" + who.format("K18") + status.format("Success"), "<Identifiers/>" + status.format("Success"),
    ]

    def found(bodies):
        rows = [("a", "T", f"{i:03}", i, "recording", f"<p>x</p><URIObject{' type=' + chr(34) + 'V.2/C' + chr(34) if i % 2 else ''}>{b}</URIObject{' ' * (i % 3)}> tail") for i, b in enumerate(bodies)]
        rows.append(("a", "T", "none", 99, "recording", "<URIObject><RecordingStatus status='Success'"))
        parts, broken = R.read_recordings(spark.createDataFrame(rows, "account_id string, thread_id string, message_id string, sent_at long, kind string, content string"), cut)
        return plain(parts), plain(broken)

    quick = found(usual + other)
    assert len(quick[0]) >= 12 and len(quick[1]) >= 4
    with monkeypatch.context() as m:
        m.setattr(R, "PLAIN", "^(?!)")
        assert found(usual + other) == quick
    form = spark.createDataFrame([(i, f"<URIObject>{b}</URIObject>") for i, b in enumerate(usual + other)], "i int, markup string")
    assert {r[0] for r in form.where(F.col("markup").rlike(R.PLAIN)).collect()} == set(range(len(usual)))


def test_changed_groups_are_asked_for_once(spark):
    """build may read its rows several times: they are written, and no read joins them with the changed groups again."""
    plans = []

    def build(own):
        plans.append(own._jdf.queryExecution().optimizedPlan().toString())
        return sums(own)

    d = derive.Derivation(["k"], ["k", "item", "size"], build)
    held = derive.refresh(spark.createDataFrame([("a", 2, None), ("b", 4, None)], SHAPE), None, d, cut).held
    done = derive.refresh(spark.createDataFrame([("a", 2, None), ("b", 6, None)], SHAPE), held, d, cut)
    assert "Join" not in plans[1] and done.moved.count() == 1 and plain(done.gained) == ["Row(k='b', total=6, n=0)", "Row(k='b', total=6, n=1)"]


def test_both_states_hold_each_message_once(spark, small):
    """The messages of both states together are those of each, and reading keeps which is which."""
    both = derived.messages(spark, small, None)
    for state, later in (("_then", False), ("_now", True)):
        assert plain(both.where(state).drop("_then", "_now")) == plain(derived.messages(spark, small, later))
    assert both.count() < 1.1 * derived.messages(spark, small).count()
    rows, broken = R.notices(both, cut, ("_then", "_now"))
    for state, later in (("_then", False), ("_now", True)):
        want = R.notices(derived.messages(spark, small, later), cut)
        assert [plain(df.where(state).drop("_then", "_now")) for df in (rows, broken)] == [plain(df) for df in want]
