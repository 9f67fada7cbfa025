"""Calendar batches: keys, sightings and silence in any order."""

import itertools
import random

import pytest

from loamline.operators import batches as B
from loamline.sources.scratch import cut

EVENT = "source string, account_id string, source_id string, global_id string, event_type string, subject string, location string, start long, end long, all_day boolean, start_date long, end_date long, cancelled boolean, clock long, at long"
HOUR = 3_600_000_000

@pytest.fixture(autouse=True, scope="module")
def interpreted(spark):
    """These plans are wide and their rows few: compiling them would take most of the time."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")
    spark.conf.unset("spark.sql.codegen.factoryMode")



def event(source_id, source="teams", global_id="", subject="Review", start=100 * HOUR, clock=1, at=1, **more):
    base = {"source": source, "account_id": "a", "source_id": source_id, "global_id": global_id, "event_type": "single", "subject": subject, "location": None, "start": start, "end": start + HOUR, "all_day": None, "start_date": None, "end_date": None, "cancelled": None, "clock": clock, "at": at}
    return tuple((base | more).values())


def batch(spark, events=(), windows=(), gone=()):
    windows = [(w[0], "a", *w[1:]) for w in windows]
    return B.Batch(spark.createDataFrame(list(events), EVENT), spark.createDataFrame(windows, "source string, account_id string, since long, until long, at long"), spark.createDataFrame([(g[0], "a", *g[1:]) for g in gone], "source string, account_id string, source_id string, at long"))


def run(spark, *batches):
    state = B.State.empty(spark)
    for b in batches:
        state, _ = B.apply(state, b, cut)
    return state


def rows(state):
    return {(r["source"], r["event_key"]): (r["subject"], r["removed_at"]) for r in B.with_removed(state.rows, state.reads).collect()}


def methods(state):
    return {(r["source"], r["source_id"]): (r["event_key"], r["method"]) for r in state.matches.collect()}


def test_sources_join_whichever_comes_first(spark):
    teams, mail = batch(spark, [event("t1", global_id="G")]), batch(spark, [event("m1", source="mail")])
    key = f"G|{100 * HOUR}"
    for order in ((teams, mail), (mail, teams)):
        state = run(spark, *order)
        assert set(rows(state)) == {("teams", key), ("mail", key)} and {k for k, _ in methods(state).values()} == {key}
    assert methods(state)["mail", "m1"] == (key, "composite") and methods(state)["teams", "t1"] == (key, "global")  # the mail row came first and moved


def test_twins_stay_apart(spark):
    state = run(spark, batch(spark, [event("m1", source="mail"), event("m2", source="mail")]), batch(spark, [event("t1", global_id="G")]))
    assert {k.partition("#")[2] for (s, k) in rows(state) if s == "mail"} == {"m1", "m2"}
    assert methods(state)["teams", "t1"] == (f"G|{100 * HOUR}", "ambiguous")
    other = run(spark, batch(spark, [event("t1", global_id="G"), event("t2", global_id="H")]), batch(spark, [event("m1", source="mail")]))
    assert methods(other)["mail", "m1"][1] == "ambiguous" and len(rows(other)) == 3


def test_a_key_never_moves_again(spark):
    state = run(spark, batch(spark, [event("t1", global_id="G")]), batch(spark, [event("t1", global_id="G", subject="Other", start=200 * HOUR, clock=2, at=2)]))
    assert rows(state) == {("teams", f"G|{100 * HOUR}"): ("Other", None)}


def test_silence_counts_only_in_the_window(spark):
    first = batch(spark, [event("in", subject="in", start=30 * HOUR), event("edge", subject="edge", start=50 * HOUR), event("out", subject="out", start=90 * HOUR), event("series", subject="series", start=30 * HOUR, event_type="master"), event("day", subject="day", start=0, all_day=True, start_date=1, end_date=2)])
    read = batch(spark, windows=[("teams", 20 * HOUR, 50 * HOUR, 7)])
    gone = {s: at for s, at in rows(run(spark, first, read)).values()}
    assert gone == {"in": 7, "edge": None, "out": None, "series": None, "day": 7}
    back = run(spark, first, read, batch(spark, [event("in", subject="in", start=30 * HOUR, clock=1, at=9)]))
    assert {s: at for s, at in rows(back).values()}["in"] is None
    named = run(spark, first, batch(spark, gone=[("teams", "out", 5), ("teams", "nobody", 5)]))
    assert {s: at for s, at in rows(named).values()}["out"] == 5


def test_a_refused_event_spares_its_row(spark):
    first = batch(spark, [event("x"), event("y", subject="gone", start=101 * HOUR)])
    bad = batch(spark, [event("x", start=100 * HOUR, end=0, at=7), event("", at=7)], windows=[("teams", 0, 300 * HOUR, 7)])
    state = run(spark, first)
    after, refused = B.apply(state, bad, cut)
    assert refused.count() == 2 and {s: at for s, at in rows(after).values()} == {"Review": None, "gone": 7}


def test_any_order_of_batches_gives_one_result(spark):
    rng = random.Random(3)
    made = []
    for at in range(1, 4):
        source = rng.choice(["teams", "mail"])
        events = [event(f"{source}{i}", source=source, global_id=f"G{i}", subject=f"s{i}", start=i * 10 * HOUR, clock=rng.randint(1, 9), at=at, location=rng.choice([None, "x", "yy"]), cancelled=rng.choice([None, True, False])) for i in rng.sample(range(6), 3)]
        made.append(batch(spark, events, windows=[(source, rng.randint(0, 3) * 10 * HOUR, rng.randint(3, 6) * 10 * HOUR, at)]))
    orders = rng.sample(list(itertools.permutations(made)), 2)

    def plain(state):
        return sorted(str(r) for r in B.with_removed(state.rows, state.reads).drop("source_id").collect())

    results = [plain(run(spark, *order)) for order in orders]
    assert results[0] == results[1]


def test_empty_batches(spark):
    state = run(spark, batch(spark))
    assert rows(state) == {} and state.matches.count() == state.reads.count() == 0


def test_found_keys_are_written_once_and_copies_meet_before_they_are_sorted(spark):
    names = []
    B.apply(B.State.empty(spark), batch(spark, [event("t1")]), lambda df, name: names.append(name) or cut(df, name))
    assert names.count("found") == 1 and "moves" not in names  # what moves is read from what was found, not found again
    plan = B.captured(spark.createDataFrame([], B.ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "SortAggregate" not in plan[plan.rindex("Exchange hashpartitioning") :]
