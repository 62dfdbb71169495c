"""Replay of issue histories against a loop over the events of each timeline, and its growth."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import issues

EVENT = f"issue_id string, field_id string, event_at timestamp, event_id string, author_id string, kind string, multi boolean, before {issues.VALUES}, after {issues.VALUES}"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def forward(state, kind, multi, before, after):
    if kind == "add" and multi:
        return state if any(x[0] == after[0][0] for x in state) else [*state, after[0]]
    if kind == "remove" and multi:
        return [x for x in state if x[0] != before[0][0]]
    return [] if kind == "remove" else list(after)


def backward(state, kind, multi, before, after):
    if kind in ("add", "remove") and not multi:
        return []
    return forward(state, {"add": "remove", "remove": "add"}.get(kind, kind), multi, after, before)


def history(r, n_issues=12):
    """Random events, not always such as fit to each other, and the current values of some of the fields."""
    value = lambda: (str(r.randrange(5)), f"v{r.randrange(3)}")
    events, current = [], []
    for i in range(n_issues):
        for field, multi in (("labels", True), ("status", False), ("watchers", True)):
            for k in range(r.randrange(12)):
                kind = r.choice(["set", "snapshot", "add", "add", "remove", "remove"]) if multi else r.choice(["set", "set", "add", "remove"])
                some = lambda: [value() for _ in range(r.randrange(3))] if kind == "snapshot" else [value()][: r.randrange(2)]  # noqa: B023, E731
                before, after = (some(), some()) if kind in ("set", "snapshot") else ([], [value()]) if kind == "add" else ([value()], [])
                events.append((f"i{i}", field, at(r.randrange(200)), f"e{i}-{k:03}", r.choice(["u", None]), kind, multi, before, after))
            if r.random() < 0.7:
                current.append((f"i{i}", field, list(dict([value() for _ in range(r.randrange(3))]).items())))
    return events, current


def expected(events, current):
    states = {(i, f): v for i, f, v in current}
    initial, out = {}, {}
    for line in {(e[0], e[1]) for e in events} | set(states):
        own = sorted((e for e in events if (e[0], e[1]) == line), key=lambda e: e[2:4])
        state = states.get(line, [])
        for e in reversed(own):
            state = backward(state, *e[5:])
        initial[line] = state
        for e in own:
            state = forward(state, *e[5:])
            out[*line, e[3]] = state
    return initial, out


@pytest.mark.parametrize("seed", range(4))
def test_replay(spark, seed):
    events, current = history(random.Random(seed))
    heads = spark.createDataFrame([(f"i{i}", at(0), "rep") for i in range(12)], "issue_id string, created_at timestamp, reporter_id string")
    current_df = spark.createDataFrame(current, f"issue_id string, field_id string, value {issues.VALUES}")
    got = issues.replay(heads, current_df, spark.createDataFrame(events, EVENT).repartition(3)).collect()
    initial, states = expected(events, current)
    value = lambda r: [tuple(x) for x in r["value"]]
    assert {(r["issue_id"], r["field_id"]): value(r) for r in got if r["event_kind"] == "synthetic_initial" and r["seq"]} == initial
    assert {(r["issue_id"], r["field_id"], r["event_id"]): value(r) for r in got if r["event_kind"] == "changelog"} == states
    assert len(got) == len(initial) + len(states) + len({i for i, _ in initial})
    numbers = {}
    for r in sorted((r for r in got if r["event_kind"] == "synthetic_initial"), key=lambda r: r["seq"]):
        numbers.setdefault(r["issue_id"], []).append((r["seq"], r["field_id"]))
    assert all([n for n, _ in x] == list(range(len(x))) and x[0][1] == "created" and sorted(f for _, f in x[1:]) == [f for _, f in x[1:]] for x in numbers.values())


def test_replay_new(spark):
    events, _ = history(random.Random(8))
    last = [(f"i{i}", f, [("1", "v")], at(100)) for i in range(12) for f in ("labels", "status")]
    new = [e for e in events if e[2] > at(100)]
    got = issues.replay_new(spark.createDataFrame(last, f"issue_id string, field_id string, value {issues.VALUES}, last_event_at timestamp"), spark.createDataFrame(events, EVENT)).collect()
    states = {(i, f): v for i, f, v, _ in last}
    want = {}
    for e in sorted(new, key=lambda e: e[2:4]):
        states[e[0], e[1]] = want[e[0], e[1], e[3]] = forward(states.get((e[0], e[1]), []), *e[5:])
    assert {(r["issue_id"], r["field_id"], r["event_id"]): [tuple(x) for x in r["value"]] for r in got} == want


def test_one_long_timeline(spark):
    """Adding and removing in turn: as many rows as events, in a session of little memory."""
    n = 200_000
    value = F.array(F.struct(F.floor(F.col("id") % 20 / 2).cast("string").alias("id"), F.lit("x").alias("display")))
    none = F.array().cast(issues.VALUES)
    add = F.col("id") % 2 == 0
    events = spark.range(n).select(
        F.lit("i").alias("issue_id"), F.lit("labels").alias("field_id"), F.timestamp_seconds("id").alias("event_at"), F.lpad(F.col("id").cast("string"), 9, "0").alias("event_id"), F.lit("u").alias("author_id"),
        F.when(add, "add").otherwise("remove").alias("kind"), F.lit(True).alias("multi"), F.when(add, none).otherwise(value).alias("before"), F.when(add, value).otherwise(none).alias("after"),
    )
    heads = spark.createDataFrame([("i", at(0), "rep")], "issue_id string, created_at timestamp, reporter_id string")
    current = spark.createDataFrame([("i", "labels", [("old", "o")])], f"issue_id string, field_id string, value {issues.VALUES}")
    sizes = issues.replay(heads, current, events).where("event_kind = 'changelog'").groupBy("delta_action", F.size("value").alias("n")).count().collect()
    assert {tuple(r) for r in sizes} == {("add", 2, n // 2), ("remove", 1, n // 2)}


# -- the stream


def _put(spark, rows, path):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)


def _run(spark, path, base, **more):
    from millrace.streaming import replay

    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)
    replay.write_history(stream, f"{base}/out", f"{base}/checkpoint", **more).awaitTermination()
    return {(r["issue_id"], r["field_id"], r["event_id"]): [tuple(x) for x in r["value"]] for r in spark.read.parquet(f"{base}/out").collect()}


END = ("~", "~", at(10_000_000), "~", None, "set", False, [], [])


@pytest.mark.parametrize("cuts", [1, 5])
def test_stream_in_any_cut(spark, tmp_path, cuts):
    """Out of order, in batches of any cut, ended and started again between them: the rows of the batch replay from nothing."""
    r = random.Random(cuts)
    events, _ = history(r, 5)
    r.shuffle(events)
    _, want = {}, {}
    states = {}
    for e in sorted(events, key=lambda e: e[2:4]):
        states[e[:2]] = want[e[0], e[1], e[3]] = forward(states.get(e[:2], []), *e[5:])
    source, got = str(tmp_path / "in"), {}
    for k in range(cuts):
        _put(spark, events[k::cuts], source)
        if k % 2 == 0:
            got = _run(spark, source, tmp_path, lateness="400 days")
    assert not got
    _put(spark, [END], source)
    assert _run(spark, source, tmp_path, lateness="400 days") == want


def test_stream_keeps_fields_in_buckets(spark, tmp_path):
    """The state has no more groups than buckets, however many fields there are, and each field its own history; ids may be null or need escapes."""
    from millrace.streaming import replay

    r = random.Random(8)
    names = [None, 'a "b"\\', "語😀", "", *map(str, range(300))]
    events = [(n, f, at(r.randrange(50_000)), f"{i}-{k}", "u", "add", True, [], [(str(r.randrange(3)), "x")]) for i, n in enumerate(names) for f in ("labels", "other") for k in range(4)]
    want, states = {}, {}
    for e in sorted(events, key=lambda e: e[2:4]):
        states[e[:2]] = want[e[0], e[1], e[3]] = forward(states.get(e[:2], []), *e[5:])
    for cut in (events[::2], events[1::2], [END]):
        _put(spark, cut, str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = replay.write_history(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", lateness="400 days", buckets=7)
    query.awaitTermination()
    assert max(o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]) <= 7
    got = {(x["issue_id"], x["field_id"], x["event_id"]): [tuple(v) for v in x["value"]] for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want


def test_stream_seeds_and_expiry(spark, tmp_path):
    v = lambda *ids: [(i, i) for i in ids]
    line = lambda t, kind, before, after, k: ("i", "labels", at(t), k, "u", kind, True, before, after)
    source = str(tmp_path / "in")
    _put(spark, [line(10, "seed", [], v("a", "b"), "s"), line(9, "add", [], v("known"), "e0"), line(11, "remove", v("a"), [], "e1"), line(12, "add", [], v("c"), "e2")], source)
    _put(spark, [("j", "x", at(500), "f", "u", "set", False, [], v("y"))], source)
    got = _run(spark, source, tmp_path, lateness="1 minute", keep_ms=60_000 * 1000)
    assert got == {("i", "labels", "e1"): v("b"), ("i", "labels", "e2"): v("b", "c")}
    _put(spark, [("j", "x", at(5000), "g", "u", "set", False, [], v("z"))], source)
    _run(spark, source, tmp_path, lateness="1 minute", keep_ms=60_000 * 1000)
    _put(spark, [line(6000, "add", [], v("new"), "e3"), line(20, "add", [], v("late"), "e4"), END], source)
    got = _run(spark, source, tmp_path, lateness="1 minute", keep_ms=60_000 * 1000)
    assert got["i", "labels", "e3"] == v("new") and ("i", "labels", "e4") not in got and got["j", "x", "g"] == v("z")
