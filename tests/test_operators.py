"""Operators on rows by hand: boundaries, nulls, ties."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.dimensions import carries, dimension, dimensions, label_of, value_of
from millrace.operators import dedup, hierarchy, history, identity, incremental, issues, quantiles, sequences
from millrace.plans import drilldown, metrics
from millrace.plans.metrics import Metric, Scope, Transform
from millrace.sources import landing
from millrace.streaming import usage


def at(day, hour=0, minute=0, second=0):
    return dt.datetime(2024, 1, day, hour, minute, second)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


# -- quantiles and metrics


def test_quantiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (4, 1, 3, 2)] + [("b", 7.0), ("b", None), ("c", None)], "k string, v double")
    out = quantiles.exact_quantiles(df, ["k"], "v", {"lo": 0.0, "m": 0.5, "hi": 1.0})
    assert rows(out, "k") == [("a", 4, 1.0, 3.0, 4.0), ("b", 1, 7.0, 7.0, 7.0)]
    assert rows(quantiles.exact_quantiles(df, [], "v", {"m": 0.5}), "n") == [(5, 3.0)]


OBS = "tenant_id string, source_key string, entity_id string, metric_date date, measure_key string, value double, subject_key string, dimensions array<struct<key:string,value:string,label:string>>"


@pytest.fixture(scope="module")
def obs(spark):
    d = [("tool", "x", "X")]
    return spark.createDataFrame(
        [("t", "s", f"p{i}", at(1 + i).date(), "m", float(i), f"k{i % 2}", d if i % 2 else []) for i in range(1, 7)] + [("t", "s", "p1", at(20).date(), "den", 0.0, None, []), ("t", "s", "p2", at(20).date(), "den", 4.0, None, d), ("t", "s", "p9", at(20).date(), "m", None, None, [])], OBS
    )


def test_honest_nulls(obs):
    total, ratio = Metric("a.total", "sum", "s", ("m",)), Metric("a.rate", "ratio", "s", ("m",), ("den",), 100.0)
    out = {r["entity_id"]: r for r in metrics.period(obs, [total, ratio]).collect()}
    assert out["p1"]["a_rate"] is None and out["p2"]["a_rate"] == 50.0 and out["p3"]["a_rate"] is None
    assert out["p9"]["a_total"] is None


def test_floor_of_peers(obs, spark):
    total = Metric("a.total", "sum", "s", ("m",))
    cohorts = spark.createDataFrame([(f"p{i}", "big" if i != 6 else "small") for i in range(1, 10)], "entity_id string, cohort_id string")
    out = {r["entity_id"]: r for r in metrics.peers(obs, total, cohorts, cohorts.select("entity_id")).collect()}
    assert (out["p1"]["n"], out["p1"]["p25"], out["p1"]["median"], out["p1"]["p75"]) == (5, 2.0, 3.0, 4.0)
    assert out["p9"]["value"] is None and out["p9"]["n"] == 5
    assert (out["p6"]["n"], out["p6"]["median"]) == (1, None)


def test_dimension_filter_and_sentinel(obs):
    assert obs.where(carries(F.col("dimensions"), "tool", ["x", "y"])).count() == 4
    by = Metric("a.total", "sum", "s", ("m",))
    out = metrics.breakdown(obs, by, ["tool"], Scope(entities=("p1", "p2")))
    assert {(r["entity_id"], r["tool_value"], r["tool_label"]) for r in out.collect()} == {("p1", "x", "X"), ("p2", "__unknown__", "Unknown")}


def test_transform_keeps_null(spark):
    t = Transform(-1.0, 100.0, 0.0, 100.0)
    df = spark.createDataFrame([(None,), (130.0,), (-5.0,), (40.0,)], "x double").select(t(F.col("x")).alias("y"))
    assert [r["y"] for r in df.collect()] == [None, 0.0, 100.0, 60.0]


def test_definitions_are_checked():
    for kind, den in (("sum", ("x",)), ("ratio", ()), ("mean", ())):
        with pytest.raises(ValueError):
            Metric("k", kind, "s", ("m",), den)


def test_capped(obs):
    with pytest.raises(ValueError):
        metrics.capped(obs, 3)
    assert len(metrics.capped(obs, 50)) == 9


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([("t", "s", "p", at(1).date(), "m", 5.0, None, [])] * 3, OBS)
    assert [(r["bin"], r["count"]) for r in metrics.histogram(df, Metric("a.m", "median", "s", ("m",))).collect()] == [(0, 3)]


def test_cursor():
    selection = {"tenant": "t", "metric": "m"}
    c = drilldown.write_cursor(selection, "s1", ["a"] * 5)
    assert drilldown.read_cursor(c, selection, "s1") == ["a"] * 5
    for args in ((c, {"tenant": "u"}, "s1"), (c, selection, "s2"), ("!!", selection, "s1"), (json.dumps(1), selection, "s1")):
        with pytest.raises(drilldown.CursorError):
            drilldown.read_cursor(*args)


def test_pages_cover_all_evidence_once(spark):
    e = spark.createDataFrame([("s", "m", f"e{i % 3}", at(1 + i % 4).date(), f"r{i:03}", 1.0) for i in range(60)], "source_key string, measure_key string, entity_id string, metric_date date, record_id string, contribution double").withColumn("dimensions", F.array().cast("array<struct<key:string,value:string,label:string>>"))
    seen, after = [], None
    while True:
        got = drilldown.page(e, [("s", "m")], after=after, size=25).collect()
        seen += [r["record_id"] for r in got[:25]]
        if len(got) <= 25:
            break
        after = [str(got[24][k]) for k in drilldown.KEY]
    assert sorted(seen) == [f"r{i:03}" for i in range(60)]


# -- sequences


def test_session_at_the_gap(spark):
    df = spark.createDataFrame([("u", at(1, 0, 0), 1), ("u", at(1, 0, 5), 2), ("u", at(1, 0, 10, 1), 3), ("v", at(1), 4)], "u string, ts timestamp, id int")
    assert [r["session"] for r in sequences.sessionize(df, ["u"], "ts", "id", 300).orderBy("id").collect()] == [1, 1, 2, 1]


def test_days_of_a_span(spark):
    df = spark.createDataFrame([(at(1, 22), at(3, 1))], "span_start timestamp, span_end timestamp")
    assert [(r["day"].day, r["seconds"]) for r in sequences.by_day(df).orderBy("day").collect()] == [(1, 7200.0), (2, 86400.0), (3, 3600.0)]


def test_steps_add_up(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 7), (5, 7), (6, 12)], "d int, x int").select(F.make_date(F.lit(2024), F.lit(1), "d").alias("day"), "x", F.lit(1).alias("k"))
    out = sequences.cumulative_steps(df, ["k"], "day", "x", F.lit("2023-12-31").cast("date")).orderBy("day").collect()
    assert [r["step"] for r in out] == [5, 2, 0, 0, 5] and [r["covers_days"] for r in out] == [1, 1, 1, 2, 1]


def test_overlap_of_open_ends(spark):
    a = spark.createDataFrame([("p", at(1), at(3)), ("p", at(3), None)], "k string, a timestamp, b timestamp")
    b = spark.createDataFrame([("p", at(2), at(3)), ("p", at(3), None)], "k string, c timestamp, d timestamp")
    out = sequences.overlaps(a, b, ["k"], ("a", "b"), ("c", "d"))
    assert [(r["overlap_start"], r["overlap_end"]) for r in out.orderBy("overlap_start").collect()] == [(at(2), at(3)), (at(3), None)]


# -- dedup and history


def test_unanimous_and_mode(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), ("b", "x"), ("b", "y"), ("c", "z"), ("c", "z"), ("c", "y")], "k string, v string")
    assert rows(dedup.unanimous(df, ["k"], "v"), "k") == [("a", "x")]
    assert [(r["k"], r["v"]) for r in dedup.unique_mode(df, ["k"], "v").orderBy("k").collect()] == [("a", "x"), ("c", "z")]


def test_union_without_producers(spark):
    empty = spark.createDataFrame([(1, 2)], "k int, version int")
    assert dedup.class_union([], ["k"], ["version"], empty).count() == 0
    with pytest.raises(ValueError):
        dedup.class_union([], ["k"], ["version"])


def test_claims(spark):
    v = spark.createDataFrame([("a", at(1), "x", None), ("a", at(2), "", "q"), ("a", at(3), "x", "q")], "k string, at timestamp, f string, g string")
    h = history.attribute_claims(history.fields_history(v, ["k"], "at", ["f", "g"]))
    assert [(r["field"], r["at"].day, r["old_value"], r["new_value"], r["claim_action"]) for r in h.orderBy("field", "at").collect()] == [("f", 1, "", "x", "set"), ("f", 2, "x", "", "clear"), ("f", 3, "", "x", "set"), ("g", 2, "", "q", "set")]
    i = history.claim_intervals(h, ["k"], "at")
    assert [(r["field"], r["valid_from"].day, r["valid_to"] and r["valid_to"].day) for r in i.orderBy("field", "valid_from").collect()] == [("f", 1, 2), ("f", 3, None), ("g", 2, None)]
    assert history.valid_at(i, F.lit(at(2))).count() == 1


def test_snapshot_appends_changes_only(spark):
    one = spark.createDataFrame([(1, "a", None), (2, "b", "c")], "k int, x string, y string")
    two = spark.createDataFrame([(1, "a", ""), (2, "b", "c"), (3, "n", None)], "k int, x string, y string")
    log = history.snapshot_changes(None, one, ["k"], ["x", "y"], F.lit(at(1)))
    new = history.snapshot_changes(log, two, ["k"], ["x", "y"], F.lit(at(2)))
    assert [r["k"] for r in new.orderBy("k").collect()] == [1, 3]
    assert history.snapshot_changes(log.unionByName(new), two, ["k"], ["x", "y"], F.lit(at(3))).count() == 0


def test_watermarks(spark):
    target = spark.createDataFrame([("a", 5), ("b", 1)], "s string, version int")
    new = spark.createDataFrame([("a", 4), ("a", 6), ("b", 2), ("c", 0)], "s string, version int")
    assert rows(incremental.after_watermark(new, target, ["s"], "version"), "s") == [("a", 6), ("b", 2), ("c", 0)]
    assert rows(incremental.after_global_watermark(new, target, "version"), "s") == [("a", 6)]
    assert incremental.after_global_watermark(new, target.limit(0), "version").count() == 4


# -- hierarchy


def test_cycles_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "parent string, child string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert rows(hierarchy.subtree(edges, roots), "depth", "node") == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]
    assert hierarchy.subtree(edges, roots, 1).count() == 2
    grants = spark.createDataFrame([("y", "c"), ("w", "*")], "viewer string, node string")
    viewers = spark.createDataFrame([("y",), ("w",)], "viewer string")
    everyone = spark.createDataFrame([("a",), ("w",)], "node string")
    out = hierarchy.visible(edges, viewers, grants, everyone)
    assert rows(out, "viewer", "node") == [("w", "a"), ("w", "w"), ("y", "a"), ("y", "b"), ("y", "c"), ("y", "d"), ("y", "y")]
    nodes = spark.createDataFrame([(n,) for n in "xyd"], "node string")
    assert rows(hierarchy.forest(edges, nodes), "node") == [("x", "x", 0), ("x", "y", 1)]


# -- issues


def test_replay(spark):
    v = lambda *ids: [(i, i.upper()) for i in ids]
    events = spark.createDataFrame(
        [
            ("i", "labels", at(2), "e1", "u", "add", True, [], v("b")), ("i", "labels", at(3), "e2", "u", "remove", True, v("a"), []),
            ("i", "status", at(2), "e3", "u", "set", False, v("open"), v("doing")), ("i", "status", at(4), "e4", "u", "set", False, v("doing"), v("done")),
            ("i", "old", at(5), "e5", "u", "snapshot", True, v("p", "q"), v("q", "r")),
        ], f"issue_id string, field_id string, event_at timestamp, event_id string, author_id string, kind string, multi boolean, before {issues.VALUES}, after {issues.VALUES}",
    )
    current = spark.createDataFrame([("i", "labels", v("b")), ("i", "status", v("done")), ("i", "old", v("q", "r")), ("i", "untouched", v("z"))], f"issue_id string, field_id string, value {issues.VALUES}")
    heads = spark.createDataFrame([("i", at(1), "rep")], "issue_id string, created_at timestamp, reporter_id string")
    out = issues.replay(heads, current, events)
    got = {(r["field_id"], r["event_kind"], r["event_at"].day): (r["seq"], [x["id"] for x in r["value"]]) for r in out.collect()}
    assert got == {
        ("created", "synthetic_initial", 1): (0, []), ("labels", "synthetic_initial", 1): (1, ["a"]), ("old", "synthetic_initial", 1): (2, ["p", "q"]), ("status", "synthetic_initial", 1): (3, ["open"]), ("untouched", "synthetic_initial", 1): (4, ["z"]),
        ("labels", "changelog", 2): (0, ["a", "b"]), ("labels", "changelog", 3): (0, ["b"]), ("status", "changelog", 2): (0, ["doing"]), ("status", "changelog", 4): (0, ["done"]), ("old", "changelog", 5): (0, ["q", "r"]),
    }
    last = spark.createDataFrame([("i", "labels", v("a", "b"), at(2)), ("i", "status", v("doing"), at(2))], f"issue_id string, field_id string, value {issues.VALUES}, last_event_at timestamp")
    new = {(r["field_id"], r["event_at"].day): [x["id"] for x in r["value"]] for r in issues.replay_new(last, events).collect()}
    assert new == {("labels", 3): ["b"], ("status", 4): ["done"], ("old", 5): ["q", "r"]}
    categories = spark.createDataFrame([("open", "todo"), ("doing", "in_progress"), ("done", "done")], "status_id string, status_category string")
    state = issues.issue_state(out.where("field_id = 'status'"), categories).first()
    assert (state["status_id"], state["final_close_at"], state["created_at"]) == ("done", at(4), at(1))


def test_changelog_items(spark):
    items = spark.createDataFrame([(1, False, None, None, "2", "Two"), (2, True, None, None, "3", None), (3, True, "4", "Four", None, None), (4, True, "1, 2", "A, B", "", "B, C"), (5, True, None, "A", None, "B")], "n int, multi boolean, from_id string, from_text string, to_id string, to_text string")
    out = {r["n"]: (r["kind"], [tuple(x) for x in r["before"]], [tuple(x) for x in r["after"]]) for r in issues.parse_items(items).collect()}
    assert out == {1: ("set", [], [("2", "Two")]), 2: ("add", [], [("3", "3")]), 3: ("remove", [("4", "Four")], []), 4: ("snapshot", [("1", "A"), ("2", "B")], [("B", "B"), ("C", "C")])}


# -- identity


def test_assignments(spark):
    cases = {
        # account: (email, closed, has_id, bound to, provenance) -> person, outcome
        "x1": ("x@x", False, True, identity.EXCLUDED, "operator", None, "skipped_excluded"),
        "k1": ("K@x", False, True, "P1", "automatic", "P1", "reused_known"),
        "k2": ("k@X", False, True, None, None, "P1", "reused_known"),
        "d1": ("d@x", False, True, "P2", "automatic", "P2", "reused_known_conflict"),
        "d2": ("d@x", False, True, "P3", "automatic", "P3", "reused_known_conflict"),
        "d3": ("d@x", False, True, None, None, None, "skipped_contested_email"),
        "s1": ("s@x", False, True, "P4", "operator", "P4", "reused_known_settled"),
        "s2": ("s@x", False, True, "P5", "automatic", "P5", "reused_known_settled"),
        "l1": ("l@x", False, True, None, None, "P6", "linked_by_email"),
        "u1": ("u@x", False, True, "P8", "unconfirmed", "P7", "linked_by_email"),
        "c1": ("c@x", True, True, None, None, None, "skipped_closed"),
        "n1": ("n@x", False, False, None, None, None, "skipped_no_source_id"),
        "m1": ("m@x", False, True, None, None, "new", "minted"),
        "m2": ("m@x", True, False, None, None, "new", "minted"),
        "b1": (" b@x", False, True, None, None, "new", "minted"),
        "b2": ("b@x", False, True, None, None, "new", "minted"),
        "a1": (None, False, True, None, None, None, "skipped_no_email"),
    }
    accounts = spark.createDataFrame([("hr" if False else "git", "i", a, c[0], c[1], c[2]) for a, c in cases.items()] + [("hr", "i", "h1", " ", False, True), ("hr", "i", "h2", None, True, True)], "source_type string, source_id string, account_id string, latest_email string, is_closed boolean, has_id boolean")
    bindings = spark.createDataFrame([("git", "i", a, c[3], c[4]) for a, c in cases.items() if c[3]], "source_type string, source_id string, account_id string, person_id string, provenance string")
    owners = spark.createDataFrame([("l@x", "P6"), ("u@x", "P7"), ("m@x", identity.EXCLUDED)], "email string, person_id string")
    out = {r["account_id"]: r for r in identity.assignments(accounts, bindings, owners, roster="hr").collect()}
    for a, c in cases.items():
        assert out[a]["outcome"] == c[6], a
        if c[5] != "new":
            assert out[a]["person_id"] == c[5], a
    assert out["m1"]["person_id"] == out["m2"]["person_id"] != out["b1"]["person_id"] != out["b2"]["person_id"]
    assert (out["h1"]["outcome"], out["h2"]["outcome"]) == ("minted_from_roster", "skipped_closed")
    queue = identity.review_queue(identity.assignments(accounts, bindings, owners, roster="hr"), bindings)
    assert [(r["kind"], r["account_id"]) for r in queue.collect()] == [("binding_conflict", "d1"), ("binding_conflict", "d2"), ("contested", "d3"), ("minted_from_roster", "h1"), ("no_evidence", "a1"), ("no_source_id", "n1"), ("provisioned_at_login", "u1")]


def test_profiles_and_rows(spark):
    inputs = spark.createDataFrame(
        [("g", "i", "a", "email", "Old@x", False, at(1), 1), ("g", "i", "a", "email", " ", False, at(3), 1), ("g", "i", "a", "email", "New@x", False, at(2), 1), ("g", "i", "a", "id", "a", False, at(1), 1), ("g", "i", "b", "id", "b" * 400, False, at(1), 1), ("g", "i", "b", "email", "b@x", True, at(2), 1), ("g", "i", "c", "id", "c", False, at(1), 1)],
        "source_type string, source_id string, account_id string, value_type string, value string, is_delete boolean, synced_at timestamp, version int",
    )
    p = {r["account_id"]: r for r in identity.profiles(inputs).collect()}
    assert (p["a"]["latest_email"], p["a"]["is_closed"], p["a"]["has_id"]) == ("New@x", False, True)
    assert (p["b"]["is_closed"], p["b"]["has_id"]) == (True, False)
    assigned = spark.createDataFrame([("g", "i", x, "P", "minted") for x in "abc"], "source_type string, source_id string, account_id string, person_id string, outcome string")
    out = identity.observation_rows(assigned, inputs)
    ids = sorted((r["value_id"], r["created_at"]) for r in out.where("value_type = 'id'").collect())
    assert ids == [("a", at(1)), ("c", at(1) + dt.timedelta(microseconds=1))]


def test_org_edges(spark):
    status = spark.createDataFrame([("p", at(1), True), ("p", at(2), True), ("p", at(5), False), ("p", at(8), True)], "person_id string, at timestamp, active boolean")
    parents = spark.createDataFrame([("p", at(3), "m"), ("p", at(4), "m"), ("p", at(9), "n")], "person_id string, at timestamp, parent_id string")
    assert rows(identity.org_edges(status, parents), "valid_from") == [("p", None, at(1), at(3)), ("p", "m", at(3), at(5)), ("p", "m", at(8), at(9)), ("p", "n", at(9), None)]


def test_who_an_address_is(spark):
    o = spark.createDataFrame([("email", " A@x ", "P1", at(1)), ("email", "a@X", "P1", at(2)), ("email", "b@x", "P1", at(1)), ("email", "b@x", "P2", at(1)), ("email", "c@x", identity.EXCLUDED, at(1)), ("display_name", "Ann", "P1", at(1)), ("username", "bob", "P2", at(1))], "value_type string, value string, person_id string, created_at timestamp")
    assert rows(identity.email_to_person(o), "email") == [("a@x", "P1")]
    assert dict(rows(identity.labels(o), "person_id"))["P1"] == "Ann" and dict(rows(identity.labels(o), "person_id"))["P2"] == "bob"


# -- functions


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [one(T.file_extension(F.lit(p))) for p in ("a/b.Tar.GZ", ".env", "Makefile", "x/.a.b")] == ["gz", "", "", "b"]
    assert [one(T.file_category(F.lit(p))) for p in ("vendor/x_test.go", "src/a_test.go", "a/tests/b.go", "docs/a.py", "a/b.yaml", "src/a.py", "target/a.py", "x/.VENV/a.py", "Gemfile.lock", "a.d.ts", "x.generated.js", "my.lock")] == ["vendored", "code", "test", "docs", "config", "code", "vendored", "vendored", "vendored", "vendored", "vendored", "config"]
    assert [one(T.issue_kind(F.lit(n))) for n in (" Bug ", "User Story", "chore", None)] == ["bug", "other", "unknown", "unknown"]
    assert [one(T.duration_seconds(F.lit(p))) for p in ("PT1H30M45.5S", "PT2M", "")] == [5445.5, 120.0, 0.0]
    assert [one(T.csv_safe(F.lit(p))) for p in ("=1", " a", "a=1", "@x")] == ["'=1", "' a", "a=1", "'@x"]
    assert one(T.segment_match(F.lit("my-git-hub"), "git_hub")) and not one(T.segment_match(F.lit("legit"), "git"))
    assert one(F.like(F.lit("50%!_x"), F.lit(T.like_escaped("%!_")), F.lit("!")))
    dims = dimensions(dimension("a", F.lit(1)), F.when(F.lit(False), dimension("b", F.lit(2))))
    assert one(value_of(dims, "a")) == "1" and one(label_of(dims, "b")) == "Unknown"


# -- sinks and streams


def test_swap_and_serving(spark, tmp_path):
    df = spark.range(10).select(F.col("id").cast("string").alias("k"), F.expr("date_add(date'2024-01-20', cast(id as int))").alias("d"))
    landing.swap_snapshot(df, "people_copy", "2024-01-02")
    landing.swap_snapshot(df.limit(8), "people_copy", "2024-01-03")
    assert spark.table("people_copy").count() == 8
    for bad, when in ((df, "2024-01-01"), (df.limit(1), "2024-01-04")):
        with pytest.raises(landing.StaleSnapshot):
            landing.swap_snapshot(bad, "people_copy", when)
    assert spark.table("people_copy").count() == 8
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("people_copy_")] == [spark.sql("DESCRIBE TABLE EXTENDED people_copy").where("col_name = 'View Text'").first()["data_type"].split()[-1]]
    spark.sql("DROP VIEW people_copy")
    landing.write_serving(df, str(tmp_path / "s"), "d", ["k"])
    assert landing.read_serving(spark, str(tmp_path / "s"), "d", "2024-01-25").count() == 5
    drilldown.export_csv(df.select(F.lit("=x").alias("k")), str(tmp_path / "csv"), {"k": "Key"})
    assert {r[0] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"'=x"}
    with pytest.raises(ValueError):
        drilldown.export_csv(df, str(tmp_path / "no"), {"k": "Key"}, rows=3)


def test_usage_stream_equals_batch(spark, tmp_path):
    record = lambda **k: {"event_name": None, "path": None, "target": None, "session_id": None, "app_name": None, "app_version": None, "time_triggered": None, "time_sent": None} | k
    beacon = {"tenant_id": "t", "person_id": "p", "arrival": "2024-01-05T00:00:10Z", "meta": record(session_id="s", time_sent=9000), "records": [record(event_name="page_view", path="/a", time_triggered=4000), record(event_name="page_view"), record(event_name="click", target="x" * 900, time_triggered=99000)] + [record(event_name="go")] * 300}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps(beacon) + "\n")
    batch = usage.usage_rows(landing.read_landed(spark, str(tmp_path / "in"), usage.SCHEMA))
    assert batch.count() == 199
    first = batch.where("event_name = 'page_view'").first()
    assert (first["event_time"], first["session_id"], first["path"]) == (dt.datetime(2024, 1, 5, 0, 0, 5), "s", "/a")
    click = batch.where("event_name = 'click'").first()
    assert click["event_time"] == dt.datetime(2024, 1, 5, 0, 0, 10) and len(click["target"]) == 512
    stream = spark.readStream.schema(usage.SCHEMA).json(str(tmp_path / "in"))
    usage.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).drop("ym").collect())) == sorted(map(str, batch.collect()))


def test_session_stream_equals_batch(spark, tmp_path):
    events = [("u", at(1, 0, 0)), ("u", at(1, 0, 5)), ("u", at(1, 0, 10, 1)), ("v", at(1, 3)), ("w", at(20))]
    spark.createDataFrame(events, "u string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u string, ts timestamp").parquet(str(tmp_path / "in"))
    q = usage.sessions(stream, ["u"], "ts", 300).writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    closed = sorted((r["u"], r["session_start"], r["events"]) for r in spark.table("closed").collect())
    assert closed == [("u", at(1, 0, 0), 2), ("u", at(1, 0, 10, 1), 1), ("v", at(1, 3), 1)]


def test_latest_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "k string, version int").write.parquet(str(tmp_path / "in"))
    def run():
        usage.latest_per_key(spark.readStream.schema("k string, version int").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], ["version"]).awaitTermination()
    run()
    spark.createDataFrame([("a", 2), ("b", 5)], "k string, version int").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert rows(spark.read.parquet(str(tmp_path / "out" / "v=1")), "k") == [("a", 3), ("b", 5)]
