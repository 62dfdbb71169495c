"""Pull requests with late sizes, snapshots of issues' fields, sums over nothing and histograms of the silent."""

import datetime as dt

from pyspark.sql import functions as F

from millrace.operators import staging
from millrace.plans import metrics
from millrace.plans.metrics import Metric, Scope

OBSERVATION = "tenant_id string, source_key string, entity_id string, metric_date date, measure_key string, value double, subject_key string, dimensions array<struct<key:string,value:string,label:string>>"


def test_pull_requests(spark):
    key = "tenant_id string, source_id string, repo_full_name string, pr_id int"
    at = lambda k, *x: ("t", "s", "p/r", k, *x)
    requests = spark.createDataFrame([at(1, "OPEN", "2024-01-01T00:00:00Z", 1), at(1, "MERGED", "2024-01-01T00:00:00Z", 3), at(2, "SUPERSEDED", "bad", 1), at(3, "OPEN", None, 1), ("t", "s", None, 4, None, None, 1), at(5, "MERGED", None, 1)], key + ", state string, created_on string, extracted_at int")
    files = spark.createDataFrame([at(1, 5, None, 1), at(1, 7, None, 2), at(3, None, 2, 9)], key + ", lines_added int, lines_removed int, extracted_at int")
    activity = spark.createDataFrame([at(1, "update", "MERGED", "2024-01-03T00:00:00Z", 4), at(1, "update", "OPEN", "2024-01-09T00:00:00Z", 4), at(1, "comment", "MERGED", "2024-01-08T00:00:00Z", 4), at(2, "update", "SUPERSEDED", "2024-01-02T00:00:00Z", 7), at(3, "update", "DECLINED", "2024-01-05T00:00:00Z", 2)], key + ", kind string, update_state string, event_date string, extracted_at int")
    run = lambda since=None: {x["pr_id"]: tuple(x[c] for c in ("project_key", "repo_slug", "state", "created_on", "closed_on", "files_changed", "lines_added", "lines_removed", "extracted_at")) for x in staging.pull_requests(requests, files, activity, since).collect()}
    day = lambda n: dt.datetime(2024, 1, n)
    assert run() == {
        1: ("p", "r", "MERGED", day(1), day(3), 2, 12, 0, 4), 2: ("p", "r", "DECLINED", None, day(2), None, None, None, 7), 3: ("p", "r", "OPEN", None, None, 1, 0, 2, 9), 4: ("", "", "", None, None, None, None, None, 1), 5: ("p", "r", "MERGED", None, None, None, None, None, 1),
    }
    assert set(run(F.lit(4))) == {2, 3}  # a late file or a late close brings its request back


def test_field_snapshot(spark):
    new = '{"status": {"id": "3", "name": "Done"}, "priority": null, "assignee": {"accountId": "a", "displayName": "A, B"}, "reporter": {"displayName": "no id"}, "labels": ["x", null, "y,z"]}'
    rows = [("s", "1", '{"status": {"id": "1", "name": "Open"}}', "P", None, None, 1), ("s", "1", new, "P", "9", dt.date(2024, 5, 1), 2), ("s", "2", "not json", None, "", None, 1), ("s", "3", None, None, None, None, 1)]
    out = staging.field_snapshot(spark.createDataFrame(rows, "source_id string, issue_id string, fields string, project_key string, parent_id string, due_date date, extracted_at int"))
    got = {(x["issue_id"], x["field_id"]): (x["value_ids"], x["value_displays"]) for x in out.collect()}
    assert len(got) == 30 and {k: v for k, v in got.items() if v[0]} == {
        ("1", "status"): (["3"], ["Done"]), ("1", "assignee"): (["a"], ["A, B"]), ("1", "labels"): (["x", "", "y,z"], ["x", "", "y,z"]), ("1", "project"): (["P"], ["P"]), ("1", "parent"): (["9"], ["9"]), ("1", "duedate"): (["2024-05-01"], ["2024-05-01"]),
    }


def test_sums_over_nothing_and_silent_entities(spark):
    day = dt.date(2024, 1, 1)
    o = spark.createDataFrame([("t", "s", "a", day, "m", None, None, []), ("t", "s", "b", day, "m", 2.0, None, []), ("t", "s", "c", day, "n", 4.0, None, []), ("t", "s", "b", day, "n", 4.0, None, [])], OBSERVATION)
    total, ratio = Metric("x.m", "sum", "s", ("m",)), Metric("x.r", "ratio", "s", ("m",), ("n",))
    value = lambda df: {r["entity_id"]: r["value"] for r in df.collect()}
    assert value(metrics.timeseries(o, total, "day", totals=False)) == value(metrics.breakdown(o, total, [])) == {"a": 0.0, "b": 2.0}
    assert value(metrics.timeseries(o, ratio, "day", totals=False)) == {"a": None, "b": 0.5, "c": None}
    assert {r["entity_id"]: r["x_m"] for r in metrics.period(o, [total]).collect()} == {"a": None, "b": 2.0}
    shown = {(r["entity_id"], r["bin"], r["count"]) for r in metrics.histogram(o, total, Scope(entities=("b", "a", "zz", "b"))).collect()}
    assert shown == {("b", 0, 1), ("a", None, 0), ("zz", None, 0)}
