"""Gold models on rows by hand, with the values that the reference expects of such rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.gold import git, observations, people, resolved, tasks, totals
from millrace.plans import metrics
from millrace.plans.metrics import Metric
from millrace.plans.registry import METRICS


def at(month, day, hour=0):
    return dt.datetime(2026, month, day, hour)


def by_measure(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["measure_key"], []).append((r["entity_id"], r["metric_date"].month, r["contribution"]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def repository(spark):
    c = lambda h, when, added, removed, email="a@x", merge=False: ("t", "s", "p", "r", h, "github", email, when, merge, added, removed)
    commits = spark.createDataFrame([c("c1", at(1, 5), 100, 0), c("c2", at(2, 5), 100, 0), c("c3", at(2, 6), 8, 3), c("c4", at(2, 7), None, None), c("m", at(2, 8), 9, 9, merge=True), c("c1", at(1, 5), 100, 0), c("c5", at(2, 9), 5, 0, " B@x ")], "tenant_id string, source_id string, project_key string, repo_slug string, commit_hash string, data_source string, author_email string, date timestamp, is_merge_commit boolean, lines_added long, lines_removed long")
    f = lambda h, path, pre, post, added, removed: ("t", "s", "p", "r", h, "github", path, path.rsplit(".", 1)[-1], "Modified", pre, post, added, removed)
    changes = spark.createDataFrame([f("c1", "src/a.py", "0", "1", 100, 0), f("c2", "src/a.py", "0", "1", 100, 0), f("c3", "src/b.py", None, None, 8, 3), f("c5", "src/b.py", "", None, 5, 0)], "tenant_id string, source_id string, project_key string, repo_slug string, commit_hash string, data_source string, file_path string, file_extension string, change_type string, pre_image_oid string, post_image_oid string, lines_added long, lines_removed long")
    p = lambda i, email, state, made, closed: ("t", "s", "p", "r", i, i, "github", email, state, "main", made, closed, 3, 4)
    pulls = spark.createDataFrame([p(1, "A@x", "MERGED", at(1, 5), at(1, 6)), p(2, "", "MERGED", at(2, 5), at(2, 4)), p(3, "", "OPEN", at(2, 5), None)], "tenant_id string, source_id string, project_key string, repo_slug string, pr_id int, pr_number int, data_source string, author_email string, state string, destination_branch string, created_on timestamp, closed_on timestamp, lines_added long, lines_removed long")
    links = spark.createDataFrame([("t", "s", "p", "r", i, h) for i, h in ((2, "c5"), (3, "c3"), (3, "c5"))], "tenant_id string, source_id string, project_key string, repo_slug string, pr_id int, commit_hash string")
    return commits, changes, pulls, links


def test_content_counts_once(repository):
    got = by_measure(git.git_evidence(*repository))
    assert got["commit_count"] == [("a@x", 1, 1.0), ("a@x", 2, 1.0), ("a@x", 2, 1.0), ("a@x", 2, 1.0), ("b@x", 2, 1.0)]
    assert got["lines_added"] == [("a@x", 1, 100.0), ("a@x", 2, 8.0), ("b@x", 2, 5.0)]
    assert got["lines_removed"] == [("a@x", 1, 0.0), ("a@x", 2, 3.0), ("b@x", 2, 0.0)]
    assert got["commit_lines_added"] == [("a@x", 1, 100.0), ("a@x", 2, 0.0), ("a@x", 2, 8.0), ("b@x", 2, 5.0)]
    assert got["commit_change_size"] == [("a@x", 1, 100.0), ("a@x", 2, 11.0), ("b@x", 2, 5.0)]


def test_pull_requests(repository):
    got = by_measure(git.git_evidence(*repository))
    assert got["pr_created"] == [("a@x", 1, 1.0), ("b@x", 2, 1.0)]  # the third's commits have two authors
    assert got["pr_merged"] == [("a@x", 1, 1.0), ("b@x", 2, 1.0)]
    assert got["pr_cycle_hours"] == [("a@x", 1, 24.0)]


def test_evidence_is_unique(repository):
    e = git.git_evidence(*repository)
    assert e.groupBy("tenant_id", "source_key", "measure_key", "entity_id", "metric_date", "record_id").count().where("count > 1").count() == 0


def now():
    return F.lit(at(4, 1)).cast("timestamp")


@pytest.fixture(scope="module")
def tracker(spark):
    """Five people with one issue each: open, in progress on day r after creation, closed later. The fifth is opened again."""
    rows = []
    for r in range(1, 6):
        def ev(field, when, value, display=None, kind="changelog", r=r):
            rows.append(("j", "jira", field, f"i{r}", f"K-{r}", f"T{r}", when, kind, "set", [value], [display or value], int(when.timestamp())))
        made = at(3, 1)
        ev("created", made, "", kind="synthetic_initial")
        ev("status", made, "1", "Open", "synthetic_initial")
        ev("assignee", made, f"u{r}", kind="synthetic_initial")
        ev("type", made, "b" if r % 2 else "s", "Bug" if r % 2 else "Story", "synthetic_initial")
        ev("due", made, "2026-03-09", kind="synthetic_initial")
        ev("est", made, "2", kind="synthetic_initial")
        ev("spent", made, "4", kind="synthetic_initial")
        ev("status", at(3, 1 + r), "2", "Doing")
        ev("status", at(3, 5 + r), "3", "Done")
    rows.append(("j", "jira", "status", "i5", "K-5", "T5", at(3, 12), "changelog", "set", ["2"], ["Doing"], 9))
    rows.append(("j", "jira", "status", "i5", "K-5", "T5", at(3, 14), "changelog", "set", ["3"], ["Done"], 10))
    history = spark.createDataFrame(rows, "source_instance_id string, data_source string, field_id string, issue_id string, id_readable string, title string, event_at timestamp, event_kind string, delta_action string, value_ids array<string>, value_displays array<string>, version long")
    names = {"status": "status", "assignee": "assignee", "type": "issuetype", "due": "duedate", "est": "estimate", "spent": "spent", "other": "ignored"}
    defaults = spark.createDataFrame([("j", "jira", f, role, "points" if f == "spent" else "hours", 3600.0) for f, role in names.items()], "source_instance_id string, data_source string, field_id string, role string, value_unit string, unit_multiplier double")
    authored = spark.createDataFrame([("j", "jira", "spent", "spent", "hours", 3600.0, at(1, 1), at(1, 2)), ("j", "jira", "spent", "ignored", "hours", 3600.0, at(1, 1), at(1, 1)), ("j", "jira", "est", "ignored", "hours", 1.0, at(9, 1), at(1, 1))], "source_instance_id string, data_source string, field_id string, role string, value_unit string, unit_multiplier double, valid_from timestamp, recorded_at timestamp")
    roles = tasks.field_roles(authored, defaults, now())
    users = spark.createDataFrame([("t", "j", f"u{r}", f"P{r}@x") for r in range(1, 6)] + [("t", "j", "bot", "none")], "tenant_id string, source_instance_id string, user_id string, email string")
    statuses = spark.createDataFrame([("j", "1", "todo"), ("j", "2", "in_progress"), ("j", "3", "done")], "source_instance_id string, status_id string, status_category string")
    types = spark.createDataFrame([("j", "b", "Fehler", "Bug", "bug"), ("j", "s", "Story", None, "other")], "source_instance_id string, issue_type_id string, issue_type_name string, untranslated_name string, issue_kind string")
    state = tasks.issue_state(history, roles, users, statuses, types)
    spans = tasks.status_spans(history, roles, state, statuses, now())
    worklogs = spark.createDataFrame([("j", "u1", dt.date(2026, 3, 2), 3600), ("j", "u1", dt.date(2026, 3, 30), 60), ("j", "u1", None, 60)], "source_instance_id string, author_id string, work_date date, duration_seconds int")
    flow = tasks.worklog_flow(spans, state, worklogs, users)
    return roles, state, spans, flow


def test_roles(tracker):
    assert {(r["field_id"], r["value_unit"]) for r in tracker[0].where("role in ('spent', 'estimate')").collect()} == {("spent", "hours"), ("est", "hours")}
    assert tracker[0].where("field_id = 'other'").count() == 0


def test_pickup_time_of_peers(tracker, spark):
    _, state, spans, flow = tracker
    e = tasks.task_evidence(state, spans, flow, now())
    o = observations(e, events=tasks.EVENTS)
    pickup = Metric("tasks.pickup_time", "median", "task", ("pickup_days",))
    out = {r["entity_id"]: r for r in metrics.tenant_peers(o, pickup).collect()}
    p5 = out["p5@x"]
    assert (p5["value"], p5["p25"], p5["median"], p5["p75"], p5["min"], p5["max"], p5["n"]) == (5.0, 2.0, 3.0, 4.0, 1.0, 5.0, 5)


def test_task_measures(tracker):
    _, state, spans, flow = tracker
    got = by_measure(tasks.task_evidence(state, spans, flow, now()))
    assert [x[0] for x in got["tasks_closed"]] == [f"p{r}@x" for r in range(1, 6)]
    assert [x[0] for x in got["bugs_fixed"]] == ["p1@x", "p3@x", "p5@x"] and [x[0] for x in got["closed_non_bug"]] == ["p2@x", "p4@x"]
    assert [x[0] for x in got["due_date_on_time"]] == ["p1@x", "p2@x", "p3@x", "p4@x"] and got["slip_days_total"] == [("p5@x", 3, 5.0)]
    assert got["dev_time_hours"][0] == ("p1@x", 3, 96.0) and got["dev_time_hours"][4] == ("p5@x", 3, 96.0 + 48.0)
    assert got["estimation_error_pct"][0] == ("p1@x", 3, 50.0)
    assert sum(x[2] for x in got["close_events"]) == 6 and got["reopened_within_14d"] == [("p5@x", 3, 1.0)]
    assert ("p1@x", 3, 3600.0) in got["worklog_seconds"] and sum(x[2] for x in got["worklog_seconds"]) == 3600.0
    assert "stale_in_progress" not in got


def test_days_without_progress_stay_in_the_flow(tracker):
    flow = {(r["entity_id"], r["metric_date"].day): (r["in_progress_seconds"], r["worklog_seconds"]) for r in tracker[3].collect()}
    assert flow[("p1@x", 2)] == (86400.0, 3600.0) and flow[("p1@x", 30)] == (0.0, 60.0)


def test_extra_usage(spark):
    r = lambda day, cents: ("t", "s", "a", "p@x", "tool", dt.date(2026, 1, 1), dt.date(2026, 1, day), at(1, day), cents)
    readings = spark.createDataFrame([r(3, 400), r(4, 400), r(5, 1000), r(6, 900)], "tenant_id string, source_id string, account_id string, entity_id string, tool string, period_month date, metric_date date, observed_at timestamp, used_cents int")
    got = [x["contribution"] for x in people.extra_usage(readings).orderBy("metric_date").collect()]
    assert got == [4.0, 0.0, 5.0, 0.0]  # a day read without spending is 0, a correction is taken out of the past


def test_seat_prices(spark):
    prices = spark.createDataFrame([("t", "m1", "a", 12.0), ("t", "m1", "b", 12.0), ("t", "m2", "a", 12.0), ("t", "m2", "b", 25.0), ("t", "m2", "c", 1.0), ("t", "m2", "c", 2.0)], "tenant_id string, period_month string, tier string, price double")
    seats = spark.createDataFrame([("t", "m1", "z"), ("t", "m2", "b"), ("t", "m2", "c"), ("t", "m3", "a")], "tenant_id string, period_month string, tier string")
    assert [(r["period_month"], r["tier"], r["price"]) for r in people.seat_prices(seats, prices).orderBy("period_month", "tier").collect()] == [("m1", "z", 12.0), ("m2", "b", 25.0), ("m2", "c", None), ("m3", "a", None)]


def test_cohorts_coverage_focus(spark):
    who = spark.createDataFrame([("a@x", "P1"), ("b@x", "P1"), ("c@x", "P2")], "email string, person_id string")
    staff = spark.createDataFrame([("t", "A@x ", "old", 1), ("t", "a@x", "d1", 2), ("t", "b@x", "d1", 1), ("t", "c@x", "d1", 1), ("t", "c@x", None, 2)], "tenant_id string, email string, department string, version int")
    assert [tuple(r) for r in people.cohorts(staff, who).collect()] == [("P1", "d1")]
    e = spark.createDataFrame([("git", "a@x"), ("git", "nobody@x"), ("git", "Nobody@x ")], "source_key string, entity_id string")
    assert [tuple(r) for r in people.coverage(e, who).collect()] == [("git", 3, 2, 1, 33.3)]
    assert resolved(e, who).count() == 1
    days = spark.createDataFrame([(2.0, None), (None, 4.0), (9.0, 8.0), (1.0, 0.0)], "meeting_hours double, working_hours double")
    assert [r["focus_pct"] for r in people.focus(days).collect()] == [75.0, 100.0, 0.0, None]


def test_totals_of_persons_that_one_table_names(spark):
    pulls = spark.createDataFrame([("t", "a", "s", "p", "r", "1", "merged", at(1, 14), "h1", None), ("t", "a", "s", "p", "r", "1", "merged", at(1, 14), "h1", None), ("t", "", "s", "p", "r", "2", "merged", at(1, 14), None, 1.0)],
        "tenant_id string, person_key string, source_id string, project_key string, repo_slug string, unique_key string, state_norm string, closed_on timestamp, merge_commit_hash string, cycle_time_h double")
    commits = spark.createDataFrame([("t", "b", "s", "p", "r", "h1", at(1, 5), True, 5, 1), ("t", "b", "s", "p", "r", "h2", at(1, 11), False, 3, 1)],
        "tenant_id string, person_key string, source_id string, project_key string, repo_slug string, commit_hash string, date timestamp, is_merge_commit boolean, lines_added int, lines_removed int")
    changes = spark.createDataFrame([("t", "c", dt.date(2026, 1, 5), False, "vendored", 9), ("t", "b", dt.date(2026, 1, 5), False, "code", None)], "tenant_id string, person_key string, week date, is_merge_commit boolean, file_category string, lines_added int")
    assert sorted(tuple(r)[1:] for r in totals.person_totals(pulls, commits, changes).collect()) == [("a", 2, 2, None, 0, 0, 0), ("b", 0, 0, None, 1, 4, 0)]
    weeks = {(r["person_key"], r["week"].day): tuple(r)[3:] for r in totals.person_weeks(pulls, commits, changes).collect()}
    assert weeks == {("a", 5): (0, 1, 0, 0, 0), ("b", 5): (1, 0, 0, 0, 0), ("c", 5): (0, 0, 0, 0, 0)}


def test_registry_over_gold(tracker, repository):
    """Every metric of tasks and of version control has a value for someone; a ratio's is within its bounds."""
    assert len(METRICS) == 66
    _, state, spans, flow = tracker
    o = observations(tasks.task_evidence(state, spans, flow, now()), events=tasks.EVENTS)
    of_tasks = [m for m in METRICS.values() if m.source_key == "task" and m.key != "tasks.stale_in_progress"]
    rows = metrics.period(o, of_tasks).collect()
    for m in of_tasks:
        assert any(r[m.column] is not None for r in rows), m.key
    assert all(r["tasks_flow_efficiency"] <= 100 and r["tasks_estimation_accuracy"] == 50.0 for r in rows)
    g = observations(git.git_evidence(*repository), events=["commit_change_size", "pr_change_size", "pr_cycle_hours"], most=["commit_day"])
    of_git = [m for m in METRICS.values() if m.source_key == "git"]
    rows = metrics.period(g, of_git).collect()
    for m in of_git:
        assert any(r[m.column] is not None for r in rows), m.key
