"""Staging and activity evidence on rows by hand."""

import datetime as dt
import json

from pyspark.sql import functions as F

from millrace.gold import activity
from millrace.operators import history, staging


def test_meetings(spark):
    m = lambda u, s, e, x=1: ("t", "z", "77", u, s, e, x)
    meetings = spark.createDataFrame([m("a", "2026-01-05T10:00:00Z", "2026-01-05T10:30:00Z"), m("b", "2026-01-05T10:35:00Z", "2026-01-05T11:00:00Z"), m("b", "2026-01-05T20:00:00Z", None, 0), m("c", "2026-01-05T11:05:01Z", "2026-01-05T12:00:00Z"), m("", "2026-01-05T11:05:01Z", None)], "tenant_id string, source_id string, id string, uuid string, start_time string, end_time string, extracted_at int")
    s = staging.stitched_meetings(meetings)
    assert {r["uuid"]: r["logical_meeting_id"] for r in s.collect()} == {"a": "77#1", "b": "77#1", "c": "77#2"}
    p = lambda u, who, j, leave, cam=None, desk=None, x=1: ("t", "z", u, f"p{who}", f"{who}@X", j, leave, cam, desk, None, None, x)
    people = spark.createDataFrame([p("a", "ann", "2026-01-05T10:00:00Z", "2026-01-05T10:10:00Z", "cam"), p("a", "ann", "2026-01-05T10:00:00Z", "2026-01-05T10:10:00Z", "cam", x=2), p("b", "ann", "2026-01-05T10:40:00Z", "2026-01-05T10:41:00Z", "", True), p("q", "ann", "2026-01-05T13:00:00Z", None)], "tenant_id string, source_id string, meeting_uuid string, participant_uuid string, email string, join_time string, leave_time string, camera string, share_desktop boolean, share_application boolean, share_whiteboard boolean, extracted_at int")
    r = staging.meeting_activity(people, s).first()
    assert (r["person_key"], r["meetings_attended"], r["audio_duration_seconds"], r["video_duration_seconds"], r["screen_share_duration_seconds"]) == ("ann@x", 2, 660, 600, 60)


def test_tickets(spark):
    events = json.dumps([{"id": "1", "type": "Comment", "public": True}, {"id": "2", "type": "Comment"}, {"id": "3", "type": "Change", "field_name": "status", "value": "solved"}, {"id": "4", "type": "Change", "field_name": "tags", "value": "x"}, {"id": "5", "type": "Create"}])
    audits = spark.createDataFrame([("k", "t", "z", "9", "7", "u", "2026-01-05T10:00:00Z", events, 1), ("k", "t", "z", "9", "7", "u", "2026-01-05T10:00:00Z", events, 2), ("l", "t", "z", "10", "7", "u", "2026-01-05T11:00:00Z", events, 1), ("m", "t", "z", "11", "8", "u", "2026-01-05T11:00:00Z", None, 1), ("n", "t", "other", "12", "8", "u", "2026-01-05T11:00:00Z", events, 1)], "unique_key string, tenant_id string, source_id string, audit_id string, ticket_id string, author_id string, created_at string, events string, extracted_at int")
    agents = spark.createDataFrame([("t", "z", "u", "ann@x")], "tenant_id string, source_id string, source_agent_id string, person_key string")
    e = staging.ticket_events(audits, agents)
    assert sorted((r["event_id"], r["event_type"], r["is_public"]) for r in e.where("event_id like '9-%'").collect()) == [("9-1", "public_comment", True), ("9-2", "private_comment", False), ("9-3", "solved", None), ("9-4", "update", None)]
    a = staging.support_activity(e).first()
    assert (a["public_replies"], a["internal_notes"], a["tickets_solved"]) == (2, 2, 1)


def test_accounts(spark):
    commits = spark.createDataFrame([("t", "s", "12+Ann@users.noreply.github.com", "2026-01-01T00:00:00Z", "A"), ("t", "s", "Bob@users.noreply.github.com", "2026-01-02T00:00:00Z", "B"), ("t", "s", "cy@users.noreply.github.com", "2026-01-02T00:00:00Z", "C"), ("t", "s", "dan@x", "2026-01-03T00:00:00Z", "D2"), ("t", "s", "Dan@x", "2026-01-02T00:00:00Z", "D1")], "tenant_id string, source_id string, author_email string, authored_date string, author_name string")
    logins = spark.createDataFrame([("t", "s", "bob", "5"), ("t", "s", "BOB", "5"), ("t", "s", "cy", "6"), ("t", "s", "cy", "7")], "tenant_id string, source_id string, login string, account_id string")
    out = staging.account_emails(commits, logins)
    assert sorted((r["account_id"], r["email"]) for r in out.collect()) == [("12", "12+ann@users.noreply.github.com"), ("5", "bob@users.noreply.github.com")]
    assert sorted((r["email"], r["author_name"]) for r in staging.unowned_emails(commits, out).collect()) == [("cy@users.noreply.github.com", "C"), ("dan@x", "D2")]


def test_costs_and_surfaces(spark):
    usage = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", 1, "z")], "email string, day int, model string")
    costs = spark.createDataFrame([("a", 1, 10)], "email string, day int, cost_cents int")
    out = staging.cost_once(usage, costs, ["email", "day"], ["model"], "cost_cents")
    assert {(r["model"], r["cost_cents"]) for r in out.collect()} == {("x", 10), ("y", None), ("z", None)}
    wide = spark.createDataFrame([("a", 3, 0, None)], "email string, chat_messages int, excel_messages int, excel_actions int")
    long = staging.one_row_per_surface(wide, ["email"], {"chat": {"messages": "chat_messages"}, "excel": {"messages": "excel_messages", "actions": "excel_actions"}})
    assert [tuple(r) for r in long.select("surface", "messages", "actions").collect()] == [("chat", 3, None)]


def test_changelogs_and_raw(spark):
    items = json.dumps([{"field": "Labels", "fieldId": "labels", "from": None, "fromString": "", "to": "1", "toString": "One"}, {"field": "Rank"}])
    h = spark.createDataFrame([("i", "c", "2026-01-05T10:00:00.000+0200", "u", items, 1), ("i", "c", "2026-01-05T10:00:00.000+0200", "u", items, 2), ("i", "d", "2026-01-06T10:00:00Z", "u", None, 1)], "issue_id string, changelog_id string, created string, author_id string, items string, extracted_at int")
    out = staging.changelog_items(h).orderBy("event_id").collect()
    assert [(r["event_id"], r["field_id"], r["from_text"], r["to_id"]) for r in out] == [("c:0", "labels", "", "1"), ("c:1", "Rank", None, None)]
    assert out[0]["event_at"] == dt.datetime(2026, 1, 5, 8)
    raw = spark.createDataFrame([('{"a": "x", "b": {"c": 1}, "d": 2}',), (None,)], "raw string").select(staging.raw_fields(F.col("raw"), ["d"]).alias("m")).collect()
    assert [r["m"] for r in raw] == [{"a": "x", "b": '{"c":1}'}, {}]


def test_edits_and_people(spark):
    at = lambda h, m: dt.datetime(2026, 1, 5, h, m)
    v = spark.createDataFrame([("a", "p", at(1, 0), 1), ("a", "p", at(1, 30), 2), ("a", "p", at(2, 1), 3), ("a", "q", at(1, 5), 1)], "who string, page_id string, edited_at timestamp, version int")
    assert [tuple(r)[2:] for r in staging.edit_sessions(v, ["who"]).collect()] == [(3, 2)]
    p = spark.createDataFrame([("a@x", "dn1", None, 1), ("b@x", "dn2", "dn1", 1), ("c@x", "dn3", "gone", 1)], "email string, distinguished_name string, manager_dn string, version int")
    assert {tuple(r) for r in staging.manager_edges(p).collect()} == {("a@x", None), ("b@x", "a@x"), ("c@x", None)}
    log = spark.createDataFrame([("u", at(1, 0), "a@x", "Ann"), ("u", at(2, 0), "", "Ann")], "k string, at timestamp, mail string, name string")
    inputs = staging.identity_inputs(history.fields_history(log, ["k"], "at", ["mail", "name"]), "k", {"mail": "email"}, F.lit(None).cast("boolean"))
    assert sorted((r["value_type"], r["value"], r["is_delete"]) for r in inputs.collect()) == [("email", "", True), ("email", "a@x", False), ("id", "u", False), ("id", "u", False)]
    s = spark.createDataFrame([("a", dt.date(2026, 1, 3), 5, 10, 1), ("a", dt.date(2026, 1, 9), 15, 10, 1), ("b", dt.date(2026, 1, 9), 15, None, 1)], "k string, snapshot_date date, used_cents int, limit_cents int, version int")
    assert {(r["k"], r["over_cents"]) for r in staging.over_limit(s, ["k"]).collect()} == {("a", 5), ("b", None)}


def got(df):
    return {(r["measure_key"], r["entity_id"], tuple(d["value"] for d in r["dimensions"])): r["contribution"] for r in df.collect()}


def test_ai(spark):
    day = dt.date(2026, 1, 5)
    dev = spark.createDataFrame([("t", "A@x", day, "cursor", None, 5, 1, 9, 3, 50, None, None, None), ("t", "a@x", day, "cursor", None, 2, None, None, None, None, 1, 1, 2), ("t", "", day, "cursor", None, 2, None, None, None, None, 1, 1, 2)], "tenant_id string, email string, day date, tool string, seat_status string, lines_added int, lines_removed int, tool_use_offered int, tool_use_accepted int, cost_cents int, conversation_count int, prs_with_cc_count int, prs_total_count int")
    chat = spark.createDataFrame([("t", "a@x", day, "claude", "chat", 1, 4, 0, 150)], "tenant_id string, email string, day date, tool string, surface string, conversation_count int, message_count int, action_count int, cost_cents int")
    e = activity.ai_evidence(dev, chat)
    out = got(e)
    assert out[("accepted_lines", "a@x", ("cursor", "unknown"))] == 7 and out[("cost_usd", "a@x", ("claude",))] == 1.5 and out[("assistant_messages", "a@x", ("claude", "chat"))] == 4
    assert out[("active_day", "a@x", ())] == 1 and out[("assistant_actions", "a@x", ("claude", "chat"))] == 0
    assert e.groupBy("measure_key", "entity_id", "metric_date", "record_id").count().where("count > 1").count() == 0


def test_collab_and_wiki(spark):
    day = dt.date(2026, 1, 5)
    base = "tenant_id string, person_key string, date date, tool string"
    chat = spark.createDataFrame([("t", "a@x", day, "slack", 5, 2, None, 3), ("t", "none", day, "slack", 5, 2, 1, 3)], f"{base}, total_chat_messages int, channel_posts int, channel_replies int, direct_and_group_messages int")
    mail = spark.createDataFrame([("t", "b@x", day, "m365", 0, 9, 9)], f"{base}, sent_count int, received_count int, read_count int")
    docs = spark.createDataFrame([("t", "a@x", day, "m365", 1, 2, 3)], f"{base}, viewed_or_edited_count int, shared_internally_count int, shared_externally_count int")
    meet = spark.createDataFrame([("t", "a@x", day, "zoom", 1, None, None, None, 3600, 60, None), ("t", "c@x", day, "zoom", 1, None, None, None, None, None, None)], f"{base}, meetings_attended int, meetings_organized int, adhoc_meetings_attended int, scheduled_meetings_attended int, audio_duration_seconds int, video_duration_seconds int, screen_share_duration_seconds int")
    focus = spark.createDataFrame([("t", "a@x", day, "x", 6.0, 8.0)], f"{base}, dev_time_h double, working_hours_per_day double")
    out = got(activity.collab_evidence(chat, mail, docs, meet, focus))
    assert out[("channel_posts", "a@x", ("slack",))] == 2 and out[("files_shared", "a@x", ("external",))] == 3 and out[("meeting_hours", "a@x", ("zoom",))] == 1
    assert out[("meeting_free_day", "a@x", ())] == 0 and out[("meeting_free_day", "c@x", ())] == 1 and ("meeting_free_day", "b@x", ()) not in out
    assert {k[2] for k in out if k[0] == "active_day" and k[1] == "a@x"} == {("slack",), ("m365",), ("zoom",)}
    pages = spark.createDataFrame([("t", "s", "p", "", "A@x", dt.datetime(2026, 1, 5, 3))], "tenant_id string, source_id string, page_id string, title string, author_email string, created_at timestamp")
    acts = spark.createDataFrame([("t", "b@x", day, 4, 2)], "tenant_id string, author_email string, day date, total_edits int, pages_edited int")
    talk = spark.createDataFrame([("t", "s", "p", day, 3), ("t", "s", "lost", day, 9)], "tenant_id string, source_id string, page_id string, day date, total_comments int")
    out = got(activity.wiki_evidence(pages, acts, talk))
    assert out == {("edits", "b@x", ()): 4, ("pages_edited", "b@x", ()): 2, ("comments", "a@x", ()): 3, ("pages_created", "a@x", ()): 1}
