"""From bronze to class tables: what connectors have in common, as functions over their rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import latest_by_key, unanimous


def parse_time(text: Column) -> Column:
    """A time in any of the forms that vendors write; null for what is none."""
    return F.coalesce(text.try_cast("timestamp"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSZ")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssZ")), F.try_to_timestamp(text, F.lit("MM/dd/yyyy HH:mm:ss")))


def stitched_meetings(meetings: DataFrame, gap_seconds: int = 300) -> DataFrame:
    """tenant_id, source_id, uuid, logical_meeting_id: sessions of one meeting that begin within the gap after the last one's end are one."""
    m = latest_by_key(meetings.where("id is not null and coalesce(uuid, '') <> ''"), ["tenant_id", "source_id", "uuid"], ["extracted_at"])
    m = m.withColumn("s", parse_time(F.col("start_time"))).withColumn("e", parse_time(F.col("end_time"))).where("s is not null")
    w = Window.partitionBy("tenant_id", "source_id", "id").orderBy("s", "uuid")
    gap = F.unix_seconds("s") - F.unix_seconds(F.lag("e").over(w))
    m = m.withColumn("opens", F.when(gap.isNull() | (gap > gap_seconds), 1).otherwise(0))
    number = F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return m.select("tenant_id", "source_id", "uuid", F.concat(F.col("id").cast("string"), F.lit("#"), number).alias("logical_meeting_id"))


def meeting_activity(participants: DataFrame, sessions: DataFrame) -> DataFrame:
    """tenant_id, source_id, person_key, date, meetings_attended and seconds of audio, video and sharing for each person and day.

    Someone who drops out and comes back has attended one meeting; a row that came in twice counts once.
    """
    p = participants.withColumn("j", parse_time(F.col("join_time"))).withColumn("l", parse_time(F.col("leave_time"))).where("j is not null and coalesce(email, '') <> ''")
    p = latest_by_key(p, ["tenant_id", "source_id", "meeting_uuid", "participant_uuid", "join_time"], ["extracted_at"])
    p = p.join(sessions.withColumnRenamed("uuid", "meeting_uuid"), ["tenant_id", "source_id", "meeting_uuid"], "left")
    seconds = F.coalesce(F.unix_seconds("l") - F.unix_seconds("j"), F.lit(0))
    shared = F.coalesce("share_desktop", F.lit(False)) | F.coalesce("share_application", F.lit(False)) | F.coalesce("share_whiteboard", F.lit(False))
    return p.groupBy("tenant_id", "source_id", F.lower("email").alias("person_key"), F.to_date("j").alias("date")).agg(
        F.count_distinct(F.coalesce("logical_meeting_id", "meeting_uuid")).alias("meetings_attended"), F.sum(seconds).alias("audio_duration_seconds"),
        F.sum(F.when(F.coalesce("camera", F.lit("")) != "", seconds).otherwise(0)).alias("video_duration_seconds"), F.sum(F.when(shared, seconds).otherwise(0)).alias("screen_share_duration_seconds"),
    )


def direct_messages(total: Column, channel: Column) -> Column:
    """Messages that went to no channel; counts that disagree give none."""
    return F.greatest(total - F.coalesce(channel, F.lit(0)), F.lit(0))


def ticket_events(audits: DataFrame, agents: DataFrame) -> DataFrame:
    """One row for each comment or change of a ticket by an agent: event_id, ticket_id, person_key, event_type, is_public, occurred_at, metric_date."""
    a = latest_by_key(audits, ["unique_key"], ["extracted_at"]).select("tenant_id", "source_id", "audit_id", "ticket_id", "author_id", "created_at", F.explode(F.from_json(F.coalesce("events", F.lit("[]")), "array<struct<id:string,type:string,public:boolean,field_name:string,value:string>>")).alias("e"))
    e = a.where("e.type in ('Comment', 'Change')").join(agents.where("person_key <> ''").select("tenant_id", "source_id", F.col("source_agent_id").alias("author_id"), "person_key"), ["tenant_id", "source_id", "author_id"])
    comment, public = F.col("e.type") == "Comment", F.coalesce("e.public", F.lit(False))
    kind = F.when(comment & public, "public_comment").when(comment, "private_comment").when((F.col("e.field_name") == "status") & (F.col("e.value") == "solved"), "solved").otherwise("update")
    at = parse_time(F.col("created_at"))
    return e.select("tenant_id", "source_id", F.concat_ws("-", "audit_id", "e.id").alias("event_id"), "ticket_id", "person_key", kind.alias("event_type"), F.when(comment, public).alias("is_public"), at.alias("occurred_at"), F.to_date(at).alias("metric_date"))


def support_activity(events: DataFrame) -> DataFrame:
    """Replies, updates and distinct solved tickets for each person and day."""
    return events.groupBy("tenant_id", "source_id", "person_key", "metric_date").agg(F.count_if(F.col("event_type") == "public_comment").alias("public_replies"), F.count_if(F.col("event_type") == "private_comment").alias("internal_notes"), F.count_distinct(F.when(F.col("event_type") == "solved", F.col("ticket_id"))).alias("tickets_solved"))


def noreply_id(email: Column) -> Column:
    """The account id in a forge's own address; empty where it has none."""
    return F.regexp_extract(F.lower(F.trim(email)), r"^([0-9]+)\+[^@]+@users\.noreply\.github\.com$", 1)


def noreply_login(email: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(email)), r"^(?:[0-9]+\+)?([^@+]+)@users\.noreply\.github\.com$", 1)


def account_emails(commits: DataFrame, logins: DataFrame) -> DataFrame:
    """tenant_id, source_id, account_id, email, seen_at: whose a forge's own address is, by its id, else by a login that has had one id.

    commits: author_email, authored_date. logins: login, account_id.
    """
    instance = ["tenant_id", "source_id"]
    known = unanimous(logins.where("coalesce(login, '') <> ''").withColumn("login", F.lower(F.trim("login"))), [*instance, "login"], "account_id")
    c = commits.where("lower(trim(author_email)) like '%@users.noreply.github.com'").select(*instance, F.lower(F.trim("author_email")).alias("email"), parse_time(F.col("authored_date").cast("string")).alias("at"))
    c = c.withColumn("own", F.nullif(noreply_id(F.col("email")), F.lit(""))).withColumn("login", noreply_login(F.col("email"))).join(known, [*instance, "login"], "left")
    out = c.withColumn("account_id", F.coalesce("own", F.col("account_id").cast("string"))).where("account_id is not null")
    return out.groupBy(*instance, "account_id", "email").agg(F.max("at").alias("seen_at"))


def unowned_emails(commits: DataFrame, owned: DataFrame) -> DataFrame:
    """Addresses of commits that belong to no account, with the name that the latest commit gives."""
    c = commits.where("coalesce(trim(author_email), '') <> ''").withColumn("email", F.lower(F.trim("author_email")))
    return c.join(owned.select("tenant_id", "email").distinct(), ["tenant_id", "email"], "left_anti").groupBy("tenant_id", "email").agg(F.max_by("author_name", F.struct("authored_date", "author_name")).alias("author_name"))


def cost_once(usage: DataFrame, costs: DataFrame, keys: Sequence[str], order: Sequence[str], cost: str) -> DataFrame:
    """usage with the cost of its keys on the first row of each key and null on the others, so that sums over rows are right."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return usage.withColumn("__n", F.row_number().over(w)).join(costs, list(keys), "left").withColumn(cost, F.when(F.col("__n") == 1, F.col(cost))).drop("__n")


def one_row_per_surface(wide: DataFrame, ids: Sequence[str], surfaces: dict[str, dict[str, str]]) -> DataFrame:
    """ids, surface and its counts: surfaces gives the wide column of each count. Surfaces without any activity have no row."""
    names = sorted({n for columns in surfaces.values() for n in columns})
    count = lambda columns, n: (F.col(columns[n]) if n in columns else F.lit(None)).cast("long").alias(n)
    entries = F.array(*[F.struct(F.lit(s).alias("surface"), *[count(columns, n) for n in names]) for s, columns in surfaces.items()])
    some = lambda e: sum((F.coalesce(e[n], F.lit(0)) for n in names), F.lit(0)) > 0
    return wide.select(*ids, F.inline(F.filter(entries, some)))


def changelog_items(histories: DataFrame) -> DataFrame:
    """One row for each item of a changelog's JSON: issue_id, changelog_id, event_at, author_id, field_id, from_id, from_text, to_id, to_text.

    Histories that came in more than once count once; an item without a field id goes by its name.
    """
    h = latest_by_key(histories, ["issue_id", "changelog_id"], ["extracted_at"])
    item = "array<struct<field:string,fieldId:string,`from`:string,fromString:string,`to`:string,toString:string>>"
    i = h.select("issue_id", "changelog_id", parse_time(F.col("created")).alias("event_at"), "author_id", F.posexplode(F.from_json(F.coalesce("items", F.lit("[]")), item)).alias("n", "i"))
    return i.select("issue_id", "changelog_id", F.concat_ws(":", "changelog_id", F.col("n").cast("string")).alias("event_id"), "event_at", "author_id", F.coalesce("i.fieldId", "i.field").alias("field_id"), F.col("i.from").alias("from_id"), F.col("i.fromString").alias("from_text"), F.col("i.to").alias("to_id"), F.col("i.toString").alias("to_text"))


def edit_sessions(versions: DataFrame, keys: Sequence[str], gap_seconds: int = 1800) -> DataFrame:
    """keys, day, total_edits, pages_edited: edits of a page by one author within the gap are one, on the day of the first."""
    from .sequences import sessionize

    s = sessionize(versions, [*keys, "page_id"], "edited_at", "version", gap_seconds).groupBy(*keys, "page_id", "session").agg(F.min("edited_at").alias("at"))
    return s.groupBy(*keys, F.to_date("at").alias("day")).agg(F.count("*").alias("total_edits"), F.count_distinct("page_id").alias("pages_edited"))


def raw_fields(raw: Column, but: Sequence[str] = ()) -> Column:
    """A JSON object as a map of texts without some keys; nested values stay JSON."""
    return F.map_filter(F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, _v: ~k.isin(list(but)) if but else F.lit(True))


def identity_inputs(history: DataFrame, account: str, fields: dict[str, str], deactivated: Column) -> DataFrame:
    """account, value_type, value, is_delete, synced_at for each change of a field that tells who someone is, and the account's own id.

    history: from fields_history, with `field`, `new_value` and `at`. fields: the type of value of each field.
    """
    named = F.create_map(*[F.lit(x) for kv in fields.items() for x in kv])
    h = history.withColumn("value_type", F.try_element_at(named, F.col("field"))).withColumn("off", F.coalesce(deactivated, F.lit(False)))
    values = h.where("value_type is not null").select(account, "value_type", F.col("new_value").alias("value"), (F.col("off") | (F.col("new_value") == "")).alias("is_delete"), F.col("at").alias("synced_at"))
    own = h.groupBy(account, "at").agg(F.max("off").alias("is_delete")).select(account, F.lit("id").alias("value_type"), F.col(account).cast("string").alias("value"), "is_delete", F.col("at").alias("synced_at"))
    return values.unionByName(own)


def manager_edges(people: DataFrame) -> DataFrame:
    """person, manager by address: the manager's distinguished name is looked up among the people; who has none, or an unknown one, has a null."""
    by_name = people.where("distinguished_name is not null").groupBy(F.col("distinguished_name").alias("manager_dn")).agg(F.max_by("email", "version").alias("manager_email"))
    return people.join(by_name, "manager_dn", "left").select("email", "manager_email")


#: Kinds of a change in what is known of who someone's manager is.
UPSERT, DELETE = "UPSERT", "DELETE"


def manager_inputs(history: DataFrame, users: DataFrame, since: Column | None = None, unresolved: bool = True) -> DataFrame:
    """Changes of managers' addresses and ids: tenant_id, source_id, account_id, value_type, value, field, operation, synced_at.

    history (tenant_id, source_id, entity_id, field_name, new_value, updated_at): changes of managerDn, mail and
    userPrincipalName. users: tenant_id, source_id, id, mail, upn, dn, manager_dn, as they are now. A new manager gives address
    and id of the one with that name; an empty one takes both back. A new address of someone goes to all that report to
    them, and takes theirs back if none is left. A new manager whom nobody knows, or who has no address, takes back what the one
    before gave (without `unresolved` it stays, until something else changes). With `since`, only changes after it are taken up: reports of people without
    a change come in no join.
    """
    own = ["tenant_id", "source_id"]
    if since is not None:
        history = history.where(F.col("updated_at") > since)
    manager = users.select(*own, F.col("dn").alias("new_value"), F.coalesce("mail", "upn").alias("address"), F.col("id").alias("manager_id")).where("new_value is not null")
    moved = history.where("field_name = 'managerDn'").select(*own, F.col("entity_id").alias("account_id"), "new_value", "updated_at")
    named = moved.where("new_value <> ''").join(manager, [*own, "new_value"], "left")
    changed = history.where("field_name in ('mail', 'userPrincipalName')").select(*own, F.col("entity_id").alias("id"), "updated_at").distinct()
    bosses = changed.join(users.select(*own, "id", "dn", F.coalesce("mail", "upn").alias("address")), [*own, "id"]).drop("id")
    reports = bosses.join(users.select(*own, F.col("id").alias("account_id"), F.col("manager_dn").alias("dn")), [*own, "dn"]).select(*own, "account_id", "updated_at", "address").distinct()

    def rows(df: DataFrame, kind: str, value: Column, field: str, operation: str) -> DataFrame:
        return df.select(*own, "account_id", F.lit(kind).alias("value_type"), value.alias("value"), F.lit(field).alias("field"), F.lit(operation).alias("operation"), F.col("updated_at").alias("synced_at"))

    none, gone = F.lit(""), moved.where("new_value = ''")
    parts = [
        rows(named.where("address <> ''"), "parent_email", F.col("address"), "managerDn", UPSERT), rows(named.where("manager_id <> ''"), "parent_id", F.col("manager_id"), "managerDn", UPSERT),
        rows(gone, "parent_email", none, "managerDn", DELETE), rows(gone, "parent_id", none, "managerDn", DELETE),
        rows(reports.where("address <> ''"), "parent_email", F.col("address"), "mail", UPSERT), rows(reports.where("coalesce(address, '') = ''"), "parent_email", none, "mail", DELETE),
    ]
    if unresolved:
        parts += [rows(named.where("coalesce(address, '') = ''"), "parent_email", none, "managerDn", DELETE), rows(named.where("coalesce(manager_id, '') = ''"), "parent_id", none, "managerDn", DELETE)]
    return reduce(DataFrame.unionByName, parts)


def current_managers(inputs: DataFrame) -> DataFrame:
    """tenant_id, source_id, account_id, value_type, value: the last change of each, unless it took the value back."""
    keys = ["tenant_id", "source_id", "account_id", "value_type"]
    return latest_by_key(inputs, keys, ["synced_at", "operation", "value"]).where(F.col("operation") == UPSERT).select(*keys, "value")


def resynced(rows: DataFrame, windows: DataFrame, instance: Sequence[str], keys: Sequence[str], day: str, version: str, origin: str, windows_origin: str = "resync") -> DataFrame:
    """The rows that stand after windows of days have been fetched again, whole.

    windows: instance, day_from, day_to, version. A window takes the place of all that was known of its days before: rows of
    one of its days with an earlier version are gone, come back or not. Of what is left, each key's last version stands;
    of equal versions the one fetched again. The same window twice, with the same rows, changes nothing.
    """
    days = windows.select(*instance, F.explode(F.sequence("day_from", "day_to")).alias(day), F.col("version").alias("__v")).groupBy(*instance, day).agg(F.max("__v").alias("__v"))
    left = rows.join(days, [*instance, day], "left").where(F.col("__v").isNull() | (F.col(version) >= F.col("__v"))).drop("__v")
    again = left.withColumn("__again", (F.col(origin) == windows_origin).cast("int"))
    return latest_by_key(again, [*instance, *keys], [version, "__again"]).select(*rows.columns)


def over_limit(snapshots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last snapshot of each key and month, with what was used over the limit; a key without a limit has none over it."""
    last = latest_by_key(snapshots.withColumn("period_month", F.trunc("snapshot_date", "month")), [*keys, "period_month"], ["snapshot_date", "version"])
    return last.withColumn("over_cents", F.when(F.col("limit_cents").isNotNull(), F.greatest(F.col("used_cents") - F.col("limit_cents"), F.lit(0))))


#: The states in which a pull request is over, and the fields of an issue's snapshot that are objects with an id and a name.
OVER = ("MERGED", "DECLINED", "SUPERSEDED")
SNAPSHOT_FIELDS = {"status": ("id", "name"), "priority": ("id", "name"), "issuetype": ("id", "name"), "resolution": ("id", "name"), "assignee": ("accountId", "displayName"), "reporter": ("accountId", "displayName")}


def pull_requests(requests: DataFrame, files: DataFrame, activity: DataFrame, since: Column | None = None) -> DataFrame:
    """requests with project_key, repo_slug, closed_on, files_changed, lines_added, lines_removed and the time of their last news.

    files (a row for each changed file) and activity come as streams of their own: where none of a request's files has
    come, its sizes are null and not 0; a request has no time of its closing but that of the last update to a state in which
    it is over. One that was superseded counts as declined. `since`: only requests with news of any of the three after it.
    """
    keys = ["tenant_id", "source_id", "repo_full_name", "pr_id"]
    sizes = files.groupBy(*keys).agg(F.count("*").alias("files_changed"), F.sum("lines_added").alias("lines_added"), F.sum("lines_removed").alias("lines_removed"), F.max("extracted_at").alias("__files"))
    over = activity.where((F.col("kind") == "update") & F.col("update_state").isin(list(OVER))).groupBy(*keys).agg(F.max("event_date").alias("__closed"), F.max("extracted_at").alias("__over"))
    news = F.greatest("extracted_at", F.coalesce("__files", "extracted_at"), F.coalesce("__over", "extracted_at"))
    out = latest_by_key(requests, keys, ["extracted_at"]).join(sizes, keys, "left").join(over, keys, "left").withColumn("extracted_at", news)
    if since is not None:
        out = out.where(F.col("extracted_at") > since)
    parts, sized = F.split(F.coalesce("repo_full_name", F.lit("")), "/"), F.col("__files").isNotNull()
    return out.select(
        *keys, parts[0].alias("project_key"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("repo_slug"), F.when(F.col("state") == "SUPERSEDED", "DECLINED").otherwise(F.coalesce("state", F.lit(""))).alias("state"),
        parse_time(F.col("created_on")).alias("created_on"), F.when(F.col("state").isin(list(OVER)), parse_time(F.col("__closed"))).alias("closed_on"), "files_changed",
        *[F.when(sized, F.coalesce(c, F.lit(0))).alias(c) for c in ("lines_added", "lines_removed")], "extracted_at",
    )


def field_snapshot(issues: DataFrame) -> DataFrame:
    """source_id, issue_id, field_id, value_ids, value_displays: what an issue's fields are in its latest row, a row for each field, empty ones too.

    issues: source_id, issue_id, fields (JSON), project_key, parent_id, due_date, extracted_at. JSON is taken apart in the
    latest row of each issue alone, in one pass.
    """
    i = latest_by_key(issues, ["source_id", "issue_id"], ["extracted_at"])
    text = lambda *path: F.coalesce(F.get_json_object("fields", "$." + ".".join(path)), F.lit(""))
    row = lambda field, ids, shown: F.struct(F.lit(field).alias("field_id"), ids.alias("value_ids"), shown.alias("value_displays"))
    one = lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", F.array(b)).otherwise(F.array().cast("array<string>"))
    rows = [row(f, one(text(f, k), text(f, k)), one(text(f, k), text(f, v))) for f, (k, v) in SNAPSHOT_FIELDS.items()]
    for field, column in (("project", "project_key"), ("parent", "parent_id"), ("duedate", "due_date")):
        value = F.col(column).cast("string")
        rows.append(row(field, one(value, value), one(value, value)))
    labels = F.transform(F.coalesce(F.from_json(F.get_json_object("fields", "$.labels"), "array<string>"), F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")))
    return i.select("source_id", "issue_id", F.inline(F.array(*rows, row("labels", labels, labels))))
