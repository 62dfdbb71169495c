"""Evidence of issue tracking: roles of fields, states of issues, status spans, work days, and the measures taken of them.

What depends on the present takes it as `as_of`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dimensions import UNKNOWN, dimension, dimensions
from ..functions.text import issue_kind
from ..operators.history import bitemporal_latest
from ..operators.sequences import by_day
from . import evidence, measure

ISSUE = ["source_instance_id", "issue_id"]
FIELD = ["source_instance_id", "data_source", "field_id"]
#: Units that are time; days after which work counts as stale and within which a close counts as reopened; the largest estimate in percent that is one.
TIME_UNITS, STALE_DAYS, REOPEN_DAYS, LARGEST_ESTIMATE = ["seconds", "minutes", "hours", "days", "man_days"], 14, 14, 200


def field_roles(authored: DataFrame, defaults: DataFrame, as_of: Column) -> DataFrame:
    """FIELD, role, value_unit, unit_multiplier: what an operator decided last for now, else the vendor's default; ignored fields go."""
    own = bitemporal_latest(authored, FIELD, ["role", "value_unit", "unit_multiplier"], "valid_from", "recorded_at", as_of)
    vendor = defaults.join(own.select(*FIELD), FIELD, "left_anti").select(*FIELD, "role", "value_unit", "unit_multiplier")
    return own.unionByName(vendor).where("role <> 'ignored'")


def issue_state(history: DataFrame, roles: DataFrame, users: DataFrame, statuses: DataFrame, types: DataFrame) -> DataFrame:
    """One row for each issue whose assignee has an address: its last values by role, when it was made and last closed.

    history: FIELD, issue_id, id_readable, title, event_at, event_kind, delta_action, value_ids, value_displays, version.
    """
    scale = F.when(F.col("value_unit").isin(TIME_UNITS), F.coalesce("unit_multiplier", F.lit(1.0)))
    h = history.join(roles, FIELD, "left").where("role is not null or event_kind = 'synthetic_initial'").withColumn("scale", scale).withColumn("first_id", F.get("value_ids", F.lit(0))).withColumn("first_text", F.get("value_displays", F.lit(0)))
    h = h.join(statuses.select("source_instance_id", F.col("status_id").alias("first_id"), F.col("status_category").alias("category")), ["source_instance_id", "first_id"], "left")
    order = F.struct("event_at", "version")

    def last(role: str, value: str) -> Column:
        return F.max_by(value, F.when((F.col("role") == role) & (F.col("delta_action") == "set"), order))

    status = (F.col("role") == "status") & (F.col("delta_action") == "set")
    p = h.groupBy(*ISSUE).agg(
        last("status", "first_id").alias("status_id"), last("assignee", "first_id").alias("user_id"), last("issuetype", "first_text").alias("issue_type"), last("issuetype", "first_id").alias("issue_type_id"),
        F.to_date(last("duedate", "first_text").try_cast("timestamp")).alias("due_date"), (last("estimate", "first_text").try_cast("double") * last("estimate", "scale")).alias("time_estimate_seconds"),
        (last("spent", "first_text").try_cast("double") * last("spent", "scale")).alias("time_spent_seconds"), F.min(F.when(F.col("event_kind") == "synthetic_initial", F.col("event_at"))).alias("created_at"),
        F.max_by("id_readable", order).alias("id_readable"), F.max_by("title", order).alias("title"), F.max(F.when(status, F.col("event_at"))).alias("last_status_event_at"),
        F.max(F.when(status & (F.col("category") == "done"), F.col("event_at"))).alias("final_close_at"), F.min("data_source").alias("data_source"),
    )
    people = users.where("email like '%@%'").select("tenant_id", "source_instance_id", "user_id", F.lower("email").alias("entity_id"))
    out = p.join(people, ["source_instance_id", "user_id"]).join(statuses.select("source_instance_id", "status_id", "status_category"), ["source_instance_id", "status_id"], "left")
    kinds = types.select("source_instance_id", "issue_type_id", "issue_type_name", "untranslated_name", issue_kind(F.coalesce("untranslated_name", "issue_type_name")).alias("issue_kind"))
    out = out.join(kinds, ["source_instance_id", "issue_type_id"], "left").withColumn("issue_kind", F.coalesce("issue_kind", F.lit("unknown")))
    named = F.nullif("issue_type", F.lit(""))
    return out.withColumn("issue_type_key", F.coalesce("untranslated_name", "issue_type_name", named)).withColumn("issue_type_name", F.coalesce("issue_type_name", named))


def status_spans(history: DataFrame, roles: DataFrame, state: DataFrame, statuses: DataFrame, as_of: Column) -> DataFrame:
    """ISSUE, interval_start, interval_end, status_category, duration_seconds. The last span ends with the final close of a done issue, else now."""
    status = roles.where("role = 'status'").select(*FIELD)
    e = history.join(status, FIELD, "left_semi").where("delta_action = 'set'").select(*ISSUE, "event_at", F.get("value_ids", F.lit(0)).alias("status_id"))
    own = state.select(*ISSUE, F.col("created_at"), F.col("status_category").alias("now_category"), "final_close_at")
    w = Window.partitionBy(*ISSUE).orderBy("event_at", "status_id")
    last = F.when(F.col("now_category") == "done", F.coalesce("final_close_at", "event_at")).otherwise(as_of)
    s = e.withColumn("next_at", F.lead("event_at").over(w)).join(own, ISSUE).withColumn("interval_end", F.coalesce("next_at", last)).withColumnRenamed("event_at", "interval_start")
    s = s.join(statuses.select("source_instance_id", "status_id", "status_category"), ["source_instance_id", "status_id"], "left")
    sane = (F.col("interval_end") >= F.col("interval_start")) & (F.col("interval_end") <= as_of + F.expr("INTERVAL 1 DAY")) & (F.col("created_at").isNull() | (F.col("interval_start") >= F.col("created_at")))
    return s.where(sane).select(*ISSUE, "interval_start", "interval_end", "status_category", (F.unix_seconds("interval_end") - F.unix_seconds("interval_start")).cast("double").alias("duration_seconds"))


def worklog_flow(spans: DataFrame, state: DataFrame, worklogs: DataFrame, users: DataFrame) -> DataFrame:
    """tenant_id, entity_id, metric_date, in_progress_seconds, worklog_seconds: what was in progress each day beside what was logged."""
    who = ["tenant_id", "entity_id", "metric_date"]
    p = by_day(spans.where("status_category = 'in_progress'").join(state.select(*ISSUE, "tenant_id", "entity_id"), ISSUE), "interval_start", "interval_end")
    p = p.groupBy("tenant_id", "entity_id", F.col("day").alias("metric_date")).agg(F.sum("seconds").alias("in_progress_seconds"))
    people = users.where("email like '%@%'").select("tenant_id", "source_instance_id", F.col("user_id").alias("author_id"), F.lower("email").alias("entity_id"))
    w = worklogs.where("work_date is not null").join(people, ["source_instance_id", "author_id"]).groupBy("tenant_id", "entity_id", F.to_date("work_date").alias("metric_date")).agg(F.sum(F.coalesce("duration_seconds", F.lit(0))).cast("double").alias("worklog_seconds"))
    return p.join(w, who, "full_outer").fillna(0.0, ["in_progress_seconds", "worklog_seconds"])


def issue_facts(state: DataFrame, spans: DataFrame) -> DataFrame:
    """Closed issues with seconds in progress before the close, from creation to the close, and from creation to the first progress."""
    work = spans.where("status_category = 'in_progress'").select(*ISSUE, "interval_start", "duration_seconds")
    before = F.col("interval_start") < F.col("final_close_at")
    facts = state.where("final_close_at is not null").select(*ISSUE, "final_close_at").join(work, ISSUE, "left").groupBy(*ISSUE).agg(F.sum(F.when(before, F.col("duration_seconds"))).alias("dev_seconds"), F.min(F.when(before, F.col("interval_start"))).alias("started_at"))
    out = state.where("final_close_at is not null").join(facts, ISSUE, "left")
    since = lambda c: F.greatest(F.lit(0.0), (F.unix_seconds(c) - F.unix_seconds("created_at")).cast("double"))
    lead = F.when(F.col("created_at").isNotNull(), since("final_close_at"))
    pickup = F.when(F.col("created_at").isNotNull() & F.col("started_at").isNotNull(), since("started_at"))
    return out.withColumn("lead_seconds", lead).withColumn("pickup_seconds", pickup).withColumn("observed_at", F.col("final_close_at")).withColumn("metric_date", F.to_date("final_close_at"))


def closes(spans: DataFrame) -> DataFrame:
    """ISSUE, close_at, reopened: each passage into done, and whether it was left again within REOPEN_DAYS."""
    t = spans.select(*ISSUE, F.col("interval_start").alias("at"), F.coalesce("status_category", F.lit("")).alias("now")).withColumn("was", F.lag("now").over(Window.partitionBy(*ISSUE).orderBy("at")))
    ahead = Window.partitionBy(*ISSUE).orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    t = t.withColumn("left_at", F.when((F.col("was") == "done") & (F.col("now") != "done"), F.col("at"))).withColumn("reopened_at", F.min("left_at").over(ahead))
    soon = F.coalesce(F.col("reopened_at") <= F.col("at") + F.expr(f"INTERVAL {REOPEN_DAYS} DAY"), F.lit(False))
    return t.where("now = 'done' and (was is null or was <> 'done')").select(*ISSUE, F.col("at").alias("close_at"), soon.alias("reopened"))


def task_evidence(state: DataFrame, spans: DataFrame, flow: DataFrame, as_of: Column) -> DataFrame:
    facts = issue_facts(state, spans)
    typed = dimensions(dimension("type", F.coalesce("issue_type_key", F.lit(UNKNOWN)), F.coalesce("issue_type_name", F.lit("Type unknown"))), dimension("source", F.col("data_source")))
    rid, label = F.concat_ws(":", *ISSUE), F.col("id_readable")
    late = F.col("metric_date") > F.col("due_date")
    one = F.lit(1)
    items = evidence(
        facts.where("status_category = 'done'"), "task",
        [
            measure("tasks_closed", one), measure("bugs_fixed", one, F.col("issue_kind") == "bug"), measure("closed_non_bug", one, F.col("issue_kind") == "other"), measure("due_date_on_time", one, ~late), measure("due_date_with_due", one, F.col("due_date").isNotNull()),
            measure("slip_days_total", F.datediff("metric_date", "due_date"), late), measure("late_count", one, late),
        ], rid, label, typed,
    )
    spent = evidence(facts, "task", [measure("dev_time_hours", F.col("dev_seconds") / 3600, F.col("dev_seconds") > 0), measure("resolution_days", F.col("lead_seconds") / 86400, F.col("lead_seconds") > 0), measure("pickup_days", F.col("pickup_seconds") / 86400)], rid, label, typed)
    day = ["tenant_id", "entity_id", "metric_date"]
    stamp = lambda df: df.withColumn("observed_at", F.lit(None).cast("timestamp"))
    fit = (F.col("status_category") == "done") & (F.coalesce("time_estimate_seconds", F.lit(0.0)) > 0) & F.col("time_spent_seconds").isNotNull()
    both = (F.col("dev_seconds") > 0) & (F.col("lead_seconds") > 0)
    by = facts.groupBy(*day).agg(
        (100 * F.avg(F.when(fit, F.col("time_estimate_seconds"))) / F.nullif(F.avg(F.when(fit, F.col("time_spent_seconds"))), F.lit(0.0))).alias("pct"), F.sum(F.when(both, F.col("dev_seconds"))).alias("dev"), F.sum(F.when(both, F.col("lead_seconds"))).alias("lead")
    )
    sure = (F.col("pct") > 0) & (F.col("pct") <= LARGEST_ESTIMATE)
    the_day, none = F.col("metric_date").cast("string"), F.col("metric_date")
    daily = evidence(stamp(by), "task", [measure("estimation_error_pct", F.abs(100 - F.col("pct")), sure), measure("estimation_samples", one, sure), measure("flow_dev_seconds", F.col("dev")), measure("flow_lead_seconds", F.col("lead"))], the_day, none)
    c = closes(spans).join(state.select(*ISSUE, "tenant_id", "entity_id"), ISSUE).groupBy("tenant_id", "entity_id", F.to_date("close_at").alias("metric_date")).agg(F.count("*").alias("n"), F.count_if("reopened").alias("again"))
    reopened = evidence(stamp(c), "task", [measure("close_events", F.col("n")), measure("reopened_within_14d", F.col("again"), F.col("again") > 0)], the_day, none)
    logged = evidence(stamp(flow.where("in_progress_seconds > 0")), "task", [measure("worklog_seconds", F.col("worklog_seconds")), measure("in_progress_seconds", F.col("in_progress_seconds"))], the_day, none)
    stale = state.where("status_category is null or status_category <> 'done'").where(F.datediff(F.to_date(as_of), F.to_date("last_status_event_at")) > STALE_DAYS).groupBy("tenant_id", "entity_id", F.to_date("last_status_event_at").alias("metric_date")).agg(F.count("*").alias("n"))
    old = evidence(stamp(stale), "task", [measure("stale_in_progress", F.col("n"))], the_day, none)
    return items.unionByName(spent).unionByName(daily).unionByName(reopened).unionByName(logged).unionByName(old)


#: Measures that medians are taken of.
EVENTS = ["dev_time_hours", "resolution_days", "pickup_days"]
