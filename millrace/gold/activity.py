"""Evidence of AI-assistant use, collaboration and wikis: counts of class tables by person, day and tool."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dimensions import dimension, dimensions
from ..functions.text import lookup
from . import evidence, measure

#: Names of tools and surfaces; a value without a name is its own.
TOOLS = {"cursor": "Cursor", "claude_code": "Claude Code", "claude": "Claude", "codex": "Codex", "chatgpt": "ChatGPT", "m365": "Microsoft 365", "slack": "Slack", "zoom": "Zoom", "zulip": "Zulip"}
SURFACES = {"chat": "Chat", "excel": "Excel", "powerpoint": "PowerPoint", "word": "Word", "cowork": "Cowork"}


def _tool() -> Column:
    return dimension("tool", F.col("tool"), lookup(F.col("tool"), TOOLS))


def _days(df: DataFrame, value: str = "email", day: str = "day") -> DataFrame:
    """Rows of a person and a day, with the columns that evidence needs."""
    return df.where(F.coalesce(F.trim(value), F.lit("")) != "").withColumn("entity_id", F.lower(value)).withColumn("metric_date", F.to_date(day)).withColumn("observed_at", F.lit(None).cast("timestamp"))


def summed(rows: DataFrame, source_key: str, sums: dict[str, Column], dims: Column | None = None) -> DataFrame:
    """Evidence of sums by person, day and dimensions: what no row tells has no evidence, and 0 is told."""
    keyed = rows.withColumn("__d", F.array().cast("array<struct<key:string,value:string,label:string>>") if dims is None else dims)
    total = keyed.groupBy("tenant_id", "entity_id", "metric_date", "observed_at", "__d").agg(*[F.sum(v).cast("double").alias(k) for k, v in sums.items()])
    rid = F.concat_ws(":", F.col("metric_date").cast("string"), F.md5(F.to_json("__d")))
    return evidence(total, source_key, [measure(k, F.col(k)) for k in sums], rid, F.col("metric_date"), F.col("__d"))


def _merge(parts: list[DataFrame]) -> DataFrame:
    """Evidence of one measure, person, day and dimensions from several tables as one row."""
    out = reduce(lambda a, b: a.unionByName(b), parts)
    keys = [c for c in out.columns if c != "contribution"]
    return out.groupBy(*keys).agg(F.sum("contribution").alias("contribution")).select(*out.columns)


def ai_evidence(dev: DataFrame, assistant: DataFrame) -> DataFrame:
    """dev and assistant: tenant_id, email, day, tool, counts; dev with seat_status, assistant with surface."""
    d, a = _days(dev), _days(assistant)
    seat = dimensions(_tool(), dimension("seat_status", F.coalesce("seat_status", F.lit("unknown"))))
    surface = dimensions(_tool(), dimension("surface", F.col("surface"), lookup(F.col("surface"), SURFACES)))
    of_dev = {"accepted_lines": "lines_added", "removed_lines": "lines_removed", "accepted_edit_actions": "tool_use_accepted", "tool_use_offered": "tool_use_offered", "dev_conversations": "conversation_count", "prs_with_assistant": "prs_with_cc_count", "prs_total": "prs_total_count"}
    of_chat = {"assistant_messages": "message_count", "assistant_actions": "action_count", "chat_assistant_conversations": "conversation_count"}
    who = ["tenant_id", "entity_id", "metric_date", "observed_at"]
    present = d.select(*who).unionByName(a.select(*who)).distinct()
    active = evidence(present, "ai_usage", [measure("active_day", F.lit(1))], F.col("metric_date").cast("string"), F.col("metric_date"))
    return _merge([
        summed(d, "ai_usage", {k: F.col(c) for k, c in of_dev.items()} | {"cost_usd": F.col("cost_cents") / 100}, seat), summed(a, "ai_usage", {"cost_usd": F.col("cost_cents") / 100}, dimensions(_tool())),
        summed(a, "ai_usage", {k: F.col(c) for k, c in of_chat.items()}, surface), active,
    ])


def deliberate_activity(chat: DataFrame, email: DataFrame, documents: DataFrame, meetings: DataFrame) -> DataFrame:
    """tenant_id, entity_id, metric_date, tool, modality: days on which a person did something, by what was done."""
    did = {
        "chat": chat.where("total_chat_messages > 0"), "email": email.where("sent_count > 0"), "meetings": meetings.where("meetings_attended > 0"),
        "documents": documents.where("viewed_or_edited_count > 0 or shared_internally_count > 0 or shared_externally_count > 0"),
    }
    return reduce(lambda a, b: a.unionByName(b), [df.select("tenant_id", "entity_id", "metric_date", "tool", F.lit(k).alias("modality")) for k, df in did.items()]).distinct()


def collab_evidence(chat: DataFrame, email: DataFrame, documents: DataFrame, meetings: DataFrame, focus: DataFrame) -> DataFrame:
    """Class tables with tenant_id, person_key, date, tool and counts; focus with dev_time_h and working_hours_per_day."""
    c, e, d, m, f = (_days(x.where("person_key like '%@%' and date is not null"), "person_key", "date") for x in (chat, email, documents, meetings, focus))
    tool = dimensions(_tool())
    scope = lambda v: dimensions(dimension("scope", F.lit(v), F.lit(v.capitalize())))
    seconds = ["audio_duration_seconds", "video_duration_seconds", "screen_share_duration_seconds"]
    zero = lambda x: F.coalesce(x, F.lit(0))
    parts = [
        summed(c, "collab", {"total_chat_messages": F.col("total_chat_messages"), "channel_posts": F.col("channel_posts") + zero("channel_replies"), "direct_and_group_messages": F.col("direct_and_group_messages"), "chat_active_day": F.when(F.col("total_chat_messages") > 0, 1)}, tool),
        summed(e, "collab", {"emails_sent": F.col("sent_count"), "emails_received": F.col("received_count"), "emails_read": F.col("read_count")}, tool),
        summed(d, "collab", {"files_engaged": F.col("viewed_or_edited_count"), "files_shared_internal": F.col("shared_internally_count"), "files_shared_external": F.col("shared_externally_count")}, tool),
        summed(d, "collab", {"files_shared": F.col("shared_internally_count")}, scope("internal")), summed(d, "collab", {"files_shared": F.col("shared_externally_count")}, scope("external")),
        summed(m, "collab", {"meeting_hours": F.greatest(*[zero(s) for s in seconds]) / 3600, "meetings_attended": F.col("meetings_attended"), "meetings_organized": F.col("meetings_organized"), "adhoc_meetings_attended": F.col("adhoc_meetings_attended"), "scheduled_meetings_attended": F.col("scheduled_meetings_attended")}, tool),
        summed(f, "collab", {"focus_hours": F.col("dev_time_h"), "working_hours": F.col("working_hours_per_day")}),
    ]
    who = ["tenant_id", "entity_id", "metric_date"]
    active = deliberate_activity(c, e, d, m).withColumn("observed_at", F.lit(None).cast("timestamp"))
    met = m.groupBy(*who).agg(F.sum(reduce(lambda a, b: a + b, [zero(s) for s in seconds])).alias("met"))
    free = active.select(*who, "observed_at").distinct().join(met, who, "left")
    day = F.col("metric_date").cast("string")
    parts.append(evidence(free, "collab", [measure("meeting_free_day", F.when(zero("met") == 0, 1).otherwise(0))], day, F.col("metric_date")))
    tools, ways = active.select(*who, "observed_at", "tool").distinct(), active.select(*who, "observed_at", "modality").distinct()
    parts.append(evidence(tools, "collab", [measure("active_day", F.lit(1), subject=F.col("metric_date"))], F.concat_ws(":", day, "tool"), F.col("metric_date"), tool))
    parts.append(evidence(ways, "collab", [measure("active_modality", F.lit(1), subject=F.col("modality"))], F.concat_ws(":", day, "modality"), F.col("metric_date")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def wiki_evidence(pages: DataFrame, activity: DataFrame, engagement: DataFrame) -> DataFrame:
    """Edits and pages edited by the editor's day, comments by the page's author, pages by who made them."""
    own = pages.where("author_email like '%@%'").withColumn("entity_id", F.lower("author_email"))
    a = _days(activity.where("author_email like '%@%' and day is not null"), "author_email")
    e = engagement.where("day is not null").join(own.select("tenant_id", "source_id", "page_id", "author_email"), ["tenant_id", "source_id", "page_id"])
    made = own.where("created_at is not null and page_id is not null").withColumn("metric_date", F.to_date("created_at")).withColumn("observed_at", F.col("created_at"))
    title = F.coalesce(F.nullif("title", F.lit("")), "page_id")
    return (
        summed(a, "wiki", {"edits": F.col("total_edits"), "pages_edited": F.col("pages_edited")})
        .unionByName(summed(_days(e, "author_email"), "wiki", {"comments": F.col("total_comments")}))
        .unionByName(evidence(made, "wiki", [measure("pages_created", F.lit(1))], F.concat_ws(":", "source_id", "page_id"), title))
    )
