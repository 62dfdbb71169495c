"""The built-in metrics.

A line is: key | source | measure, or numerator / denominator * scale | dimensions | transform. Sums need no mark, medians and
distinct counts have theirs.
"""

from __future__ import annotations

from .metrics import Metric, Transform

#: The metrics that are served, in the order in which they are listed.
TABLE = """
ai.accepted_lines | ai_usage | accepted_lines | tool
ai.removed_lines | ai_usage | removed_lines | tool
ai.active_days | ai_usage | active_day
ai.cost | ai_usage | cost_usd | tool
ai.seat_cost | ai_cost | seat_cost_usd | tool, seat_tier
ai.extra_usage_cost | ai_cost | extra_usage_usd | tool, seat_tier
ai.daily_approximate_extra_usage_cost | ai_cost | daily_extra_usage_usd | tool, seat_tier
ai.extra_usage_utilisation | ai_cost | extra_usage_usd / extra_usage_limit_usd * 100 | tool, seat_tier
ai.accepted_edit_actions | ai_usage | accepted_edit_actions | tool
ai.tool_acceptance_rate | ai_usage | accepted_edit_actions / tool_use_offered * 100 | tool
ai.assistant_messages | ai_usage | assistant_messages | tool, surface
ai.assistant_actions | ai_usage | assistant_actions | tool, surface
ai.dev_conversations | ai_usage | dev_conversations | tool
ai.chat_assistant_conversations | ai_usage | chat_assistant_conversations | tool, surface
ai.prs_with_assistant | ai_usage | prs_with_assistant | tool, seat_status
ai.prs_total | ai_usage | prs_total | tool, seat_status
git.commits | git | commit_count | project, repository, source
git.code_lines | git | code_lines_added | change_type, file_extension, project, repository, source
git.lines_added | git | lines_added | category, change_type, file_extension, project, repository, source
git.lines_removed | git | lines_removed | category, change_type, file_extension, project, repository, source
git.prs_created | git | pr_created | destination_branch, project, repository, source
git.prs_merged | git | pr_merged | destination_branch, project, repository, source
git.merge_rate | git | pr_created_merged / pr_created * 100 | destination_branch, project, repository, source
git.commits_per_active_day | git | commit_count / commit_day * 1
git.commit_size | git | median commit_change_size | project, repository, source
git.pr_size | git | median pr_change_size | destination_branch, project, repository, source
git.pr_cycle_time_h | git | median pr_cycle_hours | destination_branch, project, repository, source
collab.messages_sent | collab | total_chat_messages | tool
collab.channel_posts | collab | channel_posts | tool
collab.dm_ratio | collab | direct_and_group_messages / total_chat_messages * 100 | tool
collab.msgs_per_active_day | collab | total_chat_messages / chat_active_day * 1 | tool
collab.active_days | collab | distinct active_day | tool
collab.emails_sent | collab | emails_sent | tool
collab.emails_received | collab | emails_received | tool
collab.emails_read | collab | emails_read | tool
collab.files_engaged | collab | files_engaged | tool
collab.files_shared_internal | collab | files_shared_internal | tool
collab.files_shared_external | collab | files_shared_external | tool
collab.files_shared | collab | files_shared | scope
collab.meeting_hours | collab | meeting_hours | tool
collab.meetings_count | collab | meetings_attended | tool
collab.meeting_free_days | collab | meeting_free_day
collab.focus_time_pct | collab | focus_hours / working_hours * 100
collab.breadth | collab | distinct active_modality
collab.meetings_organized | collab | meetings_organized | tool
collab.adhoc_meetings | collab | adhoc_meetings_attended | tool
collab.scheduled_meetings | collab | scheduled_meetings_attended | tool
tasks.closed | task | tasks_closed | type, source
tasks.bugs_fixed | task | bugs_fixed
tasks.closed_non_bug | task | closed_non_bug
tasks.dev_time | task | median dev_time_hours | type, source
tasks.resolution_time | task | median resolution_days | type, source
tasks.pickup_time | task | median pickup_days | type, source
tasks.flow_efficiency | task | flow_dev_seconds / flow_lead_seconds * 100 | | at most 100
tasks.reopen_rate | task | reopened_within_14d / close_events * 100
tasks.due_date_compliance | task | due_date_on_time / due_date_with_due * 100
tasks.on_time_delivery | task | due_date_on_time / tasks_closed * 100
tasks.avg_slip | task | slip_days_total / late_count * 1
tasks.estimation_accuracy | task | estimation_error_pct / estimation_samples * 1 | | 100 less it, from 0 to 100
tasks.worklog_accuracy | task | worklog_seconds / in_progress_seconds * 100 | | at most 100
tasks.bugs_ratio | task | bugs_fixed / tasks_closed * 100
tasks.stale_in_progress | task | stale_in_progress
wiki.pages_created | wiki | pages_created
wiki.edits | wiki | edits
wiki.pages_edited | wiki | pages_edited
wiki.comments | wiki | comments
"""

TRANSFORMS = {"at most 100": Transform(high=100.0), "100 less it, from 0 to 100": Transform(-1.0, 100.0, 0.0, 100.0)}


def _metric(line: str) -> Metric:
    key, source, formula, *rest = (p.strip() for p in line.split("|"))
    dimensions = tuple(d.strip() for d in rest[0].split(",") if d.strip()) if rest else ()
    transform = TRANSFORMS[rest[1]] if len(rest) > 1 else None
    if "/" in formula:
        ratio, scale = formula.split("*")
        over, under = (m.strip() for m in ratio.split("/"))
        return Metric(key, "ratio", source, (over,), (under,), float(scale), transform, dimensions, "org_unit")
    kind, _, measure = formula.rpartition(" ")
    return Metric(key, kind or "sum", source, (measure,), (), 1.0, transform, dimensions, "org_unit")


METRICS: dict[str, Metric] = {m.key: m for m in map(_metric, TABLE.strip().splitlines())}
