"""Totals of version control by person, over all time and by week, and the focus of days.

The models stand on several tables that share a key, and a person counts if any of them names it. Each table's rows go into
one union, and one aggregation makes all figures: one shuffle, combined before it, and no spine of keys to join to.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .git import COMMIT
from .people import WORKING_HOURS

PERSON = ["tenant_id", "person_key"]


def _total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).alias(column)


def _stacked(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).where("person_key <> ''")


def _flag(condition: Column, name: str) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("long").alias(name)


def person_totals(pulls: DataFrame, commits: DataFrame, changes: DataFrame) -> DataFrame:
    """For each tenant and person: prs_created, prs_merged, avg_pr_cycle_time_h, commits, loc, clean_loc; merges don't count, and only code is clean.

    pulls: PERSON, state_norm, cycle_time_h. commits: PERSON, is_merge_commit, lines_added, lines_removed.
    changes: PERSON, is_merge_commit, file_category, lines_added. The average is null without a cycle time.
    """
    of_pulls = pulls.select(*PERSON, F.lit(1).cast("long").alias("prs_created"), _flag(F.col("state_norm") == "merged", "prs_merged"), "cycle_time_h")
    of_commits = commits.where("not is_merge_commit").select(*PERSON, F.lit(1).cast("long").alias("commits"), (F.col("lines_added") + F.col("lines_removed")).alias("loc"))
    of_changes = changes.where("not is_merge_commit and file_category = 'code'").select(*PERSON, F.col("lines_added").alias("clean_loc"))
    sums = [_total(c) for c in ("prs_created", "prs_merged", "commits", "loc", "clean_loc")]
    return _stacked(of_pulls, of_commits, of_changes).groupBy(*PERSON).agg(*sums[:2], F.avg("cycle_time_h").alias("avg_pr_cycle_time_h"), *sums[2:])


def person_weeks(pulls: DataFrame, commits: DataFrame, changes: DataFrame) -> DataFrame:
    """For each tenant, person and week (its Monday): commits, prs_merged, code_loc, spec_lines, config_loc.

    A merged pull request counts in the week of its merge commit, or where that isn't known in the week in which it was
    closed; one with several rows counts once a week. pulls: PERSON, COMMIT without its hash, unique_key, state_norm,
    closed_on, merge_commit_hash. commits: PERSON, COMMIT, date, is_merge_commit. changes: PERSON, week, is_merge_commit,
    file_category, lines_added.
    """
    monday = lambda c: F.date_trunc("week", c).cast("date")
    merged = pulls.where("state_norm = 'merged' and closed_on is not null and person_key <> ''")
    weeks = commits.select(*COMMIT[:-1], F.col("commit_hash").alias("merge_commit_hash"), monday("date").alias("of_merge"))
    placed = merged.join(weeks, [*COMMIT[:-1], "merge_commit_hash"], "left")
    of_pulls = placed.select(*PERSON, F.coalesce("of_merge", monday("closed_on")).alias("week"), "unique_key").distinct().select(*PERSON, "week", F.lit(1).cast("long").alias("prs_merged"))
    of_commits = commits.where("not is_merge_commit and date is not null").select(*PERSON, monday("date").alias("week"), F.lit(1).cast("long").alias("commits"))
    lines = [F.when(F.col("file_category") == kind, F.col("lines_added")).alias(name) for kind, name in (("code", "code_loc"), ("spec", "spec_lines"), ("config", "config_loc"))]
    of_changes = changes.where("not is_merge_commit and week is not null").select(*PERSON, "week", *lines)
    return _stacked(of_pulls, of_commits, of_changes).groupBy(*PERSON, "week").agg(*[_total(c) for c in ("commits", "prs_merged", "code_loc", "spec_lines", "config_loc")])


def focus_days(meetings: DataFrame, hours: DataFrame) -> DataFrame:
    """For each tenant, person and day: meetings_count, meeting_hours, working_hours_per_day, focus_time_pct, dev_time_h.

    meetings: PERSON, date, meetings_attended, audio_s, video_s, share_s; the longest of the three counts. hours: tenant_id,
    email, working_hours_per_day, a row for each address; else a working day has WORKING_HOURS. The share is null where the
    working day has no hours. Days are summed before hours are joined.
    """
    days = meetings.where("person_key <> '' and date is not null").groupBy("tenant_id", F.col("person_key").alias("email"), F.col("date").alias("day"))
    spent = days.agg(F.sum("meetings_attended").alias("meetings_count"), (F.sum(F.greatest("audio_s", "video_s", "share_s")) / 3600).alias("h"))
    told = hours.select("tenant_id", F.lower("email").alias("email"), "working_hours_per_day")
    work = F.coalesce("working_hours_per_day", F.lit(WORKING_HOURS))
    share = F.when(work != 0, F.greatest(F.lit(0.0), 100 - F.col("h") / work * 100))
    return spent.join(told, ["tenant_id", "email"], "left").select(
        "tenant_id", "email", "day", "meetings_count", F.round("h", 4).alias("meeting_hours"), work.alias("working_hours_per_day"),
        F.round(share, 2).alias("focus_time_pct"), F.round(F.greatest(F.lit(0.0), work - F.col("h")), 4).alias("dev_time_h"),
    )
