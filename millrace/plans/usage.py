"""Product usage: totals, by day, by person, by page and by action. A visit is a distinct session that isn't empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP = 200


def _counts():
    return F.count("*").alias("events"), F.count_distinct(F.nullif("session_id", F.lit(""))).alias("visits")


def totals(events: DataFrame) -> DataFrame:
    return events.agg(*_counts(), F.count_distinct("person_id").alias("people"))


def by_day(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("event_time").alias("day")).agg(*_counts(), F.count_distinct("person_id").alias("people"))


def by_person(events: DataFrame, names: DataFrame | None = None) -> DataFrame:
    out = events.groupBy("person_id").agg(*_counts(), F.max("event_time").alias("last_seen"))
    return out if names is None else out.join(names, "person_id", "left")


def by_page(events: DataFrame, top: int = TOP) -> DataFrame:
    """The pages with most views; ties by path."""
    return events.where("event_name = 'page_view'").groupBy("path").agg(F.count("*").alias("views"), F.count_distinct("person_id").alias("people")).orderBy(F.desc("views"), "path").limit(top)


def by_action(events: DataFrame, top: int = TOP) -> DataFrame:
    return events.where("event_name <> 'page_view'").groupBy("event_name").agg(F.count("*").alias("actions"), F.count_distinct("person_id").alias("people")).orderBy(F.desc("actions"), "event_name").limit(top)
