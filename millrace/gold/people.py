"""Cohorts, coverage of identity, focus, and seats' costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dimensions import dimension, dimensions
from ..operators.dedup import unanimous
from ..operators.sequences import cumulative_steps
from . import evidence, measure

#: Hours of a working day where none are told.
WORKING_HOURS = 8.0


def cohorts(people: DataFrame, email_to_person: DataFrame) -> DataFrame:
    """entity_id, cohort_id: the department of the latest staff row of each address, for persons with one department.

    people: tenant_id, email, department, version.
    """
    p = people.where("coalesce(trim(email), '') <> ''").withColumn("email", F.lower(F.trim("email")))
    latest = p.groupBy("tenant_id", "email").agg(F.max(F.struct("version", "department"))["department"].alias("cohort_id"))
    return unanimous(latest.where("coalesce(cohort_id, '') <> ''").join(email_to_person, "email").select(F.col("person_id").alias("entity_id"), "cohort_id"), ["entity_id"], "cohort_id")


def coverage(evidence_rows: DataFrame, email_to_person: DataFrame) -> DataFrame:
    """source_key, observation_rows, unresolved_rows, unresolved_people, match_rate_pct (one digit): how much of the evidence names a person."""
    e = evidence_rows.withColumn("email", F.lower(F.trim("entity_id"))).join(email_to_person, "email", "left")
    lost = F.col("person_id").isNull()
    rate = F.round(100.0 * F.count_if(~lost) / F.count("*"), 1)
    return e.groupBy("source_key").agg(F.count("*").alias("observation_rows"), F.count_if(lost).alias("unresolved_rows"), F.count_distinct(F.when(lost, F.col("email"))).alias("unresolved_people"), rate.alias("match_rate_pct"))


def focus(days: DataFrame) -> DataFrame:
    """days (tenant_id, entity_id, metric_date, meeting_hours, working_hours) with focus_pct: the share of the day without meetings, at least 0."""
    hours = F.coalesce("working_hours", F.lit(WORKING_HOURS))
    return days.withColumn("working_hours", hours).withColumn("focus_pct", F.when(hours > 0, F.greatest(F.lit(0.0), 100 - F.coalesce("meeting_hours", F.lit(0.0)) / hours * 100)))


def seat_prices(seats: DataFrame, prices: DataFrame) -> DataFrame:
    """seats (tenant_id, period_month, tier) with price: the month's single price, else that of the seat's tier if it is single, else null."""
    month = ["tenant_id", "period_month"]
    single = unanimous(prices, month, "price").withColumnRenamed("price", "single_price")
    tier = unanimous(prices, [*month, "tier"], "price").withColumnRenamed("price", "tier_price")
    return seats.join(single, month, "left").join(tier, [*month, "tier"], "left").withColumn("price", F.coalesce("single_price", "tier_price")).drop("single_price", "tier_price")


def extra_usage(readings: DataFrame) -> DataFrame:
    """Evidence of the day's spending from readings that add up over a month and may be corrected downwards later.

    readings: tenant_id, source_id, account_id, entity_id, tool, period_month, metric_date, observed_at, used_cents.
    """
    keys = ["tenant_id", "source_id", "account_id", "period_month"]
    steps = cumulative_steps(readings.where("metric_date is not null and coalesce(entity_id, '') <> ''"), keys, "metric_date", "used_cents", F.date_sub("period_month", 1))
    rid = F.concat_ws(":", F.col("period_month").cast("string"), "source_id", "account_id", F.col("metric_date").cast("string"))
    return evidence(steps, "ai_cost", [measure("daily_extra_usage_usd", F.col("step") / 100.0)], rid, F.date_format("period_month", "yyyy-MM"), dimensions(dimension("tool", F.col("tool"))))
