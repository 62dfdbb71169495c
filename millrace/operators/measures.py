"""From records to observations: sums, events, presence and distinct subjects, at the canonical grain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAIN = ["tenant_id", "entity_id", "metric_date", "dimensions"]


def sum_measure(evidence: DataFrame, measure: str, value: Column) -> DataFrame:
    """Sum of the values that are not null, for each tenant, entity, date and dimensions; groups of nulls alone have no row."""
    out = evidence.groupBy(*GRAIN).agg(F.sum(value).cast("double").alias("value"))
    return out.where("value is not null").select(*GRAIN, F.lit(measure).alias("measure_key"), "value", F.lit(None).cast("string").alias("subject_key"))


def event_measure(evidence: DataFrame, measure: str, value: Column) -> DataFrame:
    """A row for each event: what a median is taken of."""
    return evidence.where(value.isNotNull()).select(*GRAIN, F.lit(measure).alias("measure_key"), value.cast("double").alias("value"), F.lit(None).cast("string").alias("subject_key"))


def presence_measure(relations: list[DataFrame], measure: str) -> DataFrame:
    """1 for each tenant, entity and date that any relation has."""
    days = reduce(lambda a, b: a.unionByName(b), [r.select("tenant_id", "entity_id", "metric_date") for r in relations]).distinct()
    none = F.array().cast("array<struct<key:string,value:string,label:string>>")
    return days.select("tenant_id", "entity_id", "metric_date", none.alias("dimensions"), F.lit(measure).alias("measure_key"), F.lit(1.0).alias("value"), F.lit(None).cast("string").alias("subject_key"))


def distinct_measure(evidence: DataFrame, measure: str, subject: Column) -> DataFrame:
    """A row for each distinct subject of the grain."""
    rows = evidence.where(subject.isNotNull()).select(*GRAIN, subject.cast("string").alias("subject_key")).distinct()
    return rows.select(*GRAIN, F.lit(measure).alias("measure_key"), F.lit(1.0).alias("value"), "subject_key")
