"""Gold models: evidence of each domain from class tables, and observations from evidence.

Evidence has tenant_id, source_key, entity_id, metric_date, observed_at, measure_key, record_id, record_label, contribution,
subject_key and dimensions. Class tables come in with one row for each key (see dedup.class_union).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVIDENCE = ["tenant_id", "source_key", "entity_id", "metric_date", "observed_at", "measure_key", "record_id", "record_label", "contribution", "subject_key", "dimensions"]
NO_DIMENSIONS = "array<struct<key:string,value:string,label:string>>"


def measure(key: str, contribution: Column, when: Column | None = None, subject: Column | None = None) -> Column:
    """An entry of a record's measures: null where the condition doesn't hold or there is no contribution."""
    entry = F.struct(F.lit(key).alias("measure_key"), contribution.cast("double").alias("contribution"), (F.lit(None) if subject is None else subject).cast("string").alias("subject_key"))
    ok = contribution.isNotNull() if when is None else F.coalesce(when, F.lit(False)) & contribution.isNotNull()
    return F.when(ok, entry)


def evidence(records: DataFrame, source_key: str, measures: Sequence[Column], record_id: Column, label: Column, dimensions: Column | None = None) -> DataFrame:
    """A row for each measure that a record has. records: tenant_id, entity_id, metric_date, observed_at; without an entity or a date there is no row."""
    dims = F.array().cast(NO_DIMENSIONS) if dimensions is None else dimensions
    rows = records.where("tenant_id is not null and coalesce(entity_id, '') <> '' and metric_date is not null")
    rows = rows.select("tenant_id", F.lit(source_key).alias("source_key"), "entity_id", "metric_date", F.col("observed_at").cast("timestamp").alias("observed_at"), F.inline(F.filter(F.array(*measures), lambda m: m.isNotNull())), record_id.alias("__r"), label.cast("string").alias("record_label"), dims.alias("dimensions"))
    return rows.withColumn("record_id", F.concat_ws(":", "__r", "measure_key")).select(*EVIDENCE)


def resolved(rows: DataFrame, email_to_person: DataFrame) -> DataFrame:
    """Rows with the person in place of the address; rows of addresses that name nobody go."""
    return rows.withColumn("email", F.lower(F.trim("entity_id"))).join(email_to_person, "email").drop("email", "entity_id").withColumnRenamed("person_id", "entity_id")


def observations(rows: DataFrame, events: Sequence[str] = (), most: Sequence[str] = (), least: Sequence[str] = (), distinct: Sequence[str] = ()) -> DataFrame:
    """Evidence at the canonical grain: measures in `events` stay rows, those in `distinct` a row for each subject, all others are collapsed."""
    grain = ["tenant_id", "source_key", "entity_id", "metric_date", "measure_key", "dimensions"]
    loose = rows.where(F.col("measure_key").isin(list(events))).select(*grain, F.col("contribution").alias("value"), F.lit(None).cast("string").alias("subject_key"))
    subjects = rows.where(F.col("measure_key").isin(list(distinct)) & F.col("subject_key").isNotNull()).select(*grain, F.lit(1.0).alias("value"), "subject_key").distinct()
    kind = F.when(F.col("measure_key").isin(list(most)), F.col("h")).when(F.col("measure_key").isin(list(least)), F.col("l")).otherwise(F.col("s"))
    rest = rows.where(~F.col("measure_key").isin([*events, *distinct])).groupBy(*grain).agg(F.sum("contribution").alias("s"), F.max("contribution").alias("h"), F.min("contribution").alias("l"))
    return loose.unionByName(subjects).unionByName(rest.withColumn("value", kind).where("value is not null").select(*grain, "value", F.lit(None).cast("string").alias("subject_key")))
