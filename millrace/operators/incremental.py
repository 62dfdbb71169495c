"""Which rows a run takes up: watermarks, look-back, days to be made anew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def after_watermark(new: DataFrame, target: DataFrame, instance: list[str], version: str) -> DataFrame:
    """Rows of `new` over the target's highest version of their own instance. A watermark for all would lose slower producers' rows."""
    marks = target.groupBy(*instance).agg(F.max(version).alias("__mark"))
    return new.join(marks, instance, "left").where(F.col("__mark").isNull() | (F.col(version) > F.col("__mark"))).drop("__mark")


def after_global_watermark(new: DataFrame, target: DataFrame, version: str) -> DataFrame:
    mark = target.agg(F.max(version).alias("__mark"))
    return new.crossJoin(F.broadcast(mark)).where(F.col("__mark").isNull() | (F.col(version) > F.col("__mark"))).drop("__mark")  # one row


def within_lookback(new: DataFrame, target: DataFrame, day: str, days: int) -> DataFrame:
    """Rows later than the target's last day less the look-back; all for an empty target."""
    mark = target.agg(F.max(day).alias("__mark"))
    return new.crossJoin(F.broadcast(mark)).where(F.col("__mark").isNull() | (F.col(day) > F.date_sub("__mark", days))).drop("__mark")  # one row


def touched(rows: DataFrame, keys: list[str], extracted: str, since: Column) -> DataFrame:
    """All rows of the keys of which a row came in since: these are aggregated anew, whole."""
    return rows.join(rows.where(F.col(extracted) >= since).select(*keys).distinct(), keys, "left_semi")


def reopened_months(target: DataFrame, source: DataFrame, month: str, arrived: str, closed_before: Column) -> DataFrame:
    """month: closed ones that have to be built again, as source has rows that arrived after the target's latest for that month."""
    built = target.groupBy(month).agg(F.max(arrived).alias("__built"))
    late = source.where(F.col(month) < closed_before).groupBy(month).agg(F.max(arrived).alias("__late"))
    return late.join(built, month, "left").where("__built is null or __late > __built").select(month)


def freshness(tables: dict[str, tuple[DataFrame, str]], now: Column, most_hours: float) -> DataFrame:
    """source, latest, age_hours, stale: when each table last got a row; one without rows is stale."""
    each = [df.agg(F.max(F.col(at).cast("timestamp")).alias("latest")).select(F.lit(name).alias("source"), "latest") for name, (df, at) in tables.items()]
    age = F.round((F.unix_seconds(now) - F.unix_seconds("latest")) / 3600.0, 2)
    return reduce(DataFrame.unionByName, each).withColumn("age_hours", age).withColumn("stale", F.coalesce(age > most_hours, F.lit(True)))
