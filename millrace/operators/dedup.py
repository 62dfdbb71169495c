"""Latest rows, first rows by content, unions of producers, and unanimous values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _nth(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def latest_by_key(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of each key with the largest version; nulls are a key like another. Give enough version columns to leave no tie."""
    return _nth(df, keys, [F.desc(v) for v in version])


def latest_values(df: DataFrame, keys: list[str], version: list[str], values: list[str]) -> DataFrame:
    """As latest_by_key, for a few columns: one aggregation, combined before the shuffle, so that hot keys cost nothing."""
    at = F.max(F.struct(*version, *[v for v in values if v not in version])).alias("__x")
    return df.groupBy(*keys).agg(at).select(*keys, *[F.col("__x")[v].alias(v) for v in values])


def first_by_content(df: DataFrame, content: list[str], order: list[str]) -> DataFrame:
    """The earliest row of each content; rows of unknown content must carry something of their own in `content`."""
    return _nth(df, content, [F.asc(o) for o in order])


def class_union(producers: list[DataFrame], keys: list[str], version: list[str], empty: DataFrame | None = None) -> DataFrame:
    """Rows of all producers of a class, the latest of each key. Without producers: `empty`, which gives the columns."""
    if not producers:
        if empty is None:
            raise ValueError("a class without producers needs its empty table")
        return empty.limit(0)
    return latest_by_key(reduce(lambda a, b: a.unionByName(b), producers), keys, version)


def unanimous(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of each key whose rows agree on one; nulls have no say. Minimum and maximum tell, without a set of values."""
    agg = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("__most"))
    return agg.where(F.col(value) == F.col("__most")).drop("__most")


def unique_mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, unless another is as frequent."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    top = counts.groupBy(*keys).agg(F.max("n").alias("n"))
    best = counts.join(top, [*keys, "n"]).groupBy(*keys, "n").agg(F.min(value).alias(value), F.count("*").alias("__ties"))
    return best.where("__ties = 1").drop("__ties")


def keyed_replace(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows of keys that `new` has replaced by those of `new`: doing it twice changes nothing."""
    return target.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def alias_collapse(df: DataFrame, keys: list[str], measure: str, value: str, most: list[str] = (), least: list[str] = ()) -> DataFrame:
    """One row for each key: values are summed, except measures in `most` (day flags) and `least` (inverse flags)."""
    out = df.groupBy(*keys, measure).agg(F.sum(value).alias("__s"), F.max(value).alias("__h"), F.min(value).alias("__l"))
    kind = F.when(F.col(measure).isin(list(most)), F.col("__h")).when(F.col(measure).isin(list(least)), F.col("__l")).otherwise(F.col("__s"))
    return out.withColumn(value, kind).drop("__s", "__h", "__l")
