"""Dimension arrays: array<struct<key, value, label>>, in a fixed order, one entry for each key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN, UNKNOWN_LABEL = "__unknown__", "Unknown"


def dimension(key: str, value: Column, label: Column | None = None) -> Column:
    return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"), (value if label is None else label).cast("string").alias("label"))


def dimensions(*entries: Column) -> Column:
    """The entries that are not null, as one array. Leave an entry out with when(): a missing dimension has no entry."""
    return F.filter(F.array(*entries), lambda d: d.isNotNull())


def value_of(column: Column, key: str) -> Column:
    """Value of a dimension; the sentinel where the row doesn't carry it."""
    return F.coalesce(F.get(F.filter(column, lambda d: d["key"] == key), F.lit(0))["value"], F.lit(UNKNOWN))


def label_of(column: Column, key: str) -> Column:
    return F.coalesce(F.get(F.filter(column, lambda d: d["key"] == key), F.lit(0))["label"], F.lit(UNKNOWN_LABEL))


def carries(column: Column, key: str, values: list[str]) -> Column:
    """Whether the row carries the dimension with one of the values; rows without it don't pass, whatever the values."""
    return F.exists(column, lambda d: (d["key"] == key) & d["value"].isin(values))
