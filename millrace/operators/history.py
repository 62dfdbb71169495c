"""Versions of records and what changed between them: snapshots, field histories, claims and their intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    """A hash of values in order; null and empty differ, and no two lists of values write the same text."""
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])), 256)


def snapshot_changes(previous: DataFrame | None, current: DataFrame, key: list[str], check: list[str], tracked_at: Column) -> DataFrame:
    """Rows of `current` to append to a version log: those whose checked values differ from the key's latest version."""
    new = current.withColumn("row_hash", row_hash(check)).withColumn("tracked_at", tracked_at)
    if previous is None:
        return new
    latest = previous.groupBy(*key).agg(F.max_by("row_hash", "tracked_at").alias("__known"))
    return new.join(latest, key, "left").where(~F.col("row_hash").eqNullSafe(F.col("__known"))).drop("__known")


def fields_history(versions: DataFrame, key: list[str], at: str, fields: list[str]) -> DataFrame:
    """key, at, field, old_value, new_value for each change; the first version changes from '' to what isn't empty."""
    w = Window.partitionBy(*key).orderBy(at)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    entries = [F.struct(F.lit(f).alias("field"), F.coalesce(F.lag(text(f)).over(w), F.lit("")).alias("old_value"), text(f).alias("new_value")) for f in fields]
    changes = versions.select(*key, F.col(at), F.array(*entries).alias("__e"))
    return changes.select(*key, F.col(at), F.inline(F.filter("__e", lambda e: e["old_value"] != e["new_value"])))


def map_history(versions: DataFrame, key: list[str], at: str, values: str) -> DataFrame:
    """The same over all keys of a map column; a key that a version lacks is empty there."""
    w = Window.partitionBy(*key).orderBy(at)
    none = F.create_map().cast("map<string,string>")
    pair = versions.withColumn("__before", F.coalesce(F.lag(values).over(w), none)).withColumn("__now", F.coalesce(F.col(values), none))
    names = F.array_distinct(F.concat(F.map_keys("__now"), F.map_keys("__before")))
    entries = F.transform(names, lambda k: F.struct(k.alias("field"), F.coalesce(F.try_element_at("__before", k), F.lit("")).alias("old_value"), F.coalesce(F.try_element_at("__now", k), F.lit("")).alias("new_value")))
    return pair.select(*key, F.col(at), F.inline(F.filter(entries, lambda e: e["old_value"] != e["new_value"])))


def attribute_claims(history: DataFrame) -> DataFrame:
    """A field history with claim_action: a value is set, or cleared when it becomes empty."""
    return history.withColumn("claim_action", F.when(F.col("new_value") == "", "clear").otherwise("set"))


def claim_intervals(claims: DataFrame, key: list[str], at: str) -> DataFrame:
    """key, field, value, valid_from, valid_to: each set value until the field's next claim; null while it holds."""
    w = Window.partitionBy(*key, "field").orderBy(at)
    out = claims.withColumn("valid_to", F.lead(at).over(w)).where("claim_action = 'set'")
    return out.select(*key, "field", F.col("new_value").alias("value"), F.col(at).alias("valid_from"), "valid_to")


def valid_at(intervals: DataFrame, at: Column) -> DataFrame:
    return intervals.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def bitemporal_latest(df: DataFrame, keys: list[str], values: list[str], valid_from: str, recorded_at: str, as_of: Column) -> DataFrame:
    """The values that hold at as_of: of rows valid by then, the latest valid, and of these the latest recorded."""
    best = F.max(F.struct(*dict.fromkeys([valid_from, recorded_at, *values]))).alias("__x")
    return df.where(F.col(valid_from) <= as_of).groupBy(*keys).agg(best).select(*keys, *[F.col("__x")[v].alias(v) for v in values])
