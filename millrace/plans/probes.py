"""Probes of metric definitions: what observations hold, as a profile that runs add to, and the state of each metric from it.

A profile has a row for each source, measure, day and finding: `rows` (name empty), `dimension` (name: a key that rows carry)
or `granularity` (name: a grain of the evidence), with the number of rows. Profiles of parts add up to that of the whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import Metric

#: Days before a measure's own last one in which all its rows have to carry a metric's dimensions.
WINDOW_DAYS = 35
#: The codes of errors in a definition.
NO_TABLE, NO_COLUMN, NOT_COVERED = "table_not_found", "column_not_found", "dimension_not_covered"
#: Columns that observations must have.
COLUMNS = ("tenant_id", "source_key", "entity_id", "metric_date", "measure_key", "value", "subject_key", "dimensions")
_KEY = ["source_key", "measure_key", "metric_date", "finding", "name"]


def profile(observations: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """source_key, measure_key, metric_date, finding, name, n of observations, and of evidence with a granularity. One pass over each."""
    keys = F.array_distinct(F.transform(F.coalesce("dimensions", F.array()), lambda d: d["key"]))
    found = F.concat(
        F.array(F.struct(F.lit("rows").alias("finding"), F.lit("").alias("name"))),
        F.transform(keys, lambda k: F.struct(F.lit("dimension").alias("finding"), k.alias("name"))),
    )
    out = observations.select("source_key", "measure_key", "metric_date", F.inline(found))
    if evidence is not None:
        out = out.unionByName(evidence.select("source_key", "measure_key", "metric_date", F.lit("granularity").alias("finding"), F.coalesce("granularity", F.lit("")).alias("name")))
    return out.groupBy(*_KEY).agg(F.count("*").alias("n"))


def merged(*profiles: DataFrame) -> DataFrame:
    """The profile of all that the profiles are of, each of other rows."""
    out = profiles[0]
    for p in profiles[1:]:
        out = out.unionByName(p)
    return out.groupBy(*_KEY).agg(F.sum("n").alias("n"))


def missing_columns(observations: DataFrame | None, columns: Sequence[str] = COLUMNS) -> str | None:
    """The error of a table that isn't there (None) or lacks columns."""
    if observations is None:
        return NO_TABLE
    return None if set(columns) <= set(observations.columns) else NO_COLUMN


def statuses(found: DataFrame, metrics: Sequence[Metric], granularity: Mapping[tuple[str, str], str] | None = None, errors: Mapping[str, str] | None = None) -> DataFrame:
    """metric_key, state, error_code, last_observed, unobserved, uncovered, grain_conflicts: the state of each metric, from a profile.

    A metric none of whose measures has ever been observed, or not all, is unchecked. In the 35 days before a measure's own
    last one all rows have to carry each of the metric's dimensions, else it is an error. granularity: (source, measure) ->
    the one grain that evidence must have in the 35 days before the earliest last day of the metric's measures; a measure
    that was observed and has another grain, several or none is a conflict. errors: source -> code of a table's own error.
    """
    spark, granularity = found.sparkSession, granularity or {}
    wanted = [(m.key, m.source_key, k, list(m.dimensions), granularity.get((m.source_key, k)), (errors or {}).get(m.source_key)) for m in metrics for k in dict.fromkeys((*m.measures, *m.denominator))]
    need = spark.createDataFrame(wanted, "metric_key string, source_key string, measure_key string, dimensions array<string>, grain string, broken string")
    on = ["source_key", "measure_key"]
    last = found.where("finding = 'rows'").groupBy(*on).agg(F.max("metric_date").alias("last_observed"))
    recent = found.join(last, on).where(F.col("metric_date") >= F.date_sub("last_observed", WINDOW_DAYS))
    name = lambda kind: F.col("finding") == kind
    carried = recent.where("finding <> 'granularity'").groupBy(*on, "finding", "name").agg(F.sum("n").alias("n")).groupBy(*on).agg(
        F.max(F.when(name("rows"), F.col("n"))).alias("rows"), F.collect_list(F.when(name("dimension"), F.struct("name", "n"))).alias("carried")
    )
    measured = need.join(last, on, "left").join(carried, on, "left")
    lacking = F.filter("dimensions", lambda d: ~F.exists("carried", lambda c: (c["name"] == d) & (c["n"] == F.col("rows"))))
    measured = measured.withColumn("lacking", F.when(F.col("last_observed").isNotNull(), lacking).otherwise(F.array().cast("array<string>")))
    sinces = measured.groupBy("metric_key").agg(F.date_sub(F.min("last_observed"), WINDOW_DAYS).alias("since"))
    grains = found.where(name("granularity")).select(*on, F.col("metric_date").alias("day"), "name")
    own = need.where("grain is not null").join(sinces, "metric_key").join(grains, on, "left").groupBy("metric_key", *on, "grain").agg(
        F.collect_set(F.when(F.col("day") >= F.col("since"), F.col("name"))).alias("grains")
    )
    conflicts = own.join(last, on, "left").where((F.size("grains") > 0) | F.col("last_observed").isNotNull()).where(F.col("grains") != F.array("grain"))
    conflicts = conflicts.groupBy("metric_key").agg(F.array_sort(F.collect_set("measure_key")).alias("grain_conflicts"))
    none = F.array().cast("array<string>")
    out = measured.groupBy("metric_key").agg(
        F.max("broken").alias("broken"), F.max("last_observed").alias("last_observed"), F.array_sort(F.collect_list(F.when(F.col("last_observed").isNull(), F.col("measure_key")))).alias("unobserved"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("lacking")))).alias("uncovered"),
    )
    error = F.when(F.col("broken").isNotNull(), F.col("broken")).when(F.size("uncovered") > 0, NOT_COVERED)
    state = F.when(error.isNotNull(), "error").when(F.size("unobserved") > 0, "unchecked").otherwise("ok")
    return out.join(conflicts, "metric_key", "left").select("metric_key", state.alias("state"), error.alias("error_code"), "last_observed", "unobserved", "uncovered", F.coalesce("grain_conflicts", none).alias("grain_conflicts"))
