"""Metric definitions and their views over observations.

Observations have tenant_id, source_key, entity_id, metric_date, measure_key, value, subject_key, dimensions. A view is one
DataFrame; metrics of one source share its scan. Nothing for a metric gives null and never 0, so that an entity
without data doesn't enter a peer pool; a ratio without a denominator is null too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dimensions import carries, label_of, value_of
from ..functions.text import clamp
from ..operators.quantiles import exact_quantiles

KINDS = ("sum", "ratio", "median", "distinct")
#: Fewest entities of a pool whose quantiles are told; bins of a histogram; rows of a response; series beside the rest.
FLOOR, BINS, ROW_CAP, GROUP_CAP = 5, 10, 5_000, 50


@dataclass(frozen=True)
class Transform:
    """multiplier * x + offset, then within bounds; null stays null."""

    multiplier: float = 1.0
    offset: float = 0.0
    low: float | None = None
    high: float | None = None

    def __call__(self, x: Column) -> Column:
        return clamp(x * self.multiplier + self.offset, self.low, self.high)


@dataclass(frozen=True)
class Metric:
    """A metric: its kind, the measures it reads (a ratio: also those of the denominator), scale and transform."""

    key: str
    kind: str
    source_key: str
    measures: tuple[str, ...]
    denominator: tuple[str, ...] = ()
    scale: float = 1.0
    transform: Transform | None = None
    dimensions: tuple[str, ...] = ()
    cohort_key: str | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"{self.key}: no computation is called {self.kind}")
        if not self.measures or (self.kind == "ratio") != bool(self.denominator):
            raise ValueError(f"{self.key}: a ratio needs measures on both sides, any other kind on one")

    @property
    def column(self) -> str:
        return self.key.replace(".", "_")

    def rows(self) -> Column:
        return (F.col("source_key") == self.source_key) & F.col("measure_key").isin(list(self.measures))

    def aggregate(self, zero: bool = False) -> Column:
        """The metric's value as an aggregate; not for medians. zero: a sum over rows that have no value is 0, as in series and breakdowns of one metric."""
        total = F.sum(F.when(self.rows(), F.col("value")))
        if zero and self.kind == "sum":
            total = F.coalesce(total, F.lit(0.0))
        if self.kind == "ratio":
            under = F.sum(F.when((F.col("source_key") == self.source_key) & F.col("measure_key").isin(list(self.denominator)), F.col("value")))
            total = total * self.scale / F.nullif(under, F.lit(0.0))
        elif self.kind == "distinct":
            number = F.count_distinct(F.when(self.rows(), F.col("subject_key"))).cast("double")
            total = F.when(F.count(F.when(self.rows(), 1)) > 0, number)
        elif self.kind == "median":
            raise ValueError("a median is taken by exact_quantiles")
        return self.transform(total) if self.transform else total


@dataclass(frozen=True)
class Scope:
    """What of the observations a request covers. Dates are inclusive at both ends; a filter drops rows without the dimension."""

    tenant_id: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    entities: tuple[str, ...] = ()
    filters: dict[str, list[str]] = field(default_factory=dict)

    def of(self, observations: DataFrame, metrics: Sequence[Metric], entities: bool = True) -> DataFrame:
        out = observations
        if self.tenant_id is not None:
            out = out.where(F.col("tenant_id") == self.tenant_id)
        pairs = sorted({(m.source_key, k) for m in metrics for k in (*m.measures, *m.denominator)})
        by_source: dict[str, list[str]] = {}
        for source, measure in pairs:
            by_source.setdefault(source, []).append(measure)
        out = out.where(reduce(lambda a, b: a | b, [(F.col("source_key") == s) & F.col("measure_key").isin(m) for s, m in by_source.items()]))
        if self.date_from:
            out = out.where(F.col("metric_date") >= F.lit(self.date_from).cast("date"))
        if self.date_to:
            out = out.where(F.col("metric_date") <= F.lit(self.date_to).cast("date"))
        if entities and self.entities:
            out = out.where(F.col("entity_id").isin(list(self.entities)))
        for key, values in self.filters.items():
            out = out.where(carries(F.col("dimensions"), key, values))
        return out


def evaluate(rows: DataFrame, metrics: Sequence[Metric], keys: list[str], zero: bool = False) -> DataFrame:
    """keys and a column for each metric: one aggregation for all that can share it, one for each median, joined on the keys."""
    plain = [m for m in metrics if m.kind != "median"]
    parts = [rows.groupBy(*keys).agg(*[m.aggregate(zero).alias(m.column) for m in plain])] if plain else []
    for m in metrics:
        if m.kind == "median":
            q = exact_quantiles(rows.where(m.rows()), keys, "value", {m.column: 0.5}).drop("n")
            parts.append(q.withColumn(m.column, m.transform(F.col(m.column))) if m.transform else q)

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        if not keys:
            return a.crossJoin(b)  # a row each
        b = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        out = a.join(b, on, "full_outer")
        return out.select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys], *[c for c in out.columns if c not in keys and not c.startswith("__")])

    return reduce(join, parts)


# -- views


def period(observations: DataFrame, metrics: Sequence[Metric], scope: Scope = Scope()) -> DataFrame:
    """entity_id and a column for each metric over the whole period."""
    return evaluate(scope.of(observations, metrics), metrics, ["entity_id"])


def bucket(grain: str) -> Column:
    """First day of the day, week (Monday) or month."""
    if grain not in ("day", "week", "month"):
        raise ValueError(f"no grain is called {grain}")
    return F.col("metric_date") if grain == "day" else F.trunc("metric_date", "week" if grain == "week" else "month")


def timeseries(observations: DataFrame, metric: Metric, grain: str, scope: Scope = Scope(), dimension: str | None = None, totals: bool = True) -> DataFrame:
    """entity_id, bucket, (dimension,) value: a row for each bucket with data, and with totals one with bucket null for the period."""
    by = ["entity_id"] + (["dimension"] if dimension else [])
    rows = scope.of(observations, [metric]).withColumn("bucket", bucket(grain))
    if dimension:
        rows = rows.withColumn("dimension", value_of(F.col("dimensions"), dimension))
    if metric.kind == "median":
        out = evaluate(rows, [metric], [*by, "bucket"])
        if totals:
            out = out.unionByName(evaluate(rows, [metric], by).withColumn("bucket", F.lit(None).cast("date")))
        return out.select(*by, "bucket", F.col(metric.column).alias("value"))
    groups = [[F.col(c) for c in [*by, "bucket"]]] + ([[F.col(c) for c in by]] if totals else [])
    return rows.groupingSets(groups, *[F.col(c) for c in [*by, "bucket"]]).agg(metric.aggregate(zero=True).alias("value")).select(*by, "bucket", "value")


def densify(series: DataFrame, grain: str, date_from: str, date_to: str, keys: list[str] = ("entity_id",)) -> DataFrame:
    """All buckets of the period for each key of the series; null where the series has none."""
    step = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH"}[grain]
    first = F.lit(date_from).cast("date") if grain == "day" else F.trunc(F.lit(date_from).cast("date"), grain)
    spine = series.select(*keys).distinct().withColumn("bucket", F.explode(F.sequence(first, F.lit(date_to).cast("date"), F.expr(step))))
    return spine.join(series.where("bucket is not null"), [*keys, "bucket"], "left")


def ranking(observations: DataFrame, metric: Metric, dimension: str, k: int, scope: Scope = Scope()) -> DataFrame:
    """The k values of a dimension with the largest metric: rank, dimension, label, value. Ties go to the smaller one; null has no rank."""
    rows = scope.of(observations, [metric]).withColumn("dimension", value_of(F.col("dimensions"), dimension)).withColumn("label", label_of(F.col("dimensions"), dimension))
    labels = rows.groupBy("dimension").agg(F.max_by("label", F.struct("metric_date", "label")).alias("label"))
    top = evaluate(rows, [metric], ["dimension"]).select("dimension", F.col(metric.column).alias("value")).where("value is not null").orderBy(F.desc("value"), "dimension").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), "dimension"))).join(labels, "dimension").select("rank", "dimension", "label", "value")  # k rows


def capped_timeseries(observations: DataFrame, metric: Metric, dimension: str, k: int, grain: str, scope: Scope = Scope()) -> DataFrame:
    """rank, bucket, value: series of the k top values of a dimension and of all others together (rank 0), with totals (bucket null)."""
    if not 0 < k <= GROUP_CAP:
        raise ValueError(f"between 1 and {GROUP_CAP} series can be asked for")
    top = ranking(observations, metric, dimension, k, scope).select("rank", "dimension")
    rows = scope.of(observations, [metric]).withColumn("dimension", value_of(F.col("dimensions"), dimension)).withColumn("bucket", bucket(grain))
    ranked = rows.join(F.broadcast(top), "dimension", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))  # k rows
    if metric.kind == "median":
        series = evaluate(ranked, [metric], ["rank", "bucket"]).unionByName(evaluate(ranked, [metric], ["rank"]).withColumn("bucket", F.lit(None).cast("date")))
        return series.select("rank", "bucket", F.col(metric.column).alias("value"))
    return ranked.groupingSets([[F.col("rank"), F.col("bucket")], [F.col("rank")]], F.col("rank"), F.col("bucket")).agg(metric.aggregate().alias("value")).select("rank", "bucket", "value")


def breakdown(observations: DataFrame, metric: Metric, by: Sequence[str], scope: Scope = Scope()) -> DataFrame:
    """entity_id, value and label of each dimension (columns d_value, d_label), and the metric's value."""
    rows = scope.of(observations, [metric])
    keys = ["entity_id"]
    for d in by:
        rows = rows.withColumn(f"{d}_value", value_of(F.col("dimensions"), d)).withColumn(f"{d}_label", label_of(F.col("dimensions"), d))
        keys += [f"{d}_value", f"{d}_label"]
    return evaluate(rows, [metric], keys, zero=True).select(*keys, F.col(metric.column).alias("value"))


def _statistics(pool: DataFrame, keys: list[str]) -> DataFrame:
    """n, and p25, median, p75, min, max where n reaches the floor."""
    found = exact_quantiles(pool, keys, "value", {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "max": 1.0})
    return found.select(*keys, "n", *[F.when(F.col("n") >= FLOOR, F.col(c)).alias(c) for c in ("min", "p25", "median", "p75", "max")])


def peers(observations: DataFrame, metric: Metric, cohorts: DataFrame, targets: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """For each target: its value and the statistics of its cohort's members that have a value. cohorts: entity_id, cohort_id, one row each."""
    members = cohorts.join(targets.join(cohorts, "entity_id").select("cohort_id").distinct(), "cohort_id", "left_semi")
    values = evaluate(scope.of(observations, [metric], entities=False), [metric], ["entity_id"]).select("entity_id", F.col(metric.column).alias("value"))
    pool = members.join(values, "entity_id").where("value is not null")
    stats = _statistics(pool, ["cohort_id"])
    out = targets.select("entity_id").join(cohorts, "entity_id", "left").join(values, "entity_id", "left").join(stats, "cohort_id", "left")
    return out.select("entity_id", "cohort_id", "value", F.coalesce("n", F.lit(0)).alias("n"), "p25", "median", "p75", "min", "max")


def tenant_peers(observations: DataFrame, metric: Metric, scope: Scope = Scope()) -> DataFrame:
    """For each entity: its value and the statistics of all that have one."""
    values = evaluate(scope.of(observations, [metric]), [metric], ["entity_id"]).select("entity_id", F.col(metric.column).alias("value")).where("value is not null")
    return values.crossJoin(F.broadcast(_statistics(values, []))).select("entity_id", "value", "n", "p25", "median", "p75", "min", "max")  # one row


def histogram(observations: DataFrame, metric: Metric, scope: Scope = Scope(), bins: int = BINS) -> DataFrame:
    """entity_id, bin, count, low, high: events of each entity in bins of one width between its least and largest value; one value: bin 0. An entity that is asked for by name and has no values has one row: bin null, count 0."""
    rows = scope.of(observations, [metric]).where(metric.rows() & F.col("value").isNotNull())
    value = metric.transform(F.col("value")) if metric.transform else F.col("value")
    rows = rows.select("entity_id", value.alias("value"))
    bounds = rows.groupBy("entity_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    binned = rows.join(bounds, "entity_id").withColumn("bin", F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("low")) * bins / (F.col("high") - F.col("low"))))).cast("int"))
    out = binned.groupBy("entity_id", "bin", "low", "high").agg(F.count("*").alias("count")).select("entity_id", "bin", "count", "low", "high")
    if not scope.entities:
        return out
    named = out.sparkSession.createDataFrame([(e,) for e in dict.fromkeys(scope.entities)], "entity_id string")
    empty = named.join(bounds, "entity_id", "left_anti").select("entity_id", F.lit(None).cast("int").alias("bin"), F.lit(0).cast("long").alias("count"), *[F.lit(None).cast("double").alias(c) for c in ("low", "high")])
    return out.unionByName(empty)


def capped(df: DataFrame, cap: int = ROW_CAP) -> list:
    """Rows of a response; more than the cap are an error, found by one row over it."""
    rows = df.limit(cap + 1).collect()
    if len(rows) > cap:
        raise ValueError(f"the view has more than {cap} rows")
    return rows


def sourced(metric: Metric, source_key: str) -> Metric:
    """The metric over another source."""
    return replace(metric, source_key=source_key)
