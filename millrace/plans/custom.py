"""Metrics that users define: checked as graphs of roles and measures, carried as JSON, and evaluated many at once."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, fields
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import saved
from .gate import LONGEST, refusals
from .metrics import Metric, Scope, Transform

#: Most entries of a metric's lists and of an import; names of computations with the roles of their inputs.
MOST_ENTRIES, MOST_IMPORTED = 64, 500
ROLES = {"sum": ("value",), "median": ("value",), "distinct_count": ("value",), "ratio": ("numerator", "denominator")}
_SIMPLE, _KEY = re.compile(r"[a-z][a-z0-9_]*"), re.compile(r"[a-z][a-z0-9_]*\.[a-z][a-z0-9_]*")


@dataclass(frozen=True)
class CustomMetric:
    """A metric as its author gives it: what it is called, the query of its source, and which measure plays which role."""

    metric_key: str
    label: str
    computation: str
    source_key: str
    observation_sql: str
    measures: tuple[str, ...]
    inputs: tuple[tuple[str, str], ...]
    entity_type: str = "person"
    dimensions: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    scale: float | None = None
    transform: tuple[float, float, float | None, float | None] | None = None
    peer_cohort_key: str | None = None
    unit: str | None = None
    description: str | None = None

    def violations(self, spark: SparkSession, relations: Sequence[str] = ()) -> list[tuple[str, str]]:
        """All that is wrong, as (field, reason)."""
        out = []
        if not _KEY.fullmatch(self.metric_key):
            out.append(("metric_key", "must be two simple keys with a dot between"))
        for name in ("source_key", "entity_type", "peer_cohort_key"):
            value = getattr(self, name)
            if value is not None and not _SIMPLE.fullmatch(value):
                out.append((name, "must be a simple key"))
        for name in ("measures", "dimensions", "tags"):
            values = getattr(self, name)
            if len(values) > MOST_ENTRIES:
                out.append((name, f"at most {MOST_ENTRIES} are allowed"))
            if len(set(values)) < len(values):
                out.append((name, "must be unique"))
            if not all(_SIMPLE.fullmatch(v) for v in values):
                out.append((name, "must be simple keys"))
        if not self.measures:
            out.append(("measures", "at least one is required"))
        if len(self.observation_sql.encode()) > LONGEST:
            out.append(("observation_sql", f"must have at most {LONGEST} bytes"))
        else:
            out += [("observation_sql", r) for r in refusals(spark, self.observation_sql, relations)]
        roles = ROLES.get(self.computation)
        if roles is None:
            out.append(("computation", f"no computation is called {self.computation}"))
        elif sorted(r for r, _ in self.inputs) != sorted(roles):
            out.append(("inputs", f"{self.computation} takes one {' and one '.join(roles)} input"))
        out += [("inputs", f"input measure {m} is not in measures") for _, m in self.inputs if m not in self.measures]
        if (self.computation == "ratio") != (self.scale is not None):
            out.append(("scale", "ratios require a scale, other metrics have none"))
        if self.transform and None not in self.transform[2:] and self.transform[2] > self.transform[3]:
            out.append(("transform", "the bounds cross"))
        return out

    def compiled(self) -> Metric:
        of = lambda role: tuple(m for r, m in self.inputs if r == role)
        kind = "distinct" if self.computation == "distinct_count" else self.computation
        value = of("numerator") if kind == "ratio" else of("value")
        return Metric(self.metric_key, kind, self.source_key, value, of("denominator"), self.scale or 1.0, Transform(*self.transform) if self.transform else None, self.dimensions, self.peer_cohort_key)

    def to_json(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if v is not None}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> CustomMetric:
        """The metric of a JSON object; a field that no metric has, or one that is lacking, is an error."""
        given = json.loads(text)
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise ValueError(f"no field of a metric is called {sorted(unknown)[0]}")
        listed = {k: tuple(map(tuple, v)) if k == "inputs" else tuple(v) if isinstance(v, list) else v for k, v in given.items()}
        return cls(**listed)


def import_metrics(spark: SparkSession, existing: Mapping[str, CustomMetric], texts: Iterable[str], relations: Sequence[str] = ()) -> tuple[dict[str, CustomMetric], list[str]]:
    """The metrics after an import, and the keys left out as they or their source exist. One metric with a violation stops the whole import."""
    graphs = [CustomMetric.from_json(t) for t in texts]
    if len(graphs) > MOST_IMPORTED:
        raise ValueError(f"at most {MOST_IMPORTED} metrics are imported at once")
    wrong = [f"{g.metric_key}: {field}: {reason}" for g in graphs for field, reason in g.violations(spark, relations)]
    if wrong:
        raise ValueError("; ".join(wrong))
    out, skipped = dict(existing), []
    for g in graphs:
        if g.metric_key in out or any(g.source_key == m.source_key for m in out.values()):
            skipped.append(g.metric_key)
        else:
            out[g.metric_key] = g
    return out, skipped


def export_metrics(metrics: Mapping[str, CustomMetric]) -> list[str]:
    return [metrics[k].to_json() for k in sorted(metrics)]


# -- many metrics at once


def _as_map(groups: dict[tuple[str, str], list[str]]) -> Column:
    """A literal map of (source, measure) to the names of what a row of it counts for."""
    pairs = list(chain.from_iterable((F.lit("\x00".join(k)), F.array(*map(F.lit, v))) for k, v in sorted(groups.items())))
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<string>>")


def evaluate_many(observations: DataFrame, metrics: Sequence[Metric], scope: Scope = Scope(), keys: Sequence[str] = ("entity_id",)) -> DataFrame:
    """keys, metric_key, value: as many metrics as one likes from one scan and one shuffle of the observations.

    A row counts once for its measure's sum, which all sums and ratios share, once for each set of measures whose subjects
    are counted, and once for each median over its measure. Rows combine before the shuffle by what they count for; of
    medians the values with their numbers are left, sorted by value within a key. A metric without data has no row.
    """
    keys = list(keys)
    sums: dict[tuple[str, str], list[str]] = {}
    sets: dict[tuple[str, str], list[str]] = {}
    places: dict[tuple[str, str], list[str]] = {}
    for m in metrics:
        for k in dict.fromkeys((*m.measures, *m.denominator)):
            at, name = (m.source_key, k), "\x00".join((m.source_key, *sorted(m.measures)))
            if m.kind in ("sum", "ratio"):
                sums[at] = ["\x00".join(at)]
            else:
                own = (sets if m.kind == "distinct" else places).setdefault(at, [])
                own += [name] if name not in own else []
    measure = F.concat_ws("\x00", "source_key", "measure_key")
    none = F.lit(None)

    def parts(kind: str, groups: dict, subject: Column, value: Column, amount: Column) -> Column:
        names = F.coalesce(F.try_element_at(_as_map(groups), measure), F.array().cast("array<string>"))
        return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name"), subject.cast("string").alias("subject"), value.cast("double").alias("place"), amount.cast("double").alias("amount")))

    counted = F.concat(
        parts("sum", sums, none, none, F.col("value")), parts("set", sets, F.col("subject_key"), none, none),
        F.filter(parts("place", places, none, F.col("value"), none), lambda x: x["place"].isNotNull()),
    )
    rows = scope.of(observations, metrics).select(*keys, F.inline(counted))
    base = saved(rows.groupBy(*keys, "kind", "name", "subject", "place").agg(F.sum("amount").alias("amount"), F.count("*").alias("n")), "measures")

    upto = Window.partitionBy(*keys, "name").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys, "name")
    middle = base.where("kind = 'place'").withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole))
    middle = middle.where((F.col("upto") > F.floor(F.col("total") / 2)) & (F.col("upto") - F.col("n") <= F.floor(F.col("total") / 2))).select(*keys, "kind", "name", F.col("place").alias("x"))
    others = base.where("kind <> 'place'").groupBy(*keys, "kind", "name").agg(F.when(F.col("kind") == "sum", F.sum("amount")).otherwise(F.count("subject").cast("double")).alias("x"))
    found = middle.unionByName(others).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x01", "kind", "name"), "x"))).alias("x"))

    def value(m: Metric) -> Column:
        name = "\x00".join((m.source_key, *sorted(m.measures)))
        at = lambda kind, n: F.try_element_at("x", F.lit(f"{kind}\x01{n}"))
        if m.kind in ("distinct", "median"):
            out = at("set" if m.kind == "distinct" else "place", name)
        else:
            side = lambda ks: reduce(_plus, [at("sum", f"{m.source_key}\x00{k}") for k in ks])
            out = side(m.measures)
            if m.kind == "ratio":
                out = out * m.scale / F.nullif(side(m.denominator), F.lit(0.0))
        return m.transform(out) if m.transform else out

    pairs = F.array(*[F.struct(F.lit(m.key).alias("metric_key"), value(m).alias("value")) for m in metrics])
    return found.select(*keys, F.inline(pairs)).where("value is not null")


def _plus(a: Column, b: Column) -> Column:
    """The sum of what there is of both."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
