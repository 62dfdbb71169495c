"""Registered queries of what stands around the metric layer: gated queries, definition probes, many metrics at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import analogs as A
from .plans import custom, gate, probes
from .plans.gate import Relation
from .plans.metrics import Metric, Scope, period
from .plans.registry import METRICS
from .queries import _rounded, query
from .runtime import saved, table

# -- gated queries: an order belongs to its priority's tenant

_TENANT = "1-URGENT"
_GATED = """WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders WHERE o_totalprice > :least GROUP BY o_custkey)
SELECT c_mktsegment AS segment, count(*) AS customers, round(sum(total), 2) AS total, (SELECT count(*) FROM orders) AS tenant_orders
FROM big JOIN customer ON c_custkey = o_custkey WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY c_mktsegment"""


def _relations(spark, d):
    return {"orders": Relation(table(spark, d, "orders"), "o_orderpriority"), "customer": Relation(table(spark, d, "customer"), None)}


@query(f"WITH orders AS (SELECT * FROM main.orders WHERE o_orderpriority = '{_TENANT}'), " + _GATED.removeprefix("WITH ").replace(":least", "100000"))
def gated_query(spark, d):
    return gate.run_gated(spark, _GATED, _relations(spark, d), _TENANT, {"least": 100000})


_SOURCE = """SELECT o_orderpriority AS tenant_id, 'own_orders' AS source_key, CAST(o_custkey AS STRING) AS entity_id, CAST(o_orderdate AS DATE) AS metric_date, inline(array(named_struct('k', 'spent', 'v', o_totalprice), named_struct('k', 'orders', 'v', 1.0D))) AS (measure_key, value),
CAST(o_orderkey AS STRING) AS subject_key, CAST(NULL AS ARRAY<STRUCT<key: STRING, value: STRING, label: STRING>>) AS dimensions FROM orders"""


@query(f"SELECT CAST(o_custkey AS VARCHAR) AS entity_id, round(sum(o_totalprice), 4) AS own_spent, round(sum(o_totalprice) / count(*), 4) AS own_average FROM orders WHERE o_orderpriority = '{_TENANT}' AND o_orderdate >= '1995-01-01' GROUP BY 1")
def gated_metric_source(spark, d):
    observations = gate.observations_by_sql(spark, _SOURCE, _relations(spark, d), _TENANT, "own_orders")
    own = [Metric("own.spent", "sum", "own_orders", ("spent",)), Metric("own.average", "ratio", "own_orders", ("spent",), ("orders",))]
    return _rounded(period(observations, own, Scope(_TENANT, "1995-01-01")))


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '{_TENANT}' AND o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 500 OFFSET 20")
def tenant_rows(spark, d):
    return gate.tenant_rows(_relations(spark, d)["orders"], _TENANT, ["o_orderkey", "o_totalprice"], [("o_orderstatus", "in", ["F", "O"]), ("o_totalprice", ">=", 1000)], ["o_totalprice desc", "o_orderkey"], 500, 20)


# -- the built-in metrics, on observations of all of their measures

#: Every measure that a built-in metric reads, with the dimensions that any of its metrics has.
_MEASURES = sorted({(m.source_key, k) for m in METRICS.values() for k in (*m.measures, *m.denominator)})
_OF = [sorted({x for m in METRICS.values() if m.source_key == s and k in (*m.measures, *m.denominator) for x in m.dimensions}) for s, k in _MEASURES]
#: So many events of each turn have no measure; a few measures are never observed.
_TURN, _SEEN = len(_MEASURES) + 5, len(_MEASURES) - 2


def _builtin(spark, d):
    """Events in turn as observations of the measures; those of every seventh measure lack its last dimension where k is odd."""
    rows = [(i, s, k, of) for i, ((s, k), of) in enumerate(zip(_MEASURES, _OF, strict=True)) if i < _SEEN]
    measures = spark.createDataFrame(rows, "i int, source_key string, measure_key string, keys array<string>")
    e = A.events(spark, d).withColumn("i", (F.col("event_id") % _TURN).cast("int")).withColumn("k", F.get_json_object("props", "$.k").try_cast("long"))
    cut = (F.col("i") % 7 == 3) & (F.col("k") % 2 == 1)
    keys = F.when(cut, F.slice("keys", F.lit(1), F.greatest(F.size("keys") - 1, F.lit(0)))).otherwise(F.col("keys"))
    tags = F.transform(keys, lambda x: F.struct(x.alias("key"), F.col("k").cast("string").alias("value"), F.col("k").cast("string").alias("label")))
    out = e.join(measures, "i")
    return out.select(
        F.lit("t0").alias("tenant_id"), "source_key", F.col("user_id").cast("string").alias("entity_id"), F.to_date("ts").alias("metric_date"), "measure_key", "value", F.to_date("ts").cast("string").alias("subject_key"),
        tags.alias("dimensions"), F.when((F.col("i") % 11 == 5) & (F.col("k") == 7), "source_summary").otherwise("event").alias("granularity"),
    )


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("[" + ", ".join(f"'{y}'" for y in x) + "]::VARCHAR[]" if isinstance(x, (list, tuple)) else "NULL" if x is None else str(x) if isinstance(x, (int, float)) else f"'{x}'" for x in r) + ")" for r in rows)


_BUILTIN = f"""ms(i, source_key, measure_key, keys) AS (VALUES {_values((i, s, k, of) for i, ((s, k), of) in enumerate(zip(_MEASURES, _OF, strict=True)) if i < _SEEN)}),
b AS (SELECT source_key, measure_key, CAST(user_id AS VARCHAR) AS entity_id, CAST(ts AS DATE) AS metric_date, value, CAST(CAST(ts AS DATE) AS VARCHAR) AS subject_key, i, k,
  CASE WHEN i % 7 = 3 AND k % 2 = 1 THEN keys[1:len(keys) - 1] ELSE keys END AS keys, CASE WHEN i % 11 = 5 AND k = 7 THEN 'source_summary' ELSE 'event' END AS granularity
  FROM (SELECT *, event_id % {_TURN} AS i, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) JOIN ms USING (i))"""
_NEED = f"need(metric_key, source_key, measure_key, dims) AS (VALUES {_values((m.key, m.source_key, k, m.dimensions) for m in METRICS.values() for k in dict.fromkeys((*m.measures, *m.denominator)))})"


@query(f"""WITH {_BUILTIN}, {_NEED},
l AS (SELECT source_key, measure_key, max(metric_date) AS last FROM b GROUP BY 1, 2),
u AS (SELECT metric_key, source_key, measure_key, unnest(dims) AS dim FROM need),
c AS (SELECT DISTINCT metric_key, dim FROM u JOIN l USING (source_key, measure_key) JOIN b USING (source_key, measure_key) WHERE metric_date >= last - 35 AND NOT list_contains(keys, dim)),
w AS (SELECT metric_key, min(last) - 35 AS since FROM need JOIN l USING (source_key, measure_key) GROUP BY 1),
g AS (SELECT DISTINCT metric_key, measure_key FROM need JOIN w USING (metric_key) JOIN b USING (source_key, measure_key) WHERE metric_date >= since AND granularity <> 'event')
SELECT metric_key, CASE WHEN any_value(uncovered) <> '' THEN 'error' WHEN count(*) FILTER (last IS NULL) > 0 THEN 'unchecked' ELSE 'ok' END AS state, CASE WHEN any_value(uncovered) <> '' THEN 'dimension_not_covered' END AS error_code,
  CAST(max(last) AS VARCHAR) AS last_observed, coalesce(string_agg(measure_key, ',' ORDER BY measure_key) FILTER (last IS NULL), '') AS unobserved, any_value(uncovered) AS uncovered, any_value(conflicts) AS grain_conflicts
FROM (SELECT *, coalesce((SELECT string_agg(dim, ',' ORDER BY dim) FROM c WHERE c.metric_key = need.metric_key), '') AS uncovered, coalesce((SELECT string_agg(measure_key, ',' ORDER BY measure_key) FROM g WHERE g.metric_key = need.metric_key), '') AS conflicts FROM need)
LEFT JOIN l USING (source_key, measure_key) GROUP BY metric_key""")
def definition_probes(spark, d):
    """All built-in metrics from one profile; the profile is merged from those of the rows of odd and of even days."""
    b = _builtin(spark, d)
    halves = [b.where(F.dayofmonth("metric_date") % 2 == k) for k in (0, 1)]
    found = saved(probes.merged(*[probes.profile(h, h) for h in halves]), "profile")
    out = probes.statuses(found, list(METRICS.values()), dict.fromkeys(_MEASURES, "event"))
    return out.select("metric_key", "state", "error_code", F.col("last_observed").cast("string").alias("last_observed"), *[F.array_join(c, ",").alias(c) for c in ("unobserved", "uncovered", "grain_conflicts")])


def _metric_rows(metrics):
    for m in metrics:
        t = m.transform
        yield m.key, m.kind, m.source_key, m.measures, m.denominator, float(m.scale), float(t.multiplier if t else 1), float(t.offset if t else 0), t.low if t else None, t.high if t else None


def _many_sql(metrics, source: str) -> str:
    """Values of metrics over rows b (entity_id, source_key, measure_key, value, subject_key)."""
    return f"""WITH {source}, mt(metric_key, kind, source_key, over_, under_, scale, factor, plus, low, high) AS (VALUES {_values(_metric_rows(metrics))}),
v AS (SELECT mt.metric_key, entity_id, any_value(kind) AS kind, any_value(scale) AS scale, any_value(factor) AS factor, any_value(plus) AS plus, any_value(low) AS low, any_value(high) AS high,
  sum(value) FILTER (list_contains(over_, measure_key)) AS top, sum(value) FILTER (list_contains(under_, measure_key)) AS bottom, count(DISTINCT subject_key) AS subjects,
  list_sort(list(value) FILTER (value IS NOT NULL))[count(value) // 2 + 1] AS middle
  FROM mt JOIN b ON b.source_key = mt.source_key AND (list_contains(over_, measure_key) OR list_contains(under_, measure_key)) GROUP BY 1, 2),
x AS (SELECT metric_key, entity_id, low, high, factor * CAST(CASE kind WHEN 'sum' THEN top WHEN 'median' THEN middle WHEN 'distinct' THEN subjects ELSE top * scale / nullif(bottom, 0) END AS DOUBLE) + plus AS x FROM v)
SELECT entity_id, metric_key, round(CASE WHEN x < low THEN low WHEN x > high THEN high ELSE x END, 4) AS value FROM x WHERE x IS NOT NULL"""


@query(_many_sql(METRICS.values(), _BUILTIN))
def builtin_metrics(spark, d):
    """All built-in metrics at once."""
    return _rounded(custom.evaluate_many(_builtin(spark, d), list(METRICS.values())))


# -- fifty metrics of one source

_KINDS = ("view", "click", "purchase", "signup", "error")


def _graphs():
    """Metrics of all kinds over the events, as their authors would write them."""
    for i in range(50):
        a, b = _KINDS[i % 5], _KINDS[(i // 5 + 1 + i) % 5]
        computation = ("sum", "ratio", "median", "distinct_count")[i % 4]
        inputs = (("numerator", a), ("denominator", b)) if computation == "ratio" else (("value", a),)
        yield custom.CustomMetric(
            f"own.m{i}", f"Metric {i}", computation, "events", "SELECT * FROM observations;", tuple(dict.fromkeys((a, b))), inputs, dimensions=("bucket",), scale=100.0 if computation == "ratio" else None,
            transform=(float(1 + i % 3), float(i % 2), None, 500.0) if i % 6 == 0 else None,
        )


@query(_many_sql([g.compiled() for g in _graphs()], "b AS (SELECT CAST(user_id AS VARCHAR) AS entity_id, 'events' AS source_key, event_type AS measure_key, value, CAST(CAST(ts AS DATE) AS VARCHAR) AS subject_key FROM events)"))
def custom_metrics(spark, d):
    """Metrics that were written out as JSON, read again, checked, and evaluated over their own gated source."""
    texts = custom.export_metrics({g.metric_key: g for g in _graphs()})
    graphs = [custom.CustomMetric.from_json(t) for t in texts]
    relations = {"observations": Relation(A.observations(spark, d))}
    if wrong := [v for g in graphs for v in g.violations(spark, list(relations))]:
        raise ValueError(wrong)
    observations = gate.observations_by_sql(spark, graphs[0].observation_sql, relations, "t0", "events")
    return _rounded(custom.evaluate_many(observations, [g.compiled() for g in graphs]))
