"""A registered query for each operator, on the tables at hand, and the SQL with the same result. Sums are rounded: their order varies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analogs as A
from .functions import text as T
from .functions.dimensions import label_of, value_of
from .operators import dedup, hierarchy, history, incremental, measures, sequences
from .plans import drilldown, metrics, usage
from .plans.metrics import Metric, Scope, Transform
from .runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, dates: str = "", stamps: str = ""):
    """Register a function under its name, with the SQL that gives the same rows. Dates go out as text, times as microseconds."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: F.col(c).cast("string") for c in dates.split()} | {c: F.unix_micros(F.col(c).cast("timestamp")).cast("string") for c in stamps.split()})

        QUERIES[f.__name__] = run
        if sql:
            casts = [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()] + [f"CAST(epoch_us({c}) AS VARCHAR) AS {c}" for c in stamps.split()]
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql
        return f

    return register


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_SUM = Metric("events.view_value", "sum", "events", ("view",))
_CLICKS = Metric("events.click_value", "sum", "events", ("click", "signup"))
_RATIO = Metric("events.purchase_rate", "ratio", "events", ("purchase",), ("view",), 100.0)
_MEDIAN = Metric("events.median_value", "median", "events", ("view", "click", "purchase"))
_DAYS = Metric("events.active_days", "distinct", "events", ("view", "click"))
_TOTAL = Metric("orders.total", "sum", "orders", ("total",))
_DONE = Metric("orders.finished_rate", "ratio", "orders", ("finished",), ("orders",), 100.0)
_WINDOW = Scope("t0", "2024-01-03", "2024-01-25")
_SPAN = "metric_date BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'"

#: SQL of the observations.
_O = """o AS (SELECT 't0' AS tenant_id, 'events' AS source_key, CAST(user_id AS VARCHAR) AS entity_id, CAST(ts AS DATE) AS metric_date, event_type AS measure_key, value,
  CAST(CAST(ts AS DATE) AS VARCHAR) AS subject_key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id, ts, user_id FROM events)"""
_OO = """oo AS (SELECT CAST(o_custkey AS VARCHAR) AS entity_id, CAST(o_orderdate AS DATE) AS metric_date, o_totalprice, o_orderstatus, o_orderpriority FROM orders)"""


def _q(p: float, x: str = "value") -> str:
    """SQL of the value at place floor(p * n) of the sorted values."""
    return f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL))[CAST(least(count({x}) - 1, floor({p} * count({x}))) AS BIGINT) + 1]"


# -- metric views


@query(f"""WITH {_O} SELECT entity_id, round(sum(value) FILTER (WHERE measure_key = 'view'), 4) AS events_view_value, round(sum(value) FILTER (WHERE measure_key IN ('click', 'signup')), 4) AS events_click_value
FROM o WHERE {_SPAN} AND measure_key IN ('view', 'click', 'signup') GROUP BY entity_id""")
def metric_period_sum(spark, d):
    return _rounded(metrics.period(A.observations(spark, d), [_SUM, _CLICKS], _WINDOW))


@query(f"""WITH {_O} SELECT entity_id, round(100 * sum(value) FILTER (WHERE measure_key = 'purchase') / nullif(sum(value) FILTER (WHERE measure_key = 'view'), 0), 4) AS events_purchase_rate
FROM o WHERE {_SPAN} AND measure_key IN ('purchase', 'view') GROUP BY entity_id""")
def metric_period_ratio(spark, d):
    return _rounded(metrics.period(A.observations(spark, d), [_RATIO], _WINDOW))


@query(f"WITH {_O} SELECT entity_id, {_q(0.5)} AS events_median_value FROM o WHERE {_SPAN} AND measure_key IN ('view', 'click', 'purchase') GROUP BY entity_id")
def metric_period_median(spark, d):
    return metrics.period(A.observations(spark, d), [_MEDIAN], _WINDOW)


@query(f"WITH {_O} SELECT entity_id, CAST(count(DISTINCT subject_key) AS DOUBLE) AS events_active_days FROM o WHERE {_SPAN} AND measure_key IN ('view', 'click') GROUP BY entity_id")
def metric_period_distinct(spark, d):
    return metrics.period(A.observations(spark, d), [_DAYS], _WINDOW)


@query(f"""WITH {_O}, a AS (SELECT entity_id, round(sum(value) FILTER (WHERE measure_key = 'view'), 4) AS events_view_value,
  round(100 * sum(value) FILTER (WHERE measure_key = 'purchase') / nullif(sum(value) FILTER (WHERE measure_key = 'view'), 0), 4) AS events_purchase_rate,
  CASE WHEN count(*) FILTER (WHERE measure_key IN ('view', 'click')) > 0 THEN CAST(count(DISTINCT subject_key) FILTER (WHERE measure_key IN ('view', 'click')) AS DOUBLE) END AS events_active_days
  FROM o WHERE {_SPAN} AND measure_key IN ('view', 'click', 'purchase') GROUP BY entity_id),
m AS (SELECT entity_id, {_q(0.5)} AS events_median_value FROM o WHERE {_SPAN} AND measure_key IN ('view', 'click', 'purchase') GROUP BY entity_id)
SELECT * FROM a FULL JOIN m USING (entity_id)""")
def metric_period_batch(spark, d):
    return _rounded(metrics.period(A.observations(spark, d), [_SUM, _RATIO, _DAYS, _MEDIAN], _WINDOW))


def _series_sql(grain: str) -> str:
    bucket = "metric_date" if grain == "day" else f"CAST(date_trunc('{grain}', metric_date) AS DATE)"
    return f"WITH {_O} SELECT entity_id, bucket, round(sum(value), 4) AS value FROM (SELECT *, {bucket} AS bucket FROM o WHERE measure_key = 'view' AND {_SPAN}) GROUP BY GROUPING SETS ((entity_id, bucket), (entity_id))"


@query(_series_sql("day"), dates="bucket")
def metric_timeseries_day(spark, d):
    return _rounded(metrics.timeseries(A.observations(spark, d), _SUM, "day", _WINDOW))


@query(_series_sql("week"), dates="bucket")
def metric_timeseries_week(spark, d):
    return _rounded(metrics.timeseries(A.observations(spark, d), _SUM, "week", _WINDOW))


@query(_series_sql("month"), dates="bucket")
def metric_timeseries_month(spark, d):
    return _rounded(metrics.timeseries(A.observations(spark, d), _SUM, "month", _WINDOW))


@query(f"""WITH {_O}, x AS (SELECT entity_id, CAST(date_trunc('week', metric_date) AS DATE) AS bucket, value FROM o WHERE measure_key IN ('view', 'click', 'purchase') AND {_SPAN})
SELECT entity_id, bucket, {_q(0.5)} AS value FROM x GROUP BY entity_id, bucket UNION ALL SELECT entity_id, NULL, {_q(0.5)} FROM x GROUP BY entity_id""", dates="bucket")
def metric_timeseries_median(spark, d):
    return metrics.timeseries(A.observations(spark, d), _MEDIAN, "week", _WINDOW)


@query(f"""WITH {_O}, s AS (SELECT entity_id, metric_date AS bucket, round(sum(value), 4) AS value FROM o WHERE measure_key = 'view' AND {_SPAN} GROUP BY 1, 2),
spine AS (SELECT entity_id, CAST(unnest(generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-25', INTERVAL 1 DAY)) AS DATE) AS bucket FROM (SELECT DISTINCT entity_id FROM s))
SELECT entity_id, bucket, value FROM spine LEFT JOIN s USING (entity_id, bucket)""", dates="bucket")
def metric_timeseries_dense(spark, d):
    s = metrics.timeseries(A.observations(spark, d), _SUM, "day", _WINDOW, totals=False)
    return _rounded(metrics.densify(s, "day", "2024-01-03", "2024-01-25"))


@query(f"""WITH {_O} SELECT CAST(row_number() OVER (ORDER BY sum(value) DESC, CAST(k % 10 AS VARCHAR)) AS INTEGER) AS rank, CAST(k % 10 AS VARCHAR) AS dimension, 'Bucket ' || (k % 10) AS label, round(sum(value), 4) AS value
FROM o WHERE measure_key = 'view' GROUP BY k % 10 ORDER BY rank LIMIT 3""")
def metric_ranking(spark, d):
    return _rounded(metrics.ranking(A.observations(spark, d), _SUM, "bucket", 3))


@query(f"""WITH {_O}, x AS (SELECT CAST(k % 10 AS VARCHAR) AS dim, CAST(date_trunc('week', metric_date) AS DATE) AS bucket, value FROM o WHERE measure_key = 'view'),
t AS (SELECT dim, row_number() OVER (ORDER BY sum(value) DESC, dim) AS rank FROM x GROUP BY dim QUALIFY rank <= 3)
SELECT CAST(coalesce(rank, 0) AS INTEGER) AS rank, bucket, round(sum(value), 4) AS value FROM x LEFT JOIN t USING (dim) GROUP BY GROUPING SETS ((coalesce(rank, 0), bucket), (coalesce(rank, 0)))""", dates="bucket")
def metric_topk_other(spark, d):
    return _rounded(metrics.capped_timeseries(A.observations(spark, d), _SUM, "bucket", 3, "week"))


@query(f"""WITH {_O} SELECT entity_id, CAST(k % 10 AS VARCHAR) AS bucket_value, 'Bucket ' || (k % 10) AS bucket_label, CASE WHEN k % 2 = 0 THEN 'even' ELSE '__unknown__' END AS parity_value,
  CASE WHEN k % 2 = 0 THEN 'Even' ELSE 'Unknown' END AS parity_label, round(sum(value), 4) AS value FROM o WHERE measure_key = 'view' GROUP BY ALL""")
def metric_breakdown(spark, d):
    return _rounded(metrics.breakdown(A.observations(spark, d), _SUM, ["bucket", "parity"]))


@query(f"WITH {_O} SELECT entity_id, round(sum(value), 4) AS events_view_value FROM o WHERE measure_key = 'view' AND k % 2 = 0 AND k % 10 IN (2, 4) GROUP BY entity_id")
def metric_dimension_filter(spark, d):
    scope = Scope(filters={"parity": ["even"], "bucket": ["2", "4"]})
    return _rounded(metrics.period(A.observations(spark, d), [_SUM], scope))


@query(f"""WITH {_O}, x AS (SELECT entity_id, value FROM o WHERE measure_key IN ('view', 'click', 'purchase')), b AS (SELECT entity_id, min(value) AS low, max(value) AS high FROM x GROUP BY entity_id)
SELECT entity_id, CAST(CASE WHEN high = low THEN 0 ELSE least(9, floor((value - low) * 10 / (high - low))) END AS INTEGER) AS bin, count(*) AS count, low, high FROM x JOIN b USING (entity_id) GROUP BY ALL""")
def metric_histogram(spark, d):
    return metrics.histogram(A.observations(spark, d), _MEDIAN)


def _peer_sql(keys: str, join: str, cohort: str) -> str:
    stats = ", ".join(f"CASE WHEN n >= 5 THEN round({c}, 4) END AS {a}" for c, a in (("p25", "p25"), ("med", "median"), ("p75", "p75"), ("lo", "min"), ("hi", "max")))
    return f"""WITH {_OO}, v AS (SELECT entity_id, sum(o_totalprice) AS value FROM oo GROUP BY entity_id), c AS (SELECT CAST(c_custkey AS VARCHAR) AS entity_id, CAST(c_nationkey AS VARCHAR) AS cohort_id FROM customer),
s AS (SELECT {keys} count(*) AS n, {_q(0.25)} AS p25, {_q(0.5)} AS med, {_q(0.75)} AS p75, min(value) AS lo, max(value) AS hi FROM v JOIN c USING (entity_id) {"GROUP BY cohort_id" if keys else ""})
SELECT entity_id, {cohort} round(value, 4) AS value, n, {stats} FROM {join}"""


@query(_peer_sql("cohort_id,", "c LEFT JOIN v USING (entity_id) LEFT JOIN s USING (cohort_id)", "cohort_id,"))
def metric_peer_cohort(spark, d):
    """Each customer's orders beside those of its nation."""
    cohorts = A.nation_cohorts(spark, d)
    return _rounded(metrics.peers(A.order_observations(spark, d), _TOTAL, cohorts, cohorts.select("entity_id")))


@query(_peer_sql("", "v CROSS JOIN s", ""))
def metric_peer_tenant(spark, d):
    return _rounded(metrics.tenant_peers(A.order_observations(spark, d), _TOTAL))


@query(f"""WITH {_O}, r AS (SELECT entity_id, 100 * sum(value) FILTER (WHERE measure_key = 'purchase') / nullif(sum(value) FILTER (WHERE measure_key = 'view'), 0) AS x FROM o WHERE {_SPAN} AND measure_key IN ('purchase', 'view') GROUP BY entity_id)
SELECT entity_id, round(CASE WHEN x IS NOT NULL THEN least(100, greatest(0, 100 - x)) END, 4) AS events_purchase_rate FROM r""")
def metric_transform_clamp(spark, d):
    from dataclasses import replace

    return _rounded(metrics.period(A.observations(spark, d), [replace(_RATIO, transform=Transform(-1.0, 100.0, 0.0, 100.0))], _WINDOW))


@query(f"WITH {_OO} SELECT entity_id, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 4) AS orders_finished_rate FROM oo GROUP BY entity_id")
def metric_ratio_of_orders(spark, d):
    return _rounded(metrics.period(A.order_observations(spark, d), [_DONE]))


# -- drill-down and usage


_E = """e AS (SELECT CAST(l_suppkey AS VARCHAR) AS entity_id, CAST(l_shipdate AS DATE) AS metric_date, lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || '-' || l_linenumber AS record_id, l_extendedprice, l_discount, l_returnflag FROM lineitem)"""


@query(f"""WITH {_E} SELECT metric_date, entity_id, 'orders' AS source_key, 'price' AS measure_key, record_id, l_extendedprice AS contribution FROM e
WHERE l_returnflag = 'A' AND (CAST(metric_date AS VARCHAR), entity_id, 'orders', 'price', record_id) > ('1995-06-01', '5', 'orders', 'price', '0000000000-1')
ORDER BY CAST(metric_date AS VARCHAR), entity_id, record_id LIMIT 101""", dates="metric_date")
def drilldown_page(spark, d):
    after = ["1995-06-01", "5", "orders", "price", "0000000000-1"]
    return drilldown.page(A.lineitem_evidence(spark, d), [("orders", "price")], {"flag": ["A"]}, after).select(*drilldown.KEY, "contribution")


@query(f"WITH {_E} SELECT entity_id, metric_date, round(sum(l_extendedprice * l_discount), 4) AS numerator, round(sum(l_extendedprice), 4) AS denominator FROM e GROUP BY entity_id, metric_date", dates="metric_date")
def drilldown_ratio_daily(spark, d):
    return _rounded(drilldown.ratio_by_day(A.lineitem_evidence(spark, d), ["discounted"], ["price"]))


_U = """u AS (SELECT user_id AS person_id, ts AS event_time, CASE WHEN event_type = 'view' THEN 'page_view' ELSE event_type END AS event_name, '/page/' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 10) AS path,
  CASE WHEN event_type = 'error' THEN '' ELSE user_id || ':' || CAST(ts AS DATE) END AS session_id FROM events)"""


@query(f"WITH {_U} SELECT count(*) AS events, count(DISTINCT nullif(session_id, '')) AS visits, count(DISTINCT person_id) AS people FROM u")
def usage_summary_totals(spark, d):
    return usage.totals(A.clickstream(spark, d))


@query(f"WITH {_U} SELECT CAST(event_time AS DATE) AS day, count(*) AS events, count(DISTINCT nullif(session_id, '')) AS visits, count(DISTINCT person_id) AS people FROM u GROUP BY 1", dates="day")
def usage_summary_by_day(spark, d):
    return usage.by_day(A.clickstream(spark, d))


@query(f"WITH {_U} SELECT person_id, count(*) AS events, count(DISTINCT nullif(session_id, '')) AS visits FROM u GROUP BY 1")
def usage_summary_by_person(spark, d):
    return usage.by_person(A.clickstream(spark, d)).drop("last_seen")


@query(f"WITH {_U} SELECT path, count(*) AS views, count(DISTINCT person_id) AS people FROM u WHERE event_name = 'page_view' GROUP BY 1 ORDER BY views DESC, path LIMIT 200")
def usage_summary_by_page(spark, d):
    return usage.by_page(A.clickstream(spark, d))


@query(f"WITH {_U} SELECT event_name, count(*) AS actions, count(DISTINCT person_id) AS people FROM u WHERE event_name <> 'page_view' GROUP BY 1 ORDER BY actions DESC, event_name LIMIT 200")
def usage_summary_by_action(spark, d):
    return usage.by_action(A.clickstream(spark, d))


# -- latest rows, content, unions


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_by_key(spark, d):
    return dedup.latest_values(A.events(spark, d), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


@query("SELECT o_custkey, o_orderstatus, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, nullif(o_orderstatus, 'P'), o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1")
def first_by_content(spark, d):
    """The first order of each customer, status and priority; pending ones have no status and count as equal."""
    o = table(spark, d, "orders").withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    return dedup.first_by_content(o, ["o_custkey", "status", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey")


@query("""WITH x AS (SELECT event_id, user_id, value, 1 AS v FROM events WHERE event_type IN ('view', 'click', 'purchase') UNION ALL SELECT event_id, user_id, value * 2, 2 FROM events WHERE event_type IN ('purchase', 'signup'))
SELECT event_id, user_id, value, v AS version FROM x QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY v DESC) = 1""")
def union_class_dedup(spark, d):
    e = A.events(spark, d)
    first = e.where("event_type IN ('view', 'click', 'purchase')").select("event_id", "user_id", "value", F.lit(1).alias("version"))
    second = e.where("event_type IN ('purchase', 'signup')").select("event_id", "user_id", (F.col("value") * 2).alias("value"), F.lit(2).alias("version"))
    return dedup.class_union([first, second], ["event_id"], ["version"])


@query("SELECT user_id % 50 AS person, measure_key, round(CASE WHEN measure_key = 'error' THEN max(value) WHEN measure_key = 'signup' THEN min(value) ELSE sum(value) END, 4) AS value FROM (SELECT *, event_type AS measure_key FROM events) GROUP BY 1, 2")
def alias_collapse(spark, d):
    e = A.events(spark, d).select((F.col("user_id") % 50).alias("person"), F.col("event_type").alias("measure_key"), "value")
    return _rounded(dedup.alias_collapse(e, ["person"], "measure_key", "value", most=["error"], least=["signup"]))


@query("SELECT o_custkey, min(o_orderstatus) AS o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1")
def unique_claim_map(spark, d):
    return dedup.unanimous(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus")


@query("""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY o_custkey) AS top FROM c)
SELECT o_custkey, n, min(o_orderpriority) AS o_orderpriority FROM m WHERE n = top GROUP BY o_custkey, n HAVING count(*) = 1""")
def mode_unique(spark, d):
    return dedup.unique_mode(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@query("""WITH n AS (SELECT event_id, user_id, value + 1 AS value FROM events WHERE event_type = 'click') SELECT event_id, user_id, value FROM events WHERE event_id NOT IN (SELECT event_id FROM n) UNION ALL SELECT * FROM n""")
def keyed_replace(spark, d):
    e = A.events(spark, d).select("event_id", "user_id", "value", "event_type")
    new = e.where("event_type = 'click'").withColumn("value", F.col("value") + 1)
    return dedup.keyed_replace(e.drop("event_type"), new.drop("event_type"), ["event_id"])


# -- measures


_DIMS = "[{'key': 'bucket', 'value': CAST(k % 10 AS VARCHAR)}]"


@query(f"WITH {_O} SELECT entity_id, metric_date, CAST(k % 10 AS VARCHAR) AS bucket, k % 2 = 0 AS even, round(sum(value), 4) AS value FROM o WHERE measure_key = 'view' GROUP BY ALL", dates="metric_date")
def sum_measure(spark, d):
    e = A.observations(spark, d).where("measure_key = 'view'").drop("measure_key")
    out = measures.sum_measure(e, "views", F.col("value"))
    return _rounded(out.select("entity_id", "metric_date", value_of(F.col("dimensions"), "bucket").alias("bucket"), (value_of(F.col("dimensions"), "parity") == "even").alias("even"), "value"))


@query(f"WITH {_O} SELECT entity_id, metric_date, 'Bucket ' || (k % 10) AS label, value FROM o WHERE measure_key = 'view'", dates="metric_date")
def event_measure(spark, d):
    e = A.observations(spark, d).where("measure_key = 'view'").drop("measure_key")
    return measures.event_measure(e, "view_size", F.col("value")).select("entity_id", "metric_date", label_of(F.col("dimensions"), "bucket").alias("label"), "value")


@query(f"WITH {_O} SELECT DISTINCT entity_id, metric_date, 'active_day' AS measure_key, CAST(1 AS DOUBLE) AS value FROM o WHERE measure_key IN ('view', 'purchase')", dates="metric_date")
def presence_union(spark, d):
    o = A.observations(spark, d)
    return measures.presence_measure([o.where("measure_key = 'view'"), o.where("measure_key = 'purchase'")], "active_day").select("entity_id", "metric_date", "measure_key", "value")


@query(f"WITH {_O} SELECT DISTINCT entity_id, metric_date, CAST(k AS VARCHAR) AS subject_key, CAST(1 AS DOUBLE) AS value FROM o WHERE measure_key = 'click'", dates="metric_date")
def distinct_measure(spark, d):
    e = A.events(spark, d).where("event_type = 'click'").withColumn("k", F.get_json_object("props", "$.k"))
    e = e.select(F.lit("t0").alias("tenant_id"), F.col("user_id").cast("string").alias("entity_id"), F.to_date("ts").alias("metric_date"), F.array().cast("array<struct<key:string,value:string,label:string>>").alias("dimensions"), "k")
    return measures.distinct_measure(e, "subjects", F.col("k")).select("entity_id", "metric_date", "subject_key", "value")


# -- sequences


@query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1800 SECOND THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g""")
def sessionize(spark, d):
    return sequences.sessionize(A.events(spark, d), ["user_id"], "ts", "event_id", 1800).select("user_id", "event_id", "session")


_AS_OF = "2024-02-01 00:00:00"


@query(f"""WITH s AS (SELECT user_id, event_type, ts AS span_start, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '{_AS_OF}') AS span_end FROM events)
SELECT user_id, event_type, round(sum(epoch_us(span_end) - epoch_us(span_start)) / 1e6, 3) AS seconds, count(*) AS n FROM s WHERE span_end >= span_start GROUP BY 1, 2""")
def status_spans(spark, d):
    s = sequences.spans(A.events(spark, d), ["user_id"], "ts", "event_id", "event_type", F.lit(_AS_OF).cast("timestamp"))
    return s.groupBy("user_id", "event_type").agg(F.round(F.sum(F.unix_micros("span_end") - F.unix_micros("span_start")) / 1e6, 3).alias("seconds"), F.count("*").alias("n"))


_SPANS = f"s AS (SELECT user_id, event_type, ts AS a, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '{_AS_OF}') AS b FROM events)"
_DAYS_SQL = f"""{_SPANS}, x AS (SELECT *, CAST(unnest(generate_series(date_trunc('day', a), date_trunc('day', b), INTERVAL 1 DAY)) AS TIMESTAMP) AS day FROM s WHERE event_type = 'view'),
p AS (SELECT user_id, CAST(day AS DATE) AS day, round(sum(greatest(0, epoch_us(least(b, day + INTERVAL 1 DAY)) - epoch_us(greatest(a, day)))) / 1e6, 3) AS seconds FROM x GROUP BY 1, 2)"""


def _day_slices(spark, d):
    s = sequences.spans(A.events(spark, d), ["user_id"], "ts", "event_id", "event_type", F.lit(_AS_OF).cast("timestamp")).where("event_type = 'view'")
    return sequences.by_day(s).groupBy("user_id", "day").agg(F.round(F.sum(F.round(F.col("seconds") * 1e6).cast("long")) / 1e6, 3).alias("seconds"))


@query(f"WITH {_DAYS_SQL} SELECT * FROM p", dates="day")
def span_day_split(spark, d):
    return _day_slices(spark, d)


@query(f"""WITH {_DAYS_SQL}, w AS (SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 3) AS logged FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT user_id, day, coalesce(seconds, 0) AS seconds, coalesce(logged, 0) AS logged FROM p FULL JOIN w USING (user_id, day)""", dates="day")
def full_outer_days(spark, d):
    w = A.events(spark, d).where("event_type = 'purchase'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 3).alias("logged"))
    return _day_slices(spark, d).join(w, ["user_id", "day"], "full_outer").fillna(0, ["seconds", "logged"])


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), e AS (SELECT user_id, ts AS error_at FROM events WHERE event_type = 'error')
SELECT event_id, user_id, (SELECT min(error_at) FROM e WHERE e.user_id = p.user_id AND error_at > ts AND error_at <= ts + INTERVAL 14 DAY) AS reopened_at FROM p""", stamps="reopened_at")
def transitions_reopen(spark, d):
    e = A.events(spark, d)
    p, x = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'error'").select("user_id", F.col("ts").alias("error_at"))
    return sequences.next_within(p, x, ["user_id"], "ts", "error_at", 14, "reopened_at").drop("ts")


@query("""WITH r AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS reading FROM events GROUP BY 1, 2),
c AS (SELECT *, min(reading) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS corrected FROM r)
SELECT user_id, day, round(corrected - coalesce(lag(corrected) OVER w, 0), 4) AS step, CAST(day - coalesce(lag(day) OVER w, DATE '2023-12-31') AS INTEGER) AS covers_days FROM c WINDOW w AS (PARTITION BY user_id ORDER BY day)""", dates="day")
def cumulative_step(spark, d):
    r = A.events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("reading"))
    out = sequences.cumulative_steps(r, ["user_id"], "day", "reading", F.lit("2023-12-31").cast("date"))
    return _rounded(out.select("user_id", "day", "step", "covers_days"))


@query(f"""WITH {_SPANS}, v AS (SELECT user_id, a, b FROM s WHERE event_type = 'view'), w AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS c, ts + INTERVAL 6 HOUR AS e FROM events WHERE event_type = 'purchase')
SELECT user_id, greatest(a, c) AS overlap_start, least(b, e) AS overlap_end FROM v JOIN w USING (user_id) WHERE a < e AND c < b""", stamps="overlap_start overlap_end")
def interval_overlap_join(spark, d):
    e = A.events(spark, d)
    v = sequences.spans(e, ["user_id"], "ts", "event_id", "event_type", F.lit(_AS_OF).cast("timestamp")).where("event_type = 'view'")
    w = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("c"), (F.col("ts") + F.expr("INTERVAL 6 HOUR")).alias("e"))
    return sequences.overlaps(v, w, ["user_id"], ("span_start", "span_end"), ("c", "e")).select("user_id", "overlap_start", "overlap_end")


# -- history


_V = "v AS (SELECT o_custkey, CAST(o_orderdate AS TIMESTAMP) AS changed_at, o_orderkey, o_orderstatus, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1)"


def _versions(spark, d):
    o = table(spark, d, "orders").withColumn("changed_at", F.col("o_orderdate").cast("timestamp"))
    return dedup.latest_values(o, ["o_custkey", "changed_at"], ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


_HISTORY = f"""{_V}, l AS (SELECT o_custkey, changed_at, [{{'field': 'o_orderstatus', 'o': coalesce(lag(o_orderstatus) OVER w, ''), 'n': coalesce(o_orderstatus, '')}}, {{'field': 'o_orderpriority', 'o': coalesce(lag(o_orderpriority) OVER w, ''), 'n': coalesce(o_orderpriority, '')}}] AS xs
  FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY changed_at)), y AS (SELECT o_custkey, changed_at, unnest(xs) AS x FROM l), h AS (SELECT o_custkey, changed_at, x.field AS field, x.o AS old_value, x.n AS new_value FROM y WHERE x.o <> x.n)"""


@query(f"WITH {_HISTORY} SELECT * FROM h", stamps="changed_at")
def field_history(spark, d):
    return history.fields_history(_versions(spark, d), ["o_custkey"], "changed_at", ["o_orderstatus", "o_orderpriority"])


@query(f"WITH {_HISTORY} SELECT * FROM h", stamps="changed_at")
def field_history_map(spark, d):
    v = _versions(spark, d).withColumn("fields", F.create_map(F.lit("o_orderstatus"), "o_orderstatus", F.lit("o_orderpriority"), "o_orderpriority"))
    return history.map_history(v, ["o_custkey"], "changed_at", "fields")


@query(f"""WITH {_HISTORY}, c AS (SELECT o_custkey, field, CASE WHEN new_value = 'P' THEN '' ELSE new_value END AS value, changed_at AS valid_from, lead(changed_at) OVER (PARTITION BY o_custkey, field ORDER BY changed_at) AS valid_to FROM h)
SELECT * FROM c WHERE value <> ''""", stamps="valid_from valid_to")
def attribute_intervals(spark, d):
    h = history.fields_history(_versions(spark, d), ["o_custkey"], "changed_at", ["o_orderstatus", "o_orderpriority"])
    h = h.withColumn("new_value", F.when(F.col("new_value") == "P", "").otherwise(F.col("new_value")))  # pending clears the status
    return history.claim_intervals(history.attribute_claims(h), ["o_custkey"], "changed_at")


@query("""WITH a AS (SELECT user_id, max_by(event_type, event_id) AS event_type FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1)
SELECT b.user_id, b.event_type FROM b LEFT JOIN a USING (user_id) WHERE a.event_type IS DISTINCT FROM b.event_type""")
def scd2_snapshot(spark, d):
    e = A.events(spark, d)
    state = lambda x: dedup.latest_values(x, ["user_id"], ["event_id"], ["event_type"])
    before = history.snapshot_changes(None, state(e.where("ts < '2024-01-15'")), ["user_id"], ["event_type"], F.lit("2024-01-15").cast("timestamp"))
    return history.snapshot_changes(before, state(e), ["user_id"], ["event_type"], F.lit(_AS_OF).cast("timestamp")).select("user_id", "event_type")


@query("""SELECT o_custkey, o_orderpriority, o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def bitemporal_config(spark, d):
    o = table(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    return history.bitemporal_latest(o, ["o_custkey"], ["o_orderkey", "o_orderpriority"], "at", "o_orderkey", F.lit("1998-06-01").cast("timestamp")).select("o_custkey", "o_orderpriority", "o_orderkey")


# -- joins, sets, coverage, JSON


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_defaults(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("""WITH k AS (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) AS week FROM events),
x AS (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, event_type, sum(value) AS s, count(*) AS n FROM events GROUP BY 1, 2, 3)
SELECT user_id, week, round(coalesce(a.s, 0), 4) AS views, coalesce(b.n, 0) AS clicks, round(c.s, 4) AS bought FROM k LEFT JOIN (SELECT * FROM x WHERE event_type = 'view') a USING (user_id, week)
LEFT JOIN (SELECT * FROM x WHERE event_type = 'click') b USING (user_id, week) LEFT JOIN (SELECT * FROM x WHERE event_type = 'purchase') c USING (user_id, week)""", dates="week")
def key_spine_left_joins(spark, d):
    e = A.events(spark, d).withColumn("week", F.trunc(F.to_date("ts"), "week"))
    part = lambda kind, agg: e.where(F.col("event_type") == kind).groupBy("user_id", "week").agg(agg)
    out = e.select("user_id", "week").distinct()
    for kind, agg in (("view", F.sum("value").alias("views")), ("click", F.count("*").alias("clicks")), ("purchase", F.sum("value").alias("bought"))):
        out = out.join(part(kind, agg), ["user_id", "week"], "left")
    return _rounded(out.fillna(0, ["views", "clicks"]))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE c_custkey IS NULL) AS unresolved, count(DISTINCT user_id) FILTER (WHERE c_custkey IS NULL) AS unresolved_users, round(100.0 * count(c_custkey) / count(*), 2) AS rate
FROM events LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') ON c_custkey = user_id GROUP BY 1""")
def grouped_coverage(spark, d):
    known = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("known"))
    e = A.events(spark, d).join(known, "user_id", "left")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("unresolved"), F.count_distinct(F.when(F.col("known").isNull(), F.col("user_id"))).alias("unresolved_users"), F.round(100.0 * F.count("known") / F.count("*"), 2).alias("rate"))


@query("SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def json_explode(spark, d):
    return A.events(spark, d).select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("SELECT count(*) AS n, count(DISTINCT (o_custkey, o_orderstatus)) AS pairs, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, min(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS first_done, o_orderpriority FROM orders GROUP BY o_orderpriority", stamps="first_done")
def conditional_aggregates(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey", "o_orderstatus").alias("pairs"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"), F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("first_done"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'a') AND NOT contains(p_type, '%')")
def text_search(spark, d):
    p = table(spark, d, "part")
    return p.where(T.contains_ignoring_case(F.col("p_name"), "A") & ~F.like(F.col("p_type"), F.lit(T.like_escaped("%")), F.lit("!"))).select("p_partkey", "p_name", "p_type")


@query("SELECT DISTINCT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' ELSE o_orderpriority END AS label FROM orders")
def label_lookup(spark, d):
    return table(spark, d, "orders").select("o_orderpriority", T.lookup(F.col("o_orderpriority"), {"1-URGENT": "Urgent", "2-HIGH": "High"}).alias("label")).distinct()


@query("""WITH s AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS orders, max(o_totalprice) AS largest FROM orders GROUP BY 1),
l AS (SELECT o_custkey, 'total' AS measure, total AS value FROM s UNION ALL SELECT o_custkey, 'orders', orders FROM s UNION ALL SELECT o_custkey, 'largest', largest FROM s)
SELECT measure, count(*) AS n, round(avg(value), 2) AS mean, round(max(value), 2) AS most FROM l GROUP BY 1""")
def wide_to_long(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count("*").cast("double").alias("orders"), F.max("o_totalprice").alias("largest"))
    long = s.unpivot(["o_custkey"], ["total", "orders", "largest"], "measure", "value")
    return long.groupBy("measure").agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("mean"), F.round(F.max("value"), 2).alias("most"))


# -- hierarchy and increments


@query("""WITH e AS (SELECT 'r' || n_regionkey AS p, 'n' || n_nationkey AS c FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)
SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT p, c, 1 FROM e WHERE p LIKE 'r%' UNION ALL SELECT a.p, b.c, 2 FROM e a JOIN e b ON a.c = b.p""")
def org_subtree(spark, d):
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return hierarchy.subtree(A.edges(spark, d), roots)


@query("""WITH e AS (SELECT 'r' || n_regionkey AS p, 'n' || n_nationkey AS c FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer), v AS (SELECT 'c' || c_custkey AS viewer, c_nationkey FROM customer),
s AS (SELECT viewer, viewer AS node FROM v UNION SELECT viewer, 'n' || c_nationkey FROM v UNION SELECT viewer, c FROM v JOIN e ON p = 'n' || c_nationkey)
SELECT viewer, count(*) AS nodes, min(node) AS first_node, max(node) AS last_node FROM s GROUP BY viewer""")
def visible_set(spark, d):
    """All customers see themselves, and by grants their nation and all below it: how many nodes, the first and the last of them."""
    name = lambda kind, col: F.concat(F.lit(kind), F.col(col).cast("string"))
    v = table(spark, d, "customer").select(name("c", "c_custkey").alias("viewer"), name("n", "c_nationkey").alias("node"))
    numbers = hierarchy.numbering(A.edges(spark, d), v.select(F.col("viewer").alias("node")))
    return hierarchy.visible_counts(numbers, hierarchy.visible_ranges(numbers, v.select("viewer"), v))


@query("""WITH t AS (SELECT event_type, max(event_id) AS mark FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1) SELECT e.event_id, e.event_type FROM events e LEFT JOIN t USING (event_type) WHERE mark IS NULL OR event_id > mark""")
def watermark_per_source(spark, d):
    e = A.events(spark, d)
    return incremental.after_watermark(e, e.where("ts < '2024-01-20'"), ["event_type"], "event_id").select("event_id", "event_type")


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) - 3 FROM events WHERE ts < TIMESTAMP '2024-01-20')", dates="day")
def lookback_days(spark, d):
    e = A.events(spark, d).withColumn("day", F.to_date("ts"))
    return incremental.within_lookback(e, e.where("ts < '2024-01-20'"), "day", 3).select("event_id", "day")


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE (user_id, CAST(ts AS DATE)) IN (SELECT user_id, CAST(ts AS DATE) FROM events WHERE ts >= TIMESTAMP '2024-01-28 12:00:00') GROUP BY 1, 2", dates="day")
def touched_days(spark, d):
    e = A.events(spark, d).withColumn("day", F.to_date("ts"))
    return incremental.touched(e, ["user_id", "day"], "ts", F.lit("2024-01-28 12:00:00").cast("timestamp")).groupBy("user_id", "day").agg(F.count("*").alias("n"))
