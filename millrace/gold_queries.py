"""Registered queries of the gold models, their inputs and staging: each runs the library's function on rows made of events, orders, line items and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import analogs as A
from .functions import text as T
from .gold import activity, git, observations, people, resolved, tasks
from .operators import hierarchy, identity, incremental, sequences, staging
from .queries import _rounded, query
from .runtime import table


def _measures(evidence):
    """Rows, persons and total contribution of each measure and source."""
    return _rounded(evidence.groupBy("source_key", "measure_key").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("people"), F.sum("contribution").alias("total")), 2)


def _measures_sql(source: str, parts: str) -> str:
    return f"SELECT '{source}' AS source_key, m AS measure_key, count(*) AS n, count(DISTINCT who) AS people, round(sum(CAST(x AS DOUBLE)), 2) AS total FROM ({parts}) GROUP BY m"


# -- functions

_PATHS = ["vendor/a.py", "src/target/x.py", "Gemfile.lock", "web/app.min.js", "src/a.test.ts", "tests/x.yaml", "docs/a.py", "README.md", "conf/a.yaml", "Cargo.toml", "src/Main.java", "lib/x.d.ts"]
_KINDS = ["vendored", "vendored", "vendored", "vendored", "test", "test", "docs", "docs", "config", "config", "code", "vendored"]


@query(f"""SELECT {_KINDS}[l_partkey % 12 + 1] AS category, count(*) AS files, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY 1""")
def file_categories(spark, d):
    path = F.concat(F.lit("p"), "l_partkey", F.lit("/"), F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (F.col("l_partkey") % 12 + 1).cast("int")))
    return table(spark, d, "lineitem").groupBy(T.file_category(path).alias("category")).agg(F.count("*").alias("files"), F.sum("l_linenumber").cast("long").alias("lines"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN 'bug' WHEN c_custkey % 4 = 2 THEN 'other' ELSE 'unknown' END AS issue_kind FROM customer""")
def issue_kinds(spark, d):
    name = F.element_at(F.array(*map(F.lit, [" Bug ", "Usability Problem", "User Story", "chore"])), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", T.issue_kind(name).alias("issue_kind"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS TIMESTAMP) END AS moment, CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 60 * 60 ELSE o_orderkey % 5 * 3600 + o_orderkey % 60 * 60 + o_orderkey % 30 + 0.5 END AS DOUBLE) AS seconds FROM orders""", stamps="moment")
def times_and_durations(spark, d):
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    text = F.when(k % 4 == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(k % 4 == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'")).when(k % 4 == 2, F.date_format(at, "MM/dd/yyyy HH:mm:ss")).otherwise("n/a")
    part = lambda n, unit: F.concat((k % n).cast("string"), F.lit(unit))
    duration = F.when(k % 7 == 0, F.concat(F.lit("PT"), part(60, "M"))).otherwise(F.concat(F.lit("PT"), part(5, "H"), part(60, "M"), part(30, ".5S")))
    return table(spark, d, "orders").select("o_orderkey", staging.parse_time(text).alias("moment"), T.duration_seconds(duration).alias("seconds"))


@query("SELECT c_custkey, c_custkey % 3 <> 1 AS hit FROM customer")
def segment_sources(spark, d):
    source = F.element_at(F.array(*map(F.lit, ["github-v2", "my-mygithub", "acme_github"])), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", T.segment_match(source, "github").alias("hit"))


# -- time and trees


@query("""SELECT c_custkey AS node, 'n' || c_nationkey AS parent FROM customer WHERE c_custkey % 30 < 20""")
def edges_as_of(spark, d):
    """Every customer reports to its nation from a day of January on, two thirds by the 20th; a third have left since."""
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")).cast("timestamp")
    k = F.col("c_custkey")
    e = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), k.alias("child"), day(k % 30).alias("valid_from"), F.when(k % 30 >= 25, day(k % 30 + 1)).alias("valid_to"))
    return hierarchy.edges_at(e, F.lit("2024-01-20 12:00:00").cast("timestamp")).select(F.col("child").alias("node"), "parent")


@query("""WITH n AS (SELECT 'n' || n_nationkey AS p FROM nation WHERE n_nationkey % 2 = 0), c AS (SELECT 'n' || c_nationkey AS p, 'c' || c_custkey AS c FROM customer JOIN n ON n.p = 'n' || c_nationkey)
SELECT DISTINCT p AS root, p AS node, 0 AS depth FROM c UNION ALL SELECT p, c, 1 FROM c""")
def org_forest(spark, d):
    """The trees among even nations and all customers: customers of odd nations stand alone and aren't in one."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    nodes = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("node")).unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("node")))
    return hierarchy.forest(A.edges(spark, d), nodes)


@query("""WITH s AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS a, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 DAY * CAST(o_orderkey % 40 AS INTEGER) END AS b FROM orders),
w AS (SELECT *, max(b) OVER v AS covered, coalesce(bool_or(b IS NULL) OVER v, false) AS opened FROM s WINDOW v AS (PARTITION BY o_custkey ORDER BY a, b NULLS FIRST, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT o_custkey, count(*) AS overlapping FROM w WHERE covered > a OR opened GROUP BY 1""")
def interval_conflicts(spark, d):
    k, a = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    s = table(spark, d, "orders").select("o_custkey", k.alias("o_orderkey"), a.alias("a"), F.when(k % 50 != 0, F.timestamp_micros(F.unix_micros(a) + k % 40 * F.lit(86_400_000_000))).alias("b"))
    return sequences.overlapping(s, ["o_custkey"], "a", "b").groupBy("o_custkey").agg(F.count("*").alias("overlapping"))


@query("""WITH b AS (SELECT date_trunc('month', o_orderdate) AS m, max(o_orderkey) AS built FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), s AS (SELECT date_trunc('month', o_orderdate) AS m, max(o_orderkey) AS late FROM orders GROUP BY 1)
SELECT CAST(m AS DATE) AS month FROM s LEFT JOIN b USING (m) WHERE m < DATE '1997-01-01' AND (built IS NULL OR late > built)""", dates="month")
def months_to_reopen(spark, d):
    o = table(spark, d, "orders").select(F.trunc("o_orderdate", "month").alias("month"), "o_orderkey")
    return incremental.reopened_months(o.where("o_orderkey % 3 = 0"), o, "month", "o_orderkey", F.lit("1997-01-01").cast("date"))


@query("""WITH f AS (SELECT 'events' AS source, max(ts) AS latest FROM events UNION ALL SELECT 'clicks', max(ts) FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-15' UNION ALL SELECT 'none', NULL)
SELECT source, CAST(latest AS TIMESTAMP) AS latest, round((epoch_us(TIMESTAMP '2024-02-01') // 1000000 - epoch_us(latest) // 1000000) / 3600.0, 2) AS age_hours, coalesce(round((epoch_us(TIMESTAMP '2024-02-01') // 1000000 - epoch_us(latest) // 1000000) / 3600.0, 2) > 100, true) AS stale FROM f""", stamps="latest")
def source_freshness(spark, d):
    e = A.events(spark, d)
    sources = {"events": (e, "ts"), "clicks": (e.where("event_type = 'click' and ts < '2024-01-15'"), "ts"), "none": (e.where("event_type = 'no such type'"), "ts")}
    return incremental.freshness(sources, F.lit("2024-02-01 00:00:00").cast("timestamp"), 100.0)


# -- issue tracking: users are issues, events their changes

_AS_OF = "2024-02-10 00:00:00"
_STATE = f"""h AS (SELECT user_id AS i, ts, event_id AS v, event_type AS s, CASE WHEN event_type IN ('click', 'signup') THEN 'in_progress' WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'view' THEN 'todo' END AS cat FROM events),
st AS (SELECT i, arg_max(s, (ts, v)) AS status, arg_max('a' || (v % 20), (ts, v)) FILTER (WHERE s = 'signup') AS who, min(ts) AS made, max(ts) AS moved, max(ts) FILTER (WHERE s = 'purchase') AS closed, arg_max(v % 100, (ts, v)) FILTER (WHERE s = 'error') AS est FROM h GROUP BY i),
state AS (SELECT st.*, lower(who) || '@x' AS entity, CASE WHEN status IN ('click', 'signup') THEN 'in_progress' WHEN status = 'purchase' THEN 'done' WHEN status = 'view' THEN 'todo' END AS cat FROM st WHERE who IS NOT NULL AND CAST(substr(who, 2) AS INTEGER) < 15),
sp AS (SELECT h.i, h.ts AS a, h.s, h.cat, coalesce(lead(h.ts) OVER (PARTITION BY h.i ORDER BY h.ts, h.s), CASE WHEN state.cat = 'done' THEN coalesce(state.closed, h.ts) ELSE TIMESTAMP '{_AS_OF}' END) AS b, state.made, state.closed, state.entity FROM h JOIN state USING (i)),
spans AS (SELECT *, epoch_us(b) // 1000000 - epoch_us(a) // 1000000 AS sec FROM sp WHERE b >= a AND b <= TIMESTAMP '{_AS_OF}' + INTERVAL 1 DAY AND a >= made)"""
_DAYS = """dd AS (SELECT *, CAST(unnest(generate_series(date_trunc('day', a), date_trunc('day', b), INTERVAL 1 DAY)) AS TIMESTAMP) AS day FROM spans WHERE cat = 'in_progress'),
pg AS (SELECT entity, CAST(day AS DATE) AS day, sum(greatest(0, epoch_us(least(b, day + INTERVAL 1 DAY)) - epoch_us(greatest(a, day)))) / 1e6 AS progress FROM dd GROUP BY 1, 2),
wl AS (SELECT 'a' || (event_id % 20) || '@x' AS entity, CAST(ts AS DATE) AS day, CAST(sum(event_id % 3600) AS DOUBLE) AS logged FROM events WHERE event_type = 'purchase' AND event_id % 20 < 15 GROUP BY 1, 2),
flow AS (SELECT entity, day, coalesce(progress, 0) AS progress, coalesce(logged, 0) AS logged FROM pg FULL JOIN wl USING (entity, day))"""


def _issues(spark, d):
    """Tables of the tracker: history, roles, users, statuses, types, worklogs."""
    e = A.events(spark, d)
    one = lambda field, kind, action, value: e.select(
        F.lit("s").alias("source_instance_id"), F.lit("jira").alias("data_source"), F.lit(field).alias("field_id"), F.col("user_id").cast("string").alias("issue_id"), F.concat(F.lit("I-"), "user_id").alias("id_readable"), F.lit("t").alias("title"),
        F.col("ts").alias("event_at"), F.lit(kind).alias("event_kind"), F.lit(action).alias("delta_action"), F.array(value.cast("string")).alias("value_ids"), F.array(value.cast("string")).alias("value_displays"), F.col("event_id").alias("version"), "event_type",
    )
    k = F.col("event_id")
    first = one("created", "synthetic_initial", "none", F.lit(None)).join(e.groupBy(F.col("user_id").cast("string").alias("issue_id")).agg(F.min("ts").alias("m")), "issue_id").where("event_at = m").drop("m")
    history = one("status", "changelog", "set", F.col("event_type")).unionByName(one("assignee", "changelog", "set", F.concat(F.lit("a"), k % 20)).where("event_type = 'signup'"))
    history = history.unionByName(one("estimate", "changelog", "set", k % 100).where("event_type = 'error'")).unionByName(first).drop("event_type")
    defaults = spark.createDataFrame([("s", "jira", f, f, "hours" if f == "estimate" else None, 3600.0 if f == "estimate" else None) for f in ("status", "assignee", "estimate", "junk")], "source_instance_id string, data_source string, field_id string, role string, value_unit string, unit_multiplier double")
    authored = spark.sql("select 's' as source_instance_id, 'jira' as data_source, 'junk' as field_id, 'ignored' as role, cast(null as string) as value_unit, cast(null as double) as unit_multiplier, timestamp '2023-01-01' as valid_from, timestamp '2023-01-01' as recorded_at")
    roles = tasks.field_roles(authored, defaults, F.lit(_AS_OF).cast("timestamp"))
    users = spark.range(20).select(F.lit("t").alias("tenant_id"), F.lit("s").alias("source_instance_id"), F.concat(F.lit("a"), "id").alias("user_id"), F.when(F.col("id") < 15, F.concat(F.lit("A"), "id", F.lit("@x"))).otherwise("none").alias("email"))
    statuses = spark.createDataFrame([("s", "click", "in_progress"), ("s", "signup", "in_progress"), ("s", "purchase", "done"), ("s", "view", "todo"), ("s", "error", None)], "source_instance_id string, status_id string, status_category string")
    types = spark.createDataFrame([], "source_instance_id string, issue_type_id string, issue_type_name string, untranslated_name string")
    worklogs = e.where("event_type = 'purchase'").select(F.lit("s").alias("source_instance_id"), F.concat(F.lit("a"), k % 20).alias("author_id"), F.col("ts").alias("work_date"), (k % 3600).alias("duration_seconds"))
    return history, roles, users, statuses, types, worklogs


def _tracked(spark, d):
    history, roles, users, statuses, types, worklogs = _issues(spark, d)
    state = tasks.issue_state(history, roles, users, statuses, types)
    spans = tasks.status_spans(history, roles, state, statuses, F.lit(_AS_OF).cast("timestamp"))
    return state, spans, tasks.worklog_flow(spans, state, worklogs, users)


@query("""WITH d AS (SELECT DISTINCT ['s', 't'][o_custkey % 2 + 1] AS s, 'f' || (o_custkey % 40) AS f, ['status', 'assignee', 'estimate', 'junk'][o_custkey % 4 + 1] AS role, CASE WHEN o_custkey % 4 = 2 THEN 'hours' END AS unit, CASE WHEN o_custkey % 4 = 2 THEN 3600.0::DOUBLE END AS factor FROM orders),
a AS (SELECT ['s', 't'][o_custkey % 2 + 1] AS s, 'f' || (o_custkey % 40) AS f, ['ignored', 'status', 'due_date'][o_orderkey % 3 + 1] AS role, NULL AS unit, NULL AS factor FROM orders WHERE o_custkey % 40 < 25 AND o_orderdate <= '1997-06-01'
  QUALIFY row_number() OVER (PARTITION BY o_custkey % 2, o_custkey % 40 ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT s AS source_instance_id, f AS field_id, role, unit AS value_unit, factor AS unit_multiplier FROM (SELECT * FROM a UNION ALL SELECT * FROM d WHERE (s, f) NOT IN (SELECT s, f FROM a)) WHERE role <> 'ignored'""")
def issue_field_roles(spark, d):
    """The fields of two trackers: roles by their vendors, and what operators have said of some of them over time, both made of orders."""
    o, c = table(spark, d, "orders"), F.col("o_custkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), n.cast("int") + 1)
    field = [pick(("s", "t"), c % 2).alias("source_instance_id"), F.lit("jira").alias("data_source"), F.concat(F.lit("f"), c % 40).alias("field_id")]
    defaults = o.select(*field, pick(("status", "assignee", "estimate", "junk"), c % 4).alias("role"), F.when(c % 4 == 2, "hours").alias("value_unit"), F.when(c % 4 == 2, 3600.0).alias("unit_multiplier")).distinct()
    authored = o.where("o_custkey % 40 < 25").select(
        *field, pick(("ignored", "status", "due_date"), F.col("o_orderkey") % 3).alias("role"), F.lit(None).cast("string").alias("value_unit"), F.lit(None).cast("double").alias("unit_multiplier"), F.col("o_orderdate").cast("timestamp").alias("valid_from"),
        F.timestamp_seconds(F.col("o_orderkey")).alias("recorded_at"),
    )
    roles = tasks.field_roles(authored, defaults, F.lit("1997-06-01").cast("timestamp"))
    return roles.select("source_instance_id", "field_id", "role", "value_unit", "unit_multiplier")


@query(f"WITH {_STATE} SELECT CAST(i AS VARCHAR) AS issue_id, entity AS entity_id, status AS status_id, cat AS status_category, CAST(est * 3600 AS DOUBLE) AS time_estimate_seconds, made AS created_at, moved AS last_status_event_at, closed AS final_close_at FROM state", stamps="created_at last_status_event_at final_close_at")
def issue_states(spark, d):
    return _tracked(spark, d)[0].select("issue_id", "entity_id", "status_id", "status_category", "time_estimate_seconds", "created_at", "last_status_event_at", "final_close_at")


@query(f"WITH {_STATE} SELECT CAST(i AS VARCHAR) AS issue_id, cat AS status_category, count(*) AS n, CAST(sum(sec) AS DOUBLE) AS seconds FROM spans GROUP BY 1, 2")
def issue_status_spans(spark, d):
    return _tracked(spark, d)[1].groupBy("issue_id", "status_category").agg(F.count("*").alias("n"), F.sum("duration_seconds").alias("seconds"))


@query(f"WITH {_STATE}, {_DAYS} SELECT entity AS entity_id, day AS metric_date, round(progress, 2) AS in_progress_seconds, round(logged, 2) AS worklog_seconds FROM flow", dates="metric_date")
def issue_worklog_flow(spark, d):
    return _rounded(_tracked(spark, d)[2].drop("tenant_id"), 2)


_TASKS = f"""WITH {_STATE}, {_DAYS},
fa AS (SELECT state.i, entity, state.cat, state.closed, state.est, CAST(state.closed AS DATE) AS day, epoch_us(state.closed) // 1000000 - epoch_us(state.made) // 1000000 AS lead,
  (SELECT sum(sec) FROM spans x WHERE x.i = state.i AND x.cat = 'in_progress' AND x.a < state.closed) AS dev, (SELECT min(a) FROM spans x WHERE x.i = state.i AND x.cat = 'in_progress' AND x.a < state.closed) AS started, state.made FROM state WHERE closed IS NOT NULL),
tr AS (SELECT i, entity, a, cat, lag(coalesce(cat, '')) OVER (PARTITION BY i ORDER BY a) AS was FROM spans),
lf AS (SELECT *, CASE WHEN was = 'done' AND coalesce(cat, '') <> 'done' THEN a END AS gone FROM tr),
cl AS (SELECT *, min(gone) OVER (PARTITION BY i ORDER BY a ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS back FROM lf),
ev AS (SELECT entity, CAST(a AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE back <= a + INTERVAL 14 DAY) AS again FROM cl WHERE cat = 'done' AND (was IS NULL OR was <> 'done') GROUP BY 1, 2),
fl AS (SELECT entity, day, sum(dev) FILTER (WHERE dev > 0 AND lead > 0) AS dev, sum(lead) FILTER (WHERE dev > 0 AND lead > 0) AS lead FROM fa GROUP BY 1, 2),
old AS (SELECT entity, CAST(moved AS DATE) AS day, count(*) AS n FROM state WHERE coalesce(cat, '') <> 'done' AND date_diff('day', CAST(moved AS DATE), DATE '2024-02-10') > 14 GROUP BY 1, 2)
"""


@query(_TASKS + _measures_sql("task", """SELECT 'tasks_closed' AS m, entity AS who, 1 AS x FROM fa WHERE cat = 'done'
UNION ALL SELECT 'dev_time_hours', entity, dev / 3600.0 FROM fa WHERE dev > 0 UNION ALL SELECT 'resolution_days', entity, lead / 86400.0 FROM fa WHERE lead > 0
UNION ALL SELECT 'pickup_days', entity, (epoch_us(started) // 1000000 - epoch_us(made) // 1000000) / 86400.0 FROM fa WHERE started IS NOT NULL
UNION ALL SELECT 'flow_dev_seconds', entity, dev FROM fl WHERE dev IS NOT NULL UNION ALL SELECT 'flow_lead_seconds', entity, lead FROM fl WHERE lead IS NOT NULL
UNION ALL SELECT 'close_events', entity, n FROM ev UNION ALL SELECT 'reopened_within_14d', entity, again FROM ev WHERE again > 0
UNION ALL SELECT 'worklog_seconds', entity, logged FROM flow WHERE progress > 0 UNION ALL SELECT 'in_progress_seconds', entity, progress FROM flow WHERE progress > 0 UNION ALL SELECT 'stale_in_progress', entity, n FROM old"""))
def task_evidence(spark, d):
    return _measures(tasks.task_evidence(*_tracked(spark, d), F.lit(_AS_OF).cast("timestamp")))


# -- version control


def _repository(spark, d):
    """Orders as commits (three quarters) and pull requests, line items as changed files; a pull request without an author has the commit after it."""
    place = [F.lit("t").alias("tenant_id"), F.lit("s").alias("source_id"), F.lit("p").alias("project_key"), F.lit("r").alias("repo_slug"), F.lit("github").alias("data_source")]
    k, o = F.col("o_orderkey"), table(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    who = F.concat(F.lit(" U"), F.col("o_custkey") % 50)
    commits = o.where(k % 4 != 0).select(*place, k.cast("string").alias("commit_hash"), who.alias("author_email"), F.col("at").alias("date"), (k % 5 == 0).alias("is_merge_commit"), (k % 50).alias("lines_added"), (k % 7).alias("lines_removed"))
    path = F.concat(F.lit("src/"), "l_partkey", F.element_at(F.array(F.lit(".md"), F.lit(".py"), F.lit(".yaml")), (F.col("l_linenumber") % 3 + 1).cast("int")))
    li = table(spark, d, "lineitem").withColumn("path", path)
    changes = li.where("l_orderkey % 4 <> 0").select(
        *place, F.col("l_orderkey").cast("string").alias("commit_hash"), F.col("path").alias("file_path"), T.file_extension(F.col("path")).alias("file_extension"), F.lit("modified").alias("change_type"), F.lit(None).cast("string").alias("pre_image_oid"),
        F.when(F.col("l_linenumber") % 2 == 1, F.col("l_suppkey").cast("string")).alias("post_image_oid"), F.col("l_linenumber").cast("long").alias("lines_added"), F.lit(1).cast("long").alias("lines_removed"),
    )
    pulls = o.where(k % 4 == 0).select(
        *place, k.alias("pr_id"), k.alias("pr_number"), F.when(k % 8 != 0, who).alias("author_email"), F.when(F.col("o_orderstatus") == "F", "MERGED").otherwise("OPEN").alias("state"), F.lit("main").alias("destination_branch"),
        F.col("at").alias("created_on"), F.when(F.col("o_orderstatus") != "O", F.timestamp_micros(F.unix_micros("at") + (k % 100 - 10) * F.lit(3_600_000_000))).alias("closed_on"), (k % 9).alias("lines_added"), F.lit(0).cast("long").alias("lines_removed"),
    )
    links = o.where(k % 8 == 0).select(*place[:4], k.alias("pr_id"), (k + 1).cast("string").alias("commit_hash"))
    return commits, changes, pulls, links


_REPO = """o AS (SELECT o_orderkey AS k, 'u' || (o_custkey % 50) AS who, o_orderstatus AS s, CAST(o_orderdate AS TIMESTAMP) AS t FROM orders),
c AS (SELECT * FROM o WHERE k % 4 <> 0 AND k % 5 <> 0),
f AS (SELECT c.*, l_partkey AS p, l_linenumber AS n, CASE WHEN l_linenumber % 2 = 1 THEN l_suppkey END AS oid FROM lineitem JOIN c ON l_orderkey = c.k),
u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY p, n % 3, oid, CASE WHEN oid IS NULL THEN CAST(k AS VARCHAR) ELSE '' END ORDER BY t, CAST(k AS VARCHAR), n) = 1),
la AS (SELECT k, sum(n) AS a, count(*) AS r FROM f GROUP BY k), lu AS (SELECT k, sum(n) AS a, count(*) AS r FROM u GROUP BY k),
sz AS (SELECT c.k, c.who, greatest(0, c.k % 50 - (coalesce(la.a, 0) - coalesce(lu.a, 0))) AS a, greatest(0, c.k % 7 - (coalesce(la.r, 0) - coalesce(lu.r, 0))) AS r FROM c LEFT JOIN la USING (k) LEFT JOIN lu USING (k)),
g AS (SELECT k, who, n % 3 AS kind, sum(n) AS a, count(*) AS r FROM u GROUP BY 1, 2, 3),
pr AS (SELECT o.k, CASE WHEN o.k % 8 <> 0 THEN ' ' || o.who ELSE c.who END AS w, o.s, o.t, CASE WHEN o.s <> 'O' THEN o.t + INTERVAL 1 HOUR * CAST(o.k % 100 - 10 AS INTEGER) END AS z FROM o LEFT JOIN c ON o.k % 8 = 0 AND c.k = o.k + 1 WHERE o.k % 4 = 0),
p AS (SELECT k, trim(w) AS who, s, t, z FROM pr WHERE w IS NOT NULL)"""


@query(f"WITH {_REPO} " + _measures_sql("git", """SELECT 'commit_count' AS m, who, 1 AS x FROM sz UNION ALL SELECT 'commit_lines_added', who, a FROM sz UNION ALL SELECT 'commit_lines_removed', who, r FROM sz UNION ALL SELECT 'commit_change_size', who, a + r FROM sz WHERE a + r > 0
UNION ALL SELECT DISTINCT 'commit_day', who || '|' || CAST(t AS DATE), 1 FROM c UNION ALL SELECT 'lines_added', who, a FROM g UNION ALL SELECT 'lines_removed', who, r FROM g UNION ALL SELECT 'code_lines_added', who, a FROM g WHERE kind = 1
UNION ALL SELECT 'pr_created', who, 1 FROM p UNION ALL SELECT 'pr_created_merged', who, 1 FROM p WHERE s = 'F' UNION ALL SELECT 'pr_change_size', who, k % 9 FROM p WHERE k % 9 > 0
UNION ALL SELECT 'pr_merged', who, 1 FROM p WHERE s = 'F' UNION ALL SELECT 'pr_cycle_hours', who, k % 100 - 10 FROM p WHERE s = 'F' AND k % 100 >= 10""").replace("count(DISTINCT who)", "count(DISTINCT split_part(who, '|', 1))"))
def git_evidence(spark, d):
    return _measures(git.git_evidence(*_repository(spark, d)))


@query(f"WITH {_REPO} SELECT k AS pr_id, trim(w) AS entity_id FROM pr")
def pull_request_authors(spark, d):
    commits, _, pulls, links = _repository(spark, d)
    return git.pull_authors(pulls, links, commits).select("pr_id", "entity_id")


@query("""SELECT o_orderkey AS pr_id, CASE WHEN o_orderstatus = 'F' THEN 'merged' ELSE 'open' END AS state_norm, CASE WHEN o_orderkey % 8 <> 0 THEN ' u' || (o_custkey % 50) ELSE 'ann' END AS person_key,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 100 >= 10 THEN CAST(o_orderkey % 100 - 10 AS DOUBLE) END AS cycle_time_h FROM orders WHERE o_orderkey % 4 = 0""")
def pull_request_facts(spark, d):
    return git.pull_facts(_repository(spark, d)[2].withColumn("author_name", F.lit("Ann"))).select("pr_id", "state_norm", "person_key", "cycle_time_h")


@query("""SELECT ['code', 'code', 'config'][l_linenumber % 3 + 1] AS file_category, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, o_orderkey % 5 = 0 AS is_merge_commit, count(*) AS files FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 4 <> 0 GROUP BY 1, 2, 3""", dates="week")
def file_change_facts(spark, d):
    commits, changes, _, _ = _repository(spark, d)
    out = git.file_change_facts(changes, commits.withColumn("person_key", F.lower("author_email")))
    return out.groupBy("file_category", "week", "is_merge_commit").agg(F.count("*").alias("files"))


@query("SELECT 'c' || (c_custkey % 90) AS person_key, count(*) AS reviews FROM customer GROUP BY 1")
def review_facts(spark, d):
    r = table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey") % 90).alias("reviewer_name"))
    return git.review_facts(r).groupBy("person_key").agg(F.count("*").alias("reviews"))


# -- AI use, collaboration, wikis, costs


def _rows(spark, d, kind, **columns):
    """Events of a type as a class table: tenant_id, and the columns given as SQL."""
    return A.events(spark, d).where(F.col("event_type") == kind).selectExpr("'t' as tenant_id", *[f"{v} as {k}" for k, v in columns.items()])


_AI = """v AS (SELECT 'u' || user_id AS who, CAST(ts AS DATE) AS day, event_id % 2 AS tool, event_id AS k FROM events WHERE event_type = 'click'), a AS (SELECT 'u' || user_id AS who, CAST(ts AS DATE) AS day, event_id % 3 AS surface, event_id AS k FROM events WHERE event_type = 'view'),
g AS (SELECT who, day, tool, sum(k % 10) AS added, sum(k % 4) AS offered, sum(k % 100) / 100.0 AS cost FROM v GROUP BY 1, 2, 3), h AS (SELECT who, day, surface, sum(k % 6) AS messages FROM a GROUP BY 1, 2, 3), hc AS (SELECT who, day, sum(k % 50) / 100.0 AS cost FROM a GROUP BY 1, 2)"""


def _ai(spark, d):
    none = dict.fromkeys(["lines_removed", "tool_use_accepted", "conversation_count", "prs_with_cc_count", "prs_total_count"], "cast(null as long)")
    dev = _rows(spark, d, "click", email="concat('U', user_id)", day="ts", tool="if(event_id % 2 = 0, 'cursor', 'codex')", seat_status="cast(null as string)", lines_added="event_id % 10", tool_use_offered="event_id % 4", cost_cents="event_id % 100", **none)
    chat = _rows(spark, d, "view", email="concat('U', user_id)", day="ts", tool="'claude'", surface="concat('s', event_id % 3)", message_count="event_id % 6", action_count="cast(null as long)", conversation_count="cast(null as long)", cost_cents="event_id % 50")
    return activity.ai_evidence(dev, chat)


@query(f"WITH {_AI} " + _measures_sql("ai_usage", """SELECT 'accepted_lines' AS m, who, added AS x FROM g UNION ALL SELECT 'tool_use_offered', who, offered FROM g UNION ALL SELECT 'cost_usd', who, cost FROM g UNION ALL SELECT 'cost_usd', who, cost FROM hc
UNION ALL SELECT 'assistant_messages', who, messages FROM h UNION ALL SELECT 'active_day', who, count(DISTINCT day) FROM (SELECT who, day FROM v UNION SELECT who, day FROM a) GROUP BY who, day"""))
def ai_evidence(spark, d):
    return _measures(_ai(spark, d))


@query(f"""WITH {_AI}, x AS (SELECT who, day, added FROM g), w AS (SELECT DISTINCT who, 'P' || (CAST(substr(who, 2) AS BIGINT) % 40) AS p FROM x WHERE CAST(substr(who, 2) AS BIGINT) % 3 <> 0),
l AS (SELECT who, day, tool, added FROM g) SELECT p AS entity_id, day AS metric_date, count(*) AS n, round(CAST(sum(added) AS DOUBLE), 2) AS value FROM (SELECT p, day, tool, sum(added) AS added FROM l JOIN w USING (who) GROUP BY 1, 2, 3) GROUP BY 1, 2""", dates="metric_date")
def person_observations(spark, d):
    """Evidence under persons' ids, at the canonical grain: several addresses of a person are one row for each tool."""
    who = A.events(spark, d).where("user_id % 3 <> 0").select(F.concat(F.lit("u"), "user_id").alias("email"), F.concat(F.lit("P"), F.col("user_id") % 40).alias("person_id")).distinct()
    out = observations(resolved(_ai(spark, d).where("measure_key = 'accepted_lines'"), who))
    return _rounded(out.groupBy("entity_id", "metric_date").agg(F.count("*").alias("n"), F.sum("value").alias("value")), 2)


@query(f"""WITH {_AI}, e AS (SELECT who FROM g UNION ALL SELECT who FROM g UNION ALL SELECT who FROM g UNION ALL SELECT who FROM hc UNION ALL SELECT who FROM h UNION ALL SELECT who FROM (SELECT who, day FROM v UNION SELECT who, day FROM a)),
x AS (SELECT who, CAST(substr(who, 2) AS BIGINT) % 3 = 0 AS lost FROM e)
SELECT 'ai_usage' AS source_key, count(*) AS observation_rows, count(*) FILTER (WHERE lost) AS unresolved_rows, count(DISTINCT who) FILTER (WHERE lost) AS unresolved_people, round(100.0 * count(*) FILTER (WHERE NOT lost) / count(*), 1) AS match_rate_pct FROM x""")
def identity_coverage(spark, d):
    who = A.events(spark, d).where("user_id % 3 <> 0").select(F.concat(F.lit("u"), "user_id").alias("email"), F.concat(F.lit("P"), "user_id").alias("person_id")).distinct()
    return people.coverage(_ai(spark, d), who)


_COLLAB = """c AS (SELECT 'u' || user_id AS who, CAST(ts AS DATE) AS day, sum(event_id % 5) AS chats, max(CASE WHEN event_id % 5 > 0 THEN 1 ELSE 0 END) AS act FROM events WHERE event_type = 'view' GROUP BY 1, 2),
m AS (SELECT 'u' || user_id AS who, CAST(ts AS DATE) AS day, count(*) AS attended, sum(event_id % 4000) AS audio FROM events WHERE event_type = 'click' GROUP BY 1, 2),
ad AS (SELECT who, day, 'slack' AS tool, 'chat' AS way FROM c WHERE act = 1 UNION ALL SELECT who, day, 'zoom', 'meetings' FROM m), dd AS (SELECT DISTINCT who, day FROM ad)"""


@query(f"WITH {_COLLAB} " + _measures_sql("collab", """SELECT 'total_chat_messages' AS m, who, chats AS x FROM c UNION ALL SELECT 'chat_active_day', u, n FROM (SELECT 'u' || user_id AS u, count(*) FILTER (WHERE event_id % 5 > 0) AS n FROM events WHERE event_type = 'view' GROUP BY 1, CAST(ts AS DATE)) WHERE n > 0
UNION ALL SELECT 'meeting_hours', who, audio / 3600.0 FROM m UNION ALL SELECT 'meetings_attended', who, attended FROM m UNION ALL SELECT 'meeting_free_day', who, CASE WHEN coalesce(m.audio, 0) = 0 THEN 1 ELSE 0 END FROM dd LEFT JOIN m USING (who, day)
UNION ALL SELECT 'active_day', who, 1 FROM ad UNION ALL SELECT 'active_modality', who, 1 FROM ad"""))
def collab_evidence(spark, d):
    no = lambda *names: dict.fromkeys(names, "cast(null as long)")
    key = {"person_key": "concat('U', user_id, '@')", "date": "ts"}
    chat = _rows(spark, d, "view", **key, tool="'slack'", total_chat_messages="event_id % 5", **no("channel_posts", "channel_replies", "direct_and_group_messages"))
    meet = _rows(spark, d, "click", **key, tool="'zoom'", meetings_attended="1", audio_duration_seconds="event_id % 4000", **no("video_duration_seconds", "screen_share_duration_seconds", "meetings_organized", "adhoc_meetings_attended", "scheduled_meetings_attended"))
    none = lambda *names: _rows(spark, d, "no such type", **key, tool="'x'", **no(*names))
    out = activity.collab_evidence(chat, none("sent_count", "received_count", "read_count"), none("viewed_or_edited_count", "shared_internally_count", "shared_externally_count"), meet, none("dev_time_h", "working_hours_per_day"))
    return _measures(out)


@query("""WITH e AS (SELECT 'u' || user_id AS who, sum(event_id % 7) AS edits FROM events WHERE event_type = 'click' GROUP BY user_id, CAST(ts AS DATE)), p AS (SELECT 'c' || (o_custkey % 80) AS who FROM orders),
c AS (SELECT 'c' || (o_custkey % 80) AS who, sum(l_linenumber) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, CAST(l_shipdate AS DATE)) """ + _measures_sql("wiki", "SELECT 'edits' AS m, who, edits AS x FROM e UNION ALL SELECT 'comments', who, n FROM c UNION ALL SELECT 'pages_created', who, 1 FROM p"))
def wiki_evidence(spark, d):
    pages = table(spark, d, "orders").selectExpr("'t' as tenant_id", "'s' as source_id", "cast(o_orderkey as string) as page_id", "concat('C', o_custkey % 80, '@') as author_email", "cast(o_orderdate as timestamp) as created_at", "'' as title")
    edits = _rows(spark, d, "click", author_email="concat('U', user_id, '@')", day="ts", total_edits="event_id % 7", pages_edited="cast(null as long)")
    comments = table(spark, d, "lineitem").selectExpr("'t' as tenant_id", "'s' as source_id", "cast(l_orderkey as string) as page_id", "l_shipdate as day", "l_linenumber as total_comments")
    return _measures(activity.wiki_evidence(pages, edits, comments))


@query("""WITH r AS (SELECT c_custkey AS a, g AS n, (c_custkey * 7 + g * 13) % 50 + g * 5 AS used FROM customer, generate_series(1, 6) t(g)), c AS (SELECT *, min(used) OVER (PARTITION BY a ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM r)
SELECT 'u' || a AS entity_id, round(sum(low - prev) / 100.0, 4) AS usd, round(max(low - prev) / 100.0, 4) AS most FROM (SELECT *, coalesce(lag(low) OVER (PARTITION BY a ORDER BY n), 0) AS prev FROM c) GROUP BY 1""")
def extra_usage_evidence(spark, d):
    """Six readings of each customer's spending in a month, some corrected downwards later."""
    r = table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n"))
    r = r.selectExpr("'t' as tenant_id", "'s' as source_id", "cast(c_custkey as string) as account_id", "concat('u', c_custkey) as entity_id", "'cursor' as tool", "date'2024-01-01' as period_month", "date_add(date'2024-01-01', n) as metric_date", "cast(null as timestamp) as observed_at", "(c_custkey * 7 + n * 13) % 50 + n * 5 as used_cents")
    return _rounded(people.extra_usage(r).groupBy("entity_id").agg(F.sum("contribution").alias("usd"), F.max("contribution").alias("most")))


# -- identity

_LOG = "l AS (SELECT c_custkey AS k, n, CASE n WHEN 1 THEN 'email' WHEN 2 THEN 'id' WHEN 3 THEN 'display_name' ELSE 'email' END AS kind, CASE n WHEN 1 THEN 'U' || (c_custkey % 700) || '@x' WHEN 2 THEN CAST(c_custkey AS VARCHAR) WHEN 3 THEN 'Name ' || c_custkey ELSE CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE 'v' || c_custkey END END AS v, n = 2 AND c_custkey % 5 = 0 AS gone FROM customer, generate_series(1, 4) t(n))"


def _inputs(spark, d):
    """Four rows for each customer: an address, an id (deleted for every fifth), a name, and a second address, blank for every other."""
    r = table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("n"))
    return r.selectExpr(
        "'git' as source_type", "'i' as source_id", "cast(c_custkey as string) as account_id", "case n when 2 then 'id' when 3 then 'display_name' else 'email' end as value_type",
        "case n when 1 then concat('U', c_custkey % 700, '@x') when 2 then cast(c_custkey as string) when 3 then concat('Name ', c_custkey) else if(c_custkey % 2 = 0, ' ', concat('v', c_custkey)) end as value",
        "n = 2 and c_custkey % 5 = 0 as is_delete", "timestamp_seconds(1700000000 + n) as synced_at", "n as version",
    )


@query("SELECT CAST(c_custkey AS VARCHAR) AS account_id, CASE WHEN c_custkey % 2 = 0 THEN 'U' || (c_custkey % 700) || '@x' ELSE 'v' || c_custkey END AS latest_email, false AS is_closed, c_custkey % 5 <> 0 AS has_id FROM customer")
def account_profiles(spark, d):
    return identity.profiles(_inputs(spark, d)).select("account_id", "latest_email", "is_closed", "has_id")


@query(f"WITH {_LOG} SELECT kind AS value_type, count(*) AS n, count(*) FILTER (WHERE kind <> 'display_name') AS ids, count(*) FILTER (WHERE kind = 'display_name') AS texts FROM l GROUP BY 1")
def routed_values(spark, d):
    r = _inputs(spark, d).select("value_type", identity.routed(F.col("value_type"), F.col("value")).alias("r"))
    return r.groupBy("value_type").agg(F.count("*").alias("n"), F.count("r.value_id").alias("ids"), F.count("r.value_text").alias("texts"))


@query(f"""WITH {_LOG}, a AS (SELECT k, CASE WHEN k % 2 = 0 THEN lower('U' || (k % 700) || '@x') ELSE 'v' || k END AS email FROM (SELECT DISTINCT k FROM l)), g AS (SELECT email, bool_or(k % 5 <> 0) AS ok FROM a GROUP BY email)
SELECT kind AS value_type, count(*) AS n, count(DISTINCT email) AS persons FROM l JOIN a USING (k) JOIN g USING (email) WHERE ok AND NOT gone GROUP BY 1""")
def log_rows(spark, d):
    """What is appended to the person log: profiles are assigned, new persons made, and each value goes to its column."""
    inputs = _inputs(spark, d)
    bindings = spark.createDataFrame([], "source_type string, source_id string, account_id string, person_id string, provenance string")
    owners = spark.createDataFrame([], "email string, person_id string")
    out = identity.observation_rows(identity.assignments(identity.profiles(inputs), bindings, owners), inputs)
    return out.groupBy("value_type").agg(F.count("*").alias("n"), F.count_distinct("person_id").alias("persons"))


@query("""SELECT CASE WHEN c_custkey % 3 = 0 THEN 'no_evidence' ELSE 'no_source_id' END AS kind, CAST(c_custkey AS VARCHAR) AS account_id FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 3 = 1 AND c_custkey % 5 = 0""")
def review_cases(spark, d):
    """A third have no address; of another third every fifth states no id."""
    k = F.col("c_custkey")
    accounts = table(spark, d, "customer").select(F.lit("git").alias("source_type"), F.lit("i").alias("source_id"), k.cast("string").alias("account_id"), F.when(k % 3 != 0, F.concat(F.lit("u"), k)).alias("latest_email"), F.lit(False).alias("is_closed"), ((k % 3 != 1) | (k % 5 != 0)).alias("has_id"))
    bindings = spark.createDataFrame([], "source_type string, source_id string, account_id string, person_id string, provenance string")
    assigned = identity.assignments(accounts, bindings, spark.createDataFrame([], "email string, person_id string"))
    return identity.review_queue(assigned, bindings).select("kind", "account_id")


@query(f"""WITH {_LOG}, e AS (SELECT lower(trim(v)) AS email, 'P' || (k % 350) AS p FROM l WHERE kind = 'email' AND trim(v) <> '')
SELECT email, min(p) AS person_id FROM e GROUP BY email HAVING count(DISTINCT p) = 1""")
def address_owners(spark, d):
    o = _inputs(spark, d).withColumn("person_id", F.concat(F.lit("P"), F.col("account_id").cast("long") % 350))
    return identity.email_to_person(o)


@query(f"""WITH {_LOG} SELECT 'P' || (k % 350) AS person_id, arg_max(v, v) AS label FROM l WHERE kind = 'display_name' GROUP BY 1""")
def person_labels(spark, d):
    o = _inputs(spark, d).withColumn("person_id", F.concat(F.lit("P"), F.col("account_id").cast("long") % 350)).withColumnRenamed("synced_at", "created_at")
    return identity.labels(o)


# -- staging


@query("""WITH m AS (SELECT event_id, user_id, ts AS s, ts + INTERVAL 1 MINUTE * CAST(event_id % 60 AS INTEGER) AS e FROM events WHERE event_type = 'view'),
g AS (SELECT *, CASE WHEN lag(e) OVER w IS NULL OR epoch_us(s) // 1000000 - epoch_us(lag(e) OVER w) // 1000000 > 300 THEN 1 ELSE 0 END AS opens FROM m WINDOW w AS (PARTITION BY user_id ORDER BY s, CAST(event_id AS VARCHAR)))
SELECT CAST(event_id AS VARCHAR) AS uuid, user_id || '#' || CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY s, CAST(event_id AS VARCHAR) ROWS UNBOUNDED PRECEDING) AS BIGINT) AS logical_meeting_id FROM g""")
def meeting_sessions(spark, d):
    return staging.stitched_meetings(_meetings(spark, d)).select("uuid", "logical_meeting_id")


def _meetings(spark, d):
    end = "date_format(timestamp_micros(unix_micros(ts) + event_id % 60 * 60000000), 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
    return _rows(spark, d, "view", source_id="'s'", id="user_id", uuid="cast(event_id as string)", start_time="date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS')", end_time=end, extracted_at="ts")


@query("""WITH p AS (SELECT event_id, user_id, lower('U' || (event_id % 50)) AS who, CAST(ts AS DATE) AS day, event_id % 3000 AS sec FROM events WHERE event_type = 'view')
SELECT who AS person_key, day AS date, count(DISTINCT event_id) AS meetings_attended, CAST(sum(sec) AS BIGINT) AS audio_duration_seconds, CAST(coalesce(sum(sec) FILTER (WHERE event_id % 2 = 0), 0) AS BIGINT) AS video_duration_seconds FROM p GROUP BY 1, 2""", dates="date")
def meeting_attendance(spark, d):
    leave = "date_format(timestamp_micros(unix_micros(ts) + event_id % 3000 * 1000000), 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
    p = _rows(
        spark, d, "view", source_id="'s'", meeting_uuid="cast(event_id as string)", participant_uuid="'p'", email="concat('U', event_id % 50)", join_time="date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS')", leave_time=leave,
        camera="if(event_id % 2 = 0, 'hd', '')", share_desktop="false", share_application="false", share_whiteboard="cast(null as boolean)", extracted_at="ts",
    )
    one = _meetings(spark, d).select("tenant_id", "source_id", "uuid", F.col("uuid").alias("logical_meeting_id"))
    return staging.meeting_activity(p.unionByName(p), one).select("person_key", "date", "meetings_attended", "audio_duration_seconds", "video_duration_seconds")


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 90) || '+ann@users.noreply.github.com' WHEN c_custkey % 3 = 1 THEN 'l' || (c_custkey % 60) || '@users.noreply.github.com' ELSE 'x' || (c_custkey % 45) || '@x' END AS email FROM customer),
a AS (SELECT DISTINCT CASE WHEN k % 3 = 0 THEN CAST(k % 90 AS VARCHAR) ELSE CAST(500 + k % 60 AS VARCHAR) END AS account_id, email FROM c WHERE k % 3 = 0 OR k % 3 = 1 AND k % 60 < 40)
SELECT account_id, email, 'owned' AS what FROM a UNION ALL SELECT NULL, email, 'unowned' FROM (SELECT DISTINCT email FROM c) WHERE email NOT IN (SELECT email FROM a)""")
def forge_addresses(spark, d):
    """Addresses of a forge's own, by id or by a login with one id, and the addresses that no account has."""
    email = "case c_custkey % 3 when 0 then concat(c_custkey % 90, '+Ann@users.noreply.github.com') when 1 then concat('L', c_custkey % 60, '@users.noreply.github.com') else concat(' X', c_custkey % 45, '@x') end"
    c = table(spark, d, "customer").selectExpr("'t' as tenant_id", "'s' as source_id", f"{email} as author_email", "'2024-01-01 00:00:00' as authored_date", "'A' as author_name")
    logins = spark.range(60).selectExpr("'t' as tenant_id", "'s' as source_id", "concat('l', id) as login", "500 + id as account_id")
    logins = logins.unionByName(logins.where("account_id >= 540").withColumn("account_id", F.col("account_id") + 1000))
    owned = staging.account_emails(c, logins)
    free = staging.unowned_emails(c, owned)
    return owned.select("account_id", "email", F.lit("owned").alias("what")).unionByName(free.select(F.lit(None).cast("string").alias("account_id"), "email", F.lit("unowned").alias("what")))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) SELECT o_orderkey, CASE WHEN n = 1 AND o_custkey % 2 = 0 THEN CAST(o_custkey * 10 AS BIGINT) END AS cost FROM n""")
def cost_attached_once(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    costs = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_custkey") * 10).alias("cost"))
    return staging.cost_once(o, costs, ["o_custkey"], ["o_orderdate", "o_orderkey"], "cost").select("o_orderkey", "cost")


@query("""SELECT c_custkey, 'chat' AS surface, CAST(c_custkey % 3 AS BIGINT) AS messages, CAST(NULL AS BIGINT) AS files FROM customer WHERE c_custkey % 3 > 0
UNION ALL SELECT c_custkey, 'excel', CAST(c_custkey % 2 AS BIGINT), CAST(c_custkey % 5 AS BIGINT) FROM customer WHERE c_custkey % 2 + c_custkey % 5 > 0""")
def surfaces_to_rows(spark, d):
    k = F.col("c_custkey")
    wide = table(spark, d, "customer").select("c_custkey", (k % 3).alias("chat_messages"), (k % 2).alias("excel_messages"), (k % 5).alias("excel_files"))
    return staging.one_row_per_surface(wide, ["c_custkey"], {"chat": {"messages": "chat_messages"}, "excel": {"messages": "excel_messages", "files": "excel_files"}})


@query("""SELECT CAST(o_orderkey AS VARCHAR) || ':0' AS event_id, 'status' AS field_id, o_orderstatus AS to_id, 'A' AS from_id FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR) || ':1', 'Sprint', o_orderpriority, NULL FROM orders WHERE o_orderkey % 2 = 0""")
def changelog_explode(spark, d):
    status = """concat('{"field":"Status","fieldId":"status","from":"A","to":"', o_orderstatus, '"}')"""
    sprint = """concat('{"field":"Sprint","to":"', o_orderpriority, '"}')"""
    h = table(spark, d, "orders").selectExpr("cast(o_custkey as string) as issue_id", "cast(o_orderkey as string) as changelog_id", "'2024-01-01 00:00:00' as created", "'u' as author_id", f"concat('[', {status}, if(o_orderkey % 2 = 0, concat(',', {sprint}), ''), ']') as items", "o_orderdate as extracted_at")
    return staging.changelog_items(h.unionByName(h)).select("event_id", "field_id", "to_id", "from_id")


@query("""WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'click' AND user_id % 4 <> 0)
SELECT 'p' || user_id AS person_key, day AS metric_date, count(*) FILTER (WHERE event_id % 3 = 0) AS public_replies, count(*) FILTER (WHERE event_id % 3 = 1) AS internal_notes, count(DISTINCT event_id % 40) FILTER (WHERE event_id % 3 = 2) AS tickets_solved FROM e GROUP BY 1, 2""", dates="metric_date")
def support_days(spark, d):
    """Clicks as audits of tickets: a public comment, a private one, or a ticket solved; every fourth user is no agent."""
    events = """case event_id % 3 when 0 then '[{"id":"1","type":"Comment","public":true},{"id":"2","type":"Notice"}]' when 1 then '[{"id":"1","type":"Comment","public":false}]' else '[{"id":"1","type":"Change","field_name":"status","value":"solved"}]' end"""
    audits = _rows(spark, d, "click", source_id="'s'", unique_key="event_id", audit_id="cast(event_id as string)", ticket_id="cast(event_id % 40 as string)", author_id="cast(user_id as string)", created_at="date_format(ts, 'yyyy-MM-dd HH:mm:ss')", events=events, extracted_at="ts")
    agents = A.events(spark, d).where("user_id % 4 <> 0").selectExpr("'t' as tenant_id", "'s' as source_id", "cast(user_id as string) as source_agent_id", "concat('p', user_id) as person_key").distinct()
    return staging.support_activity(staging.ticket_events(audits.unionByName(audits), agents)).drop("tenant_id", "source_id")


@query("""WITH v AS (SELECT user_id, event_id % 5 AS page, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1800 SECOND THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id, event_id % 5 ORDER BY ts, event_id))
SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS total_edits, count(DISTINCT page) AS pages_edited FROM v WHERE opens = 1 GROUP BY 1, 2""", dates="day")
def wiki_edit_sessions(spark, d):
    v = A.events(spark, d).select("user_id", (F.col("event_id") % 5).alias("page_id"), F.col("ts").alias("edited_at"), F.col("event_id").alias("version"))
    return staging.edit_sessions(v, ["user_id"])


@query("SELECT 'u' || c.c_custkey AS email, 'u' || m.c_custkey AS manager_email FROM customer c LEFT JOIN customer m ON c.c_custkey % 3 <> 0 AND m.c_custkey = c.c_custkey // 10")
def manager_edges(spark, d):
    p = table(spark, d, "customer").selectExpr("concat('u', c_custkey) as email", "concat('CN=', c_custkey) as distinguished_name", "if(c_custkey % 3 = 0, 'CN=none', concat('CN=', c_custkey div 10)) as manager_dn", "c_custkey as version")
    return staging.manager_edges(p)


@query("""WITH l AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_month, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT o_custkey, period_month, CASE WHEN o_custkey % 3 > 0 THEN greatest(o_orderkey % 500 - 200, 0) END AS over_cents FROM l""", dates="period_month")
def over_limit_usage(spark, d):
    s = table(spark, d, "orders").selectExpr("o_custkey", "cast(o_orderdate as date) as snapshot_date", "o_orderkey as version", "if(o_custkey % 3 > 0, 200, null) as limit_cents", "o_orderkey % 500 as used_cents")
    return staging.over_limit(s, ["o_custkey"]).select("o_custkey", "period_month", "over_cents")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, 1 AS n FROM events""")
def raw_json_fields(spark, d):
    raw = F.replace("props", F.lit("{"), F.lit('{"secret": "x", '))
    fields = staging.raw_fields(raw, ["secret"])
    return A.events(spark, d).select("event_id", fields["k"].alias("k"), F.size(fields).alias("n"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS account, value_type, value, is_delete FROM (SELECT c_custkey, 'email' AS value_type, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'u' || c_custkey END AS value, c_custkey % 4 = 0 OR c_custkey % 6 = 0 AS is_delete FROM customer
UNION ALL SELECT c_custkey, 'id', CAST(c_custkey AS VARCHAR), c_custkey % 6 = 0 FROM customer)""")
def identity_values(spark, d):
    h = table(spark, d, "customer").selectExpr("cast(c_custkey as string) as account", "explode(array('mail', 'phone')) as field", "if(c_custkey % 4 = 0, '', concat('u', c_custkey)) as new_value", "timestamp'2024-01-01' as at", "c_custkey % 6 = 0 as off_duty")
    return staging.identity_inputs(h, "account", {"mail": "email"}, F.col("off_duty")).drop("synced_at")


@query("SELECT o_orderkey, CAST(greatest(o_orderkey % 30 - coalesce(CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 20 END, 0), 0) AS BIGINT) AS direct FROM orders")
def direct_messages(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", staging.direct_messages(k % 30, F.when(k % 4 > 0, k % 20)).alias("direct"))
