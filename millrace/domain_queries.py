"""Registered queries of the domain models: identity, organisation, issue replay, commits. Accounts, issues and commits are made of customers, events and orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import analogs as A
from .gold import git, people, totals
from .operators import identity, issues
from .queries import _rounded, query
from .runtime import shared_dir, table
from .streaming import replay

_ACCOUNTS = """a AS (SELECT c_custkey AS k, CASE WHEN c_mktsegment = 'BUILDING' THEN 'hr' ELSE 'git' END AS source_type, CASE WHEN c_custkey % 5 <> 0 THEN 'P' || (c_custkey % 40) || '@x' END AS latest_email,
  c_acctbal < 0 AS is_closed, c_custkey % 11 <> 0 AS has_id, CASE WHEN c_custkey % 30 = 0 THEN 'X' WHEN c_custkey % 6 = 0 THEN 'B' || (c_custkey % 4) END AS bound_to,
  CASE WHEN c_custkey % 12 = 0 THEN 'operator' WHEN c_custkey % 18 = 6 THEN 'unconfirmed' ELSE 'automatic' END AS provenance FROM customer)"""


@query(f"""WITH {_ACCOUNTS}, b AS (SELECT *, lower(latest_email) AS email, CASE WHEN c_own < 10 THEN 'E' || c_own END AS claimed_by FROM (SELECT *, CASE WHEN latest_email IS NOT NULL THEN k % 40 END AS c_own FROM a)),
c AS (SELECT *, coalesce(bound_to = 'X', false) AS excluded, bound_to IS NOT NULL AND bound_to <> 'X' AND NOT coalesce(provenance = 'unconfirmed' AND claimed_by <> bound_to, false) AS bound, coalesce(email, 'a:' || k) AS g FROM b),
d AS (SELECT *, min(CASE WHEN bound THEN bound_to END) OVER w AS one, max(CASE WHEN bound THEN bound_to END) OVER w AS other, bool_or(bound AND provenance = 'operator') OVER w AS settled,
  bool_and(is_closed) FILTER (WHERE NOT excluded) OVER w AS all_closed, bool_or(has_id) FILTER (WHERE NOT excluded) OVER w AS any_id FROM c WINDOW w AS (PARTITION BY g)),
o AS (SELECT *, CASE WHEN excluded THEN 'skipped_excluded' WHEN one = other THEN 'reused_known' WHEN one IS NOT NULL AND bound THEN CASE WHEN settled THEN 'reused_known_settled' ELSE 'reused_known_conflict' END
  WHEN one IS NOT NULL THEN 'skipped_contested_email' WHEN email IS NULL AND NOT (source_type = 'hr' AND has_id) THEN 'skipped_no_email' WHEN email IS NULL AND is_closed THEN 'skipped_closed' WHEN email IS NULL THEN 'minted_from_roster'
  WHEN claimed_by IS NOT NULL THEN 'linked_by_email' WHEN all_closed THEN 'skipped_closed' WHEN NOT any_id THEN 'skipped_no_source_id' ELSE 'minted' END AS outcome FROM d)
SELECT CAST(k AS VARCHAR) AS account_id, outcome, CASE WHEN outcome = 'reused_known' THEN one WHEN outcome LIKE 'reused_known%' THEN bound_to WHEN outcome = 'linked_by_email' THEN claimed_by END AS known_person FROM o""")
def identity_assignments(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    base = c.select(
        F.when(F.col("c_mktsegment") == "BUILDING", "hr").otherwise("git").alias("source_type"), F.lit("i").alias("source_id"), k.cast("string").alias("account_id"),
        F.when(k % 5 != 0, F.concat(F.lit("P"), k % 40, F.lit("@x"))).alias("latest_email"), (F.col("c_acctbal") < 0).alias("is_closed"), (k % 11 != 0).alias("has_id"),
        F.when(k % 30 == 0, identity.EXCLUDED).when(k % 6 == 0, F.concat(F.lit("B"), k % 4)).alias("person_id"),
        F.when(k % 12 == 0, "operator").when(k % 18 == 6, "unconfirmed").otherwise("automatic").alias("provenance"),
    )
    bindings = base.where("person_id is not null").select(*identity.ACCOUNT, "person_id", "provenance")
    owners = spark.range(10).select(F.concat(F.lit("p"), "id", F.lit("@x")).alias("email"), F.concat(F.lit("E"), "id").alias("person_id"))
    out = identity.assignments(base.drop("person_id", "provenance"), bindings, owners, roster="hr")
    return out.select("account_id", "outcome", F.when(~F.col("outcome").startswith("minted"), F.col("person_id")).alias("known_person"))


@query("""WITH e AS (SELECT user_id, ts, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS b FROM events WHERE event_type IN ('click', 'error')),
f AS (SELECT user_id, b, arg_min(event_type, (ts, event_id)) AS first_kind FROM e GROUP BY 1, 2),
s AS (SELECT x.user_id, x.event_id, f.b, coalesce((SELECT arg_max(y.event_type, (y.ts, y.event_id)) FROM e y WHERE y.user_id = x.user_id AND y.b = f.b AND (y.ts, y.event_id) <= (x.ts, x.event_id)) = 'click', f.first_kind = 'error') AS present
  FROM e x JOIN f ON f.user_id = x.user_id)
SELECT user_id, event_id, coalesce(string_agg(b, ',' ORDER BY b) FILTER (WHERE present), '') AS labels FROM s GROUP BY 1, 2""")
def issue_replay(spark, d):
    """Clicks add a label to a user's set, errors remove one; at the end none is left. What was there at first follows."""
    changes = _label_changes(spark, d)
    heads = changes.groupBy("issue_id").agg(F.min("event_at").alias("created_at"), F.lit("u").alias("reporter_id"))
    current = heads.select("issue_id", F.lit("labels").alias("field_id"), F.array().cast(issues.VALUES).alias("value"))
    return _labels(issues.replay(heads, current, changes).where("event_kind = 'changelog'"))


def _label_changes(spark, d):
    b = (F.get_json_object("props", "$.k").try_cast("long") % 5).cast("string")
    value, none = F.array(F.struct(b.alias("id"), b.alias("display"))), F.array().cast(issues.VALUES)
    click = F.col("event_type") == "click"
    return A.events(spark, d).where("event_type in ('click', 'error')").select(
        F.col("user_id").cast("string").alias("issue_id"), F.lit("labels").alias("field_id"), F.col("ts").alias("event_at"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"), F.lit("u").alias("author_id"),
        F.when(click, "add").otherwise("remove").alias("kind"), F.lit(True).alias("multi"), F.when(click, none).otherwise(value).alias("before"), F.when(click, value).otherwise(none).alias("after"),
    )


def _labels(history):
    listed = F.array_join(F.array_sort(F.transform("value", lambda x: x["id"])), ",")
    return history.select(F.col("issue_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), listed.alias("labels"))


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS VARCHAR) AS label FROM events WHERE event_type IN ('click', 'error')),
s AS (SELECT a.user_id, a.event_id, b.label, arg_max(b.event_type, struct_pack(t := b.ts, i := b.event_id)) AS last FROM e a JOIN e b ON b.user_id = a.user_id AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id <= a.event_id)) GROUP BY 1, 2, 3)
SELECT user_id, event_id, coalesce(string_agg(label, ',' ORDER BY label) FILTER (last = 'click'), '') AS labels FROM s GROUP BY 1, 2""")
def issue_replay_stream(spark, d):
    """The same changes as a stream of files in no order, from empty sets: they come out sorted, once a last event has moved the watermark."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    changes = _label_changes(spark, d)
    files = max(3, spark.sparkContext.defaultParallelism)
    changes.repartition(files).write.parquet(f"{base}/in")
    end = changes.agg(F.max("event_at").alias("m")).select(*[(F.col("m") + F.expr("INTERVAL 20000 DAYS") if c == "event_at" else F.lit(None).cast(t) if c in ("before", "after") else F.lit("-1").cast(t) if t == "string" else F.lit(True)).alias(c) for c, t in changes.dtypes])
    end.write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", (files + 2) // 2).parquet(f"{base}/in")
    replay.write_history(stream, f"{base}/out", f"{base}/checkpoint", lateness="10000 days").awaitTermination()
    return _labels(spark.read.parquet(f"{base}/out"))


@query("""WITH s AS (SELECT o_custkey AS p, o_orderdate AS t, o_orderstatus <> 'P' AS active FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) = 1),
turn AS (SELECT p, t, active, lead(t) OVER (PARTITION BY p ORDER BY t) AS till FROM (SELECT *, lag(active) OVER (PARTITION BY p ORDER BY t) AS was FROM s) WHERE was IS NULL OR was <> active),
a AS (SELECT p, t AS a, till AS b FROM turn WHERE active),
q AS (SELECT o_custkey AS p, o_orderdate AS t, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS parent FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey) = 1),
z AS (SELECT p, min(a) AS t FROM a GROUP BY p),
all_q AS (SELECT p, t, parent FROM q UNION ALL SELECT z.p, z.t, NULL FROM z LEFT JOIN (SELECT p, min(t) AS m FROM q GROUP BY p) m USING (p) WHERE m.m IS NULL OR z.t < m.m),
ch AS (SELECT p, parent, t AS c, lead(t) OVER (PARTITION BY p ORDER BY t) AS d FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY t) AS n, lag(parent) OVER (PARTITION BY p ORDER BY t) AS was FROM all_q) WHERE n = 1 OR was IS DISTINCT FROM parent)
SELECT p AS person_id, parent AS parent_id, greatest(a, c) AS valid_from, CASE WHEN b IS NULL THEN d WHEN d IS NULL THEN b ELSE least(b, d) END AS valid_to FROM a JOIN ch USING (p) WHERE (d IS NULL OR a < d) AND (b IS NULL OR c < b)""", stamps="valid_from valid_to")
def org_edges(spark, d):
    o = table(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    one = lambda df, v: df.groupBy(F.col("o_custkey").alias("person_id"), "at").agg(F.min_by(v, "o_orderkey").alias("v"))
    status = one(o.withColumn("active", F.col("o_orderstatus") != "P"), "active").withColumnRenamed("v", "active")
    named = o.withColumn("parent", F.struct(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("id")))
    parents = one(named, "parent").select("person_id", "at", F.col("v.id").alias("parent_id"))
    return identity.org_edges(status, parents)


@query("""WITH c AS (SELECT 'r' || (o_orderkey % 3) AS repo, CAST(o_orderkey AS VARCHAR) AS h, o_orderdate AS t, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS BIGINT) END AS added FROM orders),
f AS (SELECT repo, h, t, l_partkey || '#' || l_linenumber AS path, CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_suppkey AS VARCHAR) END AS oid, CAST(l_extendedprice AS BIGINT) AS lines, l_linenumber AS n FROM lineitem JOIN c ON h = CAST(l_orderkey AS VARCHAR)),
u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY repo, path, oid, CASE WHEN oid IS NULL THEN h ELSE '' END ORDER BY t, h, lines) = 1),
s AS (SELECT h, sum(lines) AS total FROM f GROUP BY h), w AS (SELECT h, sum(lines) AS own FROM u GROUP BY h)
SELECT h AS commit_hash, CAST(CASE WHEN added IS NOT NULL THEN greatest(0, added - (coalesce(total, 0) - coalesce(own, 0))) END AS VARCHAR) AS size FROM c LEFT JOIN s USING (h) LEFT JOIN w USING (h)""")
def commit_sizes(spark, d):
    """Orders as commits, line items as their changed files: what another order had before doesn't count again."""
    place = [F.lit("t").alias("tenant_id"), F.lit("s").alias("source_id"), F.lit("p").alias("project_key")]
    o = table(spark, d, "orders")
    own = o.select(*place, F.concat(F.lit("r"), F.col("o_orderkey") % 3).alias("repo_slug"), F.col("o_orderkey").cast("string").alias("commit_hash"), F.col("o_orderdate").cast("timestamp").alias("observed_at"), F.when(F.col("o_orderstatus") != "P", F.bround("o_totalprice").cast("long")).alias("lines_added"), F.lit(0).cast("long").alias("lines_removed"))
    li = table(spark, d, "lineitem")
    changes = li.select(
        *place, F.concat(F.lit("r"), F.col("l_orderkey") % 3).alias("repo_slug"), F.col("l_orderkey").cast("string").alias("commit_hash"), F.lit("git").alias("data_source"), F.concat_ws("#", "l_partkey", "l_linenumber").alias("file_path"), F.lit("Modified").alias("change_type"),
        F.lit(None).cast("string").alias("pre_image_oid"), F.when(F.col("l_linenumber") % 2 == 1, F.col("l_suppkey").cast("string")).alias("post_image_oid"), F.bround("l_extendedprice").cast("long").alias("lines_added"), F.lit(0).cast("long").alias("lines_removed"),
    )
    sized = git.commit_sizes(own, changes, git.unique_changes(changes, own))
    return sized.select("commit_hash", F.col("lines_added").cast("string").alias("size"))


@query("""WITH l AS (SELECT 'u' || (c_custkey % 100) AS email, arg_max(c_mktsegment, c_custkey) AS dep FROM customer GROUP BY 1)
SELECT 'P' || (CAST(substr(email, 2) AS BIGINT) % 60) AS entity_id, min(dep) AS cohort_id FROM l GROUP BY 1 HAVING count(DISTINCT dep) = 1""")
def department_cohorts(spark, d):
    c = table(spark, d, "customer")
    staff = c.select(F.lit("t").alias("tenant_id"), F.concat(F.lit(" U"), F.col("c_custkey") % 100).alias("email"), F.col("c_mktsegment").alias("department"), F.col("c_custkey").alias("version"))
    who = spark.range(100).select(F.concat(F.lit("u"), "id").alias("email"), F.concat(F.lit("P"), F.col("id") % 60).alias("person_id"))
    return people.cohorts(staff, who)


@query("""WITH p AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, o_orderpriority AS tier, CAST(CAST(o_totalprice / 200000 AS BIGINT) * 10 AS DOUBLE) AS price FROM orders),
s AS (SELECT m, min(price) AS one FROM p GROUP BY m HAVING count(DISTINCT price) = 1), t AS (SELECT m, tier, min(price) AS own FROM p GROUP BY 1, 2 HAVING count(DISTINCT price) = 1)
SELECT m AS period_month, tier, count(*) AS seats, round(max(coalesce(one, own)), 4) AS price FROM (SELECT DISTINCT m, tier FROM p) LEFT JOIN s USING (m) LEFT JOIN t USING (m, tier) GROUP BY 1, 2""")
def seat_prices(spark, d):
    price = (F.expr("bround(o_totalprice / 200000)").cast("long") * 10).cast("double")
    p = table(spark, d, "orders").select(F.lit("t").alias("tenant_id"), F.date_format("o_orderdate", "yyyy-MM").alias("period_month"), F.col("o_orderpriority").alias("tier"), price.alias("price"))
    out = people.seat_prices(p.select("tenant_id", "period_month", "tier").distinct(), p)
    return _rounded(out.groupBy("period_month", "tier").agg(F.count("*").alias("seats"), F.max("price").alias("price")))


def _pulls_commits_changes(spark, d):
    """Orders as pull requests (a quarter) and commits, line items as changed files. Every eighth order closes with an order before it as its merge."""
    place = [F.lit("t").alias("tenant_id"), F.lit("s").alias("source_id"), F.lit("p").alias("project_key"), F.lit("r").alias("repo_slug")]
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").withColumn("who", F.concat(F.lit("c"), F.col("o_custkey") % 200))
    pulls = o.where(k % 4 == 0).select(
        *place, F.col("who").alias("person_key"), k.cast("string").alias("unique_key"), F.when(F.col("o_orderstatus") == "F", "merged").otherwise("open").alias("state_norm"), F.when(F.col("o_orderstatus") != "O", (k % 100).cast("double")).alias("cycle_time_h"),
        F.col("o_orderdate").cast("timestamp").alias("closed_on"), F.when(k % 8 == 0, (k + 1).cast("string")).alias("merge_commit_hash"),
    )
    commits = o.where(k % 4 != 0).select(*place, F.col("who").alias("person_key"), k.cast("string").alias("commit_hash"), F.col("o_orderdate").cast("timestamp").alias("date"), (k % 5 == 0).alias("is_merge_commit"), (k % 50).alias("lines_added"), (k % 7).alias("lines_removed"))
    category = F.when(F.col("l_returnflag") == "N", "code").when(F.col("l_returnflag") == "R", "spec").otherwise("config")
    changes = table(spark, d, "lineitem").select(
        F.lit("t").alias("tenant_id"), F.concat(F.lit("c"), F.col("l_suppkey") % 300).alias("person_key"), F.date_trunc("week", F.col("l_shipdate").cast("timestamp")).cast("date").alias("week"), (F.col("l_orderkey") % 5 == 0).alias("is_merge_commit"),
        category.alias("file_category"), F.col("l_linenumber").cast("long").alias("lines_added"),
    )
    return pulls, commits, changes


_TOTALS = """p AS (SELECT 'c' || (o_custkey % 200) AS person_key, o_orderkey AS k, o_orderstatus AS state, o_orderdate AS t FROM orders WHERE o_orderkey % 4 = 0),
c AS (SELECT 'c' || (o_custkey % 200) AS person_key, o_orderkey AS k, o_orderdate AS t FROM orders WHERE o_orderkey % 4 <> 0),
f AS (SELECT 'c' || (l_suppkey % 300) AS person_key, l_returnflag AS flag, l_linenumber AS n, CAST(date_trunc('week', l_shipdate) AS DATE) AS week FROM lineitem WHERE l_orderkey % 5 <> 0)"""


@query(f"""WITH {_TOTALS}, a AS (SELECT person_key, count(*) AS prs_created, count(*) FILTER (WHERE state = 'F') AS prs_merged, avg(CASE WHEN state <> 'O' THEN k % 100 END) AS h FROM p GROUP BY 1),
b AS (SELECT person_key, count(*) AS commits, sum(k % 50 + k % 7) AS loc FROM c WHERE k % 5 <> 0 GROUP BY 1), e AS (SELECT person_key, sum(n) AS clean_loc FROM f WHERE flag = 'N' GROUP BY 1),
s AS (SELECT person_key FROM a UNION SELECT person_key FROM b UNION SELECT person_key FROM e)
SELECT person_key, CAST(coalesce(prs_created, 0) AS BIGINT) AS prs_created, CAST(coalesce(prs_merged, 0) AS BIGINT) AS prs_merged, round(h, 4) AS avg_pr_cycle_time_h, CAST(coalesce(commits, 0) AS BIGINT) AS commits, CAST(coalesce(loc, 0) AS BIGINT) AS loc,
  CAST(coalesce(clean_loc, 0) AS BIGINT) AS clean_loc FROM s LEFT JOIN a USING (person_key) LEFT JOIN b USING (person_key) LEFT JOIN e USING (person_key)""")
def git_person_totals(spark, d):
    return _rounded(totals.person_totals(*_pulls_commits_changes(spark, d)).drop("tenant_id"))


@query(f"""WITH {_TOTALS}, m AS (SELECT p.person_key, CAST(date_trunc('week', coalesce(c.t, p.t)) AS DATE) AS week, p.k FROM p LEFT JOIN c ON p.k % 8 = 0 AND c.k = p.k + 1 WHERE state = 'F'),
a AS (SELECT person_key, week, count(DISTINCT k) AS prs_merged FROM m GROUP BY 1, 2), b AS (SELECT person_key, CAST(date_trunc('week', t) AS DATE) AS week, count(*) AS commits FROM c WHERE k % 5 <> 0 GROUP BY 1, 2),
e AS (SELECT person_key, week, sum(n) FILTER (WHERE flag = 'N') AS code_loc, sum(n) FILTER (WHERE flag = 'R') AS spec_lines, sum(n) FILTER (WHERE flag NOT IN ('N', 'R')) AS config_loc FROM f GROUP BY 1, 2),
s AS (SELECT person_key, week FROM a UNION SELECT person_key, week FROM b UNION SELECT person_key, week FROM e)
SELECT person_key, week, CAST(coalesce(commits, 0) AS BIGINT) AS commits, CAST(coalesce(prs_merged, 0) AS BIGINT) AS prs_merged, CAST(coalesce(code_loc, 0) AS BIGINT) AS code_loc, CAST(coalesce(spec_lines, 0) AS BIGINT) AS spec_lines,
  CAST(coalesce(config_loc, 0) AS BIGINT) AS config_loc FROM s LEFT JOIN a USING (person_key, week) LEFT JOIN b USING (person_key, week) LEFT JOIN e USING (person_key, week)""", dates="week")
def git_person_weekly(spark, d):
    return totals.person_weeks(*_pulls_commits_changes(spark, d)).drop("tenant_id")


@query("""WITH m AS (SELECT 'u' || user_id AS email, CAST(ts AS DATE) AS day, count(*) AS meetings_count, sum(greatest(event_id % 4000, event_id % 900 * 4, event_id % 100)) / 3600.0 AS h FROM events WHERE event_type = 'click' GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN CAST(substr(email, 2) AS BIGINT) % 3 = 0 THEN CAST(substr(email, 2) AS BIGINT) % 4 * 2.0 ELSE 8.0 END AS work FROM m)
SELECT email, day, meetings_count, round(h, 4) AS meeting_hours, CAST(work AS DOUBLE) AS working_hours_per_day, round(CASE WHEN work <> 0 THEN greatest(0, 100 - h / work * 100) END, 2) AS focus_time_pct, round(greatest(0, work - h), 4) AS dev_time_h FROM w""", dates="day")
def focus_days(spark, d):
    """Clicks as meetings of their users; every third user has told its working hours, some of them none."""
    k, u = F.col("event_id"), F.col("user_id")
    e = A.events(spark, d)
    meetings = e.where("event_type = 'click'").select(F.lit("t").alias("tenant_id"), F.concat(F.lit("u"), u).alias("person_key"), F.to_date("ts").alias("date"), F.lit(1).cast("long").alias("meetings_attended"), (k % 4000).alias("audio_s"), (k % 900 * 4).alias("video_s"), (k % 100).alias("share_s"))
    hours = e.where(u % 3 == 0).select(F.lit("t").alias("tenant_id"), F.concat(F.lit("U"), u).alias("email"), (u % 4 * 2).cast("double").alias("working_hours_per_day")).distinct()
    return totals.focus_days(meetings, hours).drop("tenant_id")
