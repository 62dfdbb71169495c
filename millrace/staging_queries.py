"""Registered queries of staging, publication and export: managers' addresses, fetched-again days, snapshots, budgets, visibility of pairs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import analogs as A
from .operators import hierarchy, sequences, staging
from .plans import drilldown
from .queries import query
from .runtime import shared_dir, table
from .sources import snapshots

_PEOPLE = """u AS (SELECT CAST(c_custkey AS VARCHAR) AS id, 'CN=' || c_custkey AS dn, CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN '' ELSE 'm' || c_custkey || '@x' END AS mail,
  CASE WHEN c_custkey % 3 <> 0 THEN 'u' || c_custkey END AS upn, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'CN=' || (c_custkey // 10) END AS manager_dn FROM customer),
h AS (SELECT CAST(o_custkey AS VARCHAR) AS entity_id, CASE o_orderstatus WHEN 'F' THEN 'managerDn' WHEN 'O' THEN 'mail' ELSE 'userPrincipalName' END AS field_name,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'CN=' || (o_custkey // 10) END AS new_value, o_orderkey AS moment FROM orders),
i AS (
  SELECT h.entity_id, 'parent_email' AS value_type, coalesce(mail, upn, '') AS value, CASE WHEN coalesce(mail, upn, '') = '' THEN 'DELETE' ELSE 'UPSERT' END AS operation, moment FROM h LEFT JOIN u ON dn = new_value WHERE field_name = 'managerDn' AND new_value <> ''
  UNION ALL SELECT h.entity_id, 'parent_id', coalesce(u.id, ''), CASE WHEN u.id IS NULL THEN 'DELETE' ELSE 'UPSERT' END, moment FROM h LEFT JOIN u ON dn = new_value WHERE field_name = 'managerDn' AND new_value <> ''
  UNION ALL SELECT entity_id, unnest(['parent_email', 'parent_id']), '', 'DELETE', moment FROM h WHERE field_name = 'managerDn' AND new_value = ''
  UNION ALL SELECT r.id, 'parent_email', coalesce(b.mail, b.upn, ''), CASE WHEN coalesce(b.mail, b.upn, '') = '' THEN 'DELETE' ELSE 'UPSERT' END, moment FROM h JOIN u b ON b.id = h.entity_id JOIN u r ON r.manager_dn = b.dn WHERE field_name <> 'managerDn')"""


def _people(spark, d):
    k = F.col("c_custkey")
    one = [F.lit("t").alias("tenant_id"), F.lit("s").alias("source_id")]
    above = lambda c: F.concat(F.lit("CN="), F.floor(c / 10).cast("long"))
    mail = F.when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, "").otherwise(F.concat(F.lit("m"), k, F.lit("@x")))
    users = table(spark, d, "customer").select(*one, k.cast("string").alias("id"), mail.alias("mail"), F.when(k % 3 != 0, F.concat(F.lit("u"), k)).alias("upn"), F.concat(F.lit("CN="), k).alias("dn"), F.when(k % 7 == 0, "").otherwise(above(k)).alias("manager_dn"))
    field = F.when(F.col("o_orderstatus") == "F", "managerDn").when(F.col("o_orderstatus") == "O", "mail").otherwise("userPrincipalName")
    history = table(spark, d, "orders").select(*one, F.col("o_custkey").cast("string").alias("entity_id"), field.alias("field_name"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(above(F.col("o_custkey"))).alias("new_value"), F.col("o_orderkey").alias("updated_at"))
    return history, users


@query(f"WITH {_PEOPLE} SELECT entity_id AS account_id, value_type, value, operation, moment AS synced_at FROM i")
def manager_changes(spark, d):
    return staging.manager_inputs(*_people(spark, d)).select("account_id", "value_type", "value", "operation", "synced_at")


@query(f"WITH {_PEOPLE} SELECT entity_id AS account_id, value_type, value FROM i QUALIFY row_number() OVER (PARTITION BY entity_id, value_type ORDER BY moment DESC, operation DESC, value DESC) = 1 AND operation = 'UPSERT'")
def managers_by_increments(spark, d):
    """The managers that follow from the changes taken up in three runs, each from where the one before ended."""
    history, users = _people(spark, d)
    first, second = 5_000, 10_000
    runs = [(F.lit(-1), history.where(F.col("updated_at") <= first)), (F.lit(first), history.where(F.col("updated_at") <= second)), (F.lit(second), history)]
    parts = [staging.manager_inputs(h, users, since) for since, h in runs]
    return staging.current_managers(parts[0].unionByName(parts[1]).unionByName(parts[2])).select("account_id", "value_type", "value")


@query("""WITH w AS (SELECT o_orderpriority AS instance, CAST(o_orderdate AS DATE) AS a, o_orderkey AS v FROM orders WHERE o_orderkey % 97 = 0),
k AS (SELECT o_orderkey, o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day FROM orders o WHERE o_orderkey >= coalesce((SELECT max(v) FROM w WHERE instance = o_orderpriority AND CAST(o_orderdate AS DATE) BETWEEN a AND a + 3), 0))
SELECT o_orderpriority AS instance, CAST(day AS VARCHAR) AS day, o_custkey % 50 AS person, max(o_orderkey) AS version FROM k GROUP BY 1, 2, 3""")
def resynced_days(spark, d):
    """Orders as usage of a person on a day, a fourth of them fetched again; some make a window of four days that is fetched whole, twice over."""
    o, day = table(spark, d, "orders"), F.col("o_orderdate").cast("date")
    again = F.when(F.col("o_orderkey") % 4 == 0, "resync").otherwise("main")
    rows = o.select(F.col("o_orderpriority").alias("instance"), day.alias("day"), (F.col("o_custkey") % 50).alias("person"), F.col("o_orderkey").alias("version"), again.alias("origin"))
    windows = o.where("o_orderkey % 97 = 0").select(F.col("o_orderpriority").alias("instance"), day.alias("day_from"), F.date_add(day, 3).alias("day_to"), F.col("o_orderkey").alias("version"))
    out = staging.resynced(rows.unionByName(rows), windows.unionByName(windows), ["instance"], ["day", "person"], "day", "version", "origin")
    return out.select("instance", F.col("day").cast("string").alias("day"), "person", "version")


@query("SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_custkey % 10 <> 0 GROUP BY 1")
def published_snapshot(spark, d):
    """The second of two published copies of the customers."""
    base, c = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}", table(spark, d, "customer")
    first = snapshots.publish(c, base, "2024-01-01", expected=0)
    snapshots.publish(c.where("c_custkey % 10 <> 0"), base, "2024-01-02", expected=first)
    return snapshots.read_snapshot(spark, base).groupBy("c_nationkey").agg(F.count("*").alias("customers"))


@query("""WITH r AS (SELECT *, row_number() OVER w AS place, sum(octet_length(encode(l_orderkey || ',' || l_linenumber || ',' || l_returnflag || ',' || l_linestatus)) + 1) OVER w AS bytes FROM lineitem WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_returnflag, l_linestatus ROWS UNBOUNDED PRECEDING))
SELECT place, CAST(bytes AS BIGINT) AS bytes, l_orderkey AS "Order", l_linenumber AS "Line", l_linestatus AS "Status", l_returnflag AS "Flag" FROM r WHERE bytes + 23 <= 500000""")
def export_within_budget(spark, d):
    """As many line items as half a megabyte of CSV holds."""
    labels = {"l_orderkey": "Order", "l_linenumber": "Line", "l_returnflag": "Flag", "l_linestatus": "Status"}
    return drilldown.within_budget(table(spark, d, "lineitem"), list(labels), labels, 500_000)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place, CAST(sum(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS total FROM orders")
def running_totals(spark, d):
    out = sequences.running_total(table(spark, d, "orders").select("o_orderdate", "o_orderkey", "o_custkey"), ["o_orderdate", "o_orderkey"], F.col("o_custkey"), "total", "place")
    return out.select("o_orderkey", "place", "total")


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer), a AS (SELECT k, n, k * 7 % 150 + 1 AS other, k * 3 % 25 AS nation FROM c)
SELECT 'c' || a.k AS viewer, 'c' || other AS node, coalesce(b.n = a.n, false) AS seen FROM a LEFT JOIN c b ON b.k = other UNION ALL SELECT 'c' || k, 'n' || nation, nation = n FROM a""")
def visibility_checks(spark, d):
    """Whether each customer sees some other one and some nation, by a grant of its own nation."""
    name = lambda kind, col: F.concat(F.lit(kind), col.cast("string"))
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    v = c.select(name("c", k).alias("viewer"), name("n", F.col("c_nationkey")).alias("node"))
    numbers = hierarchy.numbering(A.edges(spark, d), v.select(F.col("viewer").alias("node")))
    ranges = hierarchy.visible_ranges(numbers, v.select("viewer"), v)
    asked = c.select(name("c", k).alias("viewer"), F.explode(F.array(name("c", k * 7 % 150 + 1), name("n", k * 3 % 25))).alias("node"))
    return hierarchy.can_see(numbers, ranges, asked)


@query("""WITH f AS (SELECT l_orderkey AS pr_id, count(*) AS n, sum(l_linenumber) AS a, sum(l_partkey % 100) AS r, max(l_suppkey) AS x FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1),
c AS (SELECT l_orderkey AS pr_id, max(CAST(l_shipdate AS DATE)) AS closed, max(l_partkey) AS x FROM lineitem WHERE l_linenumber % 2 = 1 AND l_returnflag <> 'N' GROUP BY 1),
p AS (SELECT DISTINCT ON (o_orderkey) o_orderkey AS pr_id, o_custkey % 7 AS repo, o_orderstatus AS s, o_custkey AS x FROM orders ORDER BY o_orderkey, o_custkey DESC)
SELECT p.pr_id, 'p' || repo AS project_key, CASE WHEN repo = 3 THEN '' ELSE 'r' END AS repo_slug, CASE s WHEN 'F' THEN 'MERGED' WHEN 'O' THEN 'OPEN' ELSE 'DECLINED' END AS state, CASE WHEN s <> 'O' THEN CAST(closed AS VARCHAR) END AS closed_on,
  n AS files_changed, CAST(a AS BIGINT) AS lines_added, CAST(r AS BIGINT) AS lines_removed, greatest(p.x, coalesce(f.x, p.x), coalesce(c.x, p.x)) AS extracted_at
FROM p LEFT JOIN f USING (pr_id) LEFT JOIN c USING (pr_id) WHERE greatest(p.x, coalesce(f.x, p.x), coalesce(c.x, p.x)) > 20""")
def pull_requests_with_sizes(spark, d):
    """Orders as pull requests, their line items as changed files and as activity."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    of = lambda k: [F.lit("t").alias("tenant_id"), F.lit("s").alias("source_id"), F.col(k).alias("pr_id")]
    repo = F.col("o_custkey") % 7
    name = F.concat(F.lit("p"), repo, F.when(repo == 3, "").otherwise("/r"))
    state = F.when(F.col("o_orderstatus") == "F", "MERGED").when(F.col("o_orderstatus") == "O", "OPEN").otherwise("SUPERSEDED")
    requests = o.select(*of("o_orderkey"), name.alias("repo_full_name"), state.alias("state"), F.col("o_orderdate").cast("string").alias("created_on"), F.col("o_custkey").alias("extracted_at"))
    names = requests.select(F.col("pr_id").alias("l_orderkey"), "repo_full_name").distinct()
    items = li.join(names, "l_orderkey")
    files = items.where("l_orderkey % 5 <> 0").select(*of("l_orderkey"), "repo_full_name", F.col("l_linenumber").alias("lines_added"), (F.col("l_partkey") % 100).alias("lines_removed"), F.col("l_suppkey").alias("extracted_at"))
    kind = F.when(F.col("l_linenumber") % 2 == 1, "update").otherwise("comment")
    activity = items.select(*of("l_orderkey"), "repo_full_name", kind.alias("kind"), F.when(F.col("l_returnflag") == "N", "OPEN").otherwise("MERGED").alias("update_state"), F.col("l_shipdate").cast("string").alias("event_date"), F.col("l_partkey").alias("extracted_at"))
    out = staging.pull_requests(requests, files, activity, F.lit(20))
    return out.select("pr_id", "project_key", "repo_slug", "state", F.to_date("closed_on").cast("string").alias("closed_on"), "files_changed", "lines_added", "lines_removed", "extracted_at")


@query("""WITH i AS (SELECT o_custkey AS id, max_by(o_orderkey, o_orderkey) AS k FROM orders GROUP BY 1), o AS (SELECT id, o_orderstatus AS s, o_orderpriority AS p, CAST(o_orderdate AS DATE) AS d, k FROM i JOIN orders ON o_orderkey = k AND o_custkey = id)
SELECT CAST(id AS VARCHAR) AS issue_id, u.f AS field_id, u.v AS value_ids, u.w AS value_displays FROM (SELECT id, unnest([
  {'f': 'status', 'v': s, 'w': 'S' || s}, {'f': 'priority', 'v': CASE WHEN k % 3 <> 0 THEN p ELSE '' END, 'w': CASE WHEN k % 3 <> 0 THEN 'P' || p ELSE '' END}, {'f': 'issuetype', 'v': '', 'w': ''}, {'f': 'resolution', 'v': '', 'w': ''}, {'f': 'assignee', 'v': 'a' || (k % 9), 'w': ''}, {'f': 'reporter', 'v': '', 'w': ''},
  {'f': 'project', 'v': CASE WHEN k % 2 = 0 THEN 'PR' ELSE '' END, 'w': CASE WHEN k % 2 = 0 THEN 'PR' ELSE '' END}, {'f': 'parent', 'v': '', 'w': ''}, {'f': 'duedate', 'v': CAST(d AS VARCHAR), 'w': CAST(d AS VARCHAR)},
  {'f': 'labels', 'v': CASE WHEN k % 4 = 0 THEN '' ELSE 'x|' || (k % 4) END, 'w': CASE WHEN k % 4 = 0 THEN '' ELSE 'x|' || (k % 4) END}]) AS u FROM o)""")
def issue_field_snapshots(spark, d):
    """Each customer's latest order as an issue whose fields are JSON."""
    k = F.col("o_orderkey")
    pair = lambda a, b, x, y: F.struct(x.alias(a), y.alias(b))
    o = table(spark, d, "orders")
    fields = F.struct(
        pair("id", "name", F.col("o_orderstatus"), F.concat(F.lit("S"), "o_orderstatus")).alias("status"), F.when(k % 3 != 0, pair("id", "name", F.col("o_orderpriority"), F.concat(F.lit("P"), "o_orderpriority"))).alias("priority"),
        F.struct(F.concat(F.lit("a"), k % 9).alias("accountId")).alias("assignee"), F.when(k % 4 != 0, F.array(F.lit("x"), (k % 4).cast("string"))).alias("labels"),
    )
    issues = o.select(F.lit("s").alias("source_id"), F.col("o_custkey").cast("string").alias("issue_id"), F.to_json(fields).alias("fields"), F.when(k % 2 == 0, "PR").alias("project_key"), F.lit(None).cast("string").alias("parent_id"), F.to_date("o_orderdate").alias("due_date"), k.alias("extracted_at"))
    out = staging.field_snapshot(issues)
    return out.select("issue_id", "field_id", *[F.array_join(c, "|").alias(c) for c in ("value_ids", "value_displays")])
