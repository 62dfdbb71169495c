"""The gate for queries: a table of what is let through and what is not, and what a tenant can see."""

import pytest

from millrace.plans import gate
from millrace.plans.gate import QueryRefused, Relation
from millrace.plans.metrics import Metric, Scope, period

ALLOWED = [
    "select a from t", "SELECT * FROM T", "select a, count(*) n from t group by a having count(*) > 1 order by n limit 3", "with x as (select a from t) select * from x", "select a from t;",
    "with t2 as (select a from t), x as (select * from t2) select * from x join u on x.a = u.a", "select * from t where a in (select a from u)", "select (select max(a) from u) m, exists(select 1 from t) e", "from t |> where a = 1",
    "select a, row_number() over (partition by b order by a) from t", "select * from (select a from t union all select a from u)", "select * from t lateral view explode(array(1, 2)) as z", "select 1", "values (1), (2)",
    "select ';drop table t' as s from t -- ; drop table t", "select * from t tablesample (10 percent)", "select * from t, lateral (select * from u where u.a = t.a)", "with recursive r as (select 1 n union all select n + 1 from r where n < 5) select * from r", "select a from t where b = :tenant",
    "select * from t pivot (max(a) for b in ('x', 'y'))", "select distinct a from t except select a from u",
]
REFUSED = {
    "": "parsed", "select": "parsed", "selec 1": "parsed", "select a from t; select a from t": "parsed", "drop table t": "DropTable", "create table x as select * from t": "Create", "insert into t select * from u": "Insert", "set spark.sql.ansi.enabled=false": "Set",
    "select * from secret": "secret", "select * from default.t": "default.t", "select * from t where a in (select a from secret)": "secret", "select (select max(a) from secret)": "secret", "with secret as (select * from secret) select * from secret": "secret",
    "select * from parquet.`/tmp/x`": "parquet", "select * from range(10)": "TableValued", "select transform(a) using 'cat' from t": "ScriptTransformation", "select reflect('java.lang.System', 'getenv') from t": "reflect", "select java_method('a', 'b')": "java_method",
    "select system.builtin.reflect('a', 'b')": "reflect", "select input_file_name() from t": "input_file_name", "describe t": "Describe", "show tables": "Show", "explain select 1": "Explain", "select /*+ broadcast(t) */ * from t": "Hint", "delete from t": "Delete", "cache table t": "Cache",
    "select * from (with x as (select 1 a) select * from x) y join x on true": "relation x", "select a from t where exists (select 1 from u where u.a in (select a from secret))": "secret", "select * from stream t": "stream", "select * from t version as of 1": "TimeTravel",
    "add jar '/x.jar'": "Add", "use db": "", "begin select 1; end": "", "select * from t order by (select max(a) from secret)": "secret", "select max(a) over (order by (select 1 from secret)) from t": "secret", "from t |> union all (select * from secret)": "secret",
    "select sum(a) from t group by (select a from secret limit 1)": "secret", "select transform(array(1), x -> x + (select max(a) from secret)) from t": "secret",
}


@pytest.fixture(scope="module")
def relations(spark):
    rows = lambda tenant, n: [(tenant, i, f"{tenant}{i}") for i in range(n)]
    t = spark.createDataFrame(rows("one", 5) + rows("two", 9) + [(None, 77, "nobody's")], "tenant_id string, a int, b string")
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("secret")
    yield {"t": Relation(t), "u": Relation(t.where("a % 2 = 0")), "shared": Relation(spark.range(3).withColumnRenamed("id", "a"), None)}
    spark.catalog.dropTempView("secret")


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(spark, relations, sql):
    assert gate.refusals(spark, sql, list(relations)) == []
    gate.run_gated(spark, sql, relations, "one").schema  # noqa: B018  it can be analysed


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, relations, sql):
    found = gate.refusals(spark, sql, list(relations))
    assert found and REFUSED[sql] in "; ".join(found)
    with pytest.raises(QueryRefused):
        gate.run_gated(spark, sql, relations, "one")


def test_only_the_tenants_rows(spark, relations):
    run = lambda sql, tenant="one", **args: [tuple(r) for r in gate.run_gated(spark, sql, relations, tenant, args).collect()]
    assert run("select count(*), count(distinct tenant_id), min(tenant_id) from t") == [(5, 1, "one")]
    assert run("select count(*) from t full join u on t.a <> u.a + 1000 where t.tenant_id <> 'one' or u.tenant_id <> 'one'") == [(0,)]
    assert run("select (select max(a) from t), (select count(*) from u where a in (select a from t)), (select count(*) from shared)") == [(4, 3, 3)]
    assert run("with x as (select * from t union all select * from u) select count(*) from x where tenant_id is null or tenant_id = :other", other="two") == [(0,)]
    assert run("select a from t where b = concat(:tenant, '3')", "two") == [(3,)]
    assert run("select count(*) from t", "x' or '1' = '1") == [(0,)]
    for sql, named in (("select a from t where b = :period", "period"), ("select nothing from t", "nothing")):
        with pytest.raises(QueryRefused, match=named):
            run(sql)
    for tenant in ("", None):
        with pytest.raises(QueryRefused):
            run("select 1", tenant)


def test_the_predicate_reaches_every_scan(spark, relations, tmp_path):
    relations["t"].rows.write.parquet(str(tmp_path / "t"))
    stored = {"t": Relation(spark.read.parquet(str(tmp_path / "t")))}
    out = gate.run_gated(spark, "select x.a from t x join t y on x.a = y.a where x.b in (select b from t)", stored, "one")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(tenant_id,one)") == plan.count("PushedFilters") == 3


SOURCE = """select tenant_id, 'own' as source_key, b as entity_id, date'2024-01-01' as metric_date, 'm' as measure_key, a as value, cast(null as string) as subject_key,
cast(null as array<struct<key:string,value:string,label:string>>) as dimensions from t where a >= :least"""


def test_a_metric_over_a_query(spark, relations):
    observations = gate.observations_by_sql(spark, SOURCE, relations, "two", "own", {"least": 7})
    out = period(observations, [Metric("own.m", "sum", "own", ("m",))], Scope(tenant_id="two"))
    assert sorted(map(tuple, out.collect())) == [("two7", 7.0), ("two8", 8.0)]
    assert observations.join(spark.createDataFrame([("two8",)], "entity_id string"), "entity_id").count() == 1
    with pytest.raises(QueryRefused) as e:
        gate.observations_by_sql(spark, "select tenant_id, 1 as value, current_timestamp() as metric_date from t", relations, "two", "own")
    assert "column entity_id is lacking" in e.value.reasons and "column metric_date is timestamp, not date" in e.value.reasons and not any("value" in r.split()[1] for r in e.value.reasons)


def test_queries_by_parts(relations):
    rows = lambda **x: [tuple(r) for r in gate.tenant_rows(relations["t"], "one", **x).collect()]
    assert rows(columns=["a", "b"], filters=[("a", ">=", 1), ("b", "in", ["one1", "one3", "two4"])], order=["a desc"]) == [(3, "one3"), (1, "one1")]
    assert rows(columns=["a"], order=["a"], limit=2, offset=1) == [(1,), (2,)]
    assert rows(columns=["a"], filters=[("b", "=", "' or 1 = 1 --")]) == []
    for wrong in ({"columns": ["a; drop table t"]}, {"filters": [("a = 1 or 1", "=", 1)]}, {"filters": [("a", "like", "x")]}, {"order": ["a desc nulls first"]}, {"order": ["a, b"]}, {"order": ["(select 1)"]}, {"limit": -1}, {"limit": True}, {"offset": "1"}):
        with pytest.raises(QueryRefused):
            rows(**wrong)
