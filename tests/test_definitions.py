"""Probes of definitions against a loop, custom metrics as graphs and as JSON, and many metrics against one at a time."""

import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from millrace.plans import custom, probes
from millrace.plans.custom import CustomMetric, evaluate_many
from millrace.plans.metrics import Metric, Scope, Transform, evaluate

OBSERVATION = "tenant_id string, source_key string, entity_id string, metric_date date, measure_key string, value double, subject_key string, dimensions array<struct<key:string,value:string,label:string>>"
DAY = dt.date(2024, 6, 1)


def random_rows(r, n=400):
    for _ in range(n):
        tags = [(k, "x", "X") for k in ("a", "b") if r.random() < 0.8]
        yield "t", r.choice(["s", "z"]), r.choice(["e1", "e2", "e3"]), DAY - dt.timedelta(r.randrange(90)), r.choice("mnopq"), r.choice([None, 0.0, 1.5, -2.0, float(r.randrange(9))]), r.choice([None, "u", "v", "w"]), r.choice([tags, tags, None])


# -- many metrics


def test_many_metrics_as_one_at_a_time(spark):
    r = random.Random(3)
    rows = list(random_rows(r))
    observations = spark.createDataFrame(rows, OBSERVATION).repartition(3)
    metrics = [Metric(f"k.{kind}{i}", kind, s, over, transform=t) for i, (s, over, t) in enumerate([("s", ("m",), None), ("z", ("m", "o"), Transform(2.0, 1.0, 0.0, 9.0)), ("s", ("p", "m"), None), ("s", ("none",), None)]) for kind in ("sum", "median", "distinct")]
    metrics += [Metric(f"k.ratio{i}", "ratio", "s", ("m",), u, 7.0) for i, u in enumerate([("n",), ("none",), ("m", "o")])]
    scope = Scope("t", "2024-04-01", "2024-05-20")
    for keys in (["entity_id"], ["entity_id", "metric_date"]):
        got = {(*[x[k] for k in keys], x["metric_key"]): x["value"] for x in evaluate_many(observations, metrics, scope, keys).collect()}
        want = {}
        for x in evaluate(scope.of(observations, metrics), metrics, keys).collect():
            want |= {(*[x[k] for k in keys], m.key): x[m.column] for m in metrics if x[m.column] is not None}
        assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


def test_fifty_metrics_scan_once(spark, tmp_path):
    spark.createDataFrame(list(random_rows(random.Random(4), 50)), OBSERVATION).write.parquet(str(tmp_path / "o"))
    counts = []

    def counting(df, label):
        counts.append(df._jdf.queryExecution().executedPlan().toString().count("FileScan"))
        return df

    metrics = [Metric(f"k.m{i}", ("sum", "median", "distinct", "ratio")[i % 4], "s", ("mnopq"[i % 5],), ("n",) if i % 4 == 3 else ()) for i in range(50)]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(custom, "saved", counting)
        evaluate_many(spark.read.parquet(str(tmp_path / "o")), metrics).collect()
    assert counts == [1]


# -- graphs

GOOD = CustomMetric("own.rate", "Rate", "ratio", "own", "select * from observations", ("a", "b"), (("numerator", "a"), ("denominator", "b")), dimensions=("tool",), scale=100.0, transform=(1.0, 0.0, None, 100.0), peer_cohort_key="org_unit", unit="%")
WRONG = [
    ({"metric_key": "Own.rate"}, "metric_key"), ({"metric_key": "rate"}, "metric_key"), ({"source_key": "1own"}, "source_key"), ({"entity_type": "a-b"}, "entity_type"), ({"peer_cohort_key": ""}, "peer_cohort_key"), ({"measures": ()}, "measures"),
    ({"measures": ("a", "a", "b")}, "measures"), ({"measures": tuple(f"m{i}" for i in range(65)) + ("a", "b")}, "measures"), ({"dimensions": ("Tool",)}, "dimensions"), ({"tags": ("x", "x")}, "tags"), ({"inputs": (("value", "a"),)}, "inputs"), ({"inputs": ()}, "inputs"),
    ({"inputs": (("numerator", "a"), ("denominator", "c"))}, "inputs"), ({"inputs": (("numerator", "a"), ("numerator", "b"))}, "inputs"), ({"scale": None}, "scale"), ({"computation": "sum", "inputs": (("value", "a"),)}, "scale"), ({"computation": "mean"}, "computation"),
    ({"observation_sql": "drop table x"}, "observation_sql"), ({"observation_sql": "select * from secret"}, "observation_sql"), ({"observation_sql": "select 1 -- " + "x" * 70_000}, "observation_sql"), ({"transform": (1.0, 0.0, 5.0, 1.0)}, "transform"),
]


@pytest.mark.parametrize("change, field", WRONG)
def test_violations(spark, change, field):
    assert GOOD.violations(spark, ["observations"]) == []
    found = replace(GOOD, **change).violations(spark, ["observations"])
    assert found and field in {f for f, _ in found}


def test_json_round_trip_and_import(spark):
    other = replace(GOOD, metric_key="own.count", source_key="own2", computation="distinct_count", inputs=(("value", "a"),), scale=None, transform=None, tags=("x", "y"))
    assert [CustomMetric.from_json(m.to_json()) for m in (GOOD, other)] == [GOOD, other]
    known, skipped = custom.import_metrics(spark, {}, [GOOD.to_json(), other.to_json(), GOOD.to_json()], ["observations"])
    assert set(known) == {"own.rate", "own.count"} and skipped == ["own.rate"]
    again, skipped = custom.import_metrics(spark, {}, custom.export_metrics(known), ["observations"])
    assert again == known and not skipped
    same_source = replace(other, metric_key="own.third").to_json()
    assert custom.import_metrics(spark, known, [same_source], ["observations"]) == (known, ["own.third"])
    for texts in ([GOOD.to_json(), replace(GOOD, scale=None).to_json()], ['{"metric_key": "a.b", "colour": 1}'], [GOOD.to_json()] * 501):
        with pytest.raises(ValueError):
            custom.import_metrics(spark, {}, texts, ["observations"])
    m = other.compiled()
    assert (m.kind, m.measures, m.denominator, GOOD.compiled().denominator, GOOD.compiled().transform) == ("distinct", ("a",), (), ("b",), Transform(1.0, 0.0, None, 100.0))


# -- probes


def expected(rows, evidence, metrics, grain, errors):
    out = {}
    for m in metrics:
        measures = dict.fromkeys((*m.measures, *m.denominator))
        own = {k: [r for r in rows if (r[1], r[4]) == (m.source_key, k)] for k in measures}
        last = {k: max(r[3] for r in v) for k, v in own.items() if v}
        recent = {k: [r for r in own[k] if r[3] >= last[k] - dt.timedelta(35)] for k in last}
        uncovered = sorted({d for d in m.dimensions for k in last if not all(any(t[0] == d for t in r[7] or []) for r in recent[k])})
        since = min(last.values()) - dt.timedelta(35) if last else None
        seen = {k: {g for s, e, day, g in evidence if (s, e) == (m.source_key, k) and since is not None and day >= since} for k in measures}
        conflicts = sorted(k for k in measures if (m.source_key, k) in grain and (seen[k] or k in last) and seen[k] != {grain[m.source_key, k]})
        code = errors.get(m.source_key) or (probes.NOT_COVERED if uncovered else None)
        out[m.key] = ("error" if code else "unchecked" if len(last) < len(measures) else "ok", code, max(last.values(), default=None), sorted(k for k in measures if k not in last), uncovered, conflicts)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_probes(spark, seed):
    r = random.Random(seed)
    rows = [x for x in random_rows(r) if not (x[1] == "z" and x[4] == "q")]
    rows = [(*x[:7], [("a", "x", "X"), ("b", "y", "Y")]) if x[4] in "mn" and x[3] > DAY - dt.timedelta(60) else x for x in rows]
    evidence = [(x[1], x[4], x[3], r.choice(["event"] * 30 + ["source_summary"])) for x in rows if r.random() < 0.3]
    metrics = [Metric(f"k.m{i}", "ratio", s, over, under, dimensions=d) for i, (s, over, under, d) in enumerate([("s", ("m",), ("n",), ("a", "b")), ("s", ("m", "o"), ("p",), ("a",)), ("z", ("m",), ("q",), ()), ("z", ("q",), ("q",), ("a",)), ("z", ("m",), ("n",), ("a", "c")), ("s", ("o",), ("m",), ()), ("gone", ("m",), ("n",), ())])]
    grain, errors = {(s, k): "event" for s in "sz" for k in "mnop"}, {"gone": probes.NO_TABLE}
    observations = spark.createDataFrame(rows, OBSERVATION)
    shown = spark.createDataFrame(evidence, "source_key string, measure_key string, metric_date date, granularity string")
    parts = [(observations.where(c), shown.where(c)) for c in ("metric_date > '2024-05-01'", "metric_date <= '2024-05-01'")]
    whole, added = probes.profile(observations, shown), probes.merged(*[probes.profile(o, e) for o, e in parts])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, added.collect()))
    got = {x[0]: tuple(x)[1:] for x in probes.statuses(added, metrics, grain, errors).collect()}
    assert got == expected(rows, evidence, metrics, grain, errors)


def test_missing_columns(spark):
    whole = spark.createDataFrame([], OBSERVATION)
    assert [probes.missing_columns(x) for x in (None, whole.drop("value"), whole.withColumn("more", F.lit(1)))] == [probes.NO_TABLE, probes.NO_COLUMN, None]
