"""Overlap by ranks and visibility by ranges, against loops over all pairs, and the number of rows that they make."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import hierarchy, sequences


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


@pytest.mark.parametrize("seed", range(3))
def test_overlaps(spark, seed):
    r = random.Random(seed)

    def side(n):
        out = []
        for i in range(n):
            a = r.randrange(8000)
            out.append((r.choice(["x", "x", "y", None]), i, at(a) if r.random() < 0.97 else None, r.choice([at(a), at(a + r.randrange(3000)), at(a + 5), at(a - 3), None])))
        return out

    left, right = side(90), side(70)
    got = sequences.overlaps(spark.createDataFrame(left, "k string, i int, a timestamp, b timestamp"), spark.createDataFrame(right, "k string, j int, c timestamp, d timestamp"), ["k"], ("a", "b"), ("c", "d"))
    assert got.columns == ["k", "i", "a", "b", "j", "c", "d", "overlap_start", "overlap_end"]
    want = [
        (k, i, j, max(a, c), min((x for x in (b, d) if x), default=None)) for k, i, a, b in left for k2, j, c, d in right if k is not None and k == k2 and a and c and (d is None or a < d) and (b is None or c < b)
    ]
    key = lambda x: repr(x)
    assert sorted(((x["k"], x["i"], x["j"], x["overlap_start"], x["overlap_end"]) for x in got.collect()), key=key) == sorted(want, key=key)


def test_disjoint_intervals_of_one_key(spark, monkeypatch):
    """A hundred thousand on each side, each of which meets one: rows stay linear, and no step holds them all."""
    n = 100_000
    span = lambda shift, names: spark.range(n).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 60 + shift).alias(names[0]), F.timestamp_seconds(F.col("id") * 60 + shift + 20).alias(names[1]))
    made = []
    monkeypatch.setattr(sequences, "_starting_inside", lambda *a, f=sequences._starting_inside: made.append(f(*a)) or made[-1])
    assert sequences.overlaps(span(0, "ab"), span(10, "cd"), ["k"], ("a", "b"), ("c", "d")).count() == n
    assert sum(m.count() for m in made) == n


def test_many_copies_of_one_interval(spark):
    left = spark.createDataFrame([("k", at(0), at(10))], "k string, a timestamp, b timestamp")
    right = spark.range(10_000).select(F.lit("k").alias("k"), F.lit(at(5)).alias("c"), F.lit(None).cast("timestamp").alias("d"))
    assert sequences.overlaps(left, right, ["k"], ("a", "b"), ("c", "d")).count() == 10_000


def forest(r, n=60):
    return [(f"n{r.randrange(i)}", f"n{i}") for i in range(1, n) if r.random() < 0.85]


@pytest.mark.parametrize("seed", range(3))
def test_visible_ranges(spark, seed):
    r = random.Random(seed)
    edges, names = forest(r), [f"n{i}" for i in range(63)]
    below = {x: {x} for x in names}
    for p, c in reversed(edges):
        below[p] |= below[c]
    viewers = [f"n{i}" for i in range(0, 63, 2)] + ["unknown"]
    grants = [(r.choice(viewers), r.choice([*names, "gone", "*" if r.random() < 0.2 else "n1"])) for _ in range(40)]
    want = {v: set(names) if (v, "*") in grants else set().union(below.get(v, set()), *[below.get(x, set()) for w, x in grants if w == v]) for v in viewers}
    e = spark.createDataFrame(edges, "parent string, child string").repartition(3)
    numbers = hierarchy.numbering(e, spark.createDataFrame([(x,) for x in names], "node string"))
    rows = numbers.collect()
    for x in rows:
        assert {y["node"] for y in rows if y["root"] == x["root"] and x["start"] <= y["start"] < x["start"] + x["size"]} == below[x["node"]] and (x["least"], x["greatest"]) == (min(below[x["node"]]), max(below[x["node"]]))
    g = spark.createDataFrame(grants, "viewer string, node string")
    ranges = hierarchy.visible_ranges(numbers, spark.createDataFrame([(v,) for v in viewers], "viewer string"), g)
    assert ranges.count() <= len(viewers) + len(grants)
    assert {x["viewer"]: (x["nodes"], x["first_node"], x["last_node"]) for x in hierarchy.visible_counts(numbers, ranges).collect()} == {v: (len(s), min(s), max(s)) for v, s in want.items() if s}
    asked = [(v, x) for v in viewers for x in [*names, "gone"]]
    assert {(x["viewer"], x["node"]) for x in hierarchy.can_see(numbers, ranges, spark.createDataFrame(asked, "viewer string, node string")).where("seen").collect()} == {(v, x) for v, s in want.items() for x in s}


def test_no_forest(spark):
    with pytest.raises(ValueError):
        hierarchy.numbering(spark.createDataFrame([("a", "c"), ("b", "c")], "parent string, child string"), spark.createDataFrame([], "node string"))
    assert hierarchy.numbering(spark.createDataFrame([], "parent string, child string"), spark.createDataFrame([], "node string")).isEmpty()
    cycle = spark.createDataFrame([("a", "b"), ("b", "a"), ("r", "s")], "parent string, child string")
    assert {x["node"] for x in hierarchy.numbering(cycle, spark.createDataFrame([("i",)], "node string")).collect()} == {"r", "s", "i"}
