"""Publication of whole copies, days fetched again, managers' addresses in runs, and exports within limits."""

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from millrace.operators import sequences, staging
from millrace.plans import drilldown
from millrace.sources import snapshots
from millrace.sources.landing import StaleSnapshot

# -- snapshots


def test_publish_and_read(spark, tmp_path):
    base = f"file://{tmp_path}/s"
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, base)
    df = spark.range(10).withColumn("x", F.col("id") % 3)
    assert snapshots.publish(df, base, "2024-01-02", expected=0) == 1
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(df, base, "2024-01-03", expected=0)
    assert snapshots.publish(df.limit(8), base, "2024-01-03", expected=1) == 2
    for bad, when in ((df, "2024-01-01"), (df.limit(2), "2024-01-04")):
        with pytest.raises(StaleSnapshot):
            snapshots.publish(bad, base, when)
    assert (snapshots.read_snapshot(spark, base).count(), snapshots.read_snapshot(spark, base, 1).count(), snapshots.manifest(spark, base)["taken_at"]) == (8, 10, "2024-01-03")
    assert snapshots.read_snapshot(spark, base).dtypes == df.dtypes


def test_a_crash_leaves_the_old_copy(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}/s"
    snapshots.publish(spark.range(5), base, "1")

    def stop(*_):
        raise KeyboardInterrupt

    for name in ("_put_new", "_read"):  # before the manifest is put in place, and before anything is known
        with monkeypatch.context() as m:
            m.setattr(snapshots, name, stop)
            with pytest.raises(KeyboardInterrupt):
                snapshots.publish(spark.range(6), base, "2")
        assert snapshots.read_snapshot(spark, base).count() == 5 and snapshots.versions(spark, base) == [1]
    assert snapshots.publish(spark.range(7), base, "3") == 2
    assert not [p for p in (tmp_path / "s" / "manifests").iterdir() if p.name.endswith(".draft")]
    assert snapshots.collect_orphans(spark, base) == []  # too young
    gone = snapshots.collect_orphans(spark, base, keep=1, older_than_seconds=-1)
    assert len(gone) == 2 and snapshots.versions(spark, base) == [2] and snapshots.read_snapshot(spark, base).count() == 7


def test_of_two_writers_one_wins(spark, tmp_path):
    base = f"file://{tmp_path}/s"
    snapshots.publish(spark.range(100), base, "1")
    barrier, out = threading.Barrier(4), []

    def write(k):
        barrier.wait()
        try:
            out.append((snapshots.publish(spark.range(100 + k), base, "2", expected=1), k))
        except snapshots.Conflict:
            out.append((None, k))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(1, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    won = [k for version, k in out if version == 2]
    assert len(won) == 1 and len(out) == 4 and snapshots.read_snapshot(spark, base).count() == 100 + won[0]


# -- managers

USERS = "tenant_id string, source_id string, id string, mail string, upn string, dn string, manager_dn string"
HISTORY = "tenant_id string, source_id string, entity_id string, field_name string, new_value string, updated_at long"


@pytest.mark.parametrize("seed", range(2))
def test_managers_by_runs_as_at_once(spark, seed):
    """People get other addresses and managers from run to run; what the runs add up to is what one run over all changes tells."""
    r = random.Random(seed)
    people = {f"p{i}": [f"m{i}@x", r.choice([None, f"u{i}@x"]), f"CN={i}", ""] for i in range(12)}
    history, added, clock = [], [], 0
    for _ in range(4):
        since = clock
        for _ in range(10):
            clock += 1
            who = r.choice(list(people))
            field = r.choice(["managerDn", "managerDn", "mail", "userPrincipalName"])
            value = r.choice(["", *[f"CN={i}" for i in range(12)], "CN=unknown"]) if field == "managerDn" else r.choice(["", f"n{clock}@x"])
            at = {"managerDn": 3, "mail": 0, "userPrincipalName": 1}[field]
            people[who][at] = value
            history.append(("t", "s", who, field, value, clock))
        users = spark.createDataFrame([("t", "s", k, *v) for k, v in people.items()], USERS)
        changes = spark.createDataFrame(history, HISTORY)
        added += staging.manager_inputs(changes, users, F.lit(since)).collect()
    everything = staging.manager_inputs(changes, users)
    inputs = spark.createDataFrame(added, everything.schema)
    own = lambda df: {(x["account_id"], x["value_type"]): x["value"] for x in staging.current_managers(df).collect()}
    whole = own(everything)
    assert own(inputs) == whole
    by_dn = {v[2]: (k, v) for k, v in people.items()}
    for who, v in people.items():
        boss = by_dn.get(v[3])
        if boss and v[3]:
            address = boss[1][0] if boss[1][0] is not None else boss[1][1]
            assert whole.get((who, "parent_id")) == boss[0]
            assert not address or whole[who, "parent_email"] == address


def test_a_changed_address_goes_to_the_reports_alone(spark):
    users = spark.createDataFrame([("t", "s", "boss", "new@x", None, "CN=b", ""), ("t", "s", "a", "a@x", None, "CN=a", "CN=b"), ("t", "s", "c", "c@x", None, "CN=c", "CN=b"), ("t", "s", "d", "d@x", None, "CN=d", "CN=a"), ("u", "s", "e", "e@x", None, "CN=e", "CN=b")], USERS)
    history = spark.createDataFrame([("t", "s", "boss", "mail", "new@x", 5), ("t", "s", "boss", "userPrincipalName", "", 5), ("t", "s", "d", "managerDn", "", 6), ("t", "s", "c", "managerDn", "CN=b", 1)], HISTORY)
    got = sorted(tuple(x)[2:] for x in staging.manager_inputs(history, users, F.lit(4)).collect())
    assert got == [("a", "parent_email", "new@x", "mail", "UPSERT", 5), ("c", "parent_email", "new@x", "mail", "UPSERT", 5), ("d", "parent_email", "", "managerDn", "DELETE", 6), ("d", "parent_id", "", "managerDn", "DELETE", 6)]
    lost = users.withColumn("mail", F.when(F.col("id") != "boss", F.col("mail")))
    assert {(x["account_id"], x["operation"]) for x in staging.manager_inputs(history, lost, F.lit(4)).where("value_type = 'parent_email'").collect()} == {("a", "DELETE"), ("c", "DELETE"), ("d", "DELETE")}


# -- fetched again


def test_windows_supersede_what_was_known(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [("i", "k1", day(1), 1, "main"), ("i", "k2", day(1), 1, "main"), ("i", "k1", day(2), 1, "main"), ("i", "k1", day(1), 5, "resync"), ("i", "k3", day(2), 5, "resync"), ("i", "k4", day(2), 9, "main"), ("j", "k2", day(1), 1, "main"), ("i", "k5", day(3), 7, "main"), ("i", "k5", day(3), 7, "resync"), (None, "k", day(1), 1, "main")]
    windows = [("i", day(1), day(2), 5), ("i", day(1), day(1), 3)]
    r = spark.createDataFrame(rows, "instance string, key string, day date, version int, origin string")
    w = spark.createDataFrame(windows, "instance string, day_from date, day_to date, version int")
    run = lambda r, w: sorted(map(tuple, staging.resynced(r, w, ["instance"], ["key", "day"], "day", "version", "origin").collect()), key=repr)
    want = sorted([rows[i] for i in (3, 4, 5, 6, 8, 9)], key=repr)
    assert run(r, w) == want == run(r.unionByName(r), w.unionByName(w)) == run(spark.createDataFrame(run(r, w), r.schema), w)
    assert run(r, w.limit(0)) == sorted([rows[i] for i in (1, 2, 3, 4, 5, 6, 8, 9)], key=repr)


# -- exports


def test_running_total(spark):
    r = random.Random(1)
    rows = [(r.randrange(10**6), i, r.randrange(9)) for i in range(5000)]
    got = {x["i"]: (x["total"], x["place"]) for x in sequences.running_total(spark.createDataFrame(rows, "k int, i int, n int").repartition(5), ["k", "i"], F.col("n"), "total", "place").collect()}
    total = 0
    for place, (_, i, n) in enumerate(sorted(rows), 1):
        total += n
        assert got[i] == (total, place)


TEXTS = ["plain", "with, comma", 'with "quotes"', "line\nfeed", " spaces ", "=formula", "é" * 9, "", None]


def test_limits_of_an_export(spark, tmp_path):
    df = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)]) for i in range(90)], "n int, text string")
    labels = {"n": "N", "text": 'The "text", in full'}
    drilldown.export_csv(df.coalesce(1), str(tmp_path / "a"), labels)
    size = sum(p.stat().st_size for p in (tmp_path / "a").glob("*.csv"))
    drilldown.export_csv(df.coalesce(1), str(tmp_path / "b"), labels, size=size, cell=18)
    for name, limit in (("c", {"size": size - 1}), ("d", {"cell": 17}), ("e", {"rows": 89})):
        with pytest.raises(drilldown.ExportLimit):
            drilldown.export_csv(df, str(tmp_path / name), labels, **limit)
        assert not (tmp_path / name).exists()
    drilldown.export_csv(df.limit(0), str(tmp_path / "f"), labels)


def test_the_cut_row(spark, tmp_path):
    df = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)]) for i in range(90)], "n int, text string").repartition(5)
    labels = {"n": "N", "text": "Text"}
    for size in (0, 7, 8, 500, 10**6):
        kept = drilldown.within_budget(df, ["n"], labels, size).orderBy("place")
        rows = kept.collect()
        assert [x["place"] for x in rows] == list(range(1, len(rows) + 1))
        kept.drop("place", "bytes").coalesce(1).write.options(header=True, **drilldown._CSV).csv(str(tmp_path / str(size)))
        written = sum(p.stat().st_size for p in (tmp_path / str(size)).glob("*.csv"))
        assert not rows or written == rows[-1]["bytes"] + 7 <= size
        assert len(rows) == 90 or drilldown.within_budget(df, ["n"], labels, size + 60).count() > len(rows)
    assert drilldown.within_budget(df, ["n"], labels, cell=17).count() == 6
