"""Identity administration against loops: folding, listing page by page, the queue and its rates, decisions."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import administration as admin
from millrace.operators import identity
from millrace.operators.identity import EXCLUDED

INPUT = "source_type string, source_id string, account_id string, value_type string, value string, is_delete boolean, synced_at int, version int"
NOW = dt.datetime(2024, 1, 1)


def test_fold(spark):
    r = random.Random(5)
    rows = [("git", "s", r.choice(["1", "2", "3", "", None]), r.choice([*admin.VALUES, "parent_email", "id"]), r.choice(["", None, "a", "b", "x" * 400]), r.random() < 0.2, r.randrange(9), i) for i in range(300)]
    got = {x["account_id"]: x for x in admin.fold_evidence(spark.createDataFrame(rows, INPUT)).collect()}
    assert set(got) == {"1", "2", "3"}
    for account, x in got.items():
        own = sorted((y for y in rows if y[2] == account), key=lambda y: y[6:8])
        last = lambda kind, own=own: next((y[4] for y in reversed(own) if y[3] == kind and y[4] and not y[5] and (kind != "id" or len(y[4]) <= 320)), None)
        assert x["is_closed"] == own[-1][5] and x["binding_id"] == last("id") and x["manager_email"] == last("parent_email") and all(x[v] == last(v) for v in admin.VALUES)


FOLDED = "source_type string, source_id string, account_id string, is_closed boolean, email string, username string, display_name string, first_name string, last_name string, binding_id string"


def test_listing_in_pages(spark):
    r = random.Random(2)
    rows = [(r.choice(["git-hub", "hub_x", "chub"]), "s", str(i), i % 9 == 0, *[r.choice([None, "", "Äb", "hub", "Zoë@x"]) for _ in range(3)], r.choice([None, "An"]), r.choice(["", "Lee"]), None) for i in range(80)]
    folded = spark.createDataFrame(rows, FOLDED)

    def label(x):
        return next(v for v in (x[4], x[5], x[6], " ".join(v for v in x[7:9] if v is not None).strip(), x[2]) if v).lower()

    for needle in ("", "hub", "ZOË", "n le", "7", "git_h"):
        n = needle.lower()
        fits = lambda x, n=n: not n or any(n in (v or "").lower() for v in (x[4], x[5], x[2], x[6], " ".join(v for v in x[7:9] if v is not None).strip())) or "_" + n.replace("-", "_") in "_" + x[0].replace("-", "_")
        want = sorted((label(x), *x[:3]) for x in rows if not x[3] and fits(x))
        got, after = [], None
        while True:
            page = [(x["label"], *[x[c] for c in admin.ACCOUNT]) for x in admin.list_accounts(folded, needle, after, 7).collect()]
            got += page[:7]
            if len(page) < 8:
                break
            after = page[6]
        assert got == want


def test_review(spark):
    r = random.Random(4)
    accounts = [("git", "s", str(i), r.random() < 0.1, r.choice([None, " ", "A@x", "a@X", "b@x", "c@x", "d@x", "e@x"]), None, None, None, None, r.choice([None, "id"])) for i in range(60)]
    bindings = [("git", "s", str(i), r.choice(["P1", "P2", EXCLUDED]) if accounts[i][4] in ("A@x", "a@X", "b@x") else r.choice(["P3", EXCLUDED]), r.choice(["operator", "automatic", "automatic", "unconfirmed", "roster", None])) for i in range(60) if r.random() < 0.5 and accounts[i][4] not in ("d@x", "e@x")]
    owners = [("D@x", "P4"), ("e@x", EXCLUDED)]
    queue, rates = admin.review(spark.createDataFrame(accounts, FOLDED), spark.createDataFrame(bindings, "source_type string, source_id string, account_id string, person_id string, provenance string"), spark.createDataFrame(owners, "email string, person_id string"))
    bound, address = {b[2]: b[3:] for b in bindings}, {a[2]: a[4].lower() if a[4] and a[4].strip() else None for a in accounts}
    items, counts = Counter(), Counter()
    for a in accounts:
        if a[3]:
            continue
        i, e = a[2], address[a[2]]
        people = {bound[j][0] for j in bound if e and address[j] == e and not accounts[int(j)][3] and bound[j][0] != EXCLUDED}
        settled = any(bound[j][1] == "operator" and bound[j][0] != EXCLUDED for j in bound if e and address[j] == e and not accounts[int(j)][3])
        if i in bound:
            state = "excluded" if bound[i][0] == EXCLUDED else "bound"
        else:
            state = "no_evidence" if not e else "contested" if len(people) > 1 else "no_source_id" if not a[9] and not people and e != "d@x" else "pending"
        counts["observed"] += 1
        counts["pending" if state == "contested" else state] += 1
        if state in ("no_evidence", "contested", "no_source_id"):
            items[state, i, len(people)] += 1
        if state == "bound" and bound[i][1] in ("unconfirmed", "roster"):
            items[{"unconfirmed": "provisioned_at_login", "roster": "minted_from_roster"}[bound[i][1]], i, len(people)] += 1
        if len(people) > 1 and not settled:
            items["binding_conflict", i, len(people)] += 1
    assert Counter((x["kind"], x["account_id"], x["n_candidates"]) for x in queue.collect()) == items
    assert rates.first().asDict() == {k: counts[k] for k in ("observed", "bound", "excluded", "no_evidence", "no_source_id", "pending")}


def test_decisions(spark):
    account = "source_type string, source_id string, account_id string"
    bindings = spark.createDataFrame([("git", "s", "1", "P1", "automatic"), ("git", "s", "2", "P1", "operator"), ("git", "s", "3", "P2", "operator")], account + ", person_id string, provenance string")
    people = spark.createDataFrame([("P1",), ("P2",)], "person_id string")
    later = NOW + dt.timedelta(seconds=5)
    journal = spark.createDataFrame([("P1", "git", "s", "id", later), ("P1", "git", "s", "email", later + dt.timedelta(1)), ("P2", "git", "s", "id", NOW - dt.timedelta(1))], "person_id string, source_type string, source_id string, value_type string, created_at timestamp")
    at, micro = F.lit(NOW), dt.timedelta(microseconds=1)
    wanted = lambda *rows: spark.createDataFrame([("git", "s", a, p) for a, p in rows], account + ", person_id string")
    out = lambda df: {x["account_id"]: (x["person_id"], x["outcome"], x["created_at"]) for x in df.collect()}
    done = admin.bind(wanted(("1", "P1"), ("2", "P1"), ("3", "P1"), ("4", "P2")), people, bindings, journal, at, "why")
    assert out(done) == {"1": ("P1", "applied", later + micro), "2": ("P1", "already_decided", None), "3": ("P1", "applied", later + 2 * micro), "4": ("P2", "applied", NOW)}
    after = {x["account_id"]: (x["person_id"], x["provenance"]) for x in admin.decided(bindings, done).collect()}
    assert after == {"1": ("P1", "operator"), "2": ("P1", "operator"), "3": ("P1", "operator"), "4": ("P2", "operator")}
    assert {k: v[:2] for k, v in out(admin.merge("P1", "P2", people, bindings, journal, at)).items()} == {"1": ("P2", "applied"), "2": ("P2", "applied")}
    one = wanted(("3", "x")).select(*admin.ACCOUNT)
    assert out(admin.detach(one, F.lit("P9"), bindings, journal, at)) == {"3": ("P9", "applied", NOW)}
    assert out(admin.exclude(one, bindings, journal, at)) == {"3": (EXCLUDED, "applied", NOW)}
    for rows in ([("1", "P1"), ("1", "P2")], [("1", EXCLUDED)], [("1", "nobody")], [(str(i), "P1") for i in range(1001)], []):
        with pytest.raises(admin.Refused):
            admin.bind(wanted(*rows), people, bindings, journal, at)
    for pair in (("P1", "P1"), ("P1", EXCLUDED), ("P1", "nobody")):
        with pytest.raises(admin.Refused):
            admin.merge(*pair, people, bindings, journal, at)


OBSERVED = "person_id string, source_type string, source_id string, value_type string, value string, created_at int, id int"


def test_labels_and_current_values(spark):
    """Against loops: blank and null values that take a source's or all sources' value back, equal instants."""
    r = random.Random(9)
    kinds = ["display_name", "first_name", "last_name", "username", "email", "id"]
    rows = [(f"p{r.randrange(12)}", r.choice("ab"), "s", r.choice(kinds), r.choice([None, "", " ", "x", "y ", "z"]), r.randrange(6), i) for i in range(250)]
    df = spark.createDataFrame(rows, OBSERVED)
    each = {x[:4]: x for x in sorted(rows, key=lambda x: x[5:])}
    assert sorted(map(tuple, identity.current_values(df).collect()), key=str) == sorted(each.values(), key=str)
    last = {(x[0], x[3]): (x[4] or "").strip() for x in sorted(rows, key=lambda x: x[5:])}
    want = {}
    for p in {x[0] for x in rows if x[3] != "id"}:
        display, first, family, user, mail = (last.get((p, k), "") for k in kinds[:5])
        want[p] = display or " ".join(filter(None, [first, family])) or user or mail or None
    assert {x["person_id"]: x["label"] for x in identity.labels(df).collect()} == want
    assert identity.labels(df.limit(0)).count() == 0


def test_account_persons(spark):
    rows = [("p", "a", "s", "id", "1", 5, 1), ("q", "a", "s", "id", "1", 5, 2), ("q", "a", "s", "id", "1", 7, 3), ("p", "a", "s", "id", "1", 9, 4), ("p", "a", "s", "id", None, 9, 5), ("p", "b", "s", "id", "1", 1, 6), ("p", "a", "s", "email", "1", 6, 7)]
    got = {tuple(x) for x in identity.account_persons(spark.createDataFrame(rows, OBSERVED)).collect()}
    assert got == {("a", "s", "1", "q", 5, 7), ("a", "s", "1", "q", 7, 9), ("a", "s", "1", "p", 9, None), ("b", "s", "1", "p", 1, None)}
