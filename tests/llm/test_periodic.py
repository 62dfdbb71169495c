"""Periodic runs against a search of all periods and starts."""

import hashlib
import random
import zlib

import pytest

from millrace.llm import periodic

COLUMNS = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "n_dropped", "text"]


def all_runs(w, least=6, periods=4):
    """Maximal stretches of each period, without those whose smallest period is another."""
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, periods * q) and not any(all(w[k] == w[k + r] for k in range(i, i + n - r)) for r in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text, damaged):
    w = (text or "").encode().split()
    if damaged and doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = all_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    return (len(w), len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest, len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone))


def texts(n, seed, longest=80):
    r = random.Random(seed)
    for _ in range(n):
        w, kinds = [], r.choice([1, 2, 3, 6])
        while len(w) < r.randrange(longest):
            unit = [f"é{r.randrange(kinds)}" for _ in range(r.randint(1, 6))]
            w += (unit * 9)[: r.randint(1, 9 * len(unit))]
        yield r.choice([" ", "\n", " \t "]).join(w)


def test_runs_of_short_alphabets():
    for text in texts(1500, 1):
        assert periodic.runs_of(text.encode().split()) == all_runs(text.encode().split())


@pytest.mark.parametrize("periods", [2, 3, 5])
def test_other_exponents(periods):
    for text in texts(300, periods):
        w = text.split()
        ids = [sorted(set(w)).index(x) for x in w]
        found = sorted((s, last - s + 1, q) for (s, q), last in periodic.automaton_runs(ids, periods).items())
        assert found == sorted(all_runs(w, 0, periods))


def test_many_kinds_of_words():
    w = [b"%d" % i for i in range(3000)] + [b"a", b"b", b"c"] * 7 + [b"%d" % i for i in range(3000)]
    assert periodic.runs_of(w) == [(3000, 21, 3)]


@pytest.mark.parametrize("damaged", [False, True])
def test_documents(spark, damaged):
    rows = [(i, t, 1, "s") for i, t in enumerate(texts(120, 7))]
    rows += [(200, None, 1, "s"), (201, "", 1, "s"), (202, " \n", 1, "s"), (203, "word", 1, "s"), (None, "a " * 50, 1, "s"), (None, None, 1, "s"), rows[3], rows[3], (3, rows[4][1], 1, "s")]
    rows += [(300 + i, " ".join(str(k % 411) for k in range(2000)), 1, "s") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period long, runs_sha256 string").repartition(3)
    got = [(r["doc_id"], *[bytes(r[c]) if c == "text" else r[c] for c in COLUMNS]) for r in periodic.periodic_runs(docs, damaged=damaged).collect()]
    assert sorted(got, key=repr) == sorted([(i, *expected(i, t, damaged)) for i, t, *_ in rows], key=repr)


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.periodic_runs(none).columns == ["doc_id", *COLUMNS] and periodic.periodic_runs(none).isEmpty()


def test_a_long_text():
    assert periodic.runs_of([b"x"] * 30000) == [(0, 30000, 1)]
    assert periodic.runs_of([b"%d" % (i % 4000) for i in range(20000)]) == [(0, 20000, 4000)]
