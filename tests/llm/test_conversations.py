"""The repair of conversations against all edits of short ones, and the damage against its rule."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from millrace.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, cost string, nth long"
GRAMMAR = re.compile(r"(s?(ua)+)?")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    for conv_id, turn, role, text, *_ in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        role, text, f = " " if role is None else role, " " if text is None else text, zlib.crc32(name.encode()) % 20
        if f == 1:
            text = ""
        if f == 2:
            text = re.sub("[.!?]", "", text)
        if f == 4:
            role = "user"
        yield from [(conv_id, turn, role, text)] * {0: 0, 3: 2}.get(f, 1)


def best_edit(rows, doomed, cut):
    """Least (cost, labels, rows) of all edits up to the price of deleting everything."""
    found = [(10**9, "", None)]

    def go(i, out, cost, labels, inserted):
        if cost > min(found)[0] or not re.fullmatch(r"s?(ua)*u?", "".join(o[0][:1] or "-" for o in out)):
            return
        if i == len(rows) and GRAMMAR.fullmatch("".join(o[0][:1] for o in out)):
            found.append((cost, labels, out))
        if inserted < 2:
            for role in ("user", "assistant"):
                go(i, [*out, (role, "")], cost + 5, labels + "I", inserted + 1)
        if i < len(rows):
            go(i + 1, out, cost + 2, labels + "D", 0)
            if not doomed[i]:
                go(i + 1, [*out, rows[i]], cost + cut[i], labels + "K", 0)
                for role in ("user", "assistant"):
                    go(i + 1, [*out, (role, rows[i][1])], cost + 1 + cut[i], labels + "R", 0)

    go(0, [], 0, "", 0)
    return min(found, key=lambda x: x[:2])


def expected(rows, original):
    out = {}
    for conv_id in {r[0] for r in original}:
        own = sorted([r[1:] for r in rows if r[0] == conv_id], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen, doomed, cut = [0, 0, 0], set(), [], []
        for _, role, text in own:
            last = (WORD.findall(text) or [""])[-1]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            doomed.append(fault in (0, 1))
            cut.append(5 if fault == 2 else 0)
        turns = {r[0] for r in own if r[0] is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, labels, left = best_edit([r[1:] for r in own], doomed, cut)
        digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in left).encode()).hexdigest()
        out[conv_id] = (len(own), max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, cost, labels, digest), left
    return out


def table(seed=4, n=70):
    r = random.Random(seed)
    text = lambda: r.choice(["Yes.", "No!", "é?", "cut off", "end. \n", "", " \t", None, "Yes.", "a\nb."])
    rows = []
    for conv_id in range(n):
        for turn in range(r.randrange(6)):
            rows.append((conv_id, r.choice([turn, turn, turn, 2 * turn, None]), r.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User", "aide"]), text(), "x", 1))
    rows += [(None, 0, "user", "One.", "x", 1), (None, 1, "assistant", "Two.", "x", 1), (n, 5, "user", "Same.", "x", 1), (n, 5, "user", "Same.", "x", 1), (n, 5, "assistant", "Same.", "x", 1)]
    gone = next(i for i in range(1000, 9999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return rows + [(gone, 0, "user", "Lost.", "x", 1)]


def check(spark, rows, frame, cut):
    got = {r[0]: tuple(r)[1:] for r in C.audit(frame).collect()}
    want = expected(rows, cut)
    assert got == {k: v for k, (v, _) in want.items()}
    kept = {}
    for r in C.repaired(frame).orderBy("conv_id", "place").collect():
        assert r["place"] == len(kept.setdefault(r["conv_id"], []))
        kept[r["conv_id"]].append((r["role"], r["text"]))
    assert kept == {k: v for k, (_, v) in want.items() if v}


def test_repair(spark):
    rows = table()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x, *_ in rows]
    check(spark, plain, C.plain(frame), rows)


def test_damage_and_repair(spark):
    rows = table(9)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = C.damaged(frame)
    assert sorted(map(tuple, made.where("copies > 0").withColumn("k", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "k").collect()), key=repr) == sorted(damage(rows), key=repr)
    check(spark, list(damage(rows)), made, rows)


def test_search_of_all_symbols():
    r = random.Random(2)
    for _ in range(150):
        symbols = bytes(r.randrange(12) for _ in range(r.randrange(6)))
        rows = [("sua-"[s % 4], "t") for s in symbols]
        assert C.search(symbols) == (lambda b: (b[0], b[1].encode()))(best_edit(rows, [s > 7 for s in symbols], [5 * (4 <= s < 8) for s in symbols]))


def test_a_long_conversation(spark):
    """Longer than what is held in memory and than a batch; fit for the grammar but for one row."""
    n = 40_001
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat("id", F.lit(" " * 300 + ".")).alias("text"))
    out = C.audit(C.plain(rows)).collect()
    assert len(out) == 1 and (out[0]["n_turns"], out[0]["cost"], out[0]["illegal"]) == (n, 2, 0)
    kept = [f"{'user' if i % 2 == 0 else 'assistant'}:{i}{' ' * 300}." for i in range(n - 1)]
    assert out[0]["audit"] == "K" * (n - 1) + "D" and out[0]["repaired_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.audit(C.damaged(none)).isEmpty() and C.repaired(C.plain(none)).isEmpty()
