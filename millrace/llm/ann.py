"""Approximate nearest neighbours by inner product: stable projections, a kd-tree over them, and a chi-square stopping test.

Vectors get one more component so that the largest inner product is the smallest Euclidean distance, and are projected to a
few Gaussian directions. A squared projected distance, divided by the squared distance, follows the chi-square law with as
many degrees of freedom. So neighbours are looked at in order of projected distance and verified on the original vectors,
until the law says that a point nearer than the k-th found so far would, with probability `confidence`, have come up already.

The projections are indexed by a kd-tree, fitted on a bounded sample; its leaves are the cells by which all rows are
dealt. Each query first searches its own cell and the nearest few, which bounds its k-th distance; then it visits the
other cells whose box is near enough for the test to go on. Queries and rows meet in blocks of bounded size, joined by cell and
part: a cell with more rows than a block holds (many equal vectors, say) is dealt over as many parts as it fills. A visit
takes along those queries of its block alone that ask for the cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, saved

#: Rows of a block, queries of a block, most leaves, most rows of the sample that the tree is fitted on.
ROWS, QUERIES, LEAVES, SAMPLE = 2048, 256, 8192, 65_536
#: Projected neighbours of a block that a query verifies before its stopping test is taken anew: at first, and then.
STEPS = (128, 1024)


def chi2_cdf(x: float, m: int) -> float:
    """The chi-square law of an even number m of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, m: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, m) < p else (lo, mid)
    return hi


class Index:
    """The projection and the tree: inner nodes split a direction at a sample's median, leaves are cells."""

    def __init__(self, dim: int, longest: float, directions: int, seed: int):
        self.longest, self.m = longest, directions
        self.matrix = np.random.default_rng(seed).standard_normal((dim + 1, directions))
        self.axis, self.at = np.zeros(0, np.int64), np.zeros(0)

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.longest**2 - (x**2).sum(axis=1)))
        return np.column_stack([x, more]) @ self.matrix

    def fit(self, points: np.ndarray, leaves: int) -> None:
        self.axis, self.at = np.zeros(leaves - 1, np.int64), np.zeros(leaves - 1)
        own = {0: points}
        for node in range(leaves - 1):
            p = own.pop(node)
            if len(p):
                self.axis[node] = np.argmax(p.max(axis=0) - p.min(axis=0))
                self.at[node] = np.median(p[:, self.axis[node]])
            right = p[:, self.axis[node]] > self.at[node]
            own[2 * node + 1], own[2 * node + 2] = p[~right], p[right]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range((len(self.axis) + 1).bit_length() - 1):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - len(self.axis)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _valid(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine)


def _dealt(index, kind: str):
    """id, v -> id, v, cell, p: projections of rows or queries and the leaf they fall in."""

    def dealt(batches):
        own = index.value
        for batch in batches:
            if batch.num_rows:
                p = own.project(_vectors(batch.column(1)), kind == "query")
                yield pa.record_batch({"id": batch.column(0), "v": batch.column(1), "cell": pa.array(own.cell(p), pa.int32()), "p": pa.array(list(p), pa.list_(pa.float64()))})

    return dealt


def _blocks(dealt: DataFrame, most: int, index, prefix: str) -> DataFrame:
    """Rows of a cell as blocks of about `most` rows: cell, part, and ids (also as an array, members), vectors, projections as bytes, with the projections' box."""
    counts = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}  # at most LEAVES rows
    parts = dealt.sparkSession.sparkContext.broadcast({c: -(-n // most) for c, n in counts.items()})

    def number(batches):
        for batch in batches:
            n = np.array([parts.value[c] for c in batch.column("cell").to_pylist()], np.uint64)
            ids = batch.column("id").to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            yield batch.append_column("part", pa.array(((ids >> np.uint64(33)) % np.maximum(n, 1)).astype(np.int32)))

    def gather(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        v, p = _vectors(table["v"].combine_chunks()), _vectors(table["p"].combine_chunks())
        return pa.table({
            "cell": table["cell"][:1], "part": table["part"][:1], "ids": pa.array([table["id"].to_numpy().astype(np.int64).tobytes()], pa.binary()), "members": pa.array([table["id"].to_numpy()], pa.list_(pa.int64())), "vectors": pa.array([v.tobytes()], pa.binary()),
            "projections": pa.array([p.tobytes()], pa.binary()), "low": pa.array([p.min(axis=0)], pa.list_(pa.float64())), "high": pa.array([p.max(axis=0)], pa.list_(pa.float64())),
        })

    numbered = dealt.mapInArrow(number, "id long, v array<double>, cell int, p array<double>, part int")
    return saved(numbered.groupBy("cell", "part").applyInArrow(gather, "cell int, part int, ids binary, members array<long>, vectors binary, projections binary, low array<double>, high array<double>"), prefix)


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id, each id once."""
    order = np.lexsort((ids, -score))
    return order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]


def _search(k: int, confidence: float, index):
    """Queries that visit a block of rows -> for each its k nearest ids of the block, not farther than its bound."""

    def search(batches):
        own = index.value
        stop = chi2_quantile(confidence, own.m)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                qid, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                q, x = (np.frombuffer(row[c]).reshape(len(n), -1) for c, n in (("q_vectors", qid), ("vectors", ids)))
                qp, xp = (np.frombuffer(row[c]).reshape(len(n), -1) for c, n in (("q_projections", qid), ("projections", ids)))
                bound, extra = np.frombuffer(row["bounds"]), len(ids) - len(np.unique(ids))  # rows beside the first of their id
                length = (q**2).sum(axis=1) + own.longest**2
                away = np.maximum(0, (qp**2).sum(axis=1)[:, None] + (xp**2).sum(axis=1) - 2 * qp @ xp.T)
                product = None  # of all rows with the queries, if one of them has to verify many
                out = []
                for j in range(len(qid)):
                    near, limit = away[j], bound[j]  # limit: squared distance of the k-th nearest so far
                    order = np.flatnonzero((near <= limit * stop + 1e-9 * length[j]) & (ids != qid[j]))
                    got_d, got_i, least = np.zeros(0), np.zeros(0, np.int64), STEPS[0]
                    while len(order):
                        if len(order) > least:
                            order = order[np.argpartition(near[order], least)]
                        some, order = order[:least], order[least:]
                        if product is None and len(some) > STEPS[0]:
                            product = x @ q.T
                        rough = x[some] @ q[j] if len(some) <= STEPS[0] else product[some, j]
                        some = some[length[j] - 2 * rough <= limit + 1e-9 * length[j]]
                        if len(some) > 4 * (k + extra):
                            rough = x[some] @ q[j]
                            some = some[rough >= np.partition(rough, -k - extra)[-k - extra] - 1e-9 * length[j]]
                        s = (x[some] * q[j]).sum(axis=1)  # the same for equal vectors, wherever they stand
                        got_d, got_i = np.concatenate([got_d, s]), np.concatenate([got_i, ids[some]])
                        best = _top(got_d, got_i, k)
                        got_d, got_i = got_d[best], got_i[best]
                        if len(got_d) == k:
                            limit = min(limit, max(0.0, length[j] - 2 * got_d.min()))
                        order = order[near[order] <= limit * stop + 1e-9 * length[j]]
                        least = STEPS[1]
                    out.append((np.full(len(got_i), qid[j]), got_i, got_d))
                if out:
                    yield pa.record_batch({c: pa.array(np.concatenate(a)) for c, a in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    return search


def nearest(base: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", directions: int = 10, confidence: float = 0.97, first: int = 4, seed: int = 11) -> DataFrame:
    """Of each row of `queries` its k nearest rows of `base` with another id: query_id, rank, vec_id, score (inner product in double precision).

    Nearest first, ties to the smaller id; all candidates if there are fewer than k. Rows take no part if their id or
    vector is null, if a component is null, NaN or infinite, if all are zero, or if their length isn't the most common one
    of base (the longer of two that are as common). Rows that share an id count once, with the nearest of their vectors;
    queries that share an id are one query, with the smallest of their vectors. Other columns take no part; without valid
    rows the result is empty.
    """
    spark = base.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = _valid(base, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("square"))
    common = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    if common is None:
        return empty
    dim, total = common["n"], common["rows"]
    index = Index(dim, math.sqrt(common["square"]), directions, seed)
    rows = rows.where(F.size("v") == dim)
    leaves = min(LEAVES, 1 << max(0, math.ceil(math.log2(total / ROWS))))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, 64 * leaves)).toArrow() if leaves > 1 else None
    index.fit(index.project(_vectors(sample["v"].combine_chunks()), False) if sample else np.zeros((0, directions)), leaves)
    shared = spark.sparkContext.broadcast(index)
    dealt = "id long, v array<double>, cell int, p array<double>"

    blocks = _blocks(rows.mapInArrow(_dealt(shared, "row"), dealt), ROWS, shared, "ann_rows")
    asking = _valid(queries, id_col, vector_col).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    asked = _blocks(asking.mapInArrow(_dealt(shared, "query"), dealt), QUERIES, shared, "ann_queries")
    boxes = blocks.groupBy("cell").agg(*[F.min(F.col("low")[i]).alias(f"l{i}") for i in range(directions)], *[F.max(F.col("high")[i]).alias(f"h{i}") for i in range(directions)], F.max("part").alias("last")).collect()  # at most LEAVES rows
    cells = np.array([b["cell"] for b in boxes], np.int32)
    low, high = (np.array([[b[f"{s}{i}"] for i in range(directions)] for b in boxes]) for s in "lh")
    boxed = spark.sparkContext.broadcast((cells, low, high, np.array([b["last"] + 1 for b in boxes])))

    def visit(again: bool):
        """Blocks of queries -> the parts of cells that they visit, each with the queries that ask for it and their bounds."""

        def visits(batches):
            cells, low, high, parts = boxed.value
            stop = chi2_quantile(confidence, directions)
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, p, v = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in (("ids", np.int64), ("projections", float), ("vectors", float)))
                    p, v = p.reshape(len(ids), -1), v.reshape(len(ids), -1)
                    away = np.stack([(np.maximum(0, np.maximum(low - x, x - high)) ** 2).sum(axis=1) for x in p])
                    order = np.argsort(away, axis=1, kind="stable")
                    at_first = np.zeros(away.shape, bool)
                    np.put_along_axis(at_first, order[:, :first], True, axis=1)
                    if again:
                        known = dict(zip(*(batch.column(c)[i].as_py() or [] for c in ("known", "far")), strict=True))
                        bound = np.array([known.get(int(q), np.inf) for q in ids])
                        go = ~at_first & (away <= bound[:, None] * stop + 1e-9)
                    else:
                        bound, go = np.full(len(ids), np.inf), at_first
                    hit = np.flatnonzero(go.any(axis=0))
                    ask = [np.flatnonzero(go[:, h]) for h in hit]
                    some = lambda x: pa.array([x[a].tobytes() for a in ask], pa.binary())  # noqa: B023, E731
                    yield pa.record_batch({
                        "cell": pa.array(cells[hit], pa.int32()), "parts": pa.array(parts[hit], pa.int32()), "q_ids": some(ids), "q_vectors": some(v), "q_projections": some(p), "bounds": some(bound),
                    })

        return visits

    visited = "cell int, parts int, q_ids binary, q_vectors binary, q_projections binary, bounds binary"
    found, pair = "query_id long, vec_id long, score double", ["q_ids", "q_vectors", "q_projections", "bounds", "ids", "vectors", "projections"]
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def top(hits: DataFrame) -> DataFrame:
        return hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def meet(visits: DataFrame) -> DataFrame:
        visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return visits.join(blocks.select("cell", "part", "ids", "vectors", "projections"), ["cell", "part"]).select(pair).mapInArrow(_search(k, confidence, shared), found)

    near = saved(top(meet(asked.mapInArrow(visit(False), visited))), "ann_first")
    kth = near.groupBy("query_id").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == k)
    squares = asking.select(F.col("id").alias("query_id"), (F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) + F.lit(common["square"])).alias("length"))
    far = kth.join(squares, "query_id").select("query_id", F.greatest(F.lit(0.0), F.col("length") - 2 * F.col("score")).alias("far"))
    placed = far.join(asked.select("cell", "part", F.explode("members").alias("query_id")), "query_id").groupBy("cell", "part").agg(F.collect_list("query_id").alias("known"), F.collect_list("far").alias("far"))
    second = meet(asked.join(placed, ["cell", "part"], "left").select("ids", "vectors", "projections", "known", "far").mapInArrow(visit(True), visited))
    out = saved(top(near.select("query_id", "vec_id", "score").unionByName(second)), "ann_result")
    forget(blocks, asked, near)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

