"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

Two documents are linked if the Jaccard similarity of their sets of 5-word shingles is 0.75 or more. Steps:

1. One pass makes of each text its set's size, a 128-bit key of the set, and a signature of 128 bins: a shingle's hash
   chooses its bin, the bin keeps its minimum, empty bins borrow from a filled one that a second hash chooses.
   Texts with equal sets become one class (partial aggregation on the key); only classes go on.
2. 32 bands of 4 bins each give bucket keys; two sets at 0.75 miss all buckets with probability 5e-6. Sets of under 64
   shingles fill few bins, so they get two more permutations.
3. In each bucket the smallest id is the centre and each other member is paired with it alone: as many pairs as members.
4. Pairs go whose sizes rule out the threshold, or whose signatures agree on too few bins: on fewer than a pair at the
   threshold has with probability 1 - 1e-9 where its fuller set fills as many bins itself. The others are confirmed on
   the full sets, and components are formed.
5. A star can miss a link between two members neither of which is linked to the centre. So the buckets that still hold
   more than one component are searched again: the members outside a bucket's largest component, in blocks, meet all of it,
   in blocks too. First with their signatures alone, which leaves the members that have a likely partner in another
   component; these meet again, in blocks of their own, with their full sets, and pairs are confirmed inside the task. A
   pair is tried in the first band alone that both share, and only links that join components are put out. No bucket is
   capped, and no task holds more than some blocks of two.
6. Blocks against blocks are as many as the product of their numbers, and pages that share a frame and nothing else are all
   in one bucket and never linked. So of buckets of several blocks the members that no pair can have go first, by an exact
   bound (`_parted`): what a set has alone is in no intersection and in each union.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, forget, mix, pieces, releasing, runs, saved, text_bytes
from .graph import components

BINS, ROWS, SMALL = 128, 4, 64
_SEEDS = [np.uint64(x) for x in (0, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)]
#: Members of a bucket that step 5 holds in one block; bytes of signatures and sets that one of its groups gets on average.
BLOCK, GROUP = 256, 4 << 20
#: Most ids that are broadcast, to find the texts to confirm without moving all texts (under 50 MB); more are joined by a shuffle.
IDS = 1_000_000


def shingle_sets(column: pa.Array, n: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its n-word shingles (A-Z lower-cased); of a shorter text its whole word sequence."""
    words = Words(*text_bytes(column), lower=True)
    hashes, bounds = words.hashes(), words.bounds
    h = runs(hashes, n)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out.append(np.unique(h[lo : hi - n + 1]) if hi - lo >= n else runs(hashes[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64))
    return out


def _minima(sets: list[np.ndarray], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of each set BINS 32-bit minima, and which bins have elements."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    sig, filled = np.zeros((n, BINS), np.uint32), np.zeros((n, BINS), bool)
    if size.sum():
        v = mix(np.concatenate(sets) ^ _SEEDS[seed])
        order = np.sort((np.repeat(np.arange(n, dtype=np.uint64), size) << np.uint64(39)) | (v >> np.uint64(25)))
        cell = order >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        at = cell[first].astype(np.int64)
        sig.ravel()[at] = order[first].astype(np.uint32)
        filled.ravel()[at] = True
    return sig, filled


def _densified(sig: np.ndarray, filled: np.ndarray) -> np.ndarray:
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    source, tries = filled.copy(), 0
    while len(row):
        t = (mix(col.astype(np.uint64) * np.uint64(0x10001) + np.uint64(tries << 20)) % np.uint64(BINS)).astype(np.int64)
        if tries > 4 * BINS:
            t = (col + tries) % BINS  # every bin in turn: this ends
        ok = source[row, t]
        sig[row[ok], col[ok]] = sig[row[ok], t[ok]]
        row, col, tries = row[~ok], col[~ok], tries + 1
    return sig


def signatures(sets: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """A row of BINS 32-bit minima for each set; sets without elements get zeros."""
    return _densified(*_minima(sets, seed))


def band_keys(sig: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit bucket keys of the bands of each signature."""
    bands = sig.reshape(len(sig), BINS // ROWS, ROWS).astype(np.uint64)
    key = np.arange(BINS // ROWS, dtype=np.uint64)[None, :] + np.uint64(1000 * seed)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
    return key


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _signed(batches):
    for batch in batches:
        for piece in pieces(batch, 1):
            sets = shingle_sets(piece.column(1))
            size = np.array([len(s) for s in sets])
            v = [mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)) for s in sets]
            sig, filled = _minima(sets)
            small = (size > 0) & (size < SMALL)
            more = pa.nulls(len(sets), pa.binary())
            if small.any():
                few = [s for s, x in zip(sets, small, strict=True) if x]
                keys = iter(np.hstack([band_keys(signatures(few, k), k) for k in (1, 2)]))
                more = pa.array([next(keys).tobytes() if x else None for x in small], pa.binary())
            yield pa.record_batch({
                "id": piece.column(0).cast(pa.int64()), "text_key": piece.column(2), "n_shingles": pa.array(size, pa.int64()),
                "key_a": pa.array([int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()), "key_b": pa.array([int(x.sum(dtype=np.uint64).view(np.int64)) for x in v], pa.int64()),
                "sig": _binary(_densified(sig, filled)), "filled": pa.array(filled.sum(axis=1), pa.int32()), "more": more,
            })


def _buckets(batches):
    for batch in batches:
        ids, sig = batch.column(0).to_numpy(), _matrix(batch.column(1), np.uint32, BINS)
        keys = band_keys(sig)
        bands = np.arange(keys.shape[1], dtype=np.int32)
        out = [(np.repeat(ids, len(bands)), keys.ravel(), np.tile(bands, len(ids)))]
        has = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
        if len(has):
            extra = _matrix(batch.column(2).take(pa.array(has)), np.uint64, 2 * len(bands))
            out.append((np.repeat(ids[has], extra.shape[1]), extra.ravel(), np.tile(len(bands) + np.arange(extra.shape[1], dtype=np.int32), len(has))))
        i, k, b = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.record_batch({"key": pa.array(k.view(np.int64)), "id": pa.array(i), "band": pa.array(b)})


def _least(threshold: float, loss: float = 1e-9) -> np.ndarray:
    """For 0 to BINS bins that one of two sets fills itself: the agreeing bins that a pair at the threshold has but for a probability of `loss`.

    The minima of the bins that the union fills are a sample of it without replacement; each one that both sets have is an
    agreement, and borrowed bins only add to them. So the lower tail is under the Chernoff bound for as many bins.
    """
    out = np.zeros(BINS + 1, np.int64)
    for n in range(1, BINS + 1):
        x = np.arange(1, int(threshold * n) + 1) / n
        tail = x * np.log(x / threshold) + np.where(x < 1, (1 - x) * np.log(np.maximum(1 - x, 1e-300) / (1 - threshold)), 0)
        none = (1 - threshold) ** n <= loss
        rare = np.flatnonzero((x <= threshold) & (n * tail >= -np.log(loss)))
        out[n] = rare[-1] + 2 if len(rare) else int(none)
    return np.maximum.accumulate(out)


def _likely(threshold: float):
    least = _least(threshold)

    def likely(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (_matrix(batch.column(c), np.uint32, BINS) for c in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least[batch.column(4).to_numpy()]))

    return likely


def _sets(batches):
    for batch in batches:
        for piece in pieces(batch, 1):
            yield pa.record_batch({"id": piece.column(0).cast(pa.int64()), "elements": pa.array([s.tobytes() for s in shingle_sets(piece.column(1))], pa.binary())})


def _exploded(batches):
    for batch in batches:
        for piece in pieces(batch, 2):
            sets = shingle_sets(piece.column(2))
            size = np.array([len(s) for s in sets])
            ids, component = (np.repeat(piece.column(c).to_numpy(), size) for c in (0, 1))
            yield pa.record_batch({"shingle": pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)), "id": pa.array(ids), "component": pa.array(component)})


def _similar(x: np.ndarray, y: np.ndarray, hundredths: int) -> bool:
    if min(len(x), len(y)) * 100 < hundredths * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= hundredths * (len(both) - shared)


def _confirmed(hundredths: int):
    def confirmed(batches):
        for batch in batches:
            ok = [_similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), hundredths) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return confirmed


def _partners(table: pa.Table, least: np.ndarray, hundredths: int):
    """Of the blocks in a table, each probe with the members of other components that its size and signature allow and that no earlier band has with it."""
    bands = BINS // ROWS
    key, chunk, pchunk, band, ids, comp = (table[c].to_numpy() for c in ("key", "chunk", "pchunk", "band", "id", "component"))
    probe, outside, filled, size = (table[c].to_numpy() for c in ("probe", "outside", "filled", "n_shingles"))
    sig = _matrix(table["sig"].combine_chunks(), np.uint32, BINS)
    order = np.lexsort((ids, probe, pchunk, chunk, key))
    edge = [x[order][1:] != x[order][:-1] for x in (key, chunk, pchunk)]
    for rows in np.split(order, np.flatnonzero(edge[0] | edge[1] | edge[2]) + 1):
        members, probes = rows[~probe[rows]], rows[probe[rows]]
        for p in probes:
            m = members[(comp[members] != comp[p]) & (~outside[members] | (ids[members] < ids[p]))]
            m = m[100 * np.minimum(size[m], size[p]) >= hundredths * np.maximum(size[m], size[p])]
            m = m[(sig[m] == sig[p]).sum(axis=1) >= least[np.maximum(filled[m], filled[p])]] if len(m) else m
            if len(m):
                same = (sig[m].reshape(len(m), bands, ROWS) == sig[p].reshape(bands, ROWS)).all(axis=2)
                m = m[~same[:, : band[p]].any(axis=1) if band[p] < bands else ~same.any(axis=1)]
            if len(m):
                yield int(p), m


def _promising(threshold: float, hundredths: int):
    """The members and probes that have partners by their signatures: key, id, n_shingles."""
    least = _least(threshold)

    def promising(table: pa.Table) -> pa.Table:
        hit = np.zeros(len(table), bool)
        for p, m in _partners(table, least, hundredths):
            hit[p] = hit[m] = True
        return table.select(["key", "id", "n_shingles"]).filter(pa.array(hit))

    return promising


def _across(threshold: float, hundredths: int):
    """Links between probes and members that join components, confirmed on the full sets."""
    least = _least(threshold)

    def across(table: pa.Table) -> pa.Table:
        ids, comp = table["id"].to_numpy(), table["component"].to_numpy()
        data, at = text_bytes(table["elements"].combine_chunks())
        data, at = data.view(np.uint64), at // 8
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                root[c] = root.get(root[c], root[c])
                c = root[c]
            return c

        found, tried = [], set()
        for p, m in _partners(table, least, hundredths):
            m = [x for x in m.tolist() if (int(ids[p]), int(ids[x])) not in tried and find(int(comp[x])) != find(int(comp[p]))]
            if not m:
                continue
            tried.update((int(ids[p]), int(ids[x])) for x in m)
            own, others = data[at[p] : at[p + 1]], [data[at[x] : at[x + 1]] for x in m]
            n = np.array([len(x) for x in others])
            every = np.concatenate(others)
            shared = np.add.reduceat(own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every, np.cumsum(n) - n, dtype=np.int64)
            for x in np.flatnonzero(100 * shared >= hundredths * (len(own) + n - shared)).tolist():
                a, b = find(int(comp[p])), find(int(comp[m[x]]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    found.append((int(ids[p]), int(ids[m[x]])))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return across


def _chunks(members, outside) -> tuple:
    """How many blocks a bucket's members and its probes have."""
    return F.ceil(members / BLOCK).cast("int").alias("chunks"), F.ceil(outside / BLOCK).cast("int").alias("pchunks")


def _alone(shingles: DataFrame, sets: DataFrame) -> DataFrame:
    """shingle, id, component, and of each set (sets) id, component, key_a, n_shingles -> id, alone, n_shingles.

    `alone` is a number of its shingles that no other component has: those that one or two rows have, and those that all
    sets of the component have. The others would take a join of all shingles; without them the bound is weaker, not wrong.
    So one grouping, which combines before its shuffle, is all. Ids of several sets give no row.
    """
    of = shingles.groupBy("shingle").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min("component").alias("component"), F.max("component").alias("high"), F.count("*").alias("n")).where("component = high")
    whose = F.when(F.col("n") <= 2, F.array_distinct(F.array("a", "b"))).otherwise(F.array(F.lit(None).cast("long")))
    tally = saved(of.select("component", "n", F.explode(whose).alias("id")).groupBy("component", "n", "id").agg(F.count("*").alias("shingles")), "minhash_tally")
    few = tally.where("id is not null").groupBy("id").agg(F.sum("shingles").alias("few"))
    size = sets.groupBy("component").agg(F.count("*").alias("n"))
    core = tally.where("id is null").join(size, ["component", "n"]).select("component", F.col("shingles").alias("core"))
    one = sets.groupBy("id", "component").agg(F.min("key_a").alias("low"), F.max("key_a").alias("high"), F.min("n_shingles").alias("n_shingles")).where("low = high")
    found = one.join(few, "id", "left").join(core, "component", "left")
    return found.select("id", (F.coalesce("few", F.lit(0)) + F.coalesce("core", F.lit(0))).alias("alone"), "n_shingles").where("alone > 0")


def _parted(rows: DataFrame, alone: DataFrame, hundredths: int) -> DataFrame:
    """Crowded buckets (key, band, id, component, outside) and `alone` (id, alone, n_shingles) -> those rows that a pair can have, with listed, chunks, pchunks.

    Let a set have `alone` shingles that no other component has, and `rest` others. Two sets of two components have at most the
    smaller `rest` in common, so they are linked only if t * (both alone) <= (1 - t) * (smaller rest). A set with
    2 t * alone > (1 - t) * rest is heavy: no two heavy sets are linked, nor a heavy one where even the light set with the
    fewest alone is too much for it. So each bucket becomes two: light probes with all members, and (its key's
    complement) heavy probes with the light members of the largest component. An id without a row in `alone` is light.
    """
    rated = rows.join(alone, "id", "left").withColumn("rest", F.col("n_shingles") - F.col("alone")).withColumn("alone", F.coalesce("alone", F.lit(0)))
    rated = saved(rated.withColumn("heavy", F.coalesce(F.expr(f"{2 * hundredths} * alone > {100 - hundredths} * rest"), F.lit(False))).drop("n_shingles"), "minhash_rated")
    fewest = rated.groupBy("key").agg(F.min(F.when(~F.col("heavy"), F.col("alone"))).alias("fewest"))
    left = rated.join(fewest, "key").where(f"not heavy or {hundredths} * (alone + fewest) <= {100 - hundredths} * rest").drop("alone", "rest", "fewest")
    light = left.withColumn("outside", F.expr("outside and not heavy")).withColumn("listed", F.lit(True))
    heavy = left.where("outside = heavy").withColumn("key", F.bitwise_not("key")).withColumn("listed", ~F.col("heavy"))
    both = light.unionByName(heavy).drop("heavy")
    return both.join(_counted(both).select("key", "chunks", "pchunks"), "key")


def _counted(rows: DataFrame) -> DataFrame:
    """How many blocks members and probes have, of the buckets that have both."""
    return rows.groupBy("key").agg(*_chunks(F.count_if("listed"), F.count_if("outside"))).where("chunks > 0 and pchunks > 0")


def _counted_again(rows: DataFrame) -> DataFrame:
    """The rows that are left of buckets, with chunks and pchunks of what is left. A bucket of one block against one stays so: it still has members and probes, as partners are left in pairs."""
    many = rows.where("chunks > 1 or pchunks > 1").drop("chunks", "pchunks")
    left = saved(rows.where("chunks = 1 and pchunks = 1").unionByName(many.join(_counted(many), "key")), "minhash_left")
    forget(rows)
    return left


def _in_blocks(rows: DataFrame, beside: DataFrame) -> DataFrame:
    """key, band, id, component, outside, listed, chunks, pchunks -> blocks of a bucket's members with each block of its probes.

    Members are the rows that are listed, probes those outside. A member is once in each pair of blocks that its block is
    part of, so rows are as many as blocks times members. `beside` has what blocks need of each id; it is joined before
    rows are repeated, so only the grouping moves the repeated ones.
    """
    chunk, pchunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"), F.pmod(F.xxhash64("id"), F.col("pchunks")).cast("int")
    place = lambda c, p, probe: F.struct(c.alias("chunk"), p.alias("pchunk"), F.lit(probe).alias("probe"))
    each = lambda n, to: F.transform(F.sequence(F.lit(0), F.col(n) - 1), to)
    member, probe = each("pchunks", lambda p: place(chunk, p, False)), each("chunks", lambda c: place(c, pchunk, True))
    places = F.when(~F.col("listed"), probe).when(F.col("outside"), F.concat(member, probe)).otherwise(member)
    return rows.join(beside, "id").withColumn("place", F.explode(places)).select("*", "place.*").drop("listed", "chunks", "pchunks", "place")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75, text_key: str | None = None) -> DataFrame:
    """For each row: id_col (long), n_shingles (long), component_id (smallest id reachable over links, itself included), kept (boolean).

    Null or wordless texts have no shingles and are linked with nothing. Rows that share an id count as one document
    with links of each row's text. A row with a null id has a component only if its set is that of a row with an id,
    and isn't kept then; else its component is null and it is kept. An empty table gives an empty table. With `text_key` there is a column of that name too, the
    text's xxhash64: with the id, compared so that null is null, it finds the rows that a result is of.
    """
    hundredths = round(100 * threshold)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"))
    signed = saved(texts.mapInArrow(releasing(_signed), "id long, text_key long, n_shingles long, key_a long, key_b long, sig binary, filled int, more binary"), "minhash_signed")
    some = signed.where("n_shingles > 0")
    first = some.groupBy("key_a", "key_b").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("filled").alias("filled"), F.first("more").alias("more"))
    classes = saved(first, "minhash_classes")
    nodes = classes.where("id is not null").select("id", "n_shingles", "sig", "filled", "more")

    buckets = nodes.select("id", "sig", "more").mapInArrow(_buckets, "key long, id long, band int")
    centres = buckets.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("most")).where("centre <> most").select("key", "centre")
    # Dealt by key and id, so that the join before may split a bucket that holds a large share of the rows.
    crowded = saved(buckets.join(centres, "key").repartition("key", "id").distinct(), "minhash_buckets")
    sig = nodes.select("id", "n_shingles", "sig", "filled")

    def likely(pairs: DataFrame) -> DataFrame:
        side = lambda c: sig.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"), F.col("filled").alias(f"filled_{c}"))
        x = pairs.join(side("a"), "a").join(side("b"), "b").where(F.lit(100) * F.least("n_a", "n_b") >= F.lit(hundredths) * F.greatest("n_a", "n_b"))
        return x.select("a", "b", "sig_a", "sig_b", F.greatest("filled_a", "filled_b").alias("filled")).mapInArrow(_likely(threshold), "a long, b long")

    def asked(ids: DataFrame) -> DataFrame:
        ids = saved(ids.distinct(), "minhash_ids")
        return F.broadcast(ids) if ids.count() <= IDS else ids

    def sets_of(ids: DataFrame) -> DataFrame:
        return saved(texts.join(asked(ids), "id").select("id", "text").mapInArrow(releasing(_sets), "id long, elements binary"), "minhash_sets")

    def alone_of(members: DataFrame) -> DataFrame:
        members = asked(members)
        shingles = texts.join(members, "id").select("id", "component", "text").mapInArrow(releasing(_exploded), "shingle long, id long, component long")
        return saved(_alone(shingles, some.join(members, "id").select("id", "component", "key_a", "n_shingles")), "minhash_alone")

    star = crowded.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    pairs = saved(likely(star), "minhash_pairs")
    sets = sets_of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))))
    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("of_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("elements").alias("of_b")), "b")
    links = saved(x.select("a", "b", "of_a", "of_b").mapInArrow(_confirmed(hundredths), "a long, b long").distinct(), "minhash_links")
    forget(pairs, sets)

    label = components(links)
    placed = crowded.join(label, "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("component"))
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    # A bucket of two is its star, which step 4 has tested.
    split = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1 and n > 2")
    split = split.select("key", F.col("most.component").alias("main"), *_chunks(F.col("n"), F.col("n") - F.col("most.n")))
    open_ = saved(placed.join(split, "key").withColumn("outside", F.col("component") != F.col("main")).drop("main").withColumn("listed", F.lit(True)), "minhash_open")
    crowd = open_.where("chunks > 1")
    if not crowd.isEmpty():
        alone = alone_of(crowd.select("id", "component"))
        parted = _parted(crowd.drop("listed", "chunks", "pchunks"), alone, hundredths)
        open_ = saved(open_.where("chunks = 1").unionByName(parted), "minhash_open")
        forget(crowd, alone)

    def in_groups(blocks: DataFrame, total):
        groups = max(1, round((total or 0) / GROUP))
        return blocks.groupBy(F.pmod(F.xxhash64("key", "chunk", "pchunk"), F.lit(groups)).alias("g"))

    copies = F.when(F.col("listed"), F.col("pchunks")).otherwise(0) + F.when(F.col("outside"), F.col("chunks")).otherwise(0)
    total = open_.agg(F.sum(F.lit(4 * BINS + 64) * copies)).first()[0]
    likely_ones = in_groups(_in_blocks(open_, sig), total).applyInArrow(_promising(threshold, hundredths), "key long, id long, n_shingles long")
    likely_ones = saved(likely_ones.distinct(), "minhash_likely")
    if not likely_ones.isEmpty():
        again = _counted_again(saved(open_.join(likely_ones, ["key", "id"]), "minhash_again"))
        total = again.agg(F.sum((F.col("n_shingles") * 8 + 4 * BINS + 64) * copies)).first()[0]
        sets = sets_of(again.select("id"))
        blocks = _in_blocks(again, sets.join(sig.drop("n_shingles"), "id"))
        more = saved(in_groups(blocks, total).applyInArrow(_across(threshold, hundredths), "a long, b long"), "minhash_links")
        label = components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
        forget(sets, again)
    forget(open_, crowded, likely_ones)

    named = classes.select("key_a", "key_b", "id").join(label, "id", "left").select("key_a", "key_b", F.coalesce("component", "id").alias("component_id"))
    return signed.select("id", "text_key", "n_shingles", "key_a", "key_b").join(named, ["key_a", "key_b"], "left").select(
        F.col("id").alias(id_col), "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        *([F.col("text_key").alias(text_key)] if text_key else []),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
