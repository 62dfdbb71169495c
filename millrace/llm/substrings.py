"""Substring dedup by level-wise doubling.

A window is `min_words` consecutive words of one document. The operator removes each word that lies in a window whose
word sequence also starts earlier: in a document with a smaller id (a null id comes first), or earlier in the same one.

Windows of a short length are tried first. A window of twice the length can only repeat if both of its halves do, so
each level looks at the windows that are left and extends those that repeat, until the length asked for is reached or
no candidates survive. (Longer levels can't add to the words that the windows of `min_words` cover, so it ends there.)

How it runs: texts are gathered into blocks of about a megabyte, kept once in the shared folder, bucketed by the task
that wrote them. On each level a block sends the distinct hashes of its candidate windows, in one row for each range of
hashes that it has any in: never more rows than windows. A range's task marks those that other blocks sent too and answers
with a bit each (on the last level, where windows count as equal by 128 bits and go with the document that they are in: with
the places that come after another block's). A block gets its own answers alone, by a co-located join, so texts are never
shuffled. A very common window is sent once by each block, so no range gets more than one row a block.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, forget, pieces, releasing, runs, saved, shared_dir, text_bytes

#: Windows that the task of one range of hashes holds at once, on average.
RANGE = 1 << 21
#: Bytes of answers for a shuffle partition up to which they are hashed for the join; more are sorted, which can spill.
HASHED = 128 << 20
_NULL_ID = np.iinfo(np.int64).min


def levels(min_words: int, shortest: int = 10) -> list[int]:
    """Lengths that are tried: min_words halved while it is even and its half is not under `shortest`, then doubled again."""
    out = [min_words]
    while out[0] % 2 == 0 and out[0] // 2 >= shortest:
        out.insert(0, out[0] // 2)
    return out


def _in_blocks(docs: DataFrame, id_col: str, text_col: str):
    """Rows part, block, ids, lens, rest, body: each a run of documents in order of id; rest has the other columns."""
    names, text_at, id_at = docs.columns, docs.columns.index(text_col), docs.columns.index(id_col)

    def blocks(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in pieces(batch, text_at):
                ids = piece.column(id_at).cast(pa.int64()).fill_null(_NULL_ID)
                piece = piece.take(pa.array(np.argsort(ids.to_numpy(), kind="stable")))
                buf, offsets = text_bytes(piece.column(text_at))
                ids = piece.column(id_at).cast(pa.int64()).fill_null(_NULL_ID)
                rest = piece.drop_columns([names[text_at]])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as w:
                    w.write_batch(rest)
                yield pa.record_batch({
                    "part": pa.array([part], pa.int32()), "block": pa.array([(part << 32) + k], pa.int64()),
                    "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "lens": pa.array([np.diff(offsets)], pa.list_(pa.int64())),
                    "rest": pa.array([sink.getvalue().to_pybytes()], pa.binary()), "body": pa.array([buf.tobytes()], pa.binary()),
                })
                k += 1

    return docs.mapInArrow(releasing(blocks), "part int, block long, ids array<long>, lens array<long>, rest binary, body binary")


def _kept_in_buckets(blocks: DataFrame) -> tuple[DataFrame, str, int]:
    """The blocks as a table of the shared folder, bucketed by the task that made them: joins by part then move the other side alone. Also its name and number of buckets."""
    spark, name = blocks.sparkSession, f"substring_blocks_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").bucketBy(n, "part").format("parquet").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved before the catalogue forgets the name; the files stay
    return table, name, n


class _Block:
    """A block's words and, level by level, its candidate windows."""

    def __init__(self, body: bytes, lens):
        self.words = Words(np.frombuffer(body, np.uint8), np.concatenate([[0], np.cumsum(np.asarray(lens, np.int64))]))
        self.hashes = self.words.hashes()

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n words from each place, and whether they lie within one document."""
        h = runs(self.hashes, n)
        left = np.repeat(self.words.bounds[1:], np.diff(self.words.bounds))[: len(h)] - np.arange(len(h))
        return h, left >= n

    def distinct(self, n: int, among: np.ndarray):
        """Of the windows of n words at the places `among`: distinct hashes in order, first place of each, number of each, and each one's index."""
        h, _ = self.windows(n)
        u, first, back, count = np.unique(h[among], return_index=True, return_inverse=True, return_counts=True)
        return u, among[first], back, count

    def candidates(self, steps: list[int], answers: list[dict[int, bytes]], bits: int) -> np.ndarray:
        """Places of the windows of steps[len(answers)] words that the levels before leave."""
        places = np.flatnonzero(self.windows(steps[0])[1])
        for n, longer, answer in zip(steps, steps[1:], answers, strict=False):
            u, _, back, count = self.distinct(n, places)
            again = count > 1
            full, first = _ranges(u, bits)
            for b, mask in answer.items():
                k = np.searchsorted(full, b)
                lo, hi = first[k], first[k + 1]
                again[lo:hi] |= np.unpackbits(np.frombuffer(mask, np.uint8), count=hi - lo).astype(bool)
            repeats = np.zeros(len(self.hashes) + longer, bool)
            repeats[places[again[back]]] = True
            inside = np.flatnonzero(self.windows(longer)[1])
            places = inside[repeats[inside] & repeats[inside + longer - n]]
        return places


def _ranges(u: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges (of 2 ** bits) that any hash of the sorted u is in, and where each begins in u, with the end of u after the last."""
    full, first = np.unique(u >> np.uint64(64 - bits) if bits else np.zeros(len(u), np.uint64), return_index=True)
    return full.astype(np.int64), np.append(first, len(u))


def _answers_of(rows, steps: int) -> list[dict[int, bytes]]:
    out: list[dict[int, bytes]] = [{} for _ in range(steps)]
    for x in rows or ():
        out[x["level"]][x["bucket"]] = x["reply"]
    return out


def _send(steps: list[int], level: int, bits: int):
    """Rows of the windows of steps[level] words, by ranges of hashes. On the last level with a second hash, places and documents."""
    last = level == len(steps) - 1

    def send(batches):
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in names}
                block = _Block(row["body"].as_py(), row["lens"].values.to_numpy())
                u, first, _, _ = block.distinct(steps[level], block.candidates(steps, _answers_of(row["answers"].as_py() if level else None, level), bits))
                full, at = _ranges(u, bits)
                cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())  # noqa: B023, E731
                out = {
                    "bucket": pa.array(full, pa.int32()), "part": pa.array([row["part"].as_py()] * len(full), pa.int32()), "block": pa.array([row["block"].as_py()] * len(full), pa.int64()),
                    "hashes": cut(u if last else (u >> np.uint64(32 - bits)).astype(np.uint32)),
                }
                if last:
                    doc = np.searchsorted(block.words.bounds[:-1], first, "right") - 1
                    out |= {"others": cut(runs(block.hashes, steps[level], other=True)[first]), "places": cut(first.astype(np.uint32)), "docs": cut(row["ids"].values.to_numpy()[doc])}
                yield pa.record_batch(out)

    return send, "bucket int, part int, block long, hashes binary" + ", others binary, places binary, docs binary" * last


def _match(level: int):
    """For a range of hashes: of each block, a bit for each hash, whether another block has it."""

    def match(table: pa.Table) -> pa.Table:
        sent = [np.frombuffer(x.as_py(), np.uint32) for x in table["hashes"]]
        values = np.sort(np.concatenate(sent))
        again = np.unique(values[1:][values[1:] == values[:-1]])
        replies = []
        for x in sent:
            at = np.searchsorted(again, x)
            at[at == len(again)] = 0
            hit = again[at] == x if len(again) else np.zeros(len(x), bool)
            replies.append(np.packbits(hit).tobytes() if hit.any() else None)
        got = pa.array([r is not None for r in replies])
        out = table.select(["part", "block", "bucket"]).append_column("reply", pa.array(replies, pa.binary())).filter(got)
        return out.append_column("level", pa.array([level] * len(out), pa.int32()))

    return match, "part int, block long, bucket int, reply binary, level int"


def _owners(table: pa.Table) -> pa.Table:
    """For a range of hashes on the last level: of each block, the places whose window starts earlier in another block."""
    sent = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in table[c]]
    places = sent("places", np.uint32)
    sizes = [len(x) for x in places]
    h, other, doc = (np.concatenate(sent(c, kind)) for c, kind in (("hashes", np.uint64), ("others", np.uint64), ("docs", np.int64)))
    order = np.lexsort((np.repeat(table["block"].to_numpy(), sizes), doc, other, h))
    h, other = h[order], other[order]
    later = np.zeros(len(h), bool)
    later[order[1:]] = (h[1:] == h[:-1]) & (other[1:] == other[:-1])
    replies = [(p[later[e - len(p) : e]]).tobytes() for p, e in zip(places, np.cumsum(sizes), strict=True)]
    got = pa.array([bool(r) for r in replies])
    out = table.select(["part", "block", "bucket"]).append_column("reply", pa.array(replies, pa.binary())).filter(got)
    return out.append_column("level", pa.array([0] * len(out), pa.int32()))


def _with_answers(blocks: DataFrame, answers: DataFrame, n: int) -> DataFrame:
    """Each block with its own answers. They are dealt by part alone, like the blocks' buckets; which block is meant is a condition beside it."""
    own = answers.repartition(n, "part").groupBy("part", "block").agg(F.collect_list(F.struct("level", "bucket", "reply")).alias("answers"))
    own = own.select(F.col("part").alias("to_part"), F.col("block").alias("to_block"), "answers")
    size = answers.agg(F.sum(F.octet_length("reply") + 40)).first()[0] or 0
    own = own.hint("shuffle_hash" if size <= HASHED * n else "merge")
    return blocks.join(own, (F.col("part") == F.col("to_part")) & (F.col("block") - F.col("to_block") == 0), "left").drop("to_part", "to_block")


def _finish(text_col: str, names: list[str], min_words: int, tidy: bool):
    def finish(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                body, lens = batch.column("body")[i].as_py(), batch.column("lens")[i].values.to_numpy()
                block = _Block(body, lens)
                words, n = block.words, len(block.hashes)
                inside = np.flatnonzero(block.windows(min_words)[1])
                _, first, back, _ = block.distinct(min_words, inside)
                elsewhere = np.zeros(n + 1, bool)
                for x in batch.column("answers")[i].as_py() or ():
                    elsewhere[np.frombuffer(x["reply"], np.uint32)] = True
                hit = inside[elsewhere[first[back]] | (inside != first[back])]
                cover = np.zeros(n + min_words + 1, np.int64)
                cover[:n] += np.bincount(hit, minlength=n)[:n]
                cover[min_words:] -= np.bincount(hit, minlength=n + 1)[: n + 1]
                gone = np.cumsum(cover)[:n] > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                bounds = words.bounds
                n_removed = total[bounds[1:]] - total[bounds[:-1]]
                texts = _kept(words, gone, n_removed, tidy)
                starts = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]])) if n else np.zeros(0, np.int64)
                starts = np.union1d(starts, bounds[:-1][(bounds[:-1] < n) & (gone[np.minimum(bounds[:-1], max(n - 1, 0))] if n else False)]).astype(np.int64)
                stop = np.flatnonzero(~np.concatenate([gone, [False]]))
                doc = np.searchsorted(bounds, starts, "right") - 1
                length = np.minimum(stop[np.searchsorted(stop, starts)] if len(starts) else starts, bounds[doc + 1]) - starts
                per = np.searchsorted(starts, bounds).astype(np.int32)
                spans = pa.ListArray.from_arrays(pa.array(per), pa.StructArray.from_arrays([pa.array(starts - bounds[doc], pa.int64()), pa.array(length, pa.int64())], ["start", "length"]))
                rest = pa.ipc.open_stream(batch.column("rest")[i].as_py()).read_all()
                new = {text_col: texts, "n_words": pa.array(np.diff(bounds), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "removed_spans": spans}
                yield from pa.table({c: new[c] if c in new else rest[c] for c in names}).to_batches()

    return finish


def _kept(words: Words, gone: np.ndarray, n_removed: np.ndarray, tidy: bool) -> pa.Array:
    """Texts of the words that stay, joined by one space; without tidy, texts that lose nothing stay as they are."""
    size, bounds = len(words.buf), words.bounds
    stay = ~gone
    kept_after = np.zeros(len(gone), bool)  # whether a later word of the same document stays
    last = np.full(len(bounds) - 1, -1)
    at = np.flatnonzero(stay)
    if len(at):
        doc = np.searchsorted(bounds, at, "right") - 1
        last[doc] = at
        kept_after[at] = at != last[doc]
    step = np.zeros(size + 2, np.int8)
    step[words.starts[stay]] += 1
    step[words.ends[stay] + kept_after[stay]] -= 1
    take = np.cumsum(step[:size]) > 0
    out = words.buf.copy()
    out[words.ends[kept_after]] = 32
    if not tidy:
        whole = np.repeat(n_removed == 0, np.diff(words.offsets))
        out[whole], take[whole] = words.buf[whole], True
    upto = np.concatenate([[0], np.cumsum(take)])[words.offsets]
    return pa.LargeStringArray.from_buffers(len(upto) - 1, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(out[take])).cast(pa.string())


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, tidy: bool = True) -> DataFrame:
    """docs with its text less the repeated words, and n_words, n_removed (long) and removed_spans (array of word ranges start, length).

    Words are stretches without ASCII white space. What stays is joined by one space; with tidy=False a text that loses
    nothing stays unchanged. Null text: no words, empty text. Null id: before all ids. Rows that share an id count as
    one after another in an order of the operator's choice; every row stays a row. Columns named like the results are
    replaced. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    clash = {"n_words", "n_removed", "removed_spans"}
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in clash])
    names = [*docs.columns, "n_words", "n_removed", "removed_spans"]
    schema = ", ".join([*(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in docs.schema), "n_words long, n_removed long, removed_spans array<struct<start:bigint,length:bigint>>"])
    blocks, name, n = _kept_in_buckets(_in_blocks(docs, id_col, text_col))
    size = blocks.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, size / 6 / RANGE))))
    steps, answers, source = levels(min_words), None, blocks
    for level in range(len(steps)):
        send, sent = _send(steps, level, bits)
        rows = source.mapInArrow(releasing(send), sent).groupBy("bucket")
        if level == len(steps) - 1:
            final = saved(rows.applyInArrow(_owners, "part int, block long, bucket int, reply binary, level int"), "substring_last")
        else:
            match, answered = _match(level)
            new = saved(rows.applyInArrow(match, answered), "substring_level")
            answers = new if answers is None else answers.unionByName(new)
            source = _with_answers(blocks, answers, n)
    out = _with_answers(blocks, final, n).mapInArrow(releasing(_finish(text_col, names, min_words, tidy)), schema)
    if answers is not None:
        forget(answers)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out
