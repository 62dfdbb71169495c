"""Line dedup by winnowing over line hashes.

Deleted is each line that lies in a run of consecutive lines of a document which also starts earlier: in a document with a
smaller id (a null id comes first), or earlier in the same one. A run counts if it has `min_lines` lines or more, not all of
them empty, or `min_words` words or more; so long passages on one or two lines go, and short everyday lines stay.

Windows are the runs that count and can't be made shorter: `min_lines` lines from each place, and the shortest run with
`min_words` words from each line on and up to each line. Any run that counts is a union of them. Steps:

1. Each window selects its smallest line hash (the last of equals; no empty line). Only the distinct selected positions go
   on: a line that several windows select is one fingerprint, and every run that counts has one at the same place wherever
   it stands. A position has with it the hashes of the windows that selected it.
2. Positions whose fingerprint stands nowhere else can be part of no repeat and go, before any window is looked at.
3. The matches of the others are extended to both sides, as far as the windows around a position reach: each window is
   joined to the first place in the corpus that has the same fingerprint and the same lines around it. That is one place,
   so a common line costs as many rows as it has places. Longer runs have further fingerprints, one in each window.
4. The runs so found are gathered by document and deleted from the texts.

Only hashes move until the end. A line or passage that very many documents have is counted by partial aggregation, and its
join is one that Spark can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lines, Words, forget, free_name, pieces, releasing, replacing, saved, spans, text_bytes

#: Bytes of marks for a shuffle partition up to which they are hashed for the join with the texts, which are then not sorted.
HASHED = 64 << 20
_NULL_ID = -(2**63)
_NOT = np.uint64(2**64 - 1)
_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("hash", pa.int64())])


def windows(lines: Lines, hashes: np.ndarray, min_lines: int, min_words: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the shortest runs that count, within one text each."""
    n = len(hashes)
    line, low, high = np.arange(n), *(np.repeat(x, np.diff(lines.bounds)) for x in (lines.bounds[:-1], lines.bounds[1:]))
    filled = np.concatenate([[0], np.cumsum(hashes != 0)])
    ok = line + min_lines <= high
    ok[ok] = filled[line[ok] + min_lines] > filled[line[ok]]
    found = [(line[ok] << 32) | (line[ok] + min_lines)]
    if min_words is not None:
        total = np.concatenate([[0], np.searchsorted(Words(lines.buf, lines.offsets).starts, lines.ends)])
        stop, start = np.searchsorted(total, total[:-1] + min_words), np.searchsorted(total, total[1:] - min_words, "right") - 1
        on, upto = stop <= high, start >= low
        found += [(line[on] << 32) | stop[on], (start[upto] << 32) | (line[upto] + 1)]
    both = np.unique(np.concatenate(found))
    return both >> 32, both & 0xFFFFFFFF


def smallest(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The place of the smallest value in each range, the last of equals: two overlapping ranges of a power of two each cover it."""
    out, step = np.zeros(len(starts), np.int64), np.floor(np.log2(np.maximum(stops - starts, 1))).astype(np.int64)
    best = np.arange(len(values))
    for k in range(int(step.max(initial=-1)) + 1):
        at = np.flatnonzero(step == k)
        a, b = best[starts[at]], best[stops[at] - (1 << k)]
        out[at] = np.where(values[b] <= values[a], b, a)
        a, b = best[: -(1 << k)], best[1 << k :]
        best = np.where(values[b] <= values[a], b, a)
    return out


def _positions(min_lines: int, min_words: int | None):
    """d, t, text -> the distinct selected positions: d, t, fingerprint, and the windows that selected each."""

    def positions(batches):
        for batch in batches:
            for piece in pieces(batch, 2):
                lines = Lines(*text_bytes(piece.column(2)))
                h = lines.hashes()
                start, stop = windows(lines, h, min_lines, min_words)
                place = smallest(np.where(h == 0, _NOT, h), start, stop)
                order = np.argsort(place, kind="stable")
                start, stop, place = start[order], stop[order], place[order]
                first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else place
                doc = np.searchsorted(lines.bounds, place, "right") - 1
                low = lines.bounds[doc]
                own = pa.StructArray.from_arrays([pa.array(start - low, pa.int32()), pa.array(stop - low, pa.int32()), pa.array(spans(h, start, stop).view(np.int64))], fields=list(_SPAN))
                at = pa.array(np.append(first, len(place)).astype(np.int32))
                of = pa.array(doc[first])
                yield pa.record_batch({"d": piece.column(0).take(of), "t": piece.column(1).take(of), "fingerprint": pa.array(h[place[first]].view(np.int64)), "windows": pa.ListArray.from_arrays(at, own)})

    return positions


def repeated(positions: DataFrame) -> DataFrame:
    """The positions whose fingerprint stands somewhere else too."""
    again = saved(positions.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"), "line_fingerprints")
    return positions.join(again, "fingerprint", "left_semi")  # with a table, so that a common fingerprint can be split


def _marked(batches):
    """d, t, starts, stops -> d, t, and which of the text's lines are gone, up to the last of them."""
    for batch in batches:
        masks = []
        for runs in batch.column("runs"):
            start, stop = (runs.values.field(c).to_numpy() for c in ("start", "stop"))
            depth = np.bincount(start, minlength=stop.max() + 1) - np.bincount(stop, minlength=stop.max() + 1)
            masks.append(np.cumsum(depth)[:-1] > 0)
        yield pa.record_batch({"d": batch.column("d"), "t": batch.column("t"), "gone": pa.array(masks, pa.list_(pa.bool_()))})


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 3, min_words: int | None = 8) -> DataFrame:
    """docs with its text less the deleted lines, and n_lines, n_removed (long).

    Lines are what line feeds separate, words stretches without ASCII white space. With min_words=None runs count by lines
    alone. A text that loses nothing stays as it is; a null text has no lines and stays null; an empty one has one line.
    Rows with equal id and text are one document and all get its result; those that share an id alone come one after
    another in an order of the operator's choice. Columns named like the results are replaced; any other name may be a
    column of docs. An empty table gives an empty table.
    """
    d, t, mark = (free_name(docs, c) for c in ("d", "t", "gone"))
    text = F.col(f"`{text_col}`")
    keyed = docs.select("*", F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_ID)).alias(d), F.xxhash64(text).alias(t))
    texts = keyed.where(text.isNotNull()).select(F.col(d).alias("d"), F.col(t).alias("t"), text.alias("text"))
    kind = "d long, t long, fingerprint long, windows array<struct<start:int,stop:int,hash:long>>"
    positions = saved(texts.mapInArrow(releasing(_positions(min_lines, min_words)), kind), "line_positions")
    kept = saved(repeated(positions), "line_repeated")
    forget(positions)

    around = kept.select("d", "t", "fingerprint", F.explode("windows").alias("w")).select("d", "t", "fingerprint", "w.*")
    first = around.groupBy("fingerprint", "hash").agg(F.min(F.struct("d", "t", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = saved(first, "line_first")
    later = around.join(first, ["fingerprint", "hash"]).where("not (d = first.d and t = first.t and start = first.start)")
    runs = later.groupBy("d", "t").agg(F.collect_set(F.struct("start", "stop")).alias("runs"))  # no more than the document has windows
    gone = saved(runs.mapInArrow(_marked, "d long, t long, gone array<boolean>"), "line_marks")
    forget(kept, first)

    size = gone.agg(F.sum(F.size("gone") + 40)).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = gone.select(F.col("d").alias(d), F.col("t").alias(t), F.col("gone").alias(mark)).hint("shuffle_hash" if size <= HASHED * parts else "merge")
    out = keyed.join(marks, [d, t], "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.coalesce(F.get(mark, i), F.lit(False))), "\n")
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_removed = F.coalesce(F.size(F.filter(mark, lambda x: x)), F.lit(0)).cast("long")
    counted = replacing(out, **{text_col: F.when(F.col(mark).isNull(), text).otherwise(left), "n_lines": n_lines, "n_removed": n_removed})
    return counted.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_removed")], "n_lines", "n_removed")
