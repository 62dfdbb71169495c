"""Packing documents into training sequences by shortest-pack-first histogram packing.

Each text becomes token ids, with one closing id; it is cut into full sequences and a rest. The histogram of the piece
lengths, with one entry for each length up to the sequence length, is all that the packing needs: lengths are placed
longest first, each into the pack with the most room, as counts of packing patterns and not as single pieces. Patterns are
then joined back to documents by rank: the pieces of one length are numbered, and each pattern owns ranges of numbers.

Numbers are given without gathering a length's pieces anywhere: the task that cuts a text counts by length, and the counts
of the tasks before it are added. So a length that a third of all pieces have (a full sequence, say) is no hot group.
The histogram and the patterns have a bound that depends on the sequence length alone.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, releasing, saved, text_bytes

#: Distinct strings whose ids a task remembers at most (about 75 MB), and the bytes of the longest one.
REMEMBERED, LONGEST = 300_000, 64
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
#: Letters of Latin-1 beyond ASCII are byte 195 and one of these.
_ACCENTED, _CAPITAL = np.zeros(256, bool), np.zeros(256, bool)
_ACCENTED[128:192] = _CAPITAL[128:159] = True
_ACCENTED[[151, 183]] = _CAPITAL[151] = False
_BASE = np.arange(256) < 128  # what can't combine with the letter before it
_BASE[195] = True
#: A word that a vocabulary of bytes takes as it is, and the letters that stand for bytes there, where they aren't chr(byte).
_SIMPLE = re.compile(rb"[a-z]*(?:\xc3[\x9f-\xb6\xb8-\xbf][a-z]*)*")
_BYTES = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
#: The normalizer and the pre-tokenizer of the vocabularies whose texts can be encoded stretch by stretch.
_LOWERED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Encoder:
    """A tokenizer as its file has it, and the ids of the stretches that the task at work has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        own = json.loads(self.tokenizer.to_str())
        first, *after = (own["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.apart = own["normalizer"] == _LOWERED and (first.get("pattern"), first.get("behavior"), first.get("invert")) == ({"Regex": _SPLIT}, "Removed", True)
        plain = [(p["type"], p.get("add_prefix_space"), p.get("use_regex")) for p in after] == [("ByteLevel", False, False)]
        self.model = self.tokenizer.model if self.apart and plain and not any(t["normalized"] for t in own["added_tokens"]) else None
        self.added = [t["content"].encode() for t in own["added_tokens"]]
        self.known: dict[bytes, bytes] = {}

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts by the library's defaults: an added token's string in a text is that token."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def stretches(self, found: list[bytes]) -> dict[bytes, bytes]:
        """Ids of stretches. Simple words go to the tokenizer's model at once: the steps before it don't change them, and take most of the time."""
        simple = [w for w in found if _SIMPLE.fullmatch(w)] if self.model else []
        flat, at = [], [0]
        for w in simple:
            flat += [t.id for t in self.model.tokenize(w.decode() if w.isascii() else w.decode("latin-1").translate(_BYTES))]
            at.append(4 * len(flat))
        raw = np.array(flat, "<u4").tobytes()
        out = dict(zip(simple, [raw[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))
        rest = [w for w in found if w not in out]
        return out | dict(zip(rest, self.ids(rest), strict=True))


_loaded: dict[str, _Encoder] = {}


def _lowered(buf: np.ndarray) -> np.ndarray:
    """A copy with small letters for Latin-1's capital ones, unless what comes next may combine with them: T and a diaeresis are no letter, t and one are."""
    out, last = buf.copy(), np.append(_BASE[buf[1:]], True)  # last: by the byte, if it is a letter's last one
    at = np.flatnonzero(buf - np.uint8(65) < 26)
    out[at[last[at]]] += 32
    at = np.flatnonzero(buf[:-1] == 195) + 1
    out[at[_CAPITAL[buf[at]] & last[at]]] += 32
    return out


def token_ids(path: str, column: pa.Array) -> list[bytes]:
    """The little-endian 32-bit ids of each text, as Tokenizer.from_file(path).encode(text, add_special_tokens=False) has them.

    A vocabulary that lower-cases, drops white space and never joins a letter to a mark after it, nor a mark but the apostrophe
    to a letter after it, gives the same ids for a text as for its stretches between such places, one after another; there each
    distinct short stretch is encoded once. Texts with the string of an added token, and texts of any other vocabulary, are
    encoded whole.
    """
    if path not in _loaded:
        _loaded[path] = _Encoder(path)
    own = _loaded[path]
    buf, offsets = text_bytes(column)
    raw, ends = buf.tobytes(), list(zip(offsets.tolist(), offsets[1:].tolist(), strict=False))
    special = own.added if any(t in raw for t in own.added) else []
    whole = [k for k, (a, b) in enumerate(ends) if not own.apart or any(raw.find(t, a, b) >= 0 for t in special)]
    out = dict(zip(whole, own.ids([raw[a:b] for a, b in (ends[k] for k in whole)]), strict=True))
    if len(out) == len(ends):
        return [out[k] for k in range(len(ends))]
    known = own.known
    letter, mark = _LETTER[buf], _MARK[buf]
    accented = np.flatnonzero(buf[:-1] == 195) + 1
    before = letter.copy()
    before[accented] = _ACCENTED[buf[accented]]
    cut = np.flatnonzero(before[:-1] & mark[1:] | mark[:-1] & letter[1:] & (buf[:-1] != 39)) + 1
    data = np.insert(_lowered(buf), cut, 32).tobytes()
    at = (offsets + np.searchsorted(cut, offsets)).tolist()
    texts = [() if k in out else data[a:b].split() for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]
    distinct = set().union(*texts)
    new = distinct.difference(known)
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = distinct
    known.update(own.stretches(list(new)))
    ids = [out[k] if k in out else b"".join(map(known.__getitem__, t)) for k, t in enumerate(texts)]
    for w in new:
        if len(w) > LONGEST:
            del known[w]
    return ids


def _cut(path: str, end_id: int, length: int, with_ids: bool):
    def cut(batches):
        part, seen, end = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for piece in pieces(batch, 1):
                doc, start, size, crc, total, ids = [], [], [], [], [], []
                for k, own in enumerate(token_ids(path, piece.column(1))):
                    own += end
                    n = len(own) // 4
                    for s in range(0, n, length):
                        part_ids = own[4 * s : 4 * (s + length)]
                        doc.append(k)
                        start.append(s)
                        size.append(len(part_ids) // 4)
                        crc.append(zlib.crc32(part_ids))
                        total.append(n)
                        if with_ids:
                            ids.append(np.frombuffer(part_ids, "<i4"))
                sizes = np.array(size, np.int64)
                order = np.argsort(sizes, kind="stable")
                ordered = sizes[order]
                rank = np.empty(len(sizes), np.int64)
                rank[order] = np.arange(len(sizes)) - np.searchsorted(ordered, ordered) + seen[ordered]
                seen += np.bincount(sizes, minlength=length + 1)
                out = {
                    "doc_id": piece.column(0).take(pa.array(doc, pa.int32())), "start": pa.array(start, pa.int64()), "length": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                    "doc_tokens": pa.array(total, pa.int64()), "part": pa.array(np.full(len(sizes), part), pa.int32()), "nth": pa.array(rank),
                }
                yield pa.record_batch(out | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))
        if path in _loaded:  # the worker outlives the task, and may do other work
            _loaded[path].known.clear()

    return releasing(cut)


def patterns(histogram: dict[int, int], length: int) -> list[tuple[list[int], int]]:
    """Packing patterns (lengths, longest first; how many sequences follow it) that hold histogram[n] pieces of each length n.

    Lengths are placed longest first, each into the shortest pack so far. Where none has room, as many are opened as the
    pieces left of this length fill, and take one each; the others follow into them. Packs with one pattern are one entry:
    its count splits when fewer pieces come than there are packs, so the entries number at most three times the distinct lengths.
    """
    packs: list[tuple[int, int, int, tuple | None]] = []  # (minus the room, order, count, (lengths before, length))
    order = 0
    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left > 0:
            if packs and -packs[0][0] >= n:
                room, _, count, own = heapq.heappop(packs)
                used = min(left, count)
                if count > used:
                    heapq.heappush(packs, (room, order, count - used, own))
                    order += 1
                heapq.heappush(packs, (room + n, order, used, (own, n)))
            else:
                used = -(-left // (length // n))
                heapq.heappush(packs, (n - length, order, used, (None, n)))
            order += 1
            left -= used
    out = []
    for _, _, count, own in sorted(packs, key=lambda p: p[1]):
        lengths = []
        while own:
            lengths.append(own[1])
            own = own[0]
        out.append((lengths[::-1], count))
    return out


def _owners(found: list[tuple[list[int], int]], length: int) -> dict[str, np.ndarray]:
    """Ranges of ranks by length: from which rank (with the length in the high bits), the pattern's first sequence, pieces of that length in it, the first one's offset."""
    key, first, many, offset = [], [], [], []
    used = np.zeros(length + 1, np.int64)
    sequence = 0
    for lengths, count in found:
        at = 0
        values, number = np.unique(np.array(lengths, np.int64), return_counts=True)
        for n, m in zip(values[::-1].tolist(), number[::-1].tolist(), strict=True):
            key.append((n << 48) + used[n])
            first.append(sequence)
            many.append(m)
            offset.append(at)
            used[n] += count * m
            at += n * m
        sequence += count
    order = np.argsort(np.array(key, np.int64), kind="stable")
    return {k: np.array(v, np.int64)[order] for k, v in {"key": key, "first": first, "many": many, "offset": offset}.items()}


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """A row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset (long), with with_ids also ids (array of int).

    A null or empty text is one piece with the closing id alone. Ids may be null or shared; each row is a document of its
    own. Other columns take no part. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long" + ", ids array<int>" * with_ids
    cut = saved(texts.mapInArrow(_cut(tokenizer, end_id, length, with_ids), schema), "packing_pieces")
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    owners = spark.sparkContext.broadcast(_owners(patterns(histogram, length), length))

    def place(batches):
        own = owners.value
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(own["key"], (n << 48) + rank, "right") - 1
            within = (n << 48) + rank - own["key"][i]
            sequence = own["first"][i] + within // own["many"][i]
            offset = own["offset"][i] + within % own["many"][i] * n
            out = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(sequence), pa.array(offset)], names=[*out.schema.names, "sequence_id", "offset"])

    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    ranked = cut.join(before.select("part", "length", F.coalesce("before", F.lit(0)).alias("before")), ["part", "length"]).select(*kept, (F.col("before") + F.col("nth")).alias("rank"))
    result = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, result).withColumnRenamed("doc_id", id_col)
