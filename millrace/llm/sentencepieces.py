"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three transducers are compiled from a model. The normaliser has a state for what was read before (nothing, a word, a space)
and arcs that put out the mark U+2581 for spaces, one in front, or nothing. The pieces are a trie of arcs, one for each
character, with the piece at its last one. The byte fallback takes a character that no piece has, by one arc, and writes its
bytes' pieces. The normaliser is applied to the input first: it has one path, so its output stands for the composition with
it. That output is composed with pieces and fallback lazily, place by place, and the shortest path in the tropical
semiring (minimum of sums) is the encoding; the fallback's bytes are written when the path is read back. So neither the
normaliser's states nor the 256 byte arcs are nodes of the lattice that is searched, which has the pieces and one fallback arc.

A unigram model's arcs weigh minus the piece's score. A BPE model's weights belong to pairs: a sequence of pieces is what
merging gives if and only if merging each two neighbours' text gives just these two. So the arc of a piece weighs 0 after a
piece that it may follow and infinity after any other; pairs are compiled when they first come up. One path is finite.

If no piece has the mark but at its head, stretches from one run of marks to the next can't share a piece, and the path of a text
is that of its stretches; each distinct short one is composed once and remembered, up to a bound.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

MARK = "▁"
#: Stretches, and pairs, that a Python worker remembers at most, and the characters of the longest stretch.
REMEMBERED, PAIRS, LONGEST = 700_000, 2_000_000, 64
_loaded: dict[str, Transducer] = {}


class Normaliser:
    """Arcs from a state by whether a space is read: what is put out before it, whether it is put out itself, the next state."""

    START, WORD, SPACE = range(3)

    def __init__(self, prefix: bool, squeeze: bool):
        front = MARK if prefix else ""
        if squeeze:  # spaces are put out once a word follows them
            self.arcs = {
                (self.START, True): ("", False, self.START), (self.START, False): (front, True, self.WORD), (self.WORD, True): ("", False, self.SPACE),
                (self.WORD, False): ("", True, self.WORD), (self.SPACE, True): ("", False, self.SPACE), (self.SPACE, False): (MARK, True, self.WORD),
            }
        else:
            self.arcs = {(s, space): ((front if s == self.START else "") + MARK * space, not space, self.WORD) for s in (self.START, self.WORD) for space in (True, False)}
        loop = {space: self.arcs[self.WORD, space] for space in (True, False)}
        #: What stands for a space in a text whose arcs after the first all stay in one state: the rest is rewritten at once.
        self.table = loop[True][0] if loop[True][2] == loop[False][2] == self.WORD and not loop[False][0] else None

    def __call__(self, text: str) -> str:
        """What the only path of a text puts out."""
        if not text:
            return ""
        out, state = [], self.START
        for i, c in enumerate(text):
            if state == self.WORD and self.table is not None:
                out.append(text[i:].replace(" ", self.table))
                break
            before, itself, state = self.arcs[state, c == " "]
            out.append(before + c * itself)
        return "".join(out)


class Transducer:
    """Compiled from a SentencePiece model (unigram or BPE, identity normalisation)."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        m.ParseFromString(model)
        if m.normalizer_spec.precompiled_charsmap:
            raise ValueError("only identity normalisation is compiled")
        self.prefix = m.normalizer_spec.add_dummy_prefix
        self.normalise = Normaliser(self.prefix, m.normalizer_spec.remove_extra_whitespaces)
        self.merging = m.trainer_spec.model_type == proto.TrainerSpec.BPE
        self.compile({p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type in (1, 4)})  # normal and user-defined ones stand for their text
        self.unknown = next((i for i, p in enumerate(m.pieces) if p.type == 2), 0)
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.bytes_of = [b"" if p.type == 3 else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b" \xe2\x81\x87 " if p.type == 2 else p.piece.replace(MARK, " ").encode() for p in m.pieces]
        self.apart = self.merging and all(MARK not in p.lstrip(MARK) for p in self.ids)
        feed = "" if any("\n" in p for p in self.ids) else "\n"  # one that no piece has stands alone
        self.stretches = re.compile(f"{MARK}+[^{MARK}{feed}]*|[^{MARK}{feed}]+" + (f"|{feed}" if feed else ""))

    def compile(self, pieces: dict[str, tuple[int, float]]) -> None:
        """The pieces' arcs: next[node] maps a character to a node, piece[node] is the id of the piece that ends there, or -1."""
        self.ids = {p: i for p, (i, _) in pieces.items()}
        self.score, self.text = {i: s for i, s in pieces.values()}, {i: p for p, i in self.ids.items()}
        self.next: list[dict[str, int]] = [{}]
        self.piece = [-1]
        for text, i in self.ids.items():
            node = 0
            for c in text:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.piece.append(-1)
                node = self.next[node][c]
            self.piece[node] = i
        #: Each character of a piece is a piece, so merging leaves nothing but pieces and characters that no piece begins with.
        self.whole = self.merging and all(c in self.ids for c in set("".join(self.ids)))
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.fallen: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, path: str) -> Transducer:
        if path not in _loaded:
            with open(path, "rb") as f:
                _loaded[path] = cls(f.read())
        return _loaded[path]

    def fallback(self, c: str) -> tuple[int, ...]:
        """The pieces of a character's bytes: the path of its UTF-8 form through the 256 arcs of the fallback. Without byte pieces, the unknown piece."""
        if c not in self.fallen:
            self.fallen[c] = tuple(self.byte[b] for b in c.encode()) if self.byte else (self.unknown,)
        return self.fallen[c]

    def merged(self, text: str) -> list[str]:
        """What merging makes of a text: the best-scored two neighbours first, the leftmost of equals."""
        parts, ids, score = list(text), self.ids, self.score
        while True:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and score[i] > best:
                    best, at = score[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the text of both pieces gives just these two."""
        a, b = self.text[left], self.text[right]
        if a + b in self.ids:
            return False  # these two would merge
        return self.merged(a + b) == [a, b]

    def follow(self, text: str) -> bytes | None:
        """The ids on the finite path of a normalised text where the model merges and each character of a piece is one, 32 bits each.

        The search goes by the longest arc first and comes back where no arc may follow. A place has one finite path, so it is
        gone on from once; places beside the path are mostly never seen. None if there is no such path.
        """
        n, arcs, ends, pairs = len(text), self.next, self.piece, self.pairs
        i, last, path, seen = 0, -1, [], set()  # path: place, piece before it and the arcs not tried there
        while i < n:
            node, ahead, open_arcs = 0, i, []
            while ahead < n:
                node = arcs[node].get(text[ahead])
                if node is None:
                    break
                ahead += 1
                if ends[node] >= 0:
                    open_arcs.append((ahead, ends[node]))
            if not open_arcs:
                open_arcs.append((i + 1, -1))
            while True:
                if not open_arcs:
                    if not path:
                        return None
                    i, last, open_arcs = path.pop()
                    continue
                j, k = open_arcs.pop()
                if j in seen:
                    continue
                if last >= 0 and k >= 0:
                    ok = pairs.get(last << 24 | k)
                    if ok is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        ok = pairs[last << 24 | k] = self.may_follow(last, k)
                    if not ok:
                        continue
                break
            seen.add(j)
            path.append((i, last, open_arcs))
            i, last = j, k
        out: list[int] = []
        for (start, _, _), piece in zip(path, [*[p[1] for p in path[1:]], last], strict=False):
            if piece >= 0:
                out.append(piece)
            else:
                own = self.fallback(text[start])
                if own != (self.unknown,) or not out or out[-1] != self.unknown:  # unknown ones in a row are one
                    out += own
        return struct.pack(f"<{len(out)}i", *out)

    def compose(self, text: str) -> bytes:
        """The ids on the shortest path of a normalised text, 32 bits each."""
        if self.whole and (path := self.follow(text)) is not None:
            return path
        n, arcs, ends, merging, score, pairs = len(text), self.next, self.piece, self.merging, self.score, self.pairs
        cost, back = [0.0] + [np.inf] * n, [0] * (n + 1)
        last = [-1] * (n + 1)  # the piece that the best path to a place ends with; -1 after a fallback
        for i in range(n):
            now, before = cost[i], last[i]
            if now == np.inf:
                continue
            node, alone = 0, True  # alone: no piece is this character
            for j in range(i + 1, n + 1):
                node = arcs[node].get(text[j - 1])
                if node is None:
                    break  # no piece begins so
                k = ends[node]
                if k < 0:
                    continue
                if j == i + 1:
                    alone = False
                if not merging:
                    if now - score[k] < cost[j]:
                        cost[j], back[j], last[j] = now - score[k], i, k
                elif cost[j]:  # not reached yet: one path alone is finite
                    if before >= 0:
                        ok = pairs.get(before << 24 | k)
                        if ok is None:
                            if len(pairs) >= PAIRS:
                                pairs.clear()
                            ok = pairs[before << 24 | k] = self.may_follow(before, k)
                        if not ok:
                            continue
                    cost[j], back[j], last[j] = 0.0, i, k
            if alone and now + 100 * (not merging) < cost[i + 1]:
                cost[i + 1], back[i + 1], last[i + 1] = now + 100 * (not merging), i, -1
        out: list[int] = []
        j = n
        while j:
            i = back[j]
            own = (last[j],) if last[j] >= 0 else self.fallback(text[i:j])
            if own != (self.unknown,) or not out or out[-1] != self.unknown:  # unknown ones in a row are one
                out += own[::-1]
            j = i
        return np.array(out[::-1], "<i4").tobytes()

    # -- whole texts

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit values."""
        text = self.normalise(text)
        if not self.apart:
            return self.compose(text)
        known, parts = self.known, self.stretches.findall(text)
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            long: dict[str, bytes] = {}
            for p in parts:
                if p not in known and p not in long:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    (known if len(p) <= LONGEST else long)[p] = self.compose(p)
            return b"".join([known[p] if p in known else long[p] if p in long else self.compose(p) for p in parts])

    def decode(self, ids: bytes | np.ndarray) -> str:
        """The text of ids: pieces' text and bytes in order, less the space that was put in front."""
        values = (np.frombuffer(ids, "<i4") if isinstance(ids, bytes) else ids).tolist()
        text = b"".join([self.bytes_of[i] for i in values]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _mapped(docs: DataFrame, column: str, id_col: str, out: str, make: Callable) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{column}`").alias("value"))
    return rows.mapInArrow(make, f"id {kind}, {out}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row id_col and ids (array of int; empty for an empty or null text). Other columns take no part."""

    def make(batches):
        t = Transducer.load(model)
        for batch in batches:
            for piece in pieces(batch, 1):
                yield pa.record_batch({"id": piece.column(0), "ids": pa.array([np.frombuffer(t.encode(x or ""), "<i4") for x in piece.column(1).to_pylist()], pa.list_(pa.int32()))})

    return _mapped(docs, text_col, id_col, "ids array<int>", make)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """For each row id_col and text. A null array is an empty text; ids out of range raise an error."""

    def make(batches):
        t = Transducer.load(model)
        for batch in batches:
            yield pa.record_batch({"id": batch.column(0), "text": pa.array([t.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()], pa.string())})

    return _mapped(encoded, ids_col, id_col, "text string", make)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each whole text in one pass: id_col, n_tokens, ids_crc32 (long, of little-endian 32-bit ids), same (boolean: decoding gave the text back).

    A null text is empty. Texts with the mark U+2581 come back with spaces instead, so same is false for them. Rows stay
    rows; other columns take no part; an empty table gives an empty table.
    """

    def make(batches):
        t = Transducer.load(model)
        for batch in batches:
            for piece in pieces(batch, 1):
                texts = [x or "" for x in piece.column(1).to_pylist()]
                ids = [t.encode(x) for x in texts]
                yield pa.record_batch({
                    "id": piece.column(0), "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                    "same": pa.array([t.decode(i) == x for i, x in zip(ids, texts, strict=True)], pa.bool_()),
                })

    return _mapped(docs, text_col, id_col, "n_tokens long, ids_crc32 long, same boolean", make)
