"""Periodic runs in texts: stretches of words that repeat with one period, found by a suffix automaton and its end positions.

States of the automaton are visited from the longest to the shortest, and each hands its ordered set of end positions to its
suffix link, the smaller of both sets into the larger. Two positions that become neighbours there, at a distance d that fits
into the state's length, end the same words: a square of period d, which reaches back by exactly the state's length, as the
state is where both positions meet first. So a square's start is its run's start, and the run ends where its last square does.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: A run has so many words at least, and so many periods.
LEAST, PERIODS = 6, 4
#: A set of positions is kept in blocks of at most twice so many.
BLOCK = 512

RESULT = "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, n_dropped long, text binary"


class _Positions:
    """An ordered set of positions, in blocks, so that an insertion moves few of them."""

    __slots__ = ("blocks", "tops", "size")

    def __init__(self, first: int):
        self.blocks, self.tops, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> None:
        k = min(bisect_left(self.tops, x), len(self.tops) - 1)
        block = self.blocks[k]
        insort(block, x)
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.tops[k : k + 1] = [block[BLOCK - 1], block[-1]]
        else:
            self.tops[k] = block[-1]

    def around(self, x: int) -> tuple[int, int]:
        """The neighbours of a member, -1 where there is none."""
        k = bisect_left(self.tops, x)
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else (self.tops[k - 1] if k else -1)
        after = block[i + 1] if i + 1 < len(block) else (self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1)
        return before, after


def _automaton(word: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and first own end position (-1: a copied state) of each state."""
    length, link, own, step = [0], [-1], [-1], [{}]
    last = 0
    for i, c in enumerate(word):
        new = len(length)
        length.append(i + 1), link.append(0), own.append(i), step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1), link.append(link[q]), own.append(-1), step.append(step[q].copy())
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return length, link, own


def automaton_runs(word: Sequence[int], periods: int = PERIODS) -> dict[tuple[int, int], int]:
    """(start, period) -> last position of each maximal run of at least so many periods (two or more) in a sequence.

    A run of e periods has squares whose two ends share e - 1 periods, so only states of that length are merged into. All
    of a smaller set is inserted before its neighbours are looked at: what lies between two ends of a square of a
    multiple of the period has come up in the same set as one of them. Pairs within one set met in a longer state.
    """
    length, link, own = _automaton(word)
    shortest = periods - 1
    sets: list[_Positions | None] = [_Positions(p) if p >= 0 else None for p in own]
    found: dict[tuple[int, int], int] = {}
    for state in np.argsort(-np.asarray(length), kind="stable").tolist():
        up, small = link[state], sets[state]
        sets[state] = None
        if up <= 0 or length[up] < shortest:
            continue
        large = sets[up]
        if large is None:
            sets[up] = small
            continue
        if small.size > large.size:
            small, large = large, small
        sets[up], n = large, length[up]
        new = list(small)
        for x in new:
            large.add(x)
        k, end = 0, len(new)
        while k < end:
            x = new[k]
            before, after = large.around(x)
            d = x - before
            if before >= 0 and shortest * d <= n and not (k and new[k - 1] == before):
                at = before - n + 1, d
                found[at] = max(found.get(at, -1), x)
            d = after - x
            if after >= 0 and shortest * d <= n and not (k + 1 < end and new[k + 1] == after):
                at = x - n + 1, d
                found[at] = max(found.get(at, -1), after)
            k += 1
    return found


def _stretches(ids: np.ndarray, kinds: int) -> Iterator[tuple[int, int]]:
    """Ranges outside of which no word is in a run: every three words in a row of a run stand three times in the text at least."""
    n = len(ids)
    if n < LEAST:
        return
    if kinds < 1 << 21:
        triples = (ids[:-2] * kinds + ids[1:-1]) * kinds + ids[2:]
    else:  # more kinds than fit: pairs first
        triples = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1]
        triples = triples[:-1] * kinds + ids[2:]
    _, which, times = np.unique(triples, return_inverse=True, return_counts=True)
    often = times[which] >= 3
    inside = np.zeros(n + 2, bool)
    for k in range(3):
        inside[1 + k : 1 + k + len(often)] |= often
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a >= LEAST:
            yield a, b


def runs_of(words: Sequence[bytes]) -> list[tuple[int, int, int]]:
    """start, length, period of every run of words, by start, then period."""
    known: dict[bytes, int] = {}
    ids = [known.setdefault(w, len(known)) for w in words]
    out = []
    for a, b in _stretches(np.array(ids, np.int64), max(1, len(known))):
        for (start, period), last in automaton_runs(ids[a:b]).items():
            if last - start + 1 >= LEAST:
                out.append((a + start, last - start + 1, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a tenth of all documents with a tail that repeats, chosen by the checksum of the id; a null id changes nothing."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _row(words: list[bytes]) -> tuple:
    found = runs_of(words)
    digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
    if not found:
        return len(words), 0, None, None, None, None, digest, 0, b" ".join(words)
    best = found[0]
    gone = np.zeros(len(words) + 1, np.int64)
    for r in found:
        if r[1] * best[2] > best[1] * r[2]:  # exact; the first of equals is the one with smallest start and period
            best = r
        gone[r[0] + r[2]] += 1
        gone[r[0] + r[1]] -= 1
    stay = np.cumsum(gone[:-1]) == 0
    kept = [words[i] for i in np.flatnonzero(stay).tolist()]
    return len(words), len(found), best[0], best[1], best[2], 1000 * best[1] // best[2], digest, len(words) - len(kept), b" ".join(kept)


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", damaged: bool = False) -> DataFrame:
    """A row per document: the id as it is, n_words, n_runs, the run of most periods, a digest of all runs, n_dropped and the text without repeats.

    Words are what white space (byte 32, 9 to 13) separates. A run is a stretch with smallest period q, of at least 6 words
    and 4 q, that no neighbour extends. text (binary, UTF-8) has one space between words and lacks each word that a run has
    after its first q. The best run is the one of most periods (ties: smallest start, then period); without runs start,
    length, period and exponent_milli are null. With `damaged` a tenth of the texts get a repeated tail first (repeated_tail).
    Null and empty texts have no words. Null ids, repeated rows and ids, and other columns do no harm: a document is a
    row. All is done in one pass without a shuffle; a task holds a batch of texts, and about a kilobyte for each word of
    a document that stands in phrases which the document repeats.
    """
    row = free_name(docs, "text") if text_column.lower() != "text" else "text"
    schema = docs.select(id_column).schema
    shape = ", ".join([f"`{id_column}` {schema[0].dataType.simpleString()}", *RESULT.split(", ")])

    def step(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                rows.append(_row(repeated_tail(words, doc_id) if damaged else words))
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 6 + [pa.string(), pa.int64(), pa.binary()]
            arrays = [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, [id_column, *[c.split()[0] for c in RESULT.split(", ")]])

    return docs.select(id_column, F.col(text_column).cast("binary").alias(row)).mapInArrow(step, shape)
