"""Repair of conversation structure by weighted finite-state composition.

A conversation is an acceptor of its rows, one after another. The edit transducer keeps, re-roles, deletes or inserts a row,
each at a cost. The grammar of roles accepts `(s?(ua)+)?`, initials of system, user and assistant. A state of their
composition is (rows read, rows inserted since, state of the grammar); its arcs are made when the search comes to it. Weights
are pairs of cost and edit labels, compared in this order. Distances to the end are taken from the last row backwards: there
arcs out of a state differ in label, so that comparing (cost, own label) compares whole label strings.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WHITE, STOPS = b"\x20\t\n\x0b\x0c\r", (b".", b"!", b"?")
KEEP, REROLE, DELETE, INSERT = b"KRDI"
#: Costs of edits; a row that stays truncated costs so much more.
COST, CUT = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}, 5
#: The grammar of roles: state -> initial -> next state. Accepting are 0 (nothing yet) and 3 (after an assistant).
GRAMMAR, ACCEPTING = {0: {b"s": 1, b"u": 2}, 1: {b"u": 2}, 2: {b"a": 3}, 3: {b"u": 2}}, (0, 3)
ROLES = {b"u": b"user", b"a": b"assistant"}
#: Insertions in a row: a third one comes to a state that the first one had come to.
MOST_INSERTED = 2
#: A row is fine, truncated, or has to go.
FINE, TRUNCATED, DOOMED = 0, 1, 2
_INITIALS = (b"s", b"u", b"a")
#: Bytes of a conversation's texts held in memory; what is beyond lies in a task's own scratch file until the row is written.
HELD = 8 << 20

REPORT = "n_turns long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _symbol(initial: bytes, fate: int) -> int:
    return 4 * fate + (_INITIALS.index(initial) if initial in _INITIALS else 3)


def _edits(symbol: int) -> Iterator[tuple[int, bytes, int]]:
    """The edit transducer's arcs that read a row: label, initial written (empty: none), cost."""
    fate, which = divmod(symbol, 4)
    yield DELETE, b"", COST[DELETE]
    if fate != DOOMED:
        more = CUT if fate == TRUNCATED else 0
        if which < 3:
            yield KEEP, _INITIALS[which], COST[KEEP] + more
        for initial in ROLES:
            yield REROLE, initial, COST[REROLE] + more


#: The arcs of transducer and grammar together, for each row symbol and state of the grammar: cost, label, next state.
_READS = [[[(cost, label, GRAMMAR[g][out] if out else g) for label, out, cost in _edits(s) if not out or out in GRAMMAR[g]] for g in range(4)] for s in range(12)]
_WRITES = [next((GRAMMAR[g][out] for out in ROLES if out in GRAMMAR[g])) for g in range(4)]


def search(symbols: bytes) -> tuple[int, bytes]:
    """Cost and labels of the best path: least cost, of those the least labels in byte order. A byte of memory a row and state."""
    layers, n = MOST_INSERTED + 1, len(symbols)
    chosen = bytearray((n + 1) * layers * 4)
    after: list = []
    for i in range(n, -1, -1):
        reads = _READS[symbols[i]] if i < n else None
        here: list = [None] * layers
        for k in range(MOST_INSERTED, -1, -1):
            row = []
            for g in range(4):
                best = (0, 0) if reads is None and g in ACCEPTING else None
                if reads is not None:
                    for cost, label, to in reads[g]:
                        if after[to] is not None and (best is None or (after[to] + cost, label) < best):
                            best = after[to] + cost, label
                if k < MOST_INSERTED and (ahead := here[k + 1][_WRITES[g]]) is not None and (best is None or (ahead + COST[INSERT], INSERT) < best):
                    best = ahead + COST[INSERT], INSERT
                row.append(best[0] if best else None)
                chosen[(i * layers + k) * 4 + g] = best[1] if best else 0
            here[k] = row
        after = here[0]
    i = k = g = 0
    labels = bytearray()
    while label := chosen[(i * layers + k) * 4 + g]:
        labels.append(label)
        if label == INSERT:
            k, g = k + 1, _WRITES[g]
        else:
            g = next(to for _, x, to in _READS[symbols[i]][g] if x == label)
            i, k = i + 1, 0
    return after[0], bytes(labels)


_short = lru_cache(1 << 16)(search)


class _Conversation:
    """One conversation as its rows come in order. Faults are told at once; texts wait for the search."""

    def __init__(self, conv_id):
        self.conv_id, self.symbols = conv_id, bytearray()
        self.turns, self.low, self.high = 0, None, None
        self.faults, self.illegal, self.before = [0, 0, 0], 0, None
        self.store, self.held = tempfile.SpooledTemporaryFile(HELD), 0

    def add(self, turn: int | None, role: bytes, text: bytes, again: bool) -> None:
        initial, last = role[:1], text.rstrip(WHITE)[-1:]
        fault = 0 if not last else 1 if again else 2 if last not in STOPS else None
        if fault is not None:
            self.faults[fault] += 1
        self.symbols.append(_symbol(initial, FINE if fault is None else TRUNCATED if fault == 2 else DOOMED))
        if self.before is not None and self.before + initial not in (b"su", b"ua", b"au"):
            self.illegal += 1
        self.before = initial
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        self.store.write(struct.pack("<qq", len(role), len(text)) + role + text)

    def edited(self) -> tuple[int, bytes, Iterator[tuple[int, bytes, bytes]]]:
        """Cost, labels, and label, role and text of each row that is there after the repair."""
        symbols = bytes(self.symbols)
        cost, labels = _short(symbols) if len(symbols) <= 64 else search(symbols)

        def rows():
            self.store.seek(0)
            g = 0
            for label in labels:
                role = text = b""
                if label != INSERT:
                    sizes = struct.unpack("<qq", self.store.read(16))
                    role, text = self.store.read(sizes[0]), self.store.read(sizes[1])
                if label == DELETE:
                    continue
                initial = role[:1] if label == KEEP else next(x for x in ROLES if x in GRAMMAR[g])
                g = GRAMMAR[g][initial]
                yield label, role if label == KEEP else ROLES[initial], text

        return cost, labels, rows()

    def report(self) -> tuple:
        cost, labels, rows = self.edited()
        digest = hashlib.sha256()
        for i, (_, role, text) in enumerate(rows):
            digest.update((b"\n" if i else b"") + role + b":")
            digest.update(text)
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, len(self.symbols), gaps, *self.faults, self.illegal, cost, labels.decode(), digest.hexdigest())


def _conversations(batches) -> Iterator[_Conversation]:
    """Conversations of rows conv_id, turn, role, text, copies, nth that come in order."""
    now = None
    for batch in batches:
        ids, turns, roles, texts, copies, nth = (c.to_pylist() for c in batch.columns)
        for i, conv_id in enumerate(ids):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield now
                    now.store.close()
                now = _Conversation(conv_id)
            for k in range(copies[i]):
                now.add(turns[i], roles[i], texts[i], k > 0 or nth[i] > 1)
    if now is not None:
        yield now
        now.store.close()


def plain(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (1) of a table of conversations; a null role or text is one space."""
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return c.select("conv_id", "turn", *[F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")], F.lit(1).alias("copies"))


def damaged(conversations: DataFrame) -> DataFrame:
    """plain, with faults by the checksum of `conv_id:turn` (nulls: a space): a row dropped (copies 0), emptied, without full stops, twice (copies 2), or of role user."""
    rows = plain(conversations)
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(name) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(fault == 4, "user").otherwise(F.col("role"))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows of each conversation together and in order, with the number of each among those of one role and text. One shuffle, by conversation."""
    here = F.col("copies") > 0
    rows = rows.select("conv_id", "turn", *[F.when(here, F.col(c)).alias(c) for c in ("role", "text")], "copies").repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "nth"]
    rows = rows.withColumn("nth", nth).sortWithinPartitions(*order)
    return rows.select("conv_id", "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "copies", "nth")


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == most or size > most_bytes:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def _mapped(rows: DataFrame, columns: str, make) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    ordered = _in_order(rows)
    shape = f"conv_id {ordered.schema['conv_id'].dataType.simpleString()}, {columns}"
    empty = rows.sparkSession.createDataFrame([], shape)
    schema = to_arrow_schema(empty.schema)
    return ordered.mapInArrow(lambda batches: _batches((r for c in _conversations(batches) for r in make(c)), schema), empty.schema)


def audit(rows: DataFrame) -> DataFrame:
    """Of rows as plain or damaged give them, per conv_id: n_turns, gaps, faults, cost and labels of the cheapest repair, digest of the repaired rows.

    Rows are taken by turn, nulls first, then role and text. A row is blank (no character but white space), else a
    duplicate (role and text of an earlier one), else truncated (its last such character is no full stop). gaps are turns
    that are lacking between the first and the last; illegal counts neighbours whose initials are not su, ua or au. A row
    whose role has another initial than s, u or a, or none, can't be kept as it is. A conversation all of whose rows are
    gone gives zeros and empty strings; rows with null conv_id are one conversation; an empty table gives no row. A
    conversation is streamed by one task, as its digest can only be taken in sequence: in memory are 13 bytes a row and
    at most 8 MB of its texts.
    """
    return _mapped(rows, REPORT, lambda c: [c.report()])


def repaired(rows: DataFrame) -> DataFrame:
    """The rows after the repair: conv_id, place (from 0), edit (keep, rerole or insert), role, text."""
    names = {KEEP: "keep", REROLE: "rerole", INSERT: "insert"}

    def make(c: _Conversation):
        for place, (label, role, text) in enumerate(c.edited()[2]):
            yield c.conv_id, place, names[label], role.decode(), text.decode()

    return _mapped(rows, "place long, edit string, role string, text string", make)
