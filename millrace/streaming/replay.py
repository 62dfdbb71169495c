"""Issue histories from a stream of change events, with the last state of each field kept between batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.issues import LINE

#: The kind of an event that tells what is known of a field (value in `after`) without being a change.
SEED = "seed"
OUTPUT = "issue_id string, field_id string, event_at long, event_id string, author_id string, delta_action string, value array<struct<id: string, display: string>>"
_FIELDS = [c.split()[0] for c in OUTPUT.split(", value")[0].split(", ")]
_STATE = "body string"
#: Rows of one frame at most.
_ROWS = 10_000


def _after(state: list[list[str]], kind: str, multi: bool, before: list, after: list) -> list[list[str]]:
    if kind not in ("add", "remove"):
        return after
    if kind == "add":
        return after[:1] if not multi else state if any(x[0] == after[0][0] for x in state) else state + after[:1]
    return [x for x in state if x[0] != before[0][0]] if multi else []


def _passed(line: list, passed: int) -> Iterator[tuple]:
    """The events of a line (value, what a seed knows, time of the last event, waiting ones) that have passed, in order, with the value after each; they wait no more."""
    waiting = line[3]
    waiting.sort(key=lambda e: [(x is not None, x) for x in e[:3]])
    due = [e for e in waiting if e[0] <= passed]
    line[1] = max([e[0] for e in waiting if e[3] == SEED] + ([] if line[1] is None else [line[1]]), default=None)
    line[3] = waiting[len(due) :]
    for at, event_id, author, kind, multi, before, after in due:
        if (kind == SEED and at < line[2]) or (kind != SEED and line[1] is not None and at <= line[1]):
            continue  # the seed is older than what has been seen, or a seed knows of the event
        line[0], line[2] = _after(line[0], kind, multi, before, after), at
        if kind != SEED:
            yield at, event_id, author, kind, line[0]


def _step(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState, keep_ms: int | None) -> Iterator[pd.DataFrame]:
    """The events of one bucket's fields that the watermark has passed, each field's in order, as JSON of OUTPUT; later ones wait in the state.

    The state has for each field its value, what a seed knows, the time of its last event, those that wait, and when it is forgotten.
    """
    lines = {(issue, field): line for issue, field, *line in (json.loads(state.get[0]) if state.exists else [])}
    now, fed, out = state.getCurrentWatermarkMs(), set(), []
    for frame in frames:
        for issue, field, *event in json.loads("[" + ",".join(frame["body"]) + "]"):
            lines.setdefault((issue, field), [[], None, 0, [], None])[3].append(event)
            fed.add((issue, field))
    for name, line in list(lines.items()):
        if name in fed or (line[3] and line[3][0][0] <= now * 1000):
            for *event, value in _passed(line, now * 1000):
                row = dict(zip(_FIELDS, (*name, *event), strict=True))
                out.append(json.dumps(row | {"value": [{"id": x[0], "display": x[1]} for x in value]}))
                if len(out) == _ROWS:
                    yield pd.DataFrame({"row": out})
                    out = []
            line[4] = max(line[2] // 1000, now) + keep_ms if keep_ms is not None and not line[3] else None
        elif line[4] is not None and line[4] < now:
            del lines[name]
    if not lines:
        state.remove()
    else:
        state.update((json.dumps([[*name, *line] for name, line in lines.items()]),))
        if wake := [x for line in lines.values() for x in ([max(line[3][0][0] // 1000, now) + 1] if line[3] else [line[4]]) if x is not None]:
            state.setTimeoutTimestamp(max(min(wake), now))
    if out:
        yield pd.DataFrame({"row": out})


def replay_stream(events: DataFrame, lateness: str = "1 day", keep_ms: int | None = None, buckets: int = 4096) -> DataFrame:
    """Events (as operators.issues takes them) of a stream with the state after each, as replay gives it from an empty first state.

    However the events are cut into batches and whatever their order, they come out in the order of their times, once the
    watermark has passed them; one that is later than `lateness` is dropped. An event of kind `seed` sets a field to
    `after` as of its time: what is not newer than it is known, and comes out no more. A field keeps its last state until no
    event has come for keep_ms of event time (None: for ever); after that it begins from nothing, or from a seed.
    In the state are a field's values and its events within the lateness. What Spark does for a group of each batch costs some
    milliseconds, whatever is in it, so fields are dealt to `buckets` groups by a hash; a group that gets an event is read and
    written whole. More fields want more buckets; a query that goes on from a checkpoint has to keep their number.
    """
    pairs = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: F.array(x["id"], x["display"]))
    quoted = lambda c: F.coalesce(F.to_json(F.array(F.col(c).cast("string"))), F.lit("[null]"))
    item = lambda c: F.expr(f"substring({{0}}, 2, length({{0}}) - 2)".replace("{0}", c))
    cols = events.withColumns({"__issue": quoted("issue_id"), "__field": quoted("field_id"), "__id": quoted("event_id"), "__author": quoted("author_id"), "__kind": quoted("kind")})
    body = F.concat(
        F.lit("["), item("__issue"), F.lit(","), item("__field"), F.lit(","), F.unix_micros("event_at").cast("string"), F.lit(","), item("__id"), F.lit(","), item("__author"), F.lit(","), item("__kind"), F.lit(","), F.when(F.col("multi"), "true").otherwise("false"), F.lit(","),
        F.to_json(pairs(F.col("before"))), F.lit(","), F.to_json(pairs(F.col("after"))), F.lit("]"),
    )
    rows = cols.select(F.pmod(F.xxhash64(*LINE), F.lit(buckets)).alias("bucket"), "event_at", body.alias("body")).withWatermark("event_at", lateness)
    out = rows.groupBy("bucket").applyInPandasWithState(lambda key, frames, state: _step(key, frames, state, keep_ms), "row string", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    row = out.select(F.from_json("row", OUTPUT).alias("x")).select("x.*")
    return row.select(*LINE, F.lit("changelog").alias("event_kind"), F.lit(0).alias("seq"), F.timestamp_micros("event_at").alias("event_at"), "event_id", "author_id", "delta_action", "value")


def write_history(events: DataFrame, path: str, checkpoint: str, lateness: str = "1 day", keep_ms: int | None = None, buckets: int = 4096) -> StreamingQuery:
    """Append what replay_stream gives to a table of files; a query that is started again goes on from its checkpoint."""
    out = replay_stream(events, lateness, keep_ms, buckets)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
