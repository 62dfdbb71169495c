"""Issue histories: change events replayed against the current state, and what follows from them.

An event is a row issue_id, field_id, event_at, event_id, author_id, kind, multi, before, after: kind is set, snapshot, add
or remove, multi tells whether the field holds several values, before and after are arrays of struct<id, display>. States are
kept as the intervals in which values stay in a field, found by windows; all of it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import saved

VALUES = "array<struct<id:string,display:string>>"
SEPARATOR = ", "


def _none() -> Column:
    return F.array().cast(VALUES)


def parse_items(items: DataFrame) -> DataFrame:
    """Events of changelog items: from_id, from_text, to_id, to_text and multi become kind, before and after.

    A field with one value is set. A field with several adds or removes one; where a side's text is a list, it is the old
    form that gives both whole lists. Items of such a field without an id on either side are dropped.
    """
    pair = lambda i, t: F.when(F.col(i).isNotNull(), F.array(F.struct(F.col(i).alias("id"), F.coalesce(t, i).alias("display")))).otherwise(_none())
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), SEPARATOR), F.trim), lambda x: x != "")

    def listed(i, t):
        ids = split(F.col(i))
        return F.transform(split(F.col(t)), lambda d, k: F.struct(F.coalesce(F.get(ids, k), d).alias("id"), d.alias("display")))

    old_form = F.coalesce(F.contains("from_text", F.lit(SEPARATOR)), F.lit(False)) | F.coalesce(F.contains("to_text", F.lit(SEPARATOR)), F.lit(False))
    kind = F.when(~F.col("multi"), "set").when(old_form, "snapshot").when(F.col("to_id").isNotNull(), "add").when(F.col("from_id").isNotNull(), "remove")
    out = items.withColumn("kind", kind).where("kind is not null")
    lists = F.col("kind") == "snapshot"
    out = out.withColumn("before", F.when(lists, listed("from_id", "from_text")).otherwise(pair("from_id", "from_text")).cast(VALUES))
    return out.withColumn("after", F.when(lists, listed("to_id", "to_text")).otherwise(pair("to_id", "to_text")).cast(VALUES)).drop("from_id", "from_text", "to_id", "to_text")


LINE = ["issue_id", "field_id"]
#: Positions of a timeline that one row is repeated over at once.
_BLOCK = 4096


def _numbered(events: DataFrame) -> DataFrame:
    """events with pos, their place in the timeline from 1, and whether it is the last one."""
    line = Window.partitionBy(*LINE).orderBy("event_at", "event_id", "author_id", "kind", "multi", "before", "after")
    return events.withColumns({"pos": F.row_number().over(line).cast("long"), "last": F.lead(F.lit(False), 1, True).over(line)})


def _first(values: str) -> Column:
    return F.filter(F.slice(values, 1, 1), lambda x: x.isNotNull())


def _changes(numbered: DataFrame, back: bool = False) -> DataFrame:
    """issue_id, field_id, pos, reset, put, gone of events: what each puts in and takes out, after all else has gone if it resets. back: of undoing them, in that order.

    Whatever a field with one value gets replaces it, and adding or removing is undone there to nothing.
    """
    old, new, puts, takes = ("after", "before", "remove", "add") if back else ("before", "after", "add", "remove")
    whole = F.col("kind").isin("set", "snapshot")
    single = F.when((F.col("kind") == puts) & F.lit(not back), _first(new)).otherwise(_none())
    put = F.when(whole, F.col(new)).when(~F.col("multi"), single).when(F.col("kind") == puts, _first(new)).otherwise(_none())
    gone = F.when(~whole & F.col("multi") & (F.col("kind") == takes), F.get(old, F.lit(0))["id"])
    return numbered.select(*LINE, (-F.col("pos") if back else F.col("pos")).alias("pos"), (whole | ~F.col("multi")).alias("reset"), put.cast(VALUES).alias("put"), gone.alias("gone"))


def memberships(changes: DataFrame) -> DataFrame:
    """Timelines as intervals: issue_id, field_id, id, display, since, place, until for each stay of a value in a field.

    changes: issue_id, field_id, pos, reset, put, gone. A value stays from the change `since` that put it in, at `place` among
    those of that change, until the first one that takes it out or resets the field (null: to this day); putting it in
    again meanwhile changes nothing. A value's last change before a position tells whether it is there, so all is two windows
    over as many rows as there are values put in and taken out, whatever the size of the sets.
    """
    line = Window.partitionBy(*LINE).orderBy("pos")
    later = Window.partitionBy(*LINE).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    rows = changes.withColumn("epoch", F.sum(F.col("reset").cast("long")).over(line)).withColumn("over", F.min(F.when(F.col("reset"), F.col("pos"))).over(later))
    keys = [*LINE, "epoch", "pos", "over", "reset"]
    put = rows.select(*keys, F.posexplode("put").alias("place", "x")).select(*keys, "place", "x.id", "x.display", F.lit(True).alias("here"))
    gone = rows.where("gone is not null").select(*keys, F.lit(0).alias("place"), F.col("gone").alias("id"), F.lit(None).cast("string").alias("display"), F.lit(False).alias("here"))
    own = Window.partitionBy(*LINE, "epoch", "id")
    after = own.orderBy(F.desc("pos"), F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    rows = put.unionByName(gone).withColumn("was", F.lag("here").over(own.orderBy("pos", "place"))).withColumn("out", F.min(F.when(~F.col("here"), F.col("pos"))).over(after))
    starts = F.col("here") & (F.col("reset") | F.col("was").isNull() | ~F.col("was"))
    return rows.where(starts).select(*LINE, "id", "display", F.col("pos").alias("since"), "place", F.coalesce("out", "over").alias("until"))


def _values(members: DataFrame, *keys: str) -> DataFrame:
    """keys and value: the members of each key as one list, in the order in which they came in."""
    listed = F.array_sort(F.collect_list(F.struct("since", "place", "id", "display")))
    return members.groupBy(*keys).agg(F.transform(listed, lambda x: F.struct(x["id"].alias("id"), x["display"].alias("display"))).cast(VALUES).alias("value"))


def _base(values: DataFrame, pos: Column) -> DataFrame:
    """The change that a timeline begins with, of issue_id, field_id, value."""
    return values.select(*LINE, pos.cast("long").alias("pos"), F.lit(True).alias("reset"), F.coalesce(F.col("value").cast(VALUES), _none()).alias("put"), F.lit(None).cast("string").alias("gone"))


def _history(numbered: DataFrame, start: DataFrame) -> DataFrame:
    """Events with the state after each, from a first state (issue_id, field_id, value) on: as many rows as all states have values."""
    ends = numbered.where("last").select(*LINE, (F.col("pos") + 1).alias("pos"), F.lit(True).alias("reset"), _none().alias("put"), F.lit(None).cast("string").alias("gone"))
    stays = memberships(_base(start, F.lit(0)).unionByName(_changes(numbered)).unionByName(ends))
    spans = stays.withColumn("since_", F.greatest("since", F.lit(1).cast("long"))).withColumn("until_", F.col("until") - 1).where("since_ <= until_")
    blocks = spans.withColumn("b", F.explode(F.sequence(F.floor(F.col("since_") / _BLOCK), F.floor(F.col("until_") / _BLOCK))))
    inside = F.sequence(F.greatest("since_", F.col("b") * _BLOCK), F.least("until_", F.col("b") * _BLOCK + (_BLOCK - 1)))
    states = _values(blocks.withColumn("pos", F.explode(inside)), *LINE, "pos")
    return numbered.join(states, [*LINE, "pos"], "left").select(
        *LINE, F.lit("changelog").alias("event_kind"), F.lit(0).alias("seq"), "event_at", "event_id", "author_id", F.col("kind").alias("delta_action"), F.coalesce("value", _none()).alias("value"),
    )


def initial_values(current: DataFrame, numbered: DataFrame) -> DataFrame:
    """issue_id, field_id, value before the first event: all events undone from the current value, the last one first."""
    far = F.lit(-(1 << 62))
    left = memberships(_base(current, far).unionByName(_changes(numbered, back=True))).where("until is null")
    lines = current.select(*LINE).unionByName(numbered.where("last").select(*LINE)).distinct()
    return lines.join(_values(left, *LINE), LINE, "left").withColumn("value", F.coalesce("value", _none()))


def replay(issues: DataFrame, current: DataFrame, events: DataFrame) -> DataFrame:
    """The whole history of issues: issue_id, field_id, event_kind, seq, event_at, event_id, author_id, delta_action, value.

    issues: issue_id, created_at, reporter_id. current: issue_id, field_id, value (array) for each field. First comes the
    marker of creation (field `created`, seq 0), then the initial value of each field, found by taking its events back from
    the current one (seq from 1, by field), then the events with the state after each. No row holds more than one state.
    """
    known = issues.select("issue_id")
    numbered = saved(_numbered(events.join(known, "issue_id", "left_semi")), "events")
    current = current.select(*LINE, F.col("value").cast(VALUES).alias("value")).join(known, "issue_id", "left_semi")
    start = saved(initial_values(current, numbered), "initial")
    fields = start.withColumn("seq", F.row_number().over(Window.partitionBy("issue_id").orderBy("field_id"))).join(issues, "issue_id")
    marker = issues.withColumns({"field_id": F.lit("created"), "value": _none(), "seq": F.lit(0)}).join(start.select("issue_id").distinct(), "issue_id", "left_semi")
    initial = fields.unionByName(marker, allowMissingColumns=True).select(
        *LINE, F.lit("synthetic_initial").alias("event_kind"), "seq", F.col("created_at").alias("event_at"), F.lit(None).cast("string").alias("event_id"), F.col("reporter_id").alias("author_id"), F.lit("set").alias("delta_action"), "value",
    )
    return initial.unionByName(_history(numbered, start))


def replay_new(last: DataFrame, events: DataFrame) -> DataFrame:
    """The events after what is known of each issue, on its last state: issue_id, field_id, value, last_event_at. No initial rows."""
    mark = last.groupBy("issue_id").agg(F.max("last_event_at").alias("mark"))
    new = events.join(mark, "issue_id").where("event_at > mark").drop("mark")
    return _history(_numbered(new), last.select(*LINE, "value"))


def issue_state(history: DataFrame, status_category: DataFrame) -> DataFrame:
    """issue_id, created_at, status_id, status_category, final_close_at: the last status, and when it went into a done one, if it is in one.

    history is that of the status field, from replay; status_category: status_id, status_category.
    """
    h = history.where("event_kind = 'changelog' or event_kind = 'synthetic_initial'").withColumn("status_id", F.get("value", F.lit(0))["id"]).join(status_category, "status_id", "left")
    order = F.struct("event_at", F.coalesce("event_id", F.lit("")))
    out = h.groupBy("issue_id").agg(
        F.min(F.when(F.col("event_kind") == "synthetic_initial", F.col("event_at"))).alias("created_at"), F.max_by("status_id", order).alias("status_id"), F.max_by("status_category", order).alias("status_category"),
        F.max(F.when((F.col("status_category") == "done"), F.col("event_at"))).alias("closed_at"),
    )
    return out.withColumn("final_close_at", F.when(F.col("status_category") == "done", F.col("closed_at"))).drop("closed_at")
