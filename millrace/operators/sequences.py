"""Operators over ordered events: sessions, spans, steps, transitions, day slices, interval overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import saved


def sessionize(df: DataFrame, keys: list[str], time: str, tie: str, gap_seconds: int, session: str = "session") -> DataFrame:
    """df with the number of the session, from 1: an event opens one if it comes more than the gap after the one before."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    gap = F.unix_micros(time) - F.unix_micros(F.lag(time).over(w))
    opens = F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0)
    return df.withColumn("__open", opens).withColumn(session, F.sum("__open").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__open")


def spans(df: DataFrame, keys: list[str], time: str, tie: str, state: str, last_end: Column) -> DataFrame:
    """keys, state, span_start, span_end, duration_seconds: each event's state until the next one, the last until last_end."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    end = F.coalesce(F.lead(time).over(w), last_end)
    seconds = F.greatest(F.lit(0.0), (F.unix_micros("span_end") - F.unix_micros("span_start")) / 1e6)
    out = df.select(*keys, F.col(state), F.col(time).alias("span_start"), end.alias("span_end"))
    return out.where("span_end >= span_start").withColumn("duration_seconds", seconds)


def by_day(df: DataFrame, start: str = "span_start", end: str = "span_end") -> DataFrame:
    """A row for each calendar day that a span touches: day and the seconds of the span within it."""
    days = df.where(F.col(end) >= F.col(start)).withColumn("day", F.explode(F.sequence(F.to_date(start), F.to_date(end))))
    midnight = F.col("day").cast("timestamp")
    from_, to = F.greatest(F.col(start).cast("timestamp"), midnight), F.least(F.col(end).cast("timestamp"), midnight + F.expr("INTERVAL 1 DAY"))
    return days.withColumn("seconds", F.greatest(F.lit(0.0), (F.unix_micros(to) - F.unix_micros(from_)) / 1e6))


def cumulative_steps(df: DataFrame, keys: list[str], order: str, reading: str, first_from: Column | None = None) -> DataFrame:
    """df with corrected (no later reading is smaller), step (its growth) and covers_days (days since the reading before).

    The steps of a period are never negative and add up to its last reading. first_from is the day before the period.
    """
    ahead = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # backwards: a frame that only grows
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumn("corrected", F.min(reading).over(ahead)).withColumn("step", F.col("corrected") - F.coalesce(F.lag("corrected").over(w), F.lit(0)))
    before = F.lag(order).over(w) if first_from is None else F.coalesce(F.lag(order).over(w), first_from)
    return out.withColumn("covers_days", F.datediff(order, before))


def next_within(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, days: int, out: str) -> DataFrame:
    """left with the first time of right on the same key that comes after left_time and within so many days, else null.

    Both sides' rows are put in one order by time, and each takes the next of right's times: as many rows as both have, no pairs.
    """
    own = left.select(*keys, F.col(left_time).alias("__t"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__l"), F.lit(None).cast("timestamp").alias("__r"))
    other = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("__t"), F.lit(None).cast(own.schema["__l"].dataType).alias("__l"), F.col(right_time).cast("timestamp").alias("__r"))
    after = Window.partitionBy(*keys).orderBy(F.desc(F.unix_micros(F.col("__t").cast("timestamp")))).rangeBetween(Window.unboundedPreceding, -1)  # backwards: a frame that only grows
    found = own.unionByName(other).withColumn("__r", F.min("__r").over(after)).where("__l is not null")
    soon = F.when(F.col("__r") <= F.col("__t").cast("timestamp") + F.expr(f"INTERVAL {days} DAY"), F.col("__r"))
    return found.select("__l.*", soon.alias(out))


def overlapping(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows whose half-open interval [start, end) begins before an earlier one of its key has ended: with covered_until, the latest end before it.

    An open end is null, and covers all that comes after.
    """
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("covered_until", F.max(end).over(before)).withColumn("__open", F.max(F.col(end).isNull()).over(before))
    return out.where((F.col("covered_until") > F.col(start)) | F.col("__open")).withColumn("covered_until", F.when(~F.col("__open"), F.col("covered_until"))).drop("__open")


def running_total(df: DataFrame, order: list[str], amount: Column, total: str, place: str, ranges: int = 64) -> DataFrame:
    """df with `total`, the sum of amount over all rows up to this one in an order (ties are broken at will), and `place`, its number from 1.

    Rows are dealt to ranges in order; each is summed on its own, from what the ranges before it hold, so no task sees all.
    """
    own = saved(df.withColumn("__amount", amount).repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    every = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    sums = own.groupBy("__range").agg(F.sum("__amount").alias("s"), F.count("*").alias("n"))
    before = sums.select("__range", F.coalesce(F.sum("s").over(every), F.lit(0)).alias("__s"), F.coalesce(F.sum("n").over(every), F.lit(0)).alias("__n"))
    upto = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = own.withColumns({total: F.sum("__amount").over(upto), place: F.row_number().over(upto)}).join(F.broadcast(before), "__range")  # `ranges` rows
    return walked.withColumns({total: F.col(total) + F.col("__s"), place: F.col(place) + F.col("__n")}).drop("__range", "__amount", "__s", "__n")


#: Width of the stretches of time in which interval ends are ranked, in microseconds; ranks that one row is repeated over at once.
STRETCH, _BLOCK = 86_400_000_000, 4096
_FAR = 1 << 62


def _counted(points: DataFrame, probes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """points (keys, x, id) with `rank` among those of their keys, from 1; probes (keys, x, id, side, late) with `below`, the points before x, or up to x if late.

    Points and probes are walked in one order within a stretch of time, from the number of points in the stretches before: a
    key with very many is shared by many tasks.
    """
    rows = points.select(*keys, "x", "id", F.lit(None).cast("int").alias("side"), F.lit(1).alias("turn"))
    rows = rows.unionByName(probes.select(*keys, "x", "id", "side", F.when(F.col("late"), 2).otherwise(0).alias("turn")))
    rows = rows.withColumn("stretch", F.floor(F.col("x") / STRETCH)).withColumn("one", (F.col("turn") == 1).cast("long"))
    before = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    stretches = rows.groupBy(*keys, "stretch").agg(F.sum("one").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0))).drop("s")
    upto = Window.partitionBy(*keys, "stretch").orderBy("x", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.withColumn("n", F.sum("one").over(upto)).join(stretches, [*keys, "stretch"]).withColumn("n", F.col("n") + F.col("before"))
    return ranked.where("turn = 1").select(*keys, "id", F.col("n").alias("rank")), ranked.where("turn <> 1").select(*keys, "id", "side", F.col("n").alias("below"))


def _starting_inside(outer: DataFrame, inner: DataFrame, keys: list[str]) -> DataFrame:
    """keys, outer_id, inner_id: pairs on a key where the inner interval begins within the outer one, at its very start only if not `late`. outer: keys, s, e (microseconds), id, late; inner: keys, s, id."""
    ends = F.array(F.struct(F.col("s").alias("x"), F.lit(0).alias("side"), F.col("late")), F.struct(F.col("e").alias("x"), F.lit(1).alias("side"), F.lit(False).alias("late")))
    points, probes = _counted(inner.select(*keys, F.col("s").alias("x"), "id"), outer.select(*keys, "id", F.inline(ends)), keys)
    ranges = probes.groupBy(*keys, "id").agg((F.max(F.when(F.col("side") == 0, F.col("below"))) + 1).alias("lo"), F.max(F.when(F.col("side") == 1, F.col("below"))).alias("hi")).where("lo <= hi")
    blocks = ranges.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / _BLOCK), F.floor(F.col("hi") / _BLOCK))))
    inside = F.sequence(F.greatest("lo", F.col("b") * _BLOCK), F.least("hi", F.col("b") * _BLOCK + (_BLOCK - 1)))
    wanted = blocks.select(*keys, F.col("id").alias("outer_id"), F.explode(inside).alias("rank"))
    return wanted.join(points.withColumnRenamed("id", "inner_id"), [*keys, "rank"]).select(*keys, "outer_id", "inner_id")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs on a key whose half-open intervals overlap, with overlap_start and overlap_end. An open end is null; one without a start is in no pair.

    Two intervals overlap where one begins within the other. The starts of either side are ranked within their key, so those
    inside an interval are a range of ranks, and pairs are found by key and rank: rows grow with the intervals and with the
    pairs that there are, and no key is one task's work.
    """
    (a, b), (c, d) = left_span, right_span
    micros = lambda x: F.unix_micros(F.col(x).cast("timestamp"))

    def numbered(df: DataFrame, start: str, end: str, name: str) -> tuple[DataFrame, DataFrame]:
        own = saved(df.where(F.col(start).isNotNull()).withColumn("__id", F.monotonically_increasing_id()), name)
        known = own.where(" and ".join(f"`{k}` is not null" for k in keys))
        return own, known.select(*keys, micros(start).alias("s"), F.coalesce(micros(end), F.lit(_FAR)).alias("e"), F.col("__id").alias("id"))

    (l_rows, l_spans), (r_rows, r_spans) = numbered(left, a, b, "left"), numbered(right, c, d, "right")
    way = lambda df, left_is_inner: df.withColumn("__inner", F.lit(left_is_inner))  # noqa: E731  both ways in one pass
    outer = way(r_spans, True).withColumn("late", F.lit(False)).unionByName(way(l_spans, False).withColumn("late", F.lit(True)))
    found = _starting_inside(outer, way(l_spans, True).unionByName(way(r_spans, False)), [*keys, "__inner"])
    pairs = found.select(F.when(F.col("__inner"), F.col("inner_id")).otherwise(F.col("outer_id")).alias("__l"), F.when(F.col("__inner"), F.col("outer_id")).otherwise(F.col("inner_id")).alias("__r"))
    joined = pairs.join(l_rows.withColumnRenamed("__id", "__l"), "__l").join(r_rows.withColumnRenamed("__id", "__r").drop(*keys), "__r").drop("__l", "__r")
    joined = joined.where(((F.col(d).isNull()) | (F.col(a) < F.col(d))) & ((F.col(b).isNull()) | (F.col(c) < F.col(b))))
    order = [*keys, *[x for x in left.columns if x not in keys], *[x for x in right.columns if x not in keys]]
    return joined.select(*order).withColumn("overlap_start", F.greatest(a, c)).withColumn("overlap_end", F.least(b, d))
