"""Usage events: beacons of records become rows, with shared fields, clipped texts and corrected times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Most records of a beacon; the longest that a record may have waited; longest texts.
RECORDS, WAIT_MS, NAME, PATH = 200, 24 * 60 * 60 * 1000, 64, 512
_RECORD = "struct<event_name:string,path:string,target:string,session_id:string,app_name:string,app_version:string,time_triggered:bigint,time_sent:bigint>"
SCHEMA = f"tenant_id string, person_id string, arrival timestamp, meta {_RECORD}, records array<{_RECORD}>"


def event_time(triggered: Column, sent: Column, arrival: Column) -> Column:
    """Arrival less the time that the record waited. Both stamps come from one clock that may be wrong; a wait that can't be is no wait."""
    wait = sent - triggered
    return F.when((wait >= 0) & (wait <= WAIT_MS), F.timestamp_millis(F.unix_millis(arrival) - wait)).otherwise(arrival)


def usage_rows(beacons: DataFrame) -> DataFrame:
    """Rows of beacons (SCHEMA), batch or stream. What a record lacks it has from meta; page views without a path are dropped."""
    r = beacons.select("tenant_id", "person_id", "arrival", "meta", F.explode(F.slice("records", 1, RECORDS)).alias("r"))
    own = lambda c: F.coalesce(F.col(f"r.{c}"), F.col(f"meta.{c}"))
    text = lambda c, n: F.left(F.coalesce(own(c), F.lit("")), F.lit(n)).alias(c)
    out = r.select(
        event_time(own("time_triggered"), own("time_sent"), F.col("arrival")).alias("event_time"), "tenant_id", "person_id", text("session_id", NAME), text("event_name", NAME), text("path", PATH), text("target", PATH), text("app_name", NAME), text("app_version", NAME),
    )
    return out.where("event_name <> '' and not (event_name = 'page_view' and path = '')")


def ingest(beacons: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append the rows of a stream of beacons to a table partitioned by month; without `every`, take what is there and end."""
    rows = usage_rows(beacons).withColumn("ym", F.date_format("event_time", "yyyy-MM"))
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("ym")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def sessions(events: DataFrame, keys: list[str], time: str, gap_seconds: int, late: str = "3 days") -> DataFrame:
    """keys, session_start, session_end, events: for streams, sessions come out once the watermark has passed them.

    An event at the gap exactly stays in its session, as in the batch operator: windows last a microsecond more than the gap.
    """
    gap = F.session_window(time, F.lit(f"{gap_seconds} seconds 1 microsecond"))
    out = events.withWatermark(time, late).groupBy(*keys, gap.alias("w")).agg(F.count("*").alias("events"), F.min(time).alias("session_start"), F.max(time).alias("session_end"))
    return out.select(*keys, "session_start", "session_end", "events")


def latest_per_key(stream: DataFrame, path: str, checkpoint: str, keys: list[str], version: list[str]) -> StreamingQuery:
    """Keep a table of the latest row of each key: each batch is merged with what is there into a new version, named by its number."""
    from ..operators.dedup import latest_by_key

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = f"{path}/v={number - 1}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(old)
        known = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(old)) if known else batch
        latest_by_key(rows, keys, version).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
