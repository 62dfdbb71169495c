"""Bronze rows from landed files, and sinks that replace a table as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import latest_by_key


class StaleSnapshot(ValueError):
    """A snapshot that would take a table back."""


def read_landed(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    """Rows of landed JSON lines, CSV or Parquet files in one schema: columns that a file lacks are null, others are left out."""
    reader = spark.read.schema(schema)
    if form == "csv":
        return reader.option("header", True).option("enforceSchema", False).csv(path)
    if form not in ("json", "parquet"):
        raise ValueError(f"no landed files are called {form}")
    return reader.format(form).load(path)


def promote(raw: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """One row for each natural key of rows that came in over and over."""
    return latest_by_key(raw, keys, version)


def write_serving(df: DataFrame, path: str, date: str, order: list[str]) -> None:
    """A table partitioned by month, its rows in order within files, so that readers skip months and row groups."""
    months = df.withColumn("ym", F.date_format(date, "yyyy-MM"))
    months.repartition("ym", F.pmod(F.xxhash64(*order), F.lit(16))).sortWithinPartitions("ym", *order).write.mode("overwrite").partitionBy("ym").parquet(path)


def read_serving(spark: SparkSession, path: str, date: str, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Rows of such a table; months outside the dates aren't listed for reading."""
    out = spark.read.parquet(path)
    for bound, op in ((date_from, ">="), (date_to, "<=")):
        if bound:
            out = out.where(f"ym {op} '{bound[:7]}' and {date} {op} date'{bound}'")
    return out.drop("ym")


def swap_snapshot(df: DataFrame, table: str, taken_at: str, least_share: float = 0.5) -> None:
    """Replace what a name stands for by a full copy, which may be neither older nor far smaller.

    The name is a view of the catalog, and the copy a table of its own: it is written and checked first, then the view is
    replaced in one step, so there is a whole copy at any time. The table before is dropped after that.
    """
    spark, new = df.sparkSession, f"{table}_{uuid.uuid4().hex[:8]}"
    df.withColumn("taken_at", F.lit(taken_at)).write.saveAsTable(new)
    try:
        old_table = None
        if spark.catalog.tableExists(table):
            old = spark.table(table).agg(F.max("taken_at").alias("at"), F.count("*").alias("n")).first()
            if old["at"] is not None and old["at"] > taken_at:
                raise StaleSnapshot(f"{table} is of {old['at']}")
            if spark.table(new).count() < least_share * old["n"]:
                raise StaleSnapshot(f"the new {table} has lost too many rows")
            shown = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
            old_table = next((p.strip("` ") for p in shown.get("View Text", "").split(" FROM ")[1:]), None)
        spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM {new}")
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {new}")
        raise
    if old_table:
        spark.sql(f"DROP TABLE IF EXISTS {old_table}")
