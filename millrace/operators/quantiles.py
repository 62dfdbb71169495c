"""Exact quantiles: of n values in order, the one at place floor(q * n), counted from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the values of a quantile over all rows are dealt to.
RANGES = 64


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """keys, n, and a column for each named probability; nulls are no values, keys without values have no row.

    Equal values are counted before the shuffle, and a key's values are walked in a sort that can spill: no list is built.
    Without keys, values are dealt to RANGES ranges in order; each is walked on its own, from the number of values before it.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    if not keys:
        return _of_all(counts, probabilities)
    ordered = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = counts.withColumn("__upto", F.sum("__c").over(ordered)).withColumn("__n", F.sum("__c").over(Window.partitionBy(*keys)))
    return _picked(walked, keys, probabilities)


def _picked(walked: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    place = lambda q: F.least(F.col("__n") - 1, F.floor(F.lit(q) * F.col("__n")))
    out = walked.groupBy(*keys).agg(F.max("__n").alias("n"), *[F.min(F.when(F.col("__upto") > place(q), F.col("__v"))).alias(name) for name, q in probabilities.items()])
    return out.where("n is not null")


def _of_all(counts: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """Any edges give the right values, as ranges only have to be in order; approximate quantiles make them even."""
    edges = counts.agg(F.percentile_approx("__v", [k / RANGES for k in range(1, RANGES)]).alias("__e"))
    dealt = counts.crossJoin(F.broadcast(edges)).withColumn("__b", F.coalesce(F.size(F.filter("__e", lambda e: e < F.col("__v"))), F.lit(0))).drop("__e")
    sums = dealt.groupBy("__b").agg(F.sum("__c").alias("__s"))  # RANGES rows at most
    every = Window.partitionBy(F.lit(0)).orderBy("__b")
    before = sums.select("__b", (F.sum("__s").over(every) - F.col("__s")).alias("__before"), F.sum("__s").over(Window.partitionBy(F.lit(0))).alias("__n"))
    ordered = Window.partitionBy("__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = dealt.withColumn("__upto", F.sum("__c").over(ordered)).join(F.broadcast(before), "__b").withColumn("__upto", F.col("__upto") + F.col("__before"))
    return _picked(walked, [], probabilities)
