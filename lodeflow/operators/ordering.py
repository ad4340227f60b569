"""A total order over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import settle


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before each in ``order``, 0 for the first. Rows are dealt by ranges, equal ones together, and summed within
    their range; what comes before a range is a sum over ranges, one row each. Rows that are equal in ``order`` follow each other in any way."""
    dealt = settle(df.withColumn("value_", value).repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    sums = dealt.groupBy("range_").agg(F.sum("value_").alias("sum_"))
    upto = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    starts = sums.select("range_", F.coalesce(F.sum("sum_").over(upto), F.lit(0)).alias("start_"))
    within = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(starts), "range_").withColumn(name, F.col("start_") + F.coalesce(F.sum("value_").over(within), F.lit(0))).drop("value_", "range_", "start_")
