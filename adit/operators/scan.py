"""Ordered passes over long series in two levels, so that no task gets a whole one.

Rows are dealt by ranges of (key, order). What a range needs of the ranges before and after, their last and first rows
or their sums, is a row for each range and key, which is passed along and joined back.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adit.operators.graph import kept

PART = "range_part"


def dealt(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The rows with ``PART``, the number of their range; equal keys and orders share one. Kept, so that numbers stay."""
    return kept(rows.repartitionByRange(key, order).withColumn(PART, F.spark_partition_id()))


def _within(key: str, order: str) -> Window:
    return Window.partitionBy(PART, key).orderBy(order)


def _across(key: str) -> Window:
    return Window.partitionBy(key).orderBy(PART)


def beside(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Dealt rows with ``before`` and ``after``: order and columns of the rows next to them in their series."""
    me = F.struct(order, *columns)
    ends = rows.groupBy(key, PART).agg(F.min_by(me, order).alias("low"), F.max_by(me, order).alias("high"))
    ends = ends.select(key, PART, F.lag("high").over(_across(key)).alias("from"), F.lead("low").over(_across(key)).alias("to"))
    by = _within(key, order)
    rows = rows.join(ends, [key, PART])
    return rows.withColumn("before", F.coalesce(F.lag(me).over(by), "from")).withColumn("after", F.coalesce(F.lead(me).over(by), "to")).drop("from", "to")


def accumulated(rows: DataFrame, key: str, order: str, value: str, name: str, total: str) -> DataFrame:
    """Dealt rows with the sum of ``value`` up to themselves, and of their whole series; kept.

    A range's sum is the running sum at its last row, so that sums go on from range to range without a step.
    """
    rows = kept(rows.withColumn(name, F.sum(value).over(_within(key, order).rowsBetween(Window.unboundedPreceding, 0))))
    sums = rows.groupBy(key, PART).agg(F.max_by(name, order).alias("v"))
    base = F.coalesce(F.sum("v").over(_across(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = kept(sums.select(key, PART, base.alias("base"), F.sum("v").over(_across(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total)))
    return rows.join(sums, [key, PART]).withColumn(name, F.col("base") + F.col(name)).drop("base")


def carried(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Dealt rows with ``before`` and ``after``: the last ``value`` that is not null at or before their order, and the first at or after it."""
    there = F.when(F.col(value).isNotNull(), F.col(order))
    ends = rows.groupBy(key, PART).agg(F.min_by(value, there).alias("low"), F.max_by(value, there).alias("high"))
    last, first = F.last("high", True).over(_across(key).rowsBetween(Window.unboundedPreceding, -1)), F.first("low", True).over(_across(key).rowsBetween(1, Window.unboundedFollowing))
    ends = ends.select(key, PART, last.alias("from"), first.alias("to"))
    by = _within(key, order)
    before, after = F.last(value, True).over(by.rangeBetween(Window.unboundedPreceding, 0)), F.first(value, True).over(by.rangeBetween(0, Window.unboundedFollowing))
    return rows.join(ends, [key, PART]).withColumn("before", F.coalesce(before, "from")).withColumn("after", F.coalesce(after, "to")).drop("from", "to")
