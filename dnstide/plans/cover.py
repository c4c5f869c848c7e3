"""Sums over any range of hours from few stored nodes: counts kept at dyadic levels, and ranges covered minimally.

A node of level L and number i holds the counts of the hours ``i * 2 ** L`` up to ``(i + 1) * 2 ** L``, hours counted
since 1970. A range of n hours is at most 2 log2 n nodes, whose partitions alone are read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnstide.functions.stamps import bound, time_of
from dnstide.operators.rates import HOUR

#: Levels above the hours: the top one spans 1024 hours.
LEVELS = 10
#: Nodes of a level that share a folder, as a power of two; within it files are sorted by node.
SHARED = 4


def hour_number(stamp: Column) -> Column:
    """The hour that ends at a stamp of hourly rows."""
    return (F.unix_seconds(time_of(stamp)) / HOUR).cast("bigint") - 1


def write_levels(hourly: DataFrame, path: str, levels: int = LEVELS) -> None:
    """Store the whole ``hourly(kind, view, stamp, item, query_num)`` at all levels: each level adds up the one below
    it, in one job a level."""
    spark = hourly.sparkSession
    rows = hourly.groupBy("kind", "view", "item", hour_number(F.col("stamp")).alias("node")).agg(F.sum("query_num").alias("query_num"))
    for level in range(levels + 1):
        at = f"{path}/level={level}"
        block = F.shiftright("node", SHARED)
        rows.withColumn("block", block).hint("rebalance", "block").sortWithinPartitions("block", "node", "view").write.mode("overwrite").partitionBy("block").parquet(at)
        below = spark.read.parquet(at).drop("block")
        rows = below.groupBy("kind", "view", "item", F.shiftright("node", 1).alias("node")).agg(F.sum("query_num").alias("query_num"))


def cover(first: int, end: int, levels: int = LEVELS) -> list[tuple[int, int]]:
    """The fewest nodes ``(level, node)`` that hold the hours ``first`` up to ``end`` and no other, in order of time."""
    left, right, level = [], [], 0
    while first < end:
        if level == levels:
            return left + [(level, n) for n in range(first, end)] + right[::-1]
        if first & 1:
            left.append((level, first))
            first += 1
        if end & 1:
            end -= 1
            right.append((level, end))
        first, end, level = first >> 1, end >> 1, level + 1
    return left + right[::-1]


def hours_of(start: str, end: str) -> tuple[int, int]:
    """The numbers of the hours whose rows have stamps from ``start`` up to ``end``."""
    since = lambda s: int((bound(s) - bound("19700101000000")).total_seconds())
    return -(-since(start) // HOUR) - 1, -(-since(end) // HOUR) - 1


def range_sums(spark: SparkSession, path: str, view: str, start: str, end: str) -> DataFrame:
    """``kind, item, query_num`` of one view over ``start <= stamp < end``, from the nodes that cover it."""
    nodes = cover(*hours_of(start, end))
    rows = spark.read.option("basePath", path).parquet(path)
    by_level: dict[int, list[int]] = {}
    for level, node in nodes:
        by_level.setdefault(level, []).append(node)
    here = [(F.col("level") == level) & F.col("block").isin(sorted({n >> SHARED for n in own})) & F.col("node").isin(own) for level, own in by_level.items()]
    met = rows.where((F.col("view") == view) & reduce(Column.__or__, here, F.lit(False)))
    return met.groupBy("kind", "item").agg(F.sum("query_num").alias("query_num"))
