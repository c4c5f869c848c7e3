"""Heavy hitters with bounds: mergeable summaries of ``n`` counters a group, for ranges whose whole counts aren't kept.

A summary's row of a name has ``lower``, what is known of its count, and a counter ``over``; rows without a name hold in
``over`` how much of any name's count may be missing. So a count is at least ``lower`` and at most ``over`` and those
rows together, and a name without a row has at most those rows. Summaries add up row by row. A cut takes the largest
counter that it leaves out off each of the ``n`` others, so what may be missing is at most a share of 1 / (n + 1) of
all that was counted, over any merges and cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Counters of a group: one less than the optimizer's bound, as the largest one left out is looked at too.
COUNTERS = 999


def of_counts(counts: DataFrame, *by: str, n: int = COUNTERS) -> DataFrame:
    """The summary ``*by, name, lower, over`` of exact ``counts(*by, name, count)``; a name is there once a group."""
    return _cut(counts.where("name is not null").select(*by, "name", F.col("count").alias("lower"), F.col("count").alias("over")), *by, n=n)


def merged(summaries: DataFrame, *by: str, n: int = COUNTERS) -> DataFrame:
    """One summary of each group ``by`` of all ``summaries(*by, name, lower, over)``, of hours or of summaries."""
    return _cut(summaries.groupBy(*by, "name").agg(F.sum("lower").alias("lower"), F.sum("over").alias("over")), *by, n=n)


def _cut(rows: DataFrame, *by: str, n: int) -> DataFrame:
    """The ``n`` largest counters of each group, equal ones by name. A task sends n + 1 rows of a group at most."""
    if n < 1:
        raise ValueError("a summary has at least one counter")
    own = Window.partitionBy(*by, "rest")
    ranked = rows.withColumn("rest", F.col("name").isNull()).withColumn("rank", F.row_number().over(own.orderBy(F.desc("over"), "name"))).where(F.col("rank") <= n + 1)
    last, over = F.col("rank") > n, F.col("over")
    off = F.coalesce(F.max(F.when(last, over)).over(own), F.lit(0))
    return ranked.select(*by, F.when(~last, F.col("name")).alias("name"), F.when(last, 0).otherwise(F.col("lower")).alias("lower"), F.when(last, over).otherwise(over - off).alias("over"))


def heaviest(summaries: DataFrame, *by: str, n: int) -> DataFrame:
    """``*by, name, lower, upper, unlisted``: the ``n`` names of each group with the largest upper bounds; a name that
    isn't listed has a count of ``unlisted`` at most. So names with ``lower > unlisted`` are among the true top ``n``."""
    most = F.coalesce(F.sum(F.when(F.col("name").isNull(), F.col("over"))).over(Window.partitionBy(*by)), F.lit(0))
    listed = merged(summaries, *by, n=n).withColumn("unlisted", most).where("name is not null")
    return listed.select(*by, "name", "lower", (F.col("over") + F.col("unlisted")).alias("upper"), "unlisted")
