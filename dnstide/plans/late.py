"""Late lines put into stored rollups: the counts of a late batch are added where it has any, and only those lists are
ranked again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnstide.functions.stamps import stamp, time_of
from dnstide.operators.counters import keyed
from dnstide.operators.rates import DAY, HOUR, end_of
from dnstide.plans.rollup import daily_rollup, named, snapshot_rows

GROUP = ["kind", "hour", "key"]


def hourly_counts(records: DataFrame) -> DataFrame:
    """``kind, hour, key, name, count``: all counts of each hour, from which its lists are cut. They add up, so they
    are what is stored beside the lists."""
    rows = records.select("view", "zone", stamp(end_of(F.col("ts"), HOUR)).alias("hour"), F.inline(named(*map(F.col, ("domain", "client_ip", "rcode", "rtype")))))
    return keyed(rows.where("name is not null"), "hour", "kind", "name").select(*GROUP, "name", "count")


def changed_counts(counts: DataFrame, late: DataFrame) -> DataFrame:
    """The whole counts of the groups that ``late`` has any of, with them added. Groups of ``counts`` that it doesn't
    touch aren't shuffled where the changed ones are few enough to be sent to all tasks."""
    there = counts.join(late.select(*GROUP).distinct(), GROUP, "left_semi")
    return there.unionByName(late).groupBy(*GROUP, "name").agg(F.sum("count").alias("count"))


def with_late_hours(hourly: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hourly rows with the changed groups' lists in the place of their old ones, and those new lists alone."""
    new = snapshot_rows(changed)
    lists = changed.select("kind", F.col("hour").alias("stamp"), F.col("key").alias("view")).distinct()
    return hourly.join(lists, ["kind", "stamp", "view"], "left_anti").unionByName(new), new


def with_late_days(daily: DataFrame, hourly: DataFrame, new: DataFrame) -> DataFrame:
    """The daily rows anew for the days and keys that have ``new`` hourly lists; ``hourly`` has them already."""
    mark = stamp(end_of(time_of(F.col("stamp")), DAY))
    days = new.select("kind", "view", mark.alias("stamp")).distinct()
    own = hourly.withColumn("mark", mark).join(days.withColumnRenamed("stamp", "mark"), ["kind", "view", "mark"], "left_semi").drop("mark")
    return daily.join(days, ["kind", "view", "stamp"], "left_anti").unionByName(daily_rollup(own))
