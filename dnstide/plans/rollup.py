"""From records to the rows of the history tables: hourly snapshots and daily sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnstide.functions.names import full_name, rcode_label, rtype_label, without_root
from dnstide.functions.stamps import stamp, time_of
from dnstide.operators.counters import keyed
from dnstide.operators.rates import DAY, HOUR, end_of
from dnstide.operators.topn import topn

#: Kinds of item tables; the first two hold top lists.
KINDS = ("domain", "ip", "rcode", "rtype")


def named(domain: Column, client: Column, rcode: Column, rtype: Column) -> Column:
    """The four ``(kind, name)`` of a record."""
    names = zip(KINDS, (full_name(domain), full_name(client), rcode_label(rcode), rtype_label(rtype)))
    return F.array(*(F.struct(F.lit(kind).alias("kind"), name.alias("name")) for kind, name in names))


def snapshot_rows(counts: DataFrame) -> DataFrame:
    """``kind, view, stamp, item, query_num`` of ``counts(kind, hour, key, name, count)``: the top lists. Codes and types
    are few, so their lists are whole."""
    item = F.when(F.col("kind") == "ip", without_root(F.col("name"))).otherwise(F.col("name"))
    lists = topn(counts, None, "kind", "hour")
    return lists.select("kind", F.col("key").alias("view"), F.col("hour").alias("stamp"), item.alias("item"), F.col("count").alias("query_num"))


def hourly_snapshot(records: DataFrame) -> DataFrame:
    """``kind, view, stamp, item, query_num`` for each hour, stamped with its end: the top domains and clients and all
    response codes and record types of each key. One pass over the records."""
    rows = records.select("view", "zone", end_of(F.col("ts"), HOUR).alias("hour"), F.inline(named(*map(F.col, ("domain", "client_ip", "rcode", "rtype")))))
    counts = keyed(rows.where("name is not null"), "hour", "kind", "name")
    return snapshot_rows(counts.withColumn("hour", stamp(F.col("hour"))))


def daily_rollup(hourly: DataFrame) -> DataFrame:
    """The same columns for each day mark: sums of the hourly rows stamped in the day up to it, the mark left out;
    the top domains and clients only."""
    day = stamp(end_of(time_of(F.col("stamp")), DAY))
    sums = hourly.groupBy("kind", F.col("view").alias("key"), day.alias("stamp"), F.col("item").alias("name")).agg(F.sum("query_num").alias("count"))
    return topn(sums, None, "kind", "stamp").select("kind", F.col("key").alias("view"), "stamp", F.col("name").alias("item"), F.col("count").alias("query_num"))
