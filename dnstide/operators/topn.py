"""Rankings per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnstide.functions.names import label_place

#: The most that a key's list holds; the optimizer's group limit before the shuffle works up to this number.
TOP = 1000


def list_size(n: int | None) -> int:
    """None and 0 ask for all that is held."""
    if n is not None and n < 0:
        raise ValueError("a list can't have fewer than no rows")
    return min(n or TOP, TOP)


def topn(counts: DataFrame, n: int | None = None, *by: str, name: str = "name", count: str = "count") -> DataFrame:
    """The ``n`` largest counts of each key (and ``by``), equal counts by name; with their ``rank``."""
    order = Window.partitionBy("key", *by).orderBy(F.desc(count), name)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= list_size(n))


def property_sorted(counts: DataFrame, name: str, labels: tuple[str, ...]) -> DataFrame:
    """A key's labels by count, equal counts in the order of ``labels``; with their ``rank``."""
    order = Window.partitionBy("key").orderBy(F.desc("count"), label_place(F.col(name), labels))
    return counts.withColumn("rank", F.row_number().over(order))


def stats_reply(ranked: DataFrame) -> DataFrame:
    """``key, names, counts``: a ranked list of each key as two arrays side by side."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "name", "count")))
    lists = ranked.groupBy("key").agg(rows.alias("rows"))
    return lists.select("key", F.transform("rows", lambda r: r["name"]).alias("names"), F.transform("rows", lambda r: r["count"]).alias("counts"))
