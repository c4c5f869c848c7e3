"""Questions over a time range, put to the fine or the one-day tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnstide.functions.stamps import is_long
from dnstide.operators.rates import downsample
from dnstide.operators.topn import TOP

#: The latest stamp of an empty table.
EMPTY_STAMP = "20130101010101"


def history_range(rows: DataFrame, view: str, start: str, end: str) -> DataFrame:
    """Rows of one view with ``start <= stamp < end``."""
    return rows.where((F.col("view") == view) & (F.col("stamp") >= start) & (F.col("stamp") < end))


def property_totals(rows: DataFrame, view: str, start: str, end: str) -> DataFrame:
    """``item, query_num`` summed over the range, largest first."""
    return history_range(rows, view, start, end).groupBy("item").agg(F.sum("query_num").alias("query_num")).orderBy(F.desc("query_num"), "item")


def history_topn(rows: DataFrame, view: str, start: str, end: str, n: int) -> DataFrame:
    """The ``n`` largest of property_totals."""
    if n < 0:
        raise ValueError("a list can't have fewer than no rows")
    return property_totals(rows, view, start, end).limit(n)


def latest_stamp(rows: DataFrame) -> str:
    """The largest stamp of a table, over all views."""
    return rows.agg(F.max("stamp")).first()[0] or EMPTY_STAMP


def _sum(parts: DataFrame, n: int) -> DataFrame:
    return parts.groupBy("item").agg(F.sum("query_num").alias("query_num")).orderBy(F.desc("query_num"), "item").limit(n)


def topn_range(fine: DataFrame, coarse: DataFrame, view: str, start: str, end: str, n: int) -> DataFrame:
    """``item, query_num``: the top ``n`` of a range. Five days or more: the one-day table's list and the fine table's
    list since the one-day table's latest stamp, summed and ranked again."""
    if not is_long(start, end):
        return history_topn(fine, view, start, end, n)
    recent = history_topn(fine, view, latest_stamp(coarse), end, n)
    return _sum(history_topn(coarse, view, start, end, n).unionByName(recent), n)


def property_range(fine: DataFrame, coarse: DataFrame, view: str, start: str, end: str) -> DataFrame:
    """The same for response codes and record types, which are cut only after the union."""
    if not is_long(start, end):
        return property_totals(fine, view, start, end)
    recent = property_totals(fine, view, latest_stamp(coarse), end)
    return _sum(property_totals(coarse, view, start, end).unionByName(recent), TOP)


def series_range(fine: DataFrame, coarse: DataFrame, view: str, start: str, end: str) -> DataFrame:
    """A series of one view, thinned: ``view, stamp`` and its values, from the fine table for less than five days."""
    return downsample(history_range(coarse if is_long(start, end) else fine, view, start, end), "view")
