"""Reports as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnstide.operators.rates import downsample


def quoted(c: Column) -> Column:
    """A text as JSON, control characters escaped."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.char_length(listed) - 2)


def _list(df: DataFrame, key: str, order: Column, first: Column, second: Column) -> DataFrame:
    pair = F.concat(F.lit("["), quoted(first), F.lit(", "), second.cast("string"), F.lit("]"))
    rows = df.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), pair.alias("pair")))).alias("rows"))
    return rows.select("key", F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["pair"]), ", "), F.lit("]")).alias("body"))


def list_json(ranked: DataFrame) -> DataFrame:
    """``key, body``: a ranked list as [[name, count], ...]."""
    return _list(ranked, "key", F.col("rank"), F.col("name"), F.col("count"))


def series_json(series: DataFrame) -> DataFrame:
    """``key, body``: a series as [[stamp, value], ...]. Series are thinned first, to a bounded number of points."""
    return _list(downsample(series, "key"), "key", F.col("stamp"), F.col("stamp"), F.col("value"))


def value_json(values: DataFrame, name: str) -> DataFrame:
    """``key, body``: a value as {name: value}."""
    return values.select("key", F.concat(F.lit(f'{{"{name}": '), F.col(name).cast("string"), F.lit("}")).alias("body"))
