"""Rates over time: ten-second query rates, five-minute samples, half-hour means, and thinning of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnstide.functions.stamps import stamp
from dnstide.operators.counters import keyed, rate, shown_rate

POINTS = 1500


#: Seconds of the windows.
TICK, MARK, HALF, HOUR, DAY = 10, 300, 1800, 3600, 86400


def end_of(ts: Column, seconds: int) -> Column:
    """End of the tumbling window that holds ``ts``; windows start at multiples of their width since 1970 (UTC)."""
    return F.timestamp_seconds((F.floor(F.unix_seconds(ts) / seconds) + 1) * seconds)


def qps_10s(records: DataFrame) -> DataFrame:
    """``key, stamp, qps``: queries of each ten seconds with any, stamped with their end."""
    counts = keyed(records.withColumn("tick", end_of(F.col("ts"), TICK)), "tick")
    return counts.select("key", stamp(F.col("tick")).alias("stamp"), (F.col("count") / 10.0).alias("qps"))


def fill_ticks(qps: DataFrame, start: str, end: str) -> DataFrame:
    """``key, stamp, qps`` at every ten seconds with ``start <= stamp < end``, 0.0 where a key of ``qps`` had no query;
    both bounds are marks of ten seconds."""
    time = lambda x: F.to_timestamp(F.lit(x), "yyyyMMddHHmmss")
    last = time(end) - F.expr("INTERVAL 10 SECONDS")
    ticks = F.sequence(time(start), last, F.expr("INTERVAL 10 SECONDS")) if start < end else F.array().cast("array<timestamp>")
    every = qps.select("key").distinct().select("key", F.explode(ticks).alias("tick")).select("key", stamp(F.col("tick")).alias("stamp"))
    return every.join(qps, ["key", "stamp"], "left").select("key", "stamp", F.coalesce("qps", F.lit(0.0)).alias("qps"))


def _marks(records: DataFrame) -> DataFrame:
    """Sums of each five minutes with any query, and the mark at which the next such five minutes end, or the hour's
    end: until then nothing changes."""
    timed = records.select("view", "zone", "rcode", "ts", end_of(F.col("ts"), MARK).alias("mark"), end_of(F.col("ts"), HOUR).alias("hour"))
    last = F.col("ts") >= F.col("mark") - F.expr("INTERVAL 10 SECONDS")
    sums = keyed(timed, "hour", "mark", n=F.count("*"), failed=F.count_if(F.col("rcode") == "SERVFAIL"), last=F.count_if(last))
    own = Window.partitionBy("key", "hour").orderBy("mark")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    until = F.coalesce(F.lead("mark").over(own) - F.expr("INTERVAL 5 MINUTES"), F.col("hour"))
    return sums.select("key", "mark", "last", F.sum("n").over(so_far).alias("n"), F.sum("failed").over(so_far).alias("failed"), until.alias("until"))


def live_series_fill(records: DataFrame) -> DataFrame:
    """``key, stamp, qps`` at every five-minute mark of each live key, 0.0 where its last ten seconds had no query. A
    key is live from its first query after an hour mark up to the next hour mark."""
    return five_minute_samples(records).select("key", "stamp", "qps")


def five_minute_samples(records: DataFrame) -> DataFrame:
    """``key, stamp, qps, success_rate`` at every five-minute mark of each live key: the rate of the ten seconds
    before the mark, and the success rate since the hour mark before it."""
    filled = _marks(records).select("*", F.explode(F.sequence("mark", "until", F.expr("INTERVAL 5 MINUTES"))).alias("at"))
    qps = F.when(F.col("at") == F.col("mark"), F.col("last") / 10.0).otherwise(0.0)
    return filled.select("key", stamp(F.col("at")).alias("stamp"), qps.alias("qps"), shown_rate(rate(F.col("n"), F.col("failed"))).alias("success_rate"))


def half_hour_mean(samples: DataFrame) -> DataFrame:
    """``key, stamp, qps, success_rate`` at each half-hour mark T of keys live then: means of their samples stamped in
    the half hour up to T, T left out; 0.0 and 1.0 where there are none."""
    timed = samples.withColumn("ts", F.to_timestamp("stamp", "yyyyMMddHHmmss"))
    means = timed.groupBy("key", stamp(end_of(F.col("ts"), HALF)).alias("stamp")).agg(F.avg("qps").alias("q"), F.avg("success_rate").alias("s"))
    live = timed.where(F.substring("stamp", 11, 2).isin("00", "30")).select("key", "stamp")
    return live.join(means, ["key", "stamp"], "left").select("key", "stamp", F.coalesce("q", F.lit(0.0)).alias("qps"), F.coalesce("s", F.lit(1.0)).alias("success_rate"))


def half_hour_rollup(samples: DataFrame) -> DataFrame:
    """The one-day series ``series, view, stamp, value`` of half_hour_mean."""
    means = half_hour_mean(samples)
    return means.select(F.expr("stack(2, 'qps', qps, 'success_rate', success_rate) AS (series, value)"), F.col("key").alias("view"), "stamp").select("series", "view", "stamp", "value")


def interface_rates(values: DataFrame) -> DataFrame:
    """``ethn, stamp, rx_rate, tx_rate`` of ``values(ethn, ts, value)``: mean and largest value of each five minutes."""
    return values.groupBy("ethn", stamp(end_of(F.col("ts"), MARK) - F.expr("INTERVAL 5 MINUTES")).alias("stamp")).agg(F.avg("value").alias("rx_rate"), F.max("value").alias("tx_rate"))


def interface_half_hours(rows: DataFrame) -> DataFrame:
    """The one-day table of interface_rates: ``ethn, stamp, rx_rate, tx_rate`` at each half-hour mark with any rows in
    the half hour up to it, the mark left out: their means."""
    mark = stamp(end_of(F.to_timestamp("stamp", "yyyyMMddHHmmss"), HALF))
    return rows.groupBy("ethn", mark.alias("stamp")).agg(F.avg("rx_rate").alias("rx_rate"), F.avg("tx_rate").alias("tx_rate"))


def downsample(series: DataFrame, *keys: str, order: str = "stamp", points: int = POINTS) -> DataFrame:
    """At most ``points`` rows of each series: all if there are no more, else every (n div points)-th from the first,
    the last row never, cut at ``points``. Rows of one stamp must be told apart by the series' other columns.

    Rows are numbered within each day of a series, and days are placed by their counts, so that a long series isn't
    sorted in one task.
    """
    rest = [c for c in series.columns if c not in keys and c != order]
    days = series.withColumn("_day", F.substring(order, 1, 8))
    own = Window.partitionBy(*keys)
    counts = days.groupBy(*keys, "_day").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(own.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select(*keys, "_day", before.alias("_before"), F.sum("_c").over(own).alias("_n"))
    number = F.row_number().over(Window.partitionBy(*keys, "_day").orderBy(order, *rest)) - 1
    rows = days.withColumn("_r", number).join(placed, [*keys, "_day"])
    i, n, step = F.col("_before") + F.col("_r"), F.col("_n"), F.greatest(F.floor(F.col("_n") / points), F.lit(1))
    thin = (i < n - 1) & (i % step == 0) & (F.floor(i / step) < points)
    return rows.where((n <= points) | thin).select(*series.columns)
