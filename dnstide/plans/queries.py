"""The registered queries: thin, over the log derived from the whole ``events`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnstide.functions.addresses import ipv4, ipv6, is_loopback, same_network
from dnstide.functions.names import RCODES, RTYPES, rcode_label, rtype_label, full_name, valid_key, without_root
from dnstide.functions.stamps import stamp, whole_point
from dnstide.operators import counters, heavy, lookups, nested, rates, reports, requests
from dnstide.operators import topn as ranks
from dnstide.plans import cover, late, ranges, rollup
from dnstide.sources import fixture, history, logs
from dnstide.sources.tail import tail
from dnstide.streaming import jobs, live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

VIEW = "default$z1.com"
FINE = ("20240110000000", "20240113000000")
DAY_END = "20240111000000"
COARSE = ("20240105000000", "20240120000000")
NOW = "20240412000000"
HEAVY = 8


def query(f: Query) -> Query:
    QUERIES[f.__name__.rstrip("_")] = f
    return f


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.accepted(fixture.log_lines(spark, sf_dir))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.hourly_snapshot(records(spark, sf_dir))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly rows of the fine range, read from a history table that has been written with all days."""
    path = history.scratch(spark, "history")
    history.append(hourly(spark, sf_dir), path)
    return history.read(spark, path, *FINE).select("kind", "view", "stamp", "item", "query_num")


def kind(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("kind") == name)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a written table, as a job's history or lookup tables are; what reads it several times doesn't
    work it out again."""
    path = history.scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Sources and sinks


@query
def parse_log(spark, sf_dir):
    parsed = logs.accepted_lines(fixture.log_lines(spark, sf_dir))
    return parsed.select("position", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"), "client_ip", "view", "domain", "rtype", "rcode", "zone")


@query
def stream_follow(spark, sf_dir):
    """The log written as files into a folder, followed, and its lines counted by what parsing says."""
    folder, out = history.scratch(spark, "log"), history.scratch(spark, "followed")
    fixture.log_lines(spark, sf_dir).select("value").write.text(folder)
    counts = logs.rejected_counts(jobs.follow(spark, folder, "part-*"))
    jobs.start(counts, out, history.scratch(spark, "state"), {"availableNow": True}).awaitTermination()
    return jobs.latest(spark, out, "reason")


@query
def history_append(spark, sf_dir):
    """Hourly rows appended, appended again, and read back by range."""
    path = history.scratch(spark, "history")
    rows = stored(hourly(spark, sf_dir))
    half = F.substring("stamp", 9, 2) < "12"
    history.append(rows.where(half), path, batch="first half")
    for name in rollup.KINDS:  # later hours of the same days, each kind by itself
        history.append(rows.where(~half & (F.col("kind") == name)), path)
    history.append(rows.where(half), path, batch="first half")  # a job that runs again
    history.compact(spark, path, COARSE[1])
    return history.read(spark, path, *COARSE).select("kind", "view", "stamp", "item", "query_num")


@query
def latest_log(spark, sf_dir):
    return logs.latest_log(fixture.log_lines(spark, sf_dir), F.col("position"))


@query
def report_json(spark, sf_dir):
    r = records(spark, sf_dir)
    top = reports.list_json(ranks.topn(counters.name_counts(r, "domain"), 10)).withColumn("report", F.lit("domaintopn"))
    series = rates.five_minute_samples(r).select("key", "stamp", F.col("qps").alias("value"))
    value = reports.value_json(counters.success_rate(r).select("key", F.format_string("%.6f", "success_rate").alias("success_rate")), "success_rate").withColumn("report", F.lit("success_rate"))
    return top.unionByName(reports.series_json(series).withColumn("report", F.lit("qps"))).unionByName(value).select("report", "key", "body")


@query
def stats_reply(spark, sf_dir):
    return ranks.stats_reply(ranks.topn(counters.name_counts(records(spark, sf_dir), "domain"), 20)).select("key", F.to_json("names").alias("names"), F.to_json("counts").alias("counts"))


# Projections, filters, predicates


@query
def reject_lines(spark, sf_dir):
    return logs.rejected_counts(fixture.log_lines(spark, sf_dir))


@query
def view_keys(spark, sf_dir):
    parsed = logs.accepted_lines(fixture.log_lines(spark, sf_dir))
    return counters.view_keys(parsed).select("position", "key")


@query
def valid_keys(spark, sf_dir):
    """Keys of zones with the names' own labels before them, so that some are too long."""
    parsed = logs.accepted_lines(fixture.log_lines(spark, sf_dir))
    long = parsed.select("position", F.concat("view", F.lit("$"), "domain", F.lit("."), "domain", F.lit("."), "zone").alias("key"))
    return long.where(valid_key(F.col("key")))


@query
def normalize_names(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.select(F.col("domain").alias("raw"), full_name(F.col("domain")).alias("name")).where("name is not null").groupBy("raw", "name").count()


@query
def rtype_bucket(spark, sf_dir):
    return records(spark, sf_dir).groupBy("rtype", rtype_label(F.col("rtype")).alias("label")).count()


@query
def rcode_bucket(spark, sf_dir):
    return records(spark, sf_dir).groupBy("rcode", rcode_label(F.col("rcode")).alias("label")).count()


@query
def history_range(spark, sf_dir):
    return ranges.history_range(kept(spark, sf_dir), VIEW, *FINE)


@query
def strip_root_dot(spark, sf_dir):
    counts = counters.name_counts(records(spark, sf_dir), "client_ip")
    return counts.select("key", "name", without_root(F.col("name")).alias("client_ip"))


@query
def loopback_filter(spark, sf_dir):
    r = records(spark, sf_dir).groupBy("client_ip").count()
    return r.where(~is_loopback(F.col("client_ip"), ipv6(F.col("client_ip"))))


def _pairs(spark, sf_dir):
    """Each line's client beside the client of its user's number, and a mask each."""
    lines = logs.accepted_lines(fixture.log_lines(spark, sf_dir))
    other = F.when(F.col("position") % 5 == 0, F.concat(F.lit("2001:db8::"), (F.col("position") % 7).cast("string"))).otherwise(F.concat(F.lit("10."), (F.col("position") % 3).cast("string"), F.lit(".7.9")))
    return lines.select("position", F.col("client_ip").alias("a"), other.alias("b"), (F.col("position") % 37 - 2).cast("int").alias("a_mask"), (F.col("position") % 131).cast("int").alias("b_mask"))


@query
def same_network_(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("a6", ipv6(F.col("a"))).withColumn("b6", ipv6(F.col("b")))
    same = same_network(F.col("a"), F.col("b"), F.col("a_mask"), F.col("b_mask"), F.col("a6"), F.col("b6"))
    return p.select("position", "a", "b", same.alias("same"))


def _cidrs(spark, sf_dir):
    """A prefix of each line's client: lengths 0 to 34, some without a length, some with letters."""
    lines = logs.accepted_lines(fixture.log_lines(spark, sf_dir))
    size = F.when(F.col("position") % 41 == 0, "").when(F.col("position") % 43 == 0, "/8x").otherwise(F.concat(F.lit("/"), (F.col("position") % 35).cast("string")))
    return lines.select("position", "rcode", F.concat("client_ip", size).alias("cidr"), F.concat(F.lit("net"), (F.col("position") % 100).cast("string")).alias("info"))


@query
def parse_cidr(spark, sf_dir):
    return lookups.parse_cidr(_cidrs(spark, sf_dir)).select("position", "cidr", F.col("net").cast("string").alias("net"), F.col("len").cast("string").alias("len"), "status")


@query
def view_defaults(spark, sf_dir):
    r = records(spark, sf_dir)
    asked = counters.views_list(r).select(F.col("key").alias("view"))
    asked = asked.union(asked.select(F.concat(F.lit("not"), "view")))
    return requests.view_defaults(asked, r)


# Joins


@query
def subnet_lpm(spark, sf_dir):
    table = _subnets(spark, sf_dir)
    addresses = records(spark, sf_dir).groupBy("client_ip").count()
    return lookups.subnet_lpm(addresses, table)


def _subnets(spark, sf_dir):
    return stored(lookups.subnet_table(_cidrs(spark, sf_dir), "position"))


@query
def subnet_insert(spark, sf_dir):
    return lookups.subnet_insert(_cidrs(spark, sf_dir), "position").select("position", "cidr", F.col("net").cast("string").alias("net"), F.col("len").cast("string").alias("len"), "status")


@query
def subnet_remove(spark, sf_dir):
    """Prefixes of clients that met a server failure asked to go, changed in their length so that some are absent."""
    asked = _cidrs(spark, sf_dir).where("rcode = 'SERVFAIL'").select(F.regexp_replace("cidr", "/1(\\d)$", "/2$1").alias("cidr")).distinct()
    kept, status = lookups.subnet_remove(_subnets(spark, sf_dir), asked)
    both = status.select("cidr", "net", "len", "status").unionByName(kept.select(F.lit(None).cast("string").alias("cidr"), "net", "len", F.lit("KEPT").alias("status")))
    return both.select("cidr", F.col("net").cast("string").alias("net"), F.col("len").cast("string").alias("len"), "status")


@query
def closest_ancestor(spark, sf_dir):
    r = records(spark, sf_dir)
    return lookups.closest_ancestor(r.select(F.col("domain").alias("name")), _zones(r))


def _zones(r):
    zones = r.where(F.col("zone").isin("z1.com", "z2.com")).select(F.concat("zone", F.lit(".")).alias("zone")).distinct()
    zones = zones.union(r.where("domain like 'view%'").select(full_name(F.col("domain")).alias("zone")).distinct()).union(r.select(F.regexp_extract("zone", r"([^.]+)$", 1).alias("zone")).distinct().select(F.concat("zone", F.lit(".")).alias("zone")))
    return stored(zones.distinct())


@query
def exact_lookup(spark, sf_dir):
    r = records(spark, sf_dir)
    asked = r.select(F.concat("view", F.lit("$"), "zone").alias("key"), F.regexp_replace("domain", "^click", "clicks").alias("name")).distinct()
    found = lookups.exact_lookup(asked, counters.name_counts(r, "domain"))
    return found.select("key", "name", F.col("count").cast("string").alias("count"))


@query
def subnet_ranges(spark, sf_dir):
    """The longest prefixes again, by disjoint ranges in one sorted pass."""
    return nested.longest_prefix(records(spark, sf_dir).groupBy("client_ip").count(), _subnets(spark, sf_dir))


@query
def prefix_ancestor(spark, sf_dir):
    """The closest ancestors again, by names in the order of their labels from the last."""
    r = records(spark, sf_dir)
    return nested.prefix_ancestor(r.select(F.col("domain").alias("name")), _zones(r))


@query
def live_series_fill(spark, sf_dir):
    return rates.live_series_fill(records(spark, sf_dir))


# Aggregations


@query
def domain_counts(spark, sf_dir):
    return counters.name_counts(records(spark, sf_dir), "domain")


@query
def ip_counts(spark, sf_dir):
    return counters.name_counts(records(spark, sf_dir), "client_ip")


@query
def rcode_counts(spark, sf_dir):
    return counters.rcode_counts(records(spark, sf_dir))


@query
def rtype_counts(spark, sf_dir):
    return counters.rtype_counts(records(spark, sf_dir))


@query
def query_totals(spark, sf_dir):
    return counters.query_totals(records(spark, sf_dir))


@query
def success_rate(spark, sf_dir):
    return counters.success_rate(records(spark, sf_dir)).select("key", F.round("success_rate", 6).alias("success_rate"))


@query
def distinct_names(spark, sf_dir):
    return counters.distinct_names(records(spark, sf_dir))


@query
def distinct_range(spark, sf_dir):
    """Different names of a range of hours by sketches kept by the hour, beside their exact number."""
    hours = stored(records(spark, sf_dir).withColumn("stamp", stamp(rates.end_of(F.col("ts"), rates.HOUR))))
    inside = (F.col("stamp") >= COARSE[0]) & (F.col("stamp") < COARSE[1])
    estimates = counters.distinct_estimates(stored(counters.distinct_sketches(hours, "stamp")).where(inside))
    exact = counters.distinct_names(hours.where(inside)).select("key", F.expr("stack(2, 'domains', domains, 'clients', clients) AS (kind, names)"))
    near = F.abs(F.col("estimate") - F.col("names")) <= 0.05 * F.col("names")
    return exact.where("names > 0").join(estimates, ["key", "kind"], "full").select("key", "kind", "names", F.coalesce(near, F.lit(False)).alias("within"))


@query
def property_totals(spark, sf_dir):
    h = kept(spark, sf_dir)
    both = [ranges.property_totals(kind(h, k), VIEW, *FINE).withColumn("kind", F.lit(k)) for k in ("rcode", "rtype")]
    return both[0].union(both[1])


@query
def half_hour_mean(spark, sf_dir):
    means = rates.half_hour_mean(rates.five_minute_samples(records(spark, sf_dir)))
    return means.select("key", "stamp", F.round("qps", 6).alias("qps"), F.round("success_rate", 6).alias("success_rate"))


@query
def latest_stamp(spark, sf_dir):
    """Of each kind of item table, and of one that holds nothing."""
    h = stored(hourly(spark, sf_dir))
    found = [(k, ranges.latest_stamp(kind(h, k))) for k in (*rollup.KINDS, "none")]
    return spark.createDataFrame(found, "kind string, stamp string")


@query
def total_views(spark, sf_dir):
    return counters.total_views(records(spark, sf_dir))


# Rankings


@query
def domain_topn(spark, sf_dir):
    return ranks.topn(counters.name_counts(records(spark, sf_dir), "domain"), 5).select("key", "name", "count", "rank")


@query
def ip_topn(spark, sf_dir):
    top = ranks.topn(counters.name_counts(records(spark, sf_dir), "client_ip"))
    return top.select("key", without_root(F.col("name")).alias("client_ip"), "count", "rank")


@query
def property_sorted(spark, sf_dir):
    r = records(spark, sf_dir)
    rcodes = ranks.property_sorted(counters.rcode_counts(r), "rcode", RCODES).select(F.lit("rcode").alias("kind"), "key", F.col("rcode").alias("item"), "count", "rank")
    rtypes = ranks.property_sorted(counters.rtype_counts(r), "rtype", RTYPES).select(F.lit("rtype").alias("kind"), "key", F.col("rtype").alias("item"), "count", "rank")
    return rcodes.union(rtypes)


@query
def history_topn(spark, sf_dir):
    return ranges.history_topn(kind(kept(spark, sf_dir), "domain"), VIEW, *FINE, 10)


@query
def heavy_hitters(spark, sf_dir):
    """The heaviest names of a range, from hourly summaries that are merged by the day and then over the days, beside
    their exact counts. Eight counters a summary, so that hours of small logs are cut too."""
    counts = stored(late.hourly_counts(records(spark, sf_dir)).where(F.col("kind").isin(*rollup.KINDS[:2])))
    inside = (F.col("hour") >= COARSE[0]) & (F.col("hour") < COARSE[1])
    hours = stored(heavy.of_counts(counts, "kind", "hour", "key", n=HEAVY)).where(inside)
    days = heavy.merged(hours.withColumn("hour", F.substring("hour", 1, 8)), "kind", "hour", "key", n=HEAVY)
    listed = heavy.heaviest(days, "kind", "key", n=HEAVY)
    exact = counts.where(inside).groupBy("kind", "key", "name").agg(F.sum("count").alias("count"))
    within = F.col("count").between(F.col("lower"), F.col("upper"))
    return listed.join(exact, ["kind", "key", "name"]).select("kind", "key", "name", "lower", "upper", "unlisted", "count", within.alias("within"))


@query
def views_list(spark, sf_dir):
    return counters.views_list(records(spark, sf_dir))


@query
def subnet_list(spark, sf_dir):
    return lookups.subnet_list(_subnets(spark, sf_dir)).select("net", "len", "info", "size")


# Time windows and rollups


@query
def qps_10s(spark, sf_dir):
    return rates.qps_10s(records(spark, sf_dir))


@query
def qps_ticks(spark, sf_dir):
    """The same at every ten seconds of a day, 0.0 where a key had no query."""
    return rates.fill_ticks(rates.qps_10s(records(spark, sf_dir)), FINE[0], DAY_END)


@query
def whole_point_(spark, sf_dir):
    stamps = records(spark, sf_dir).select(stamp(F.col("ts")).alias("stamp")).distinct()
    return stamps.select("stamp", whole_point(F.col("stamp")).alias("whole"))


@query
def five_minute_samples(spark, sf_dir):
    return rates.five_minute_samples(records(spark, sf_dir)).select("key", "stamp", "qps", F.round("success_rate", 6).alias("success_rate"))


@query
def hourly_snapshot(spark, sf_dir):
    return hourly(spark, sf_dir)


@query
def half_hour_rollup(spark, sf_dir):
    rows = rates.half_hour_rollup(rates.five_minute_samples(records(spark, sf_dir)))
    return rows.select("series", "view", "stamp", F.round("value", 6).alias("value"))


@query
def daily_rollup(spark, sf_dir):
    return rollup.daily_rollup(hourly(spark, sf_dir))


@query
def retention(spark, sf_dir):
    path, hour = history.scratch(spark, "history"), F.substring("stamp", 9, 2)
    rows = stored(hourly(spark, sf_dir))
    history.append(rows, path, hour)
    history.retention(spark, path, NOW)
    history.append(rows.where(F.col("stamp") == history.oldest(NOW)), path, hour)  # an hour of the day at the bound, written again
    return history.read(spark, path).select("kind", "view", "stamp", "item", "query_num")


def _series(spark, sf_dir):
    fine = stored(rates.five_minute_samples(records(spark, sf_dir)))
    named = fine.select(F.expr("stack(2, 'qps', qps, 'success_rate', success_rate) AS (series, value)"), F.col("key").alias("view"), "stamp").select("series", "view", "stamp", "value")
    return named, rates.half_hour_rollup(fine)


@query
def series_read(spark, sf_dir):
    fine, coarse = _series(spark, sf_dir)
    parts = []
    for name in ("qps", "success_rate"):
        for label, span in (("fine", FINE), ("long", COARSE)):
            rows = ranges.series_range(fine.where(F.col("series") == name), coarse.where(F.col("series") == name), VIEW, *span)
            parts.append(rows.select(F.lit(label).alias("span"), "series", "stamp", F.round("value", 6).alias("value")))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def _interfaces(spark, sf_dir):
    """The fine and the one-day table of two interfaces."""
    values = fixture.events(spark, sf_dir).select(F.concat(F.lit("eth"), (F.col("user_id") % 2).cast("string")).alias("ethn"), F.col("ts").cast("timestamp").alias("ts"), "value")
    fine = stored(rates.interface_rates(values))
    return [t.withColumnRenamed("ethn", "view") for t in (fine, stored(rates.interface_half_hours(fine)))]


def _interface_rows(rows):
    return rows.select(F.col("view").alias("ethn"), "stamp", F.round("rx_rate", 6).alias("rx_rate"), F.round("tx_rate", 6).alias("tx_rate"))


@query
def nic_rate_read(spark, sf_dir):
    return _interface_rows(ranges.series_range(*_interfaces(spark, sf_dir), "eth0", *FINE))


@query
def nic_rate_long(spark, sf_dir):
    """Five days or more, from the one-day table."""
    return _interface_rows(ranges.series_range(*_interfaces(spark, sf_dir), "eth0", *COARSE))


@query
def downsample(spark, sf_dir):
    series = fixture.events(spark, sf_dir).select("event_type", F.date_format(F.col("ts").cast("timestamp"), "yyyyMMddHHmmssSSSSSS").alias("stamp"), "event_id")
    return rates.downsample(series, "event_type")


# Set operations


def _tables(spark, sf_dir, names):
    """The fine and the one-day table of each kind."""
    fine = stored(hourly(spark, sf_dir).where(F.col("kind").isin(*names)))
    coarse = stored(rollup.daily_rollup(fine))
    return {k: (kind(fine, k), kind(coarse, k)) for k in names}


@query
def long_topn(spark, sf_dir):
    parts = [ranges.topn_range(*t, VIEW, *COARSE, 10).withColumn("kind", F.lit(k)) for k, t in _tables(spark, sf_dir, ("domain", "ip")).items()]
    return parts[0].union(parts[1])


@query
def long_property(spark, sf_dir):
    parts = [ranges.property_range(*t, VIEW, *COARSE).withColumn("kind", F.lit(k)) for k, t in _tables(spark, sf_dir, ("rcode", "rtype")).items()]
    return parts[0].union(parts[1])


@query
def range_cover(spark, sf_dir):
    """Sums of the long range from the nodes that cover it."""
    path = history.scratch(spark, "levels")
    cover.write_levels(hourly(spark, sf_dir), path)
    return cover.range_sums(spark, path, VIEW, *COARSE)


def _with_late(spark, sf_dir):
    """Hourly and daily rows stored before the lines of server failures came, and then with them."""
    r = stored(records(spark, sf_dir))
    counts = stored(late.hourly_counts(r.where("rcode != 'SERVFAIL'")))
    fine = stored(rollup.snapshot_rows(counts))
    coarse = stored(rollup.daily_rollup(fine))
    changed = stored(late.changed_counts(counts, late.hourly_counts(r.where("rcode = 'SERVFAIL'"))))
    both, new = late.with_late_hours(fine, changed)
    return both, late.with_late_days(coarse, both, new)


@query
def late_hours(spark, sf_dir):
    return _with_late(spark, sf_dir)[0].select("kind", "view", "stamp", "item", "query_num")


@query
def late_days(spark, sf_dir):
    return _with_late(spark, sf_dir)[1].select("kind", "view", "stamp", "item", "query_num")


# Streams


def _stream(spark, sf_dir):
    schema = fixture.events(spark, sf_dir).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    return logs.accepted_lines(fixture.lines_of(stream))


def _ran(spark, stream, change=lambda df: df):
    out = history.scratch(spark, "stream")
    jobs.start(stream, out, history.scratch(spark, "state"), {"availableNow": True}, change).awaitTermination()
    return out


@query
def stream_counts(spark, sf_dir):
    out = _ran(spark, jobs.stream_counts(_stream(spark, sf_dir)))
    return jobs.latest(spark, out, "kind", "hour", "key", "name")


@query
def stream_qps(spark, sf_dir):
    out = _ran(spark, jobs.stream_qps(_stream(spark, sf_dir)))
    return jobs.latest(spark, out, "key", "stamp")


@query
def stream_topn(spark, sf_dir):
    out = _ran(spark, jobs.stream_counts(_stream(spark, sf_dir)))
    top = jobs.live_topn(jobs.latest(spark, out, "kind", "hour", "key", "name"), 10)
    return top.select("kind", "hour", "key", "name", "count", "rank")


@query
def stream_samples(spark, sf_dir):
    """Hourly rows that the stream itself writes to a history table, read back."""
    path = history.scratch(spark, "history")
    jobs.start_snapshots(jobs.stream_counts(_stream(spark, sf_dir)), history.scratch(spark, "stream"), path, history.scratch(spark, "state"), {"availableNow": True}).awaitTermination()
    return history.read(spark, path).select("kind", "view", "stamp", "item", "query_num")


@query
def stream_tail(spark, sf_dir):
    """The log in files of a folder, followed as files that are still written, by byte."""
    folder, out = history.scratch(spark, "log"), history.scratch(spark, "tailed")
    fixture.log_lines(spark, sf_dir).select("value").write.text(folder)
    counts = logs.rejected_counts(tail(spark, folder, "part-*"))
    jobs.start(counts, out, history.scratch(spark, "state"), {"availableNow": True}).awaitTermination()
    return jobs.latest(spark, out, "reason")


def _in_order(spark, sf_dir):
    """The records as a stream of several batches in the order of time."""
    live.use_rocksdb(spark)
    folder, whole = history.scratch(spark, "log"), history.scratch(spark, "records")
    records(spark, sf_dir).write.parquet(whole)  # lines are parsed once, not for each of the parts
    r = spark.read.parquet(whole)
    for first, last in ((1, 10), (11, 20), (21, 31)):
        r.where(F.dayofmonth("ts").between(first, last)).write.mode("append").parquet(folder)
    return spark.readStream.schema(r.schema).parquet(folder)


def _appended(spark, stream, mode="append"):
    out = history.scratch(spark, "stream")
    jobs.start(stream, out, history.scratch(spark, "state"), {"availableNow": True}, mode=mode).awaitTermination()
    return spark.read.parquet(out)


@query
def stream_five_minutes(spark, sf_dir):
    """Five-minute samples that the stream gives as its watermark passes them."""
    found = _appended(spark, live.stream_samples(_in_order(spark, sf_dir)))
    return found.select("key", F.col("stamp").cast("string").alias("stamp"), "qps", F.round("success_rate", 6).alias("success_rate"))


@query
def stream_half_hours(spark, sf_dir):
    """Half-hour means of those samples, in the same stream."""
    found = _appended(spark, live.stream_half_hours(_in_order(spark, sf_dir)))
    return found.select("key", F.col("stamp").cast("string").alias("stamp"), F.round("qps", 6).alias("qps"), F.round("success_rate", 6).alias("success_rate"))


@query
def stream_top_lists(spark, sf_dir):
    """Top lists as the stream's state holds them after its last batch."""
    found = _appended(spark, live.stream_topn(_in_order(spark, sf_dir), 10), "update")
    last = found.groupBy("kind", "hour", "key").agg(F.max("batch").alias("batch"))
    return found.join(last, ["kind", "hour", "key", "batch"]).select("kind", F.col("hour").cast("string").alias("hour"), "key", "name", "count", "rank")
