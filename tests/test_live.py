"""Streams with timers against the batch jobs on the same log, in several batches."""

import pytest
from pyspark.sql import functions as F

from dnstide.functions.stamps import stamp
from dnstide.operators import rates, topn
from dnstide.operators.counters import name_counts
from dnstide.operators.rates import HOUR, end_of
from dnstide.sources import fixture, logs
from dnstide.streaming import jobs, live


@pytest.fixture(scope="module")
def log(spark, sf_dir, tmp_path_factory):
    """Four files in the order of time, and their records."""
    at = f"file://{tmp_path_factory.mktemp('log')}/records"
    records = logs.accepted(fixture.log_lines(spark, sf_dir)).cache()
    for first, last in ((1, 6), (7, 7), (8, 15), (16, 31)):
        records.where(F.dayofmonth("ts").between(first, last)).coalesce(1).write.mode("append").parquet(at)
    live.use_rocksdb(spark)
    return records, lambda: spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(at)


def run(spark, tmp_path, stream, mode):
    out = f"file://{tmp_path}/out"
    jobs.start(stream, out, f"file://{tmp_path}/state", {"availableNow": True}, mode=mode).awaitTermination()
    return spark.read.parquet(out)


def rows(df, *columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def passed(records, late="10 minutes"):
    """The stamp of the watermark at the log's end."""
    return records.agg(stamp(F.max("ts") - F.expr(f"INTERVAL {late}"))).first()[0]


def test_samples(spark, log, tmp_path):
    records, stream = log
    columns = ("key", "stamp", "qps", "success_rate")
    got = run(spark, tmp_path, live.stream_samples(stream()), "append")
    want = rates.five_minute_samples(records).where(F.col("stamp") <= passed(records))
    assert got.select("batch").distinct().count() > 2
    assert rows(got, *columns) == rows(want, *columns) != []


def test_half_hours(spark, log, tmp_path):
    records, stream = log
    columns = ("key", "stamp", "qps", "success_rate")
    got = rows(run(spark, tmp_path, live.stream_half_hours(stream()), "append"), *columns)
    want = rows(rates.half_hour_mean(rates.five_minute_samples(records)).where(F.col("stamp") <= passed(records)), *columns)
    assert got == want != []


def test_top_lists(spark, log, tmp_path):
    records, stream = log
    got = run(spark, tmp_path, live.stream_topn(stream(), 3), "update")
    last = got.groupBy("kind", "hour", "key").agg(F.max("batch").alias("batch"))
    got = got.join(last, ["kind", "hour", "key", "batch"])
    timed = records.withColumn("hour", stamp(end_of(F.col("ts"), HOUR)))
    parts = [topn.topn(name_counts(timed, field, "hour"), 3, "hour").withColumn("kind", F.lit(kind)) for kind, field in (("domain", "domain"), ("ip", "client_ip"))]
    columns = ("kind", "hour", "key", "name", "count", "rank")
    assert [tuple(map(str, r)) for r in rows(got, *columns)] == [tuple(map(str, r)) for r in rows(parts[0].unionByName(parts[1]), *columns)]


def test_late_lines_and_quiet_hours(spark, tmp_path):
    """A key without queries is sampled up to its hour's end and no further; a line behind the watermark is dropped."""
    at = f"file://{tmp_path}/in"
    schema = "ts timestamp, client_ip string, view string, domain string, rtype string, rcode string, zone string"
    row = lambda t, rcode="NOERROR": (t, "10.0.0.1", "v", "d.com", "A", rcode, "z.com")
    for part in ([row("2024-01-01 10:07:00"), row("2024-01-01 10:09:55", "SERVFAIL")], [row("2024-01-01 13:00:00")], [row("2024-01-01 10:20:00")], [row("2024-01-01 13:40:00")]):
        spark.createDataFrame(part, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(at)
    live.use_rocksdb(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)
    got = rows(run(spark, tmp_path, live.stream_samples(stream), "append").where("key = 'v$z.com'"), "stamp", "qps", "success_rate")
    first = [(f"2024010110{m:02}00" if m < 60 else "20240101110000", 0.1 if m == 10 else 0.0, 0.5) for m in range(10, 61, 5)]
    assert got == first + [(f"2024010113{m:02}00", 0.0, 1.0) for m in range(5, 31, 5)]
