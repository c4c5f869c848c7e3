"""Sums of streams where a task reads several Arrow batches."""

import pytest
from pyspark.sql import functions as F

from dnstide.functions.stamps import stamp
from dnstide.operators import rates, topn
from dnstide.operators.counters import name_counts
from dnstide.operators.rates import HOUR, end_of
from dnstide.sources import fixture, logs
from dnstide.streaming import jobs, live


@pytest.mark.parametrize(("gather", "most"), [(1 << 16, 1 << 20), (1, 1 << 20), (1, 50), (7000, 10)])
def test_added_up(spark, gather, most):
    """A literal is "not null" in Arrow and a sum isn't; groups may come out in parts."""
    rows = spark.range(25_000).coalesce(1).select((F.col("id") % 100).alias("name"), F.lit(1).alias("n"))
    got = live.added_up(rows, {"n": "bigint"}, gather, most).groupBy("name").agg(F.sum("n").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(i, 250) for i in range(100)]


@pytest.fixture
def log(spark, sf_dir, tmp_path):
    """The records, and one file of them as a stream that is read 100 rows at a time."""
    records = logs.accepted(fixture.log_lines(spark, sf_dir))
    records.coalesce(1).write.parquet(f"file://{tmp_path}/records")
    live.use_rocksdb(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    yield records, spark.readStream.schema(records.schema).parquet(f"file://{tmp_path}/records")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def ran(spark, tmp_path, stream, mode):
    jobs.start(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state", {"availableNow": True}, mode=mode).awaitTermination()
    return spark.read.parquet(f"file://{tmp_path}/out")


def rows(df, *columns):
    return sorted(tuple(str(round(x, 9) if isinstance(x, float) else x) for x in r) for r in df.select(*columns).collect())


def test_half_hours(spark, log, tmp_path):
    records, stream = log
    columns = ("key", "stamp", "qps", "success_rate")
    passed = records.agg(stamp(F.max("ts") - F.expr("INTERVAL 10 MINUTES"))).first()[0]
    want = rates.half_hour_mean(rates.five_minute_samples(records)).where(F.col("stamp") <= passed)
    assert rows(ran(spark, tmp_path, live.stream_half_hours(stream), "append"), *columns) == rows(want, *columns) != []


def test_top_lists(spark, log, tmp_path):
    records, stream = log
    got = ran(spark, tmp_path, live.stream_topn(stream, 3), "update")
    timed = records.withColumn("hour", stamp(end_of(F.col("ts"), HOUR)))
    want = [topn.topn(name_counts(timed, field, "hour"), 3, "hour").withColumn("kind", F.lit(kind)) for kind, field in (("domain", "domain"), ("ip", "client_ip"))]
    columns = ("kind", "hour", "key", "name", "count", "rank")
    assert rows(got, *columns) == rows(want[0].unionByName(want[1]), *columns) != []
