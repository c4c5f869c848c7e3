"""Range answers worked out by hand, stamps, retention, thinning, and stored tables."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dnstide.functions import stamps
from dnstide.operators import rates, reports, topn
from dnstide.plans import ranges, rollup
from dnstide.sources import fixture, history, logs
from dnstide.streaming import jobs

ROWS = "view string, stamp string, item string, query_num bigint"


def table(spark, *rows):
    return spark.createDataFrame(list(rows), ROWS)


def pairs(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def ips(spark):
    fine = [("default", "20130817000000", "203.119.80.40", 100), ("*", "20130818000000", "202.118.81.50", 100), ("default", "20130818000000", "202.118.81.50", 100), ("default", "20130818000000", "202.118.81.50", 100), ("default", "20130818000000", "203.119.80.40", 100), ("default", "20130817000000", ".40", 100)]
    coarse = [("default", "20130816000000", "202.118.82.50", 100), ("default", "20130816000000", "202.118.81.50", 300)]
    return table(spark, *fine), table(spark, *coarse)


def test_long_ip_list(ips):
    got = pairs(ranges.topn_range(*ips, "default", "20130815200427", "20130821200427", 10))
    assert got == [("202.118.81.50", 500), ("203.119.80.40", 200), (".40", 100), ("202.118.82.50", 100)]
    assert pairs(ranges.topn_range(*ips, "*", "20130815200427", "20130821200427", 10)) == [("202.118.81.50", 100)]


def test_long_properties(spark):
    fine = table(spark, *[("default", s, i, n) for s in ("20130817000000", "20130818000000") for i, n in (("A", 100), ("AAAA", 200))])
    coarse = table(spark, ("default", "20130816000000", "A", 100), ("default", "20130816000000", "AAAA", 200))
    assert pairs(ranges.property_range(fine, coarse, "default", "20130815000000", "20130828000000")) == [("AAAA", 600), ("A", 300)]


def test_range_length():
    assert stamps.is_long("20130811000000", "20130817000000")
    assert not stamps.is_long("20130811000000", "20130815235959")
    assert stamps.bound("20130900020101").isoformat() == "2013-08-31T02:01:01"


def test_empty_tables(spark):
    none = table(spark)
    assert ranges.latest_stamp(none) == "20130101010101"
    assert pairs(ranges.topn_range(none, none, "default", "20130815200427", "20130821200427", 10)) == []


def test_list_sizes():
    assert (topn.list_size(None), topn.list_size(0), topn.list_size(5), topn.list_size(5000)) == (1000, 1000, 5, 1000)
    with pytest.raises(ValueError):
        topn.list_size(-1)


@pytest.mark.parametrize("n", [1, 1500, 1501, 2999, 3000, 4600])
def test_downsample(spark, n):
    series = spark.range(n).select(F.lit("a").alias("view"), F.format_string("%014d", "id").alias("stamp"), "id")
    got = sorted(r["id"] for r in rates.downsample(series, "view").collect())
    assert got == (list(range(n)) if n <= 1500 else list(range(0, n - 1, n // 1500))[:1500])


def test_append_adds_and_replaces_a_batch(spark, tmp_path):
    path = f"file://{tmp_path}/h"
    rows = table(spark, ("a", "20240101010000", "x", 1), ("a", "20240101020000", "x", 2), ("a", "20240102000000", "x", 3))
    for part in ("stamp < '20240101015959'", "stamp > '20240101015959'"):
        history.append(rows.where(part), path)
    assert sorted(pairs(history.read(spark, path).select(rows.columns))) == sorted(pairs(rows))
    assert pairs(history.read(spark, path, "20240102000000").select("query_num")) == [(3,)]
    history.append(rows.where("query_num = 1"), path, batch="later")
    history.append(rows.where("query_num = 1"), path, batch="later")
    assert sorted(pairs(history.read(spark, path).select("query_num"))) == [(1,), (1,), (2,), (3,)]


def test_appends_of_five_minutes_and_of_kinds_stay(spark, tmp_path):
    """Rows of one hour that come one after another, and kinds of one hour, all stay; named ones replace themselves."""
    path, own = f"file://{tmp_path}/h", lambda: sorted(r.query_num for r in history.read(spark, path).collect())
    for minute, n in (("05", 1), ("10", 2), ("15", 3)):
        history.append(table(spark, ("a", f"2024010101{minute}00", "x", n)), path)
    for kind, n in (("domain", 4), ("ip", 5)):
        history.append(table(spark, ("a", "20240101020000", kind, n)), path)
    assert own() == [1, 2, 3, 4, 5]
    history.compact(spark, path)
    assert own() == [1, 2, 3, 4, 5] and len([x for x in os.listdir(tmp_path / "h" / "day=20240101") if x.startswith("batch")]) == 1
    history.append(table(spark, ("a", "20240101030000", "x", 6), ("a", "20240102030000", "x", 7)), path, batch="02")
    history.append(table(spark, ("a", "20240102030000", "x", 8)), path, batch="02")  # the rerun has no row of the first day
    history.compact(spark, path)
    assert own() == [1, 2, 3, 4, 5, 8]
    history.append(table(spark), path, batch="02")
    history.append(table(spark), path)
    assert own() == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        history.append(table(spark), path, batch="rows-1")


def test_rerun_after_retention(spark, tmp_path):
    """The day at the bound keeps its batch names, so that an hour written again replaces itself."""
    path, own = f"file://{tmp_path}/h", lambda: sorted((r.stamp, r.query_num) for r in history.read(spark, path).collect())
    rows = table(spark, *(("a", f"202401010{h}0000", "x", h) for h in range(1, 6)))
    history.append(rows, path, F.substring("stamp", 9, 2))
    history.delete_before(spark, path, "20240101030000")
    history.append(rows.where("query_num = 3"), path, F.substring("stamp", 9, 2))
    history.append(rows.where("query_num = 2").withColumn("stamp", F.lit("20240101033000")), path, batch="02")
    assert own() == [("20240101030000", 3), ("20240101033000", 2), ("20240101040000", 4), ("20240101050000", 5)]
    assert sorted(x for x in os.listdir(tmp_path / "h" / "day=20240101") if x.startswith("batch")) == ["batch=02", "batch=03", "batch=04", "batch=05"]


@pytest.mark.parametrize("whole", [True, False])
def test_writer_that_stopped(spark, tmp_path, whole):
    """Stopped between its two renames, or before its new rows were whole: the next writer finds the day's rows."""
    path = f"file://{tmp_path}/h"
    history.append(table(spark, ("a", "20240101010000", "x", 1)), path)
    os.rename(tmp_path / "h" / "day=20240101", tmp_path / "h" / "_old.day=20240101.7")
    if whole:
        table(spark, ("a", "20240101010000", "x", 2)).withColumn("batch", F.lit("b")).write.partitionBy("batch").parquet(f"{path}/_day.day=20240101.7")
    history.append(table(spark, ("a", "20240102010000", "x", 3)), path)
    assert sorted(r.query_num for r in history.read(spark, path).collect()) == [2 if whole else 1, 3]
    assert not [x for x in os.listdir(tmp_path / "h") if x.startswith("_") and x != "_SUCCESS"]


def test_snapshots_lay_batches_together(spark, sf_dir, tmp_path):
    """Many batches of the same hours: few folders stay, and the rows are those of the batch job."""
    records = logs.accepted(fixture.log_lines(spark, sf_dir)).where(F.dayofmonth("ts") < 3)
    at = f"file://{tmp_path}/log"
    records.repartition(8, "client_ip").write.parquet(at)
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(at)
    jobs.start_snapshots(jobs.stream_counts(stream, "30 days"), f"file://{tmp_path}/out", f"file://{tmp_path}/h", f"file://{tmp_path}/state", {"availableNow": True}, deltas=2).awaitTermination()
    columns = ("kind", "view", "stamp", "item", "query_num")
    assert sorted(pairs(history.read(spark, f"file://{tmp_path}/h").select(*columns))) == sorted(pairs(rollup.hourly_snapshot(records).select(*columns)))
    assert max(len([x for x in os.listdir(tmp_path / "out" / h) if x.startswith("batch")]) for h in os.listdir(tmp_path / "out") if h.startswith("hour")) <= 4


def test_retention_deletes_days(spark, tmp_path):
    path = f"file://{tmp_path}/h"
    rows = table(spark, ("a", "20240101000000", "x", 1), ("a", "20240102230000", "x", 2), ("a", "20240103050000", "x", 3), ("a", "20240103070000", "x", 4), ("b", "20240401000000", "x", 5))
    history.append(rows, path)
    history.retention(spark, path, "20240402060000")
    assert sorted(pairs(history.read(spark, path).select("query_num"))) == [(4,), (5,)]
    assert sorted(x for x in os.listdir(tmp_path / "h") if x.startswith("day")) == ["day=20240103", "day=20240401"]
    history.append(table(spark, ("b", "20240401010000", "x", 6)), path)
    assert sorted(pairs(history.read(spark, path).select("query_num"))) == [(4,), (5,), (6,)]


def test_report_json_is_json(spark):
    odd = 'a"b\\c\td\ne\x01'
    ranked = spark.createDataFrame([("k", odd, 3, 1)], "key string, name string, count bigint, rank int")
    assert json.loads(reports.list_json(ranked).first().body) == [[odd, 3]]
    series = spark.range(4000).select(F.lit("k").alias("key"), F.format_string("%014d", "id").alias("stamp"), "id").withColumnRenamed("id", "value")
    assert len(json.loads(reports.series_json(series).first().body)) == 1500


def test_ticks_are_filled(spark):
    qps = spark.createDataFrame([("k", "20240101000010", 0.5), ("k", "20240101000100", 0.2)], "key string, stamp string, qps double")
    got = sorted(pairs(rates.fill_ticks(qps, "20240101000000", "20240101000040")))
    assert got == [("k", f"202401010000{s}", 0.5 if s == "10" else 0.0) for s in ("00", "10", "20", "30")]
    assert pairs(rates.fill_ticks(qps, "20240101000000", "20240101000000")) == []


def test_follow_from_the_end(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "old").write_text("old line\n")
    os.utime(tmp_path / "log" / "old", (1e9, 1e9))
    (tmp_path / "log" / "new").write_text("new line\n")
    for since, want in ((None, 2), (datetime(2020, 1, 1), 1)):
        out = f"file://{tmp_path}/out{want}"
        lines = jobs.follow(spark, f"file://{tmp_path}/log", since=since).withColumnRenamed("value", "key").groupBy("key").count()
        jobs.start(lines, out, f"file://{tmp_path}/state{want}", {"availableNow": True}).awaitTermination()
        assert jobs.latest(spark, out, "key").count() == want
