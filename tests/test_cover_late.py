"""Dyadic covers against exact sums at every boundary; late lines against a full recomputation."""

import random

import pytest
from pyspark.sql import functions as F

from dnstide.plans import cover, late, rollup
from dnstide.sources import fixture, logs


@pytest.fixture(scope="module")
def records(spark, sf_dir):
    return logs.accepted(fixture.log_lines(spark, sf_dir)).cache()


def test_cover_is_exact_and_small():
    rng = random.Random(1)
    for _ in range(3000):
        a = rng.randrange(5000)
        b = a + rng.randrange(0, 3000)
        nodes = cover.cover(a, b)
        assert [h for level, n in nodes for h in range(n << level, (n + 1) << level)] == list(range(a, b))
        assert len(nodes) <= 2 * max(1, (b - a).bit_length()) + 3


def test_sums_at_every_boundary(spark, tmp_path):
    path = f"file://{tmp_path}/levels"
    rows = [("domain", "v", f"202401{1 + h // 24:02}{h % 24:02}0000", f"i{h % 5}", 1 << (h % 40)) for h in range(1, 60)] + [("ip", "w", "20240101050000", "x", 7)]
    hourly = spark.createDataFrame(rows, "kind string, view string, stamp string, item string, query_num bigint")
    cover.write_levels(hourly, path)
    rng = random.Random(2)
    stamps = sorted({r[2] for r in rows}) + ["20231231000000", "20240105000000", "20240101003000", "20240102235959"]
    for _ in range(12):
        start, end = sorted(rng.sample(stamps, 2))
        want = {}
        for k, v, s, i, n in rows:
            if v == "v" and start <= s < end:
                want[k, i] = want.get((k, i), 0) + n
        assert {(r.kind, r.item): r.query_num for r in cover.range_sums(spark, path, "v", start, end).collect()} == want
    assert cover.range_sums(spark, path, "v", "20240102000000", "20240102000000").collect() == []
    plan = cover.range_sums(spark, path, "v", "20240101000000", "20240102000000")._jdf.queryExecution().toString()
    assert "PartitionFilters: [((" in plan and "level" in plan.split("PartitionFilters")[1]


def test_late_lines(spark, records):
    on_time = (F.col("rcode") != "SERVFAIL") | (F.dayofmonth("ts") > 20)
    counts = late.hourly_counts(records.where(on_time)).cache()
    hourly = rollup.snapshot_rows(counts)
    daily = rollup.daily_rollup(hourly)
    changed = late.changed_counts(counts, late.hourly_counts(records.where(~on_time))).cache()
    new_hourly, new = late.with_late_hours(hourly, changed)
    columns = ("kind", "view", "stamp", "item", "query_num")
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    whole = rollup.hourly_snapshot(records).cache()
    assert rows(new_hourly) == rows(whole)
    assert 0 < new.count() < whole.count()
    assert rows(late.with_late_days(daily, new_hourly, new)) == rows(rollup.daily_rollup(whole))
