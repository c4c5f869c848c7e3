"""Summaries of heavy hitters against exact counts: bounds over merges in any order, and the guaranteed error."""

import random
from collections import Counter

import pytest

from dnstide.operators import heavy


def counts_of(spark, rng):
    """Counts by hour and key, with names that are light in each hour and heavy over all, and ties."""
    rows, exact = [], {}
    for hour in range(16):
        for key in ("*$z", "a$z"):
            own = Counter({f"h{hour}-{i}": rng.choice((9, 10, 11)) for i in range(12)})
            own |= Counter({f"steady{i}": 8 + i for i in range(3)})
            own |= Counter({f"n{rng.randrange(400)}": 1 for _ in range(40)})
            rows += [(hour, key, name, n) for name, n in own.items()]
            exact.setdefault(key, Counter()).update(own)
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "hour int, key string, name string, count bigint"), exact


@pytest.mark.parametrize("n", [1, 7, 999])
def test_bounds(spark, n):
    counts, exact = counts_of(spark, random.Random(n))
    hours = heavy.of_counts(counts, "hour", "key", n=n)
    days = heavy.merged(hours.withColumn("hour", (hours["hour"] / 5).cast("int")), "hour", "key", n=n)
    for parts in (hours, days):
        for size in (n, 5):
            listed = heavy.heaviest(parts, "key", n=size).collect()
            for key, own in exact.items():
                got = {r.name: r for r in listed if r.key == key}
                assert len(got) == min(size, len(own)) or n < size
                unlisted = next(r.unlisted for r in got.values())
                assert all(r.lower <= own[x] <= r.upper for x, r in got.items())
                assert all(c <= unlisted for x, c in own.items() if x not in got)
                assert unlisted <= sum(own.values()) / (min(n, size) + 1)
                top = {x for x, c in own.items() if c >= sorted(own.values(), reverse=True)[min(size, len(own)) - 1]}
                assert {x for x, r in got.items() if r.lower > unlisted} <= top
    if n == 999:
        assert all(r.lower == r.upper == exact[r.key][r.name] for r in heavy.heaviest(days, "key", n=n).collect())


def test_order_and_edges(spark):
    counts, exact = counts_of(spark, random.Random(3))
    hours = heavy.of_counts(counts, "hour", "key", n=10).persist()
    left, right = hours.where("hour < 11"), hours.where("hour >= 11")
    one = heavy.merged(heavy.merged(left, "key", n=10).unionByName(right.drop("hour")), "key", n=10)
    two = heavy.merged(left.drop("hour").unionByName(heavy.merged(right, "key", n=10)), "key", n=10)
    for df in (one, two):
        assert all(r.lower <= exact[r.key][r.name] <= r.upper for r in heavy.heaviest(df, "key", n=10).collect())
    odd = spark.createDataFrame([("k", None, 5), ("k", "", 2), (None, "x", 3)], "key string, name string, count bigint")
    assert sorted((r.key or "-", r.name, r.lower, r.upper) for r in heavy.heaviest(heavy.of_counts(odd, "key"), "key", n=3).collect()) == [("-", "x", 3, 3), ("k", "", 2, 2)]
    assert heavy.heaviest(heavy.of_counts(odd.where("false"), "key"), "key", n=3).collect() == []
    with pytest.raises(ValueError):
        heavy.of_counts(odd, "key", n=0)
