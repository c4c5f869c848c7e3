"""Lookups by one sorted pass against those by exploded candidates."""

import random

import pytest

from dnstide.operators import lookups, nested


def dotted(n):
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


@pytest.mark.parametrize("seed", range(3))
def test_longest_prefix(spark, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(32) for _ in range(8)] + [0, (1 << 32) - 1]
    near = lambda: (rng.choice(base) ^ rng.getrandbits(rng.choice([0, 4, 12, 20]))) & 0xFFFFFFFF
    prefixes = {}
    for _ in range(400):
        size = rng.randrange(1, 33)
        prefixes[near() >> (32 - size) << (32 - size), size] = None if rng.random() < 0.1 else f"net{len(prefixes)}"
    table = spark.createDataFrame([(n, s, i) for (n, s), i in prefixes.items()], "net long, len int, info string")
    texts = {dotted(near()) for _ in range(1500)} | {dotted(n) for n, _ in prefixes} | {"::1", "", "1.2.3", "1.2.3.4.5", "01.2.3.4", "1.2.3.256", "10.0.0.1\n"}
    addresses = spark.createDataFrame([(x, i) for i, x in enumerate(sorted(texts))] + [(None, -1)], "client_ip string, count long")
    got = sorted(map(repr, map(tuple, nested.longest_prefix(addresses, table).collect())))
    want = []
    for r in addresses.collect():
        parts, best = (r.client_ip or "").split("."), None
        if len(parts) == 4 and all(p.isascii() and p.isdigit() and str(int(p)) == p and int(p) < 256 for p in parts):
            ip = sum(int(p) << s for p, s in zip(parts, (24, 16, 8, 0)))
            best = next((prefixes[k] for n in range(32, 0, -1) if (k := (ip >> (32 - n) << (32 - n), n)) in prefixes), None)
        want.append(repr((r.client_ip, best, r["count"])))
    assert got == sorted(want)


def test_no_prefixes(spark):
    table = spark.createDataFrame([], "net long, len int, info string")
    addresses = spark.createDataFrame([("1.2.3.4", 5)], "client_ip string, count long")
    assert [tuple(r) for r in nested.longest_prefix(addresses, table).collect()] == [("1.2.3.4", None, 5)]
    assert nested.longest_prefix(addresses.where("false"), table).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_prefix_ancestor(spark, seed):
    rng = random.Random(seed)
    label = lambda: rng.choice(["a", "b", "ab", "com", "z", "", "é", "a-b"])
    texts = {".".join(label() for _ in range(rng.randrange(1, 6))) + rng.choice(["", "."]) for _ in range(800)} | {"", ".", "x" * 40}
    zones = {".".join(label() for _ in range(rng.randrange(1, 4))) + "." for _ in range(60)} | ({".", "com"} if seed else {"com."})
    names = spark.createDataFrame([(x,) for x in texts] * 2 + [(None,)], "name string").repartition(3)
    table = spark.createDataFrame([(x,) for x in zones] + [(None,)], "zone string")
    got = sorted(map(repr, map(tuple, nested.prefix_ancestor(names, table).collect())))
    assert got == sorted(map(repr, map(tuple, lookups.closest_ancestor(names, table).collect())))
