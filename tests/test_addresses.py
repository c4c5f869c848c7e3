import ipaddress

from pyspark.sql import functions as F

from dnstide.functions.addresses import ipv4, ipv6, is_loopback, same_network, subnet
from dnstide.operators import lookups


def test_subnets(spark):
    texts = ["10.0.0.0/0", "10.0.0.0/33", "10.0.0.0", "10.0.0/8", "10.0.0.0/8x", "10.9.9.9/8", "256.0.0.1/8", "01.2.3.4/8", "255.255.255.255/32", "", None]
    got = [r.s and tuple(r.s) for r in spark.createDataFrame([(t,) for t in texts], "c string").select(subnet(F.col("c")).alias("s")).collect()]
    assert got == [None] * 5 + [(10 << 24, 8), None, None, ((1 << 32) - 1, 32), None, None]


def test_v4(spark):
    texts = ["0.0.0.0", "10.1.2.3", "255.255.255.255", "1.2.3", "a.b.c.d", "::1"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "c string").select(ipv4(F.col("c"))).collect()]
    assert got == [int(ipaddress.IPv4Address(t)) for t in texts[:3]] + [None] * 3


def test_same_network(spark):
    rows = [("10.1.0.1", "10.1.255.1", 16, 24, True), ("10.1.0.1", "10.2.0.1", 16, 16, False), ("10.1.0.1", "11.1.0.1", -3, 5, True), ("10.0.0.1", "10.0.0.1", 64, 64, True), ("10.0.0.1", "::1", 0, 0, False), ("2001:db8::1", "2001:db8::2", 126, 128, True), ("2001:db8::1", "2001:db8::2", 127, 300, False), ("2001:db8::1", "2001:db8:0::1", 128, 300, True), ("x", "x", 1, 1, False)]
    df = spark.createDataFrame(rows, "a string, b string, am int, bm int, want boolean").withColumn("a6", ipv6("a")).withColumn("b6", ipv6("b"))
    for r in df.select("want", same_network(F.col("a"), F.col("b"), F.col("am"), F.col("bm"), F.col("a6"), F.col("b6")).alias("got")).collect():
        assert r.got == r.want


def test_v6(spark):
    texts = ["::", "::1", "1::", "2001:db8::ff00:42:8329", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "FE80::A", "::ffff:1.2.3.4", "1:2:3:4:5:6:10.0.0.1", "1:2:3:4::5:6:7:8", ":::", "1::2::3", "12345::", "1:2", ":1:2:3:4:5:6:7", "g::", "", "1.2.3.4", "::1.2.3", "1:2:3:4:5:6:7:8:9", "a:" * 5000, None]

    def plain(t):
        try:
            return ipaddress.IPv6Address(t).packed if t else None
        except ValueError:
            return None

    got = [r[0] and bytes(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "c string").select(ipv6("c")).collect()]
    assert got == [plain(t) for t in texts]


def test_loopback(spark):
    df = spark.createDataFrame([(t,) for t in ("127.0.0.1", "::1", "0:0:0:0:0:0:0:1", "127.0.0.2", "x", None)], "c string").withColumn("p", ipv6("c"))
    assert [r[0] for r in df.select(is_loopback(F.col("c"), F.col("p"))).collect()] == [True, True, True, False, False, False]


def test_longest_prefix(spark):
    table = spark.createDataFrame([("10.0.0.0/8", "a", 1), ("10.1.0.0/16", "b", 2), ("10.1.1.0/24", "c", 3), ("10.2.0.0/15", "d", 4), ("127.0.0.1/32", "lo", 5), ("10.9.9.9/8", "again", 6)], "cidr string, info string, n int")
    placed = lookups.subnet_insert(table, "n")
    assert {r.n: r.status for r in placed.collect()} == {1: "SUCCEED", 2: "SUCCEED", 3: "SUCCEED", 4: "SUCCEED", 5: "SUCCEED", 6: "DUP_KEY"}
    ips = spark.createDataFrame([("10.1.1.9", 1), ("10.1.2.1", 1), ("10.3.0.1", 1), ("10.4.0.1", 1), ("127.0.0.1", 1), ("1.1.1.1", 1), ("::1", 1)], "client_ip string, count bigint")
    got = {r.client_ip: r.info for r in lookups.subnet_lpm(ips, placed.where("status = 'SUCCEED'")).collect()}
    assert got == {"10.1.1.9": "c", "10.1.2.1": "b", "10.3.0.1": "d", "10.4.0.1": "a", "127.0.0.1": "lo", "1.1.1.1": None, "::1": None}


def test_closest_ancestor(spark):
    odd = spark.createDataFrame([(n,) for n in ("x.a..com.", ".com.", "a..", "..")], "name string")
    held = spark.createDataFrame([("a.com.",), (".com.",), (".",)], "zone string")
    assert {r.name: r.zone for r in lookups.closest_ancestor(odd, held).collect()} == {"x.a..com.": ".com.", ".com.": ".com.", "a..": ".", "..": "."}
    zones = spark.createDataFrame([(".",), ("com.",), ("z1.com.",)], "zone string")
    names = spark.createDataFrame([(n,) for n in ("a.z1.com", "z1.com.", "b.z2.com", "x.org", "n" * 32, ".")], "name string")
    got = {r.name: r.zone for r in lookups.closest_ancestor(names, zones).collect()}
    assert got == {"a.z1.com": "z1.com.", "z1.com.": "z1.com.", "b.z2.com": "com.", "x.org": ".", "n" * 32: None, ".": "."}
