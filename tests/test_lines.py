"""Edge lines of the parser, and the counters' rules for names and keys."""

from pyspark.sql import functions as F

from dnstide.operators import counters
from dnstide.sources import logs

HEAD = "02-Jul-2013 11:36:36.273 client"


def line(ip="203.119.80.41", view="interval:", name="www14998.test.com", rtype="A", rcode="NXDOMAIN", tail="+ NS NE NT ND NC test.com"):
    return f"{HEAD} {ip} 57867: view {view} {name} IN {rtype} {rcode} {tail}"


def frame(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def reasons(spark, *lines):
    df = frame(spark, *lines)
    return [r[0] for r in df.select(logs.reason(F.col("value"))).collect()]


def test_rejects(spark):
    sample = line(tail="+ NS NE NT ND NC")
    assert reasons(spark, sample, line(), line(view="interval"), "", " ", "a b", line(tail="")) == ["zone", None, "colon", "view", "view", "view", "zone"]


def test_accepted_is_no_reason(spark):
    lines = [line(), line(view="v"), line(tail="+ NS"), line(tail="+ NS NE NT ND NC test.com more"), "", "  " + line(), line(view=":")]
    df = frame(spark, *lines)
    assert logs.accepted(df).count() == df.where(logs.reason(F.col("value")).isNull()).count() == 4


def test_fields(spark):
    got = logs.accepted(frame(spark, line().replace(" client ", "   client  "))).first()
    assert (got.client_ip, got.view, got.domain, got.rtype, got.rcode, got.zone) == ("203.119.80.41", "interval", "www14998.test.com", "A", "NXDOMAIN", "test.com")
    assert got.ts.isoformat() == "2013-07-02T11:36:36.273000"


def test_zone_loses_a_character_before_more_tokens(spark):
    got = logs.accepted(frame(spark, line(tail="+ NS NE NT ND NC test.com; y"))).first()
    assert got.zone == "test.com"


def test_bad_time_is_null(spark):
    assert logs.accepted(frame(spark, line().replace("Jul", "Xxx"))).first().ts is None


def test_names(spark):
    lines = [line(name="a" * 31), line(name="a" * 32), line(name="baidu.com"), line(name="baidu.com."), line(name="A.com"), line(name="a.com")]
    r = logs.accepted(frame(spark, *lines))
    names = {x["name"]: x["count"] for x in counters.name_counts(r, "domain").where("key = '*$test.com'").collect()}
    assert names == {"a" * 31 + ".": 1, "baidu.com.": 2, "A.com.": 1, "a.com.": 1}
    assert {x["key"]: x["count"] for x in counters.query_totals(r).collect()} == {"*$test.com": 6, "interval$test.com": 6}


def test_long_key_is_dropped_and_star_counts_twice(spark):
    fits, long = "v" * (64 - len("$test.com")), "v" * (65 - len("$test.com"))
    r = logs.accepted(frame(spark, line(view=fits + ":"), line(view=long + ":"), line(view="*:")))
    assert {x["key"]: x["count"] for x in counters.query_totals(r).collect()} == {f"{fits}$test.com": 1, "*$test.com": 4}


def test_long_v6_text_is_no_client(spark):
    r = logs.accepted(frame(spark, line(ip="2001:0db8:0000:0000:0000:0000:0000:0001")))
    assert counters.name_counts(r, "client_ip").count() == 0
    assert counters.rcode_counts(r).count() == 2
