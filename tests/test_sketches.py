"""Sketches of different names: united over hours and views, within the stated error of exact numbers."""

from pyspark.sql import functions as F

from dnstide.operators.counters import distinct_estimates, distinct_names, distinct_sketches


def test_error(spark):
    n = 40_000
    some = F.concat(F.lit("n"), F.pmod(F.xxhash64("id"), F.lit(9000)).cast("string"))
    log = spark.range(n).select((F.col("id") % 24).cast("string").alias("hour"), F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("view"), F.lit("z").alias("zone"), some.alias("domain"), F.concat(F.lit("10.0.0."), (F.col("id") % 7).cast("string")).alias("client_ip"))
    sketches = distinct_sketches(log, "hour").persist()
    for part in (F.lit(True), F.col("hour").isin("3", "4", "5"), F.col("hour") == "0"):
        exact = {(r.key, k): r[k] for r in distinct_names(log.where(part)).collect() for k in ("domains", "clients")}
        got = {(r.key, r.kind): r.estimate for r in distinct_estimates(sketches.where(part)).collect()}
        assert got.keys() == exact.keys()
        assert all(abs(got[k] - exact[k]) <= 0.05 * exact[k] for k in got)
        assert all(got[k] == exact[k] for k in got if k[1] == "clients")
    assert distinct_estimates(distinct_sketches(log.where("false"), "hour")).collect() == []
