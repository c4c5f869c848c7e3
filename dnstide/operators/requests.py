"""Answers for asked views, known or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnstide.operators.counters import keyed, rate, shown_rate


def view_defaults(asked: DataFrame, records: DataFrame) -> DataFrame:
    """``view, qps, success_rate`` of ``asked(view)``: queries a second in the last ten seconds of the log, and the
    success rate; 0.0 and 1.0 for an unknown view, and 1.0 for a rate below 0.1."""
    last = records.agg(F.max("ts").alias("end"))
    timed = records.crossJoin(F.broadcast(last)).withColumn("late", F.col("ts") > F.col("end") - F.expr("INTERVAL 10 SECONDS"))
    sums = keyed(timed, n=F.count("*"), failed=F.count_if(F.col("rcode") == "SERVFAIL"), late=F.count_if("late"))
    joined = asked.join(sums, asked["view"] == sums["key"], "left")
    return joined.select("view", F.coalesce(F.col("late") / 10.0, F.lit(0.0)).alias("qps"), F.coalesce(shown_rate(rate(F.col("n"), F.col("failed"))), F.lit(1.0)).alias("success_rate"))
