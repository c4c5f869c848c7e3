"""Counts per view key: ``view$zone``, and ``*$zone`` over all views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnstide.functions.names import full_name, rcode_label, rtype_label, valid_key, view_key


def keys_of(view: Column, zone: Column) -> Column:
    return F.array(view_key(view, zone), view_key(F.lit("*"), zone))


def view_keys(records: DataFrame) -> DataFrame:
    """Each record under both of its keys, without keys that are too long. Raw rows double: aggregate first
    (``keyed``) where only sums are asked for."""
    return records.select("*", F.explode(keys_of(F.col("view"), F.col("zone"))).alias("key")).where(valid_key(F.col("key")))


def keyed(records: DataFrame, *by: str, **sums: Column) -> DataFrame:
    """``key, *by`` and the ``sums``, which are aggregates that add up; ``count`` if none are given.

    Records are aggregated by view and zone first, and only those sums are dealt to both keys and added again: the raw
    rows aren't doubled, and the hot ``*`` keys add a row per view. A view named ``*`` adds to ``*`` twice.
    """
    sums = sums or {"count": F.count("*")}
    once = records.groupBy("view", "zone", *by).agg(*(x.alias(n) for n, x in sums.items()))
    twice = once.select(F.explode(keys_of(F.col("view"), F.col("zone"))).alias("key"), *by, *sums).where(valid_key(F.col("key")))
    return twice.groupBy("key", *by).agg(*(F.sum(n).alias(n) for n in sums))


def name_counts(records: DataFrame, field: str, *by: str) -> DataFrame:
    """``key, *by, name, count`` of ``domain`` or ``client_ip``; names that are too long aren't counted."""
    named = records.withColumn("name", full_name(F.col(field))).where("name is not null")
    return keyed(named, *by, "name")


def rcode_counts(records: DataFrame, *by: str) -> DataFrame:
    return keyed(records.withColumn("rcode", rcode_label(F.col("rcode"))), *by, "rcode")


def rtype_counts(records: DataFrame, *by: str) -> DataFrame:
    return keyed(records.withColumn("rtype", rtype_label(F.col("rtype"))), *by, "rtype")


def query_totals(records: DataFrame) -> DataFrame:
    return keyed(records)


def success_rate(records: DataFrame) -> DataFrame:
    """``key, success_rate``: the share of answers other than SERVFAIL."""
    sums = keyed(records, n=F.count("*"), failed=F.count_if(F.col("rcode") == "SERVFAIL"))
    return sums.select("key", rate(F.col("n"), F.col("failed")).alias("success_rate"))


def rate(n: Column, failed: Column) -> Column:
    """1.0 where there was no query."""
    return F.when(n > 0, (n - failed).cast("double") / n).otherwise(1.0)


def shown_rate(value: Column) -> Column:
    """A rate below 0.1 is reported and stored as 1.0."""
    return F.when(value < 0.1, 1.0).otherwise(value)


def _both_names(records: DataFrame, *by: str) -> DataFrame:
    """``view, zone, *by, kind, name``: of each record its domain and its client, by one reading of the log."""
    kinds = (("domains", "domain"), ("clients", "client_ip"))
    names = F.array(*(F.struct(F.lit(kind).alias("kind"), full_name(F.col(c)).alias("name")) for kind, c in kinds))
    return records.select("view", "zone", *by, F.inline(names)).where("name is not null")


def distinct_names(records: DataFrame) -> DataFrame:
    """``key, domains, clients``: numbers of different names held."""
    held = keyed(_both_names(records), "kind", "name")
    return held.groupBy("key").agg(*(F.count_if(F.col("kind") == kind).alias(kind) for kind in ("domains", "clients")))


#: Binary logarithm of a sketch's registers: a relative standard error of 1.04 / 2 ** (SKETCH / 2), 1.6 %.
SKETCH = 12


def distinct_sketches(records: DataFrame, *by: str) -> DataFrame:
    """``key, *by, kind, sketch``: HyperLogLog sketches of the different domains and clients. Sketches of views are
    made first and united under the ``*`` keys."""
    once = _both_names(records, *by).groupBy("view", "zone", *by, "kind").agg(F.hll_sketch_agg("name", SKETCH).alias("sketch"))
    dealt = once.select(F.explode(keys_of(F.col("view"), F.col("zone"))).alias("key"), *by, "kind", "sketch").where(valid_key(F.col("key")))
    return dealt.groupBy("key", *by, "kind").agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_estimates(sketches: DataFrame) -> DataFrame:
    """``key, kind, estimate``: about how many different names the united sketches of a key have met, of any hours and
    without the log; within 5 % (three standard errors) nearly always, and exact where they are few."""
    return sketches.groupBy("key", "kind").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def total_views(records: DataFrame) -> DataFrame:
    """``zone, name, count`` of domains over all views: what the ``*`` keys hold."""
    counts = name_counts(records, "domain").where(F.col("key").startswith("*$"))
    return counts.select(F.substring("key", 3, 1 << 20).alias("zone"), "name", "count")


def views_list(records: DataFrame) -> DataFrame:
    """All keys, in byte order."""
    return keyed(records).select("key").orderBy("key")
