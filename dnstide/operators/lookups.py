"""Lookups as joins: subnets by longest prefix, closest ancestors of names, exact names. A lookup table that is stored
has a known size, by which the optimizer broadcasts it or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnstide.functions.addresses import ipv4, network, subnet
from dnstide.functions.names import ancestors, full_name

def parse_cidr(table: DataFrame) -> DataFrame:
    """``table(cidr, ...)`` with ``net``, ``len`` and ``status``, SUCCEED or FORMAT_ERROR."""
    parsed = table.withColumn("_s", subnet(F.col("cidr")))
    return parsed.select(*table.columns, "_s.net", "_s.len", F.when(F.col("_s").isNull(), "FORMAT_ERROR").otherwise("SUCCEED").alias("status"))


def subnet_insert(table: DataFrame, order: str) -> DataFrame:
    """``table(cidr, info, <order>)`` with ``net``, ``len`` and ``status``: the first of equal prefixes is inserted,
    later ones are DUP_KEY."""
    parsed = parse_cidr(table)
    first = parsed.where("net is not null").groupBy("net", "len").agg(F.min(order).alias("_first"))
    status = F.when(F.col("net").isNull(), "FORMAT_ERROR").when(F.col(order) == F.col("_first"), "SUCCEED").otherwise("DUP_KEY")
    return parsed.drop("status").join(first, ["net", "len"], "left").withColumn("status", status).select(*parsed.columns)


def subnet_table(table: DataFrame, order: str) -> DataFrame:
    """``net, len, info`` of the prefixes that subnet_insert would insert, by one aggregate."""
    good = parse_cidr(table).where("net is not null")
    return good.groupBy("net", "len").agg(F.min_by("info", order).alias("info"))


def subnet_remove(table: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prefixes of ``table(net, len, ...)`` that stay, and ``asked(cidr)`` with a status: FAILED if absent."""
    wanted = parse_cidr(asked)
    kept = table.join(wanted.where("net is not null").select("net", "len"), ["net", "len"], "left_anti")
    there = wanted.join(table.select("net", "len", F.lit(True).alias("_there")), ["net", "len"], "left")
    status = F.when(F.col("status") == "FORMAT_ERROR", "FORMAT_ERROR").when(F.col("_there"), "SUCCEED").otherwise("FAILED")
    return kept, there.select("cidr", "net", "len", status.alias("status"))


def subnet_list(table: DataFrame) -> DataFrame:
    """The prefixes in trie order, network first and the shorter prefix first, each with the number of all."""
    size = table.agg(F.count("*").alias("size"))
    return table.select("net", "len", "info").crossJoin(F.broadcast(size)).orderBy("net", "len")


def subnet_lpm(addresses: DataFrame, table: DataFrame) -> DataFrame:
    """``client_ip, info, count`` of the distinct ``addresses(client_ip, count)``: the info of the longest prefix that
    holds the address, null if none does or it isn't a v4 address. One equi-join on the network of each prefix length
    that the table has."""
    lengths = [r["len"] for r in table.select("len").distinct().collect()]  # 32 at most
    ips = addresses.withColumn("_ip", ipv4(F.col("client_ip")))
    nets = F.transform(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: F.struct(network(F.col("_ip"), n).alias("net"), n.alias("len")))
    met = ips.where("_ip is not null").select("client_ip", F.inline(nets)).join(table.select("net", "len", "info"), ["net", "len"])
    best = met.groupBy("client_ip").agg(F.max_by("info", "len").alias("info"))
    return addresses.join(best, "client_ip", "left").select("client_ip", "info", "count")


def closest_ancestor(names: DataFrame, zones: DataFrame) -> DataFrame:
    """``name, zone`` for the distinct ``names(name)``: the deepest of ``zones(zone)`` that is the name or an
    ancestor of it, null if none is or the name is too long."""
    asked = names.select("name").distinct()
    full = full_name(F.col("name"))
    held = asked.select("name", F.posexplode(F.when(full.isNotNull(), ancestors(full))).alias("depth", "zone"))
    best = held.join(zones.select("zone").distinct(), "zone").groupBy("name").agg(F.min_by("zone", "depth").alias("zone"))
    return asked.join(best, "name", "left").select("name", "zone")


def exact_lookup(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """``asked(key, name)`` with the count of the name, in full form, under the key; null if absent."""
    full = asked.withColumn("_name", full_name(F.col("name")))
    held = counts.select(F.col("key").alias("_key"), F.col("name").alias("_held"), "count")
    return full.join(held, (F.col("key") == F.col("_key")) & (F.col("_name") == F.col("_held")), "left").select("key", "name", "count")
