"""Lookups in nested ranges by one sorted pass: the longest prefix of an address, the closest ancestor of a name.

Prefixes and zones nest, so what holds at a place is the last one opened that isn't closed: a stack. Each address or
name is one row of the pass, whatever lengths or labels there are. Tasks get a stretch of the sorted order each, and
with it what was opened before the stretch and still holds."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnstide.functions.addresses import ipv4
from dnstide.functions.names import full_name, without_root

#: Addresses of a stretch share this many leading bits, so a stretch has at most 65,536 addresses and twice that many
#: prefixes; of shorter prefixes there are at most 131,071.
LEAD = 16
#: Names sampled for each stretch.
SAMPLED = 20


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of prefixes in the order of ``stretch, net, len``: the places ``at`` at which what holds changes, and to what.
    ``held`` is false where nothing holds."""
    columns: list[list] = [[], [], [], []]
    stack: list[tuple[int, str]] = []  # the place after the last address, and the info
    now = None

    def put(at: int, *what) -> None:
        if columns[1] and columns[0][-1] == now and columns[1][-1] == at:
            for c in columns:
                c.pop()
        for c, x in zip(columns, (now, at, *what)):
            c.append(x)

    def close(upto: int | None) -> None:
        while stack and (upto is None or stack[-1][0] <= upto):
            end, _ = stack.pop()
            put(end, bool(stack), stack[-1][1] if stack else None)

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.string()))], names=["stretch", "at", "held", "info"])
        columns[:] = [[], [], [], []]
        return out

    for b in batches:
        for stretch, net, size, info in zip(*(c.to_pylist() for c in b.columns)):
            if stretch != now:
                close(None)
                if len(columns[0]) > 10_000:
                    yield flush()
                now = stretch
            close(net)
            stack.append((net + (1 << (32 - size)), info))
            put(net, True, info)
    close(None)
    yield flush()


_CHANGES = "stretch bigint, at bigint, held boolean, info string"


def disjoint_ranges(table: DataFrame) -> DataFrame:
    """``stretch, at, held, info``: from the address ``at`` up to the next row's of the stretch, ``info`` is that of
    the longest of the prefixes ``table(net, len, info)``. Prefixes are different from each other."""
    short = table.where(F.col("len") <= LEAD).select(F.lit(0).cast("bigint").alias("stretch"), "net", "len", "info")
    changes = short.repartition(1).sortWithinPartitions("net", "len").mapInArrow(_sweep, _CHANGES)  # 131,071 rows at most
    until = F.lead("at").over(Window.partitionBy("stretch").orderBy("at"))
    spans = changes.withColumn("until", until).where("held")
    first, last = (F.col("at") / (1 << LEAD)).cast("bigint"), (F.col("until") / (1 << LEAD)).cast("bigint") - 1
    whole = spans.select(F.explode(F.sequence(first, last)).alias("stretch"), "info")  # a row a stretch at most
    outer = whole.select("stretch", (F.col("stretch") * (1 << LEAD)).alias("net"), F.lit(LEAD).alias("len"), "info")
    inner = table.where(F.col("len") > LEAD).select(F.shiftright("net", LEAD).cast("bigint").alias("stretch"), "net", "len", "info")
    return outer.union(inner).repartition("stretch").sortWithinPartitions("stretch", "net", "len").mapInArrow(_sweep, _CHANGES)


def longest_prefix(addresses: DataFrame, table: DataFrame) -> DataFrame:
    """``client_ip, info, count`` of the distinct ``addresses(client_ip, count)``: the info of the longest of the
    different prefixes ``table(net, len, info)`` that holds the address, null if none does or it isn't a v4 address.
    The ranges that prefixes leave disjoint and the addresses are merged in stretches of 65,536 addresses."""
    ip = ipv4(F.col("client_ip"))
    ranges = disjoint_ranges(table).select("stretch", "at", F.struct("info").alias("hit"), F.lit(None).cast("string").alias("client_ip"), F.lit(None).cast("bigint").alias("count"), F.lit(0).alias("is_address"))
    placed = addresses.select(ip.alias("at"), "client_ip", "count")
    stretch = F.coalesce(F.shiftright("at", LEAD).cast("bigint"), -1 - F.pmod(F.xxhash64("client_ip"), F.lit(1 << LEAD)))  # others are dealt by hash
    asked = placed.select(stretch.alias("stretch"), "at", F.lit(None).cast("struct<info: string>").alias("hit"), "client_ip", "count", F.lit(1).alias("is_address"))
    order = Window.partitionBy("stretch").orderBy("at", "is_address")
    merged = ranges.union(asked).withColumn("hit", F.last("hit", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return merged.where("is_address = 1").select("client_ip", F.col("hit.info").alias("info"), "count")


def label_key(full: Column) -> Column:
    """A full name's labels, last first, each with a zero byte after it: an ancestor's key starts its names' keys."""
    labels = F.reverse(F.split(without_root(full), r"\."))
    return F.when(full == ".", F.lit("")).otherwise(F.concat(F.array_join(labels, "\0"), F.lit("\0"))).cast("binary")


def prefix_ancestor(names: DataFrame, zones: DataFrame) -> DataFrame:
    """``name, zone`` for the distinct ``names(name)``: the deepest of ``zones(zone)`` that is the name or an ancestor
    of it, null if none is or the name is too long.

    Names and zones are range-partitioned by sampled names; a zone is sent to each stretch that it reaches into, which
    at a stretch's start are as many as a name has labels at most."""
    spark = names.sparkSession
    full = full_name(F.col("name"))
    asked = names.select("name").distinct().select(label_key(full).alias("key"), F.col("name").alias("text"), F.lit(True).alias("asked"))
    held = zones.where(F.col("zone").endswith(".")).distinct().select(label_key(F.col("zone")).alias("key"), F.col("zone").alias("text"), F.lit(False).alias("asked"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = names.count()
    sample = names.sample(min(1.0, SAMPLED * n / max(1, total)), seed=5).select(label_key(full).alias("key")).where("key is not null")
    keys = sorted(bytes(r.key) for r in sample.toLocalIterator())  # about SAMPLED * n
    cuts = sorted(set(keys[SAMPLED::SAMPLED]))
    sent = spark.sparkContext.broadcast(cuts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = sent.value
        for b in batches:
            which, at = [], []
            for i, (key, text, asked) in enumerate(zip(*(c.to_pylist() for c in b.columns))):
                first = hash(text) % (len(cuts) + 1) if key is None else bisect_right(cuts, key)
                last = first if asked else bisect_right(cuts, key + b"\xff")
                which += [i] * (last - first + 1)
                at += range(first, last + 1)
            yield pa.record_batch([pa.array(at, pa.int32()), *b.take(pa.array(which, pa.int64())).columns], names=["stretch", "key", "text", "asked"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[bytes, str]] = []
        for b in batches:
            found: tuple[list, list] = ([], [])
            for key, text, asked in zip(*(b.column(c).to_pylist() for c in ("key", "text", "asked"))):
                if key is None:
                    found[0].append(text)
                    found[1].append(None)
                    continue
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if asked:
                    found[0].append(text)
                    found[1].append(stack[-1][1] if stack else None)
                else:
                    stack.append((key, text))
            yield pa.record_batch([pa.array(c, pa.string()) for c in found], names=["name", "zone"])

    placed = asked.union(held).mapInArrow(place, "stretch int, key binary, text string, asked boolean")
    return placed.repartitionById(len(cuts) + 1, F.col("stretch")).sortWithinPartitions("key", "asked").mapInArrow(walk, "name string, zone string")
