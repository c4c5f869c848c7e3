"""SimHash near-dedup: covering locality-sensitive hashing over 64-bit fingerprints.

Fingerprints link when they differ in at most ``radius`` bits. The tables are covering (Pagh, 2016): each bit gets a
code of ``radius + 1`` bits, and for each of the ``2 ** (radius + 1) - 1`` nonzero vectors a table keeps the bits whose
code has an odd product with the vector. The codes of up to ``radius`` differing bits span too few dimensions, so some
vector has an even product with all of them, and each pair within the radius agrees in all kept bits of its table: no
link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnstide.llm.shared import connected_components, settle, shuffled, spread


def shingle_hashes(text: bytes | None, words: int, seed: int = 42) -> np.ndarray:
    """Hashes of the shingles of UTF-8 text: A-Z lower-cased, words between ASCII blanks, shingles of ``words`` words
    with repeats (fewer words: the whole sequence; none: nothing)."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, size = b" ".join(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size + 1) - 1
    n = max(1, len(parts) - words + 1)
    last = ends[min(words, len(parts)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip((ends - size)[:n].tolist(), last.tolist())), np.uint64, n)


def fingerprint(text: bytes | None, words: int, seed: int = 42) -> int:
    """SimHash of the shingles of UTF-8 text; none: 0. Signed."""
    return fold_hashes(shingle_hashes(text, words, seed))


def fold_hashes(hashes: np.ndarray) -> int:
    """SimHash of hashes: a bit is 1 if it is in over half of them. Signed."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for texts of any length
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, fp bigint)`` for each row of ``docs``; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(x.as_py(), words, seed) for x in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp bigint")


def cover_masks(radius: int, seed: int = 20240607) -> list[int]:
    """The covering masks, as signed 64-bit numbers. Codes are dealt evenly over the nonzero vectors and shuffled."""
    size = (1 << (radius + 1)) - 1
    codes = np.random.default_rng(seed).permutation(np.resize(np.arange(1, size + 1), 64))
    masks = [sum(1 << bit for bit, code in enumerate(codes.tolist()) if (code & v).bit_count() % 2) for v in range(1, size + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = 4, hot: int = 1000) -> DataFrame:
    """Links ``(a, b)`` between distinct values of ``fp`` that connect the same fingerprints as all links within
    ``radius`` do.

    A bucket of up to ``hot`` fingerprints is joined with itself, and a link is given by the first table in which its
    ends meet. A larger bucket would make all its pairs, so there each fingerprint is instead filed under every point
    at most ``ceil(radius / 2)`` kept-out bits away: ends within the radius share such a midpoint, and each
    fingerprint of a point links to the least one there, which is at most ``2 * ceil(radius / 2)`` away. With an even
    radius both ways connect the same; with an odd one every bucket takes the first way.
    """
    masks = cover_masks(radius)
    array = F.array(*(F.lit(m) for m in masks))
    filed = fps.select("fp", F.posexplode(F.transform(array, lambda m: F.col("fp").bitwiseAND(m))).alias("t", "key"))
    hot_keys = filed.groupBy("t", "key").count().where(F.col("count") > hot).select("t", "key").withColumn("is_hot", F.lit(True))
    if radius % 2:
        marked = filed.withColumn("is_hot", F.lit(False))
    else:
        hot_keys = settle(hot_keys)
        marked = filed.join(spread(hot_keys), ["t", "key"], "left").withColumn("is_hot", F.coalesce("is_hot", F.lit(False)))
        if hot_keys.isEmpty():
            marked, hot_keys = filed.withColumn("is_hot", F.lit(False)), None
    cold = marked.where("not is_hot").select("t", "key", "fp")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.array_position(F.transform(array, lambda m: differ.bitwiseAND(m) == 0), True) - 1
    left, right = cold.withColumnRenamed("fp", "a"), cold.withColumnRenamed("fp", "b")
    near = shuffled(left).join(right, ["t", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= radius)).where(first == F.col("t")).select("a", "b")
    if radius % 2 or hot_keys is None:
        return near
    return near.union(_midpoint_links(marked.where("is_hot").select("t", "fp"), masks, radius // 2))


def _midpoint_links(rows: DataFrame, masks: list[int], reach: int) -> DataFrame:
    """``(a, b)`` for the fingerprints of hot buckets, through the points within ``reach`` flips of free bits."""
    free = [[1 << b if b < 63 else -(1 << 63) for b in range(64) if not (m >> b) & 1] for m in masks]
    bits = F.element_at(F.array(*(F.array(*(F.lit(x) for x in f)) for f in free)), F.col("t") + 1)
    rows = rows.withColumn("bits", bits)
    points = rows.select("t", "fp", F.col("fp").alias("point"))
    ring = rows.select("t", "fp", F.col("fp").alias("point"), "bits", F.lit(0).alias("from"))
    for _ in range(reach):
        ring = ring.select("t", "fp", F.posexplode(F.expr("slice(bits, from + 1, size(bits))")).alias("at", "bit"), "point", "bits", "from")
        ring = ring.select("t", "fp", F.col("point").bitwiseXOR(F.col("bit")).alias("point"), "bits", (F.col("from") + F.col("at") + 1).alias("from"))
        points = points.union(ring.select("t", "fp", "point"))
    lows = spread(points.groupBy("t", "point").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1"))
    return shuffled(points).join(lows, ["t", "point"]).where("fp != low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4, hot: int = 1000) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs(doc_id, text, ...)``: ``component_id`` is the smallest
    doc_id reachable through fingerprints that differ in at most ``radius`` bits, equal ones included.

    Null and empty texts have fingerprint 0 and link like any other. A row without doc_id keeps null and counts for
    reachability; where a component has no doc_id at all, component_id is null. Rows that repeat a doc_id are each
    fingerprinted, and texts of any length whole. An empty table gives an empty one; other columns are not read.
    """
    fps = settle(fingerprints(docs, words))
    distinct = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    components = connected_components(links(distinct.select("fp"), radius, hot))
    joined = distinct.join(components, distinct["fp"] == components["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    least = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    named = settle(joined.join(spread(least), "component").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
