"""Near dedup by the Jaccard similarity of word shingles: SimHash and MinHash bands find pairs, the shingles decide.

Two texts link when their sets of shingles have a similarity of at least the threshold. Equal sets are one node. First
the SimHash fingerprints of the sets are searched through operator 10's covering tables, so sets within ``RADIUS`` bits
meet, and the pairs that are similar are joined up. At a similarity of 0.8 fingerprints differ in about 10 of 64 bits,
where no few tables cover; so that no link is lost, MinHash bands then find pairs among what is still apart. A pair at
0.8 meets in none of ``BANDS`` bands of ``ROWS`` minima with a chance of (1 - 0.8 ** 4) ** 24, 3e-6; every pair that
meets is verified, but for pairs that verified links connect anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnstide.llm.shared import connected_components, settle, shuffled, spread, unpacked, whole_row
from dnstide.llm.simhash import fold_hashes, links as near_fingerprints, shingle_hashes

#: Bits by which fingerprints of a pair may differ.
RADIUS = 4
BANDS, ROWS = 24, 4
#: Sets of one bucket that are compared as pairs, where links left them apart; larger buckets are compared as blocks.
HOT = 32
#: Shingles of a chunk of a large bucket, how many chunks there are before chunks grow, the most shingles of a chunk,
#: from which on there are more chunks again, and sets of a chunk.
BLOCK, CHUNKS, LARGEST, SETS = 1 << 15, 8, 1 << 21, 192
#: Bytes of the matrices in which a group's sets are compared.
STRIP_BYTES = 32 << 20
#: Links that a task joins up by itself before components are sought over all tasks.
LINKS = 1 << 16
#: Different orders by which buckets choose their pivots.
PIVOTS = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Sketch:
    """Band keys of sets of hashes."""

    def __init__(self, seed: int = 20240607):
        rng = np.random.default_rng(seed)
        self.flip, self.times = (rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
        self.times |= np.uint64(1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), 1024):  # bounded memory for texts of any length
            least = np.minimum(least, ((hashes[at : at + 1024] ^ self.flip) * self.times).min(1))
        keys = np.zeros(BANDS, np.uint64)
        for row in least.reshape(BANDS, ROWS).T:
            keys = (keys ^ row) * _MIX
            keys ^= keys >> np.uint64(29)
        return keys.view(np.int64)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, text_hash, set, n, fp, keys)`` for each row: a hash of its set of shingles, its size, SimHash and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch()
        for b in batches:
            sets, sizes, fps, keys = [], [], [], []
            for x in b.column(2):
                own = np.unique(shingle_hashes(x.as_py(), words))
                sets.append(xxhash.xxh64_intdigest(own.tobytes()))
                sizes.append(len(own))
                fps.append(fold_hashes(own))
                keys.append(sketch(own) if len(own) else [])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "set", "n", "fp", "keys"])

    rows = docs.select("doc_id", _text_hash().alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash bigint, set bigint, n bigint, fp bigint, keys array<bigint>")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(set, text)``, one text for each row of ``wanted(set, text_hash)``."""
    rows = docs.select(_text_hash().alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return rows.join(spread(wanted), "text_hash").select("set", "text").dropDuplicates(["set"])


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``(set, own binary)``: the sorted shingle hashes of each set of ``wanted(set, text_hash)``; a settled table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([np.unique(shingle_hashes(x.as_py(), words)).tobytes() for x in b.column(1)], pa.binary())], names=["set", "own"])

    return settle(_texts(docs, wanted).mapInArrow(run, "set bigint, own binary"))


def shared_sizes(own: DataFrame) -> DataFrame:
    """``(set, most)``: how many shingles of each set of ``own(set, own)`` another of them has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), b.column(1)):
                hashes = np.frombuffer(x.as_buffer(), np.int64)
                yield pa.record_batch([pa.array(np.full(len(hashes), name, np.int64)), pa.array(hashes)], names=["set", "shingle"])

    found = settle(own.mapInArrow(run, "set bigint, shingle bigint"))
    alone = found.groupBy("shingle").agg(F.count("*").alias("sets"), F.min("set").alias("set")).where("sets = 1").groupBy("set").agg(F.count("*").alias("alone"))
    return found.groupBy("set").count().join(alone, "set", "left").select("set", (F.col("count") - F.coalesce("alone", F.lit(0))).alias("most"))


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, words: int, threshold: float) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` whose sets have at least the similarity, by the shingles of their texts."""
    pairs = settle(pairs.distinct())
    # settled, so that the texts are only shuffled where what is wanted of them is more than a broadcast takes
    wanted = settle(pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct().join(sets.select("set", "text_hash"), "set"))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both >= threshold * (len(one) + len(two) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    own = shingle_sets(docs, wanted, words)
    left, right = own.withColumnsRenamed({"set": "a", "own": "x"}), own.withColumnsRenamed({"set": "b", "own": "y"})
    return settle(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(similar, "a bigint, b bigint"))


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """The places of links ``(a, b)`` that connect what all of them do."""
    parent, taken = {}, []

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for at, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        if (x := root(x)) != (y := root(y)):
            parent[x] = y
            taken.append(at)
    return taken


def joined_up(links: DataFrame, stretch: int = LINKS) -> DataFrame:
    """``(node, component)`` of the links ``(a, b)``, as connected_components gives them.

    Links are dealt by range to tasks of about ``stretch`` of them, those of a hub by their other ends too, and each
    task puts a link to its least node in the place of each node's links. Rounds over all tasks then have stars to
    start from; where all links are one stretch nothing is left for them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
        if held:
            nodes, ends = np.unique(np.concatenate(held, 1), return_inverse=True)
            x, y = ends.reshape(2, -1)
            least, before = np.arange(len(nodes)), None
            while before is None or (least != before).any():
                before, low, least = least, np.minimum(least[x], least[y]), least.copy()
                np.minimum.at(least, before[x], low)
                np.minimum.at(least, before[y], low)
                least = least[least]
            yield pa.record_batch([pa.array(nodes), pa.array(nodes[least])], names=["node", "component"])

    parts = max(1, -(-links.count() // stretch))
    dealt = links.select("a", "b").repartitionByRange(parts, "a", "b") if parts > 1 else links.select("a", "b").repartition(1)
    stars = settle(dealt.mapInArrow(run, "node bigint, component bigint"))
    return stars if parts == 1 else connected_components(stars.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b")))


def block_links(members: DataFrame, own: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between sets of different components in the buckets of ``members(t, key, set, n, component)``,
    as many as connect what all such links do.

    The sets of a bucket are dealt to chunks, and each two chunks are compared in one group, so a set travels once for
    each chunk, not for each other set. Chunks have ``block`` shingles, or more where there would be over ``CHUNKS``
    of them, and there are never more chunks than sets. A group holds two chunks, by ``LARGEST`` bounded but for a
    longer text, and matrices of ``STRIP_BYTES``.
    """

    def run(group: pa.Table) -> pa.Table:
        names, component = group["set"].to_numpy(), group["component"].to_numpy()
        own = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["own"]]
        n = np.array([len(x) for x in own])
        _, shingle, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        common = (times > 1)[shingle]
        row, column = np.repeat(np.arange(len(own)), n)[common], (np.cumsum(times > 1) - 1)[shingle[common]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        chunk, i, j = (group[c].to_numpy() for c in ("chunk", "i", "j"))
        one, two = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        both, width = np.zeros((len(one), len(two))), max(1, STRIP_BYTES // (4 * len(own)))
        for at in range(0, int(np.count_nonzero(times > 1)), width):  # a strip of shingles; float32 is exact below 2^24
            x, y = np.searchsorted(column, [at, at + width])
            has = np.zeros((len(own), width), np.float32)
            has[row[x:y], column[x:y] - at] = 1
            both += has[one] @ has[two].T
        near = (both >= threshold * (n[one][:, None] + n[two] - both) - 1e-9) & (component[one][:, None] != component[two])
        x, y = np.nonzero(near)
        x, y = one[x], two[y]
        at = _forest(component[x], component[y])
        return pa.table({"a": names[x[at]], "b": names[y[at]]})

    n, sets = F.sum("n"), F.count("*")
    chunks = F.least(sets, F.greatest(F.least(F.ceil(n / block), F.lit(CHUNKS)), F.ceil(n / LARGEST), F.ceil(sets / SETS)))
    weights = members.groupBy("t", "key").agg(chunks.alias("chunks"))
    dealt = members.join(spread(weights), ["t", "key"]).withColumn("chunk", F.expr("pmod(xxhash64(set, key), chunks)"))
    dealt = dealt.select("t", "key", "set", "component", "chunk", F.expr("explode(sequence(0, chunks - 1))").alias("other"))
    dealt = dealt.select("t", "key", "set", "component", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    return settle(shuffled(dealt).join(own, "set").groupBy("t", "key", "i", "j").applyInArrow(run, "a bigint, b bigint"))


def _meeting(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of sets of different components in a bucket whose sizes allow the similarity."""
    right = right.select("t", "key", F.col("set").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"))
    fits = F.least("n", "m") >= threshold * F.greatest("n", "m") - 1e-9
    apart = F.col("component") != F.col("other")
    return left.withColumnRenamed("set", "a").join(right, ["t", "key"]).where(apart & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def simhash_pairs(sets: DataFrame, threshold: float, radius: int = RADIUS) -> DataFrame:
    """Pairs ``(a, b)`` of ``sets(set, n, fp)`` by SimHash, whose sizes allow the similarity: the least set of each
    fingerprint with the others of that, and with the least set of each fingerprint that links to it."""
    filled = sets.where("n > 0").select("set", "n", "fp")
    firsts = settle(filled.groupBy("fp").agg(F.min(F.struct("set", "n")).alias("first")))
    one, two = (firsts.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_first")) for end in "ab")
    across = near_fingerprints(firsts.select("fp"), radius).join(spread(one), "a").join(spread(two), "b").select(F.col("a_first").alias("x"), F.col("b_first").alias("y"))
    same = filled.join(spread(firsts), "fp").select(F.struct("set", "n").alias("x"), F.col("first").alias("y")).where("x.set != y.set")
    fits = F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n") - 1e-9
    return same.union(across).where(fits).select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b"))


def _apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` that ``components(node, component)`` don't connect."""
    pairs = pairs.distinct()
    for end in "ab":
        pairs = pairs.join(spread(components.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component"))), end, "left")
    return pairs.where(F.coalesce("a_component", "a") != F.coalesce("b_component", "b")).select("a", "b")


def near_components(docs: DataFrame, sets: DataFrame, words: int, threshold: float, hot: int = HOT) -> DataFrame:
    """``(node, component)`` for the sets that link to others.

    Pairs of near fingerprints come first. Then each set of a bucket is compared with one of them, its pivot (a few different ones over the bands), which takes
    a pair a member, where links don't connect them yet; then, in the buckets that all links left apart, members of different
    components are compared: pair by pair in buckets of up to ``hot`` sets; in larger ones block by block, and only those
    that share enough shingles with others.
    """
    by_simhash = verified(simhash_pairs(sets, threshold), docs, sets, words, threshold)
    filed = sets.select("set", "n", F.posexplode("keys").alias("t", "key"))
    sizes = filed.groupBy("t", "key").agg(F.count("*").alias("size"), F.min_by("set", F.xxhash64("set", F.col("t") % PIVOTS)).alias("pivot")).where("size > 1")
    members = settle(shuffled(filed).join(spread(sizes), ["t", "key"]).where("set != pivot"))
    pairs = members.select(F.least("set", "pivot").alias("a"), F.greatest("set", "pivot").alias("b"))
    links = by_simhash.union(verified(_apart(pairs, joined_up(by_simhash)), docs, sets, words, threshold))
    components = joined_up(links)
    members = members.where("size > 2").select("t", "key", "set", "n", "size")
    members = settle(members.join(spread(components.withColumnRenamed("node", "set")), "set", "left").withColumn("component", F.coalesce("component", "set")))
    parts = members.groupBy("t", "key", "component").agg(F.count("*").alias("sets"))
    mixed = parts.groupBy("t", "key").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("sets", "component")).alias("main")).where("parts > 1")
    mixed = settle(members.join(spread(mixed), ["t", "key"]))
    small, large = mixed.where(F.col("size") <= hot), mixed.where(F.col("size") > hot)
    more = verified(_meeting(small.where("component != main"), small, threshold), docs, sets, words, threshold)
    if not large.isEmpty():
        own = shingle_sets(docs, settle(large.select("set").distinct().join(sets.select("set", "text_hash"), "set")), words)
        able = settle(large.join(spread(shared_sizes(own)), "set").where(F.col("most") >= threshold * F.col("n") - 1e-9))
        more = more.union(block_links(able, own, threshold))
    return components if more.isEmpty() else joined_up(links.union(more))


def near_dedup(docs: DataFrame, words: int = 5, threshold: float = 0.8, hot: int = HOT) -> DataFrame:
    """One row of ``docs(doc_id, text, ...)`` of each component of rows whose sets of shingles have a Jaccard similarity
    of at least ``threshold``; columns as given.

    Shingles are those of SimHash: A-Z lower-cased, words between ASCII blanks, fewer than ``words`` words the whole
    sequence. Texts without a word, null ones included, are equal. The row of the smallest doc_id stays, rows without
    doc_id come last, and of several the text of the smallest hash. Other texts under the same doc_id are other rows.
    Texts are compared whole, however long; columns may have any names; an empty table gives an empty one.
    """
    rows = settle(sketches(docs, words))
    sets = settle(rows.groupBy("set").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("text_hash").alias("hash"))).alias("least")))
    components = near_components(docs, sets, words, threshold, hot)
    least = sets.select("set", "least").join(components.withColumnRenamed("node", "set"), "set", "left").groupBy(F.coalesce("component", "set").alias("component")).agg(F.min("least").alias("least"))
    stay = least.select(F.col("least.doc_id").alias("stay_id"), F.col("least.hash").alias("stay_hash"))
    repeated = rows.groupBy("doc_id", "text_hash").agg((F.count("*") > 1).alias("again"))
    named = stay.join(spread(repeated), F.col("stay_id").eqNullSafe(F.col("doc_id")) & (F.col("stay_hash") == F.col("text_hash")))
    stay = settle(named.select("stay_id", "stay_hash", "again"))
    whole = docs.select(whole_row(docs), F.col("doc_id").alias("own_id"), _text_hash().alias("own_hash"))
    kept = whole.join(spread(stay), F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_hash") == F.col("stay_hash")))
    if stay.where("again").isEmpty():
        return unpacked(kept, docs.columns)
    return unpacked(kept.where("not again").select("row").union(kept.where("again").dropDuplicates(["own_id", "own_hash"]).select("row")), docs.columns)
