"""Embedding near-dedup: random-hyperplane hashing in several tables, exact cosines, connected components.

Equal vectors under one label are one node. A node's sign bits make a key in each table; nodes that share a key are
compared, a pair once and only if its signatures, 128 of the bits, differ in no more places than a pair within the
threshold ever does. In a bucket of many nodes pairs aren't made:
its nodes are dealt into chunks, and each pair of chunks is one product of two matrices, from which only the number of
links of each node and a spanning tree of the links leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnstide.llm.shared import connected_components, settle, spread

#: Chance that a pair at the threshold meets in no table.
MISS = 2e-5
#: Nodes that share a key by chance, in the mean: sets the number of bits of a table.
BY_CHANCE = 16
#: Sign bits that each row of a table carries, so that chance pairs aren't compared, and the words that hold them.
SIGNATURE, WORDS = 128, ("s0", "s1")
#: Nodes of a bucket that are compared as pairs of rows, and nodes of a chunk beyond that.
HOT, CHUNK = 64, 256


class Planes:
    """Sign bits of vectors: ``tables`` tables of ``bits`` bits; the first ``SIGNATURE`` of all bits tell near pairs
    from chance ones."""

    def __init__(self, bits: int, threshold: float, seed: int = 7):
        self.bits, self.seed = bits, seed
        differ = math.acos(threshold) / math.pi  # chance that a plane parts a pair at the threshold
        self.tables = max(-(-SIGNATURE // bits), math.ceil(math.log(MISS) / math.log(1 - (1 - differ) ** bits)))
        self.most = math.ceil(SIGNATURE * differ + 6 * math.sqrt(SIGNATURE * differ * (1 - differ)))

    @classmethod
    def for_size(cls, rows: int, threshold: float) -> Planes:
        """As many bits as leave about ``BY_CHANCE`` of ``rows`` nodes to a key; 4 at a time."""
        return cls(min(32, max(8, 4 * math.ceil(math.log2(max(1, rows / BY_CHANCE)) / 4))), threshold)

    def signs(self, values: np.ndarray, planes: dict[int, np.ndarray]) -> np.ndarray:
        """Table numbers of each row of ``values``."""
        dim = values.shape[1]
        if dim not in planes:
            planes[dim] = np.random.default_rng([self.seed, dim]).standard_normal((dim, self.tables * self.bits))
        weights = (1 << np.arange(self.bits)).astype(np.int64)
        return ((values @ planes[dim] > 0).reshape(-1, self.tables, self.bits) * weights).sum(2)

    def signatures(self, signs: np.ndarray) -> np.ndarray:
        """The first bits of each row, as words of 64."""
        bits = (signs[:, :, None] >> np.arange(self.bits)) & 1
        words = np.packbits(bits.reshape(len(signs), -1)[:, :SIGNATURE].astype(np.uint8), axis=1)
        return np.ascontiguousarray(words).view(np.int64)


def units(vectors: pa.Array) -> np.ndarray:
    """Rows of equal length, scaled to length 1 in double precision; by the largest component first, so that nothing
    overflows."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def filed(nodes: DataFrame, planes: Planes) -> DataFrame:
    """``(key, t, node, s0, s1, ...)``: for each row of ``nodes(node, label_hash, embedding)`` a row a table, with its
    signature."""
    words = WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                dims = np.array([len(x) for x in part.column(2)])
                for dim in np.unique(dims).tolist():
                    own = part.take(pa.array(np.flatnonzero(dims == dim)))
                    signs = planes.signs(units(own.column(2)), made)
                    n, t = len(signs), planes.tables
                    labels = own.column(1).to_numpy().astype(np.uint64)
                    key = (labels[:, None] ^ ((np.arange(t, dtype=np.uint64)[None, :] << np.uint64(32)) + signs.astype(np.uint64))) * np.uint64(0x9E3779B97F4A7C15)
                    key = (key ^ (key >> np.uint64(29)) ^ np.uint64(dim)) * np.uint64(0xBF58476D1CE4E5B9)
                    which = np.repeat(np.arange(n), t)
                    packed = planes.signatures(signs)[which]
                    columns = [pa.array(key.view(np.int64).ravel()), pa.array(np.tile(np.arange(t, dtype=np.int32), n)), own.column(0).take(pa.array(which)), *(pa.array(packed[:, i]) for i in range(len(words)))]
                    yield pa.record_batch(columns, names=["key", "t", "node", *words])

    return nodes.select("node", "label_hash", "embedding").mapInArrow(run, "key bigint, t int, node bigint, " + ", ".join(f"{w} bigint" for w in words))


def pair_links(cold: DataFrame, nodes: DataFrame, planes: Planes, threshold: float) -> DataFrame:
    """Links ``(a, b)`` between the nodes that share a key of ``cold``, each once, but for those that share one of an
    earlier table: that bucket is large and gives them."""
    left = cold.withColumnsRenamed({"node": "a", **{w: f"{w}a" for w in WORDS}})
    right = cold.drop("t").withColumnsRenamed({"node": "b", **{w: f"{w}b" for w in WORDS}})
    differ = reduce(Column.__add__, (F.bit_count(F.col(f"{w}a").bitwiseXOR(F.col(f"{w}b"))) for w in WORDS))
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & (differ <= planes.most)).groupBy("a", "b").agg(F.min("t").alias("t"))
    side = nodes.select("node", "label", "embedding")
    for k in ("a", "b"):
        pairs = pairs.join(side.select(F.col("node").alias(k), F.struct("label", "embedding").alias(f"{k}_v")), k)
    pairs = pairs.where((F.col("a_v.label") == F.col("b_v.label")) & (F.size("a_v.embedding") == F.size("b_v.embedding")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                dims = np.array([len(x) for x in part.column(3)])
                for dim in np.unique(dims).tolist():
                    own = part.take(pa.array(np.flatnonzero(dims == dim)))
                    x, y = units(own.column(3)), units(own.column(4))
                    near = np.flatnonzero((x * y).sum(1) >= threshold)
                    first = (planes.signs(x[near], made) == planes.signs(y[near], made)).argmax(1)
                    yield own.select(["a", "b"]).take(pa.array(near[first == own.column(2).to_numpy()[near]]))

    return pairs.select("a", "b", "t", "a_v.embedding", F.col("b_v.embedding").alias("other")).mapInArrow(verify, "a bigint, b bigint")


def block_links(hot: DataFrame, nodes: DataFrame, planes: Planes, threshold: float) -> DataFrame:
    """``(a, b, others)`` of the large buckets ``hot(key, t, node, ..., size)``: rows with ``b`` are a spanning forest
    of the links of a pair of chunks, rows without one add ``others`` to the links of ``a``, by number of vectors."""
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    dealt = hot.select("key", "t", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    dealt = dealt.select("key", "t", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"))
    rows = dealt.join(nodes.select("node", "label_hash", "n", "embedding"), "node").withColumn("dim", F.size("embedding"))

    def compare(block: pa.Table) -> pa.Table:
        made: dict[int, np.ndarray] = {}
        node, n, second = (block[c].to_numpy() for c in ("node", "n", "second"))
        t, alone = block["t"][0].as_py(), block["i"][0].as_py() == block["j"][0].as_py()
        vectors = units(block["embedding"].combine_chunks())
        signs = planes.signs(vectors, made)
        x, y = (np.arange(len(node)), np.arange(len(node))) if alone else (np.flatnonzero(~second), np.flatnonzero(second))
        links = np.zeros((len(x), len(y)), bool)
        for at in range(0, len(x), 32):  # a pair counts in the first table in which it meets
            part = x[at : at + 32]
            good = (vectors[part] @ vectors[y].T) >= threshold
            r, c = np.nonzero(good)
            good[r, c] = (signs[part[r]] == signs[y[c]]).argmax(1) == t
            links[at : at + 32] = good
        if alone:
            np.fill_diagonal(links, False)
        others = np.zeros(len(node), np.int64)
        others[x] += links @ n[y]
        if not alone:
            others[y] += links.T @ n[x]
        root = np.arange(len(node))
        if links.any():
            while True:  # least node reached, step by step
                before = root.copy()
                root[x] = np.minimum(root[x], np.where(links, root[y][None, :], len(node)).min(1, initial=len(node)))
                root[y] = np.minimum(root[y], np.where(links, root[x][:, None], len(node)).min(0, initial=len(node)))
                if (root == before).all():
                    break
        tree, some = np.flatnonzero(root != np.arange(len(node))), np.flatnonzero(others)
        a = np.concatenate([node[tree], node[some]])
        b = pa.array(np.concatenate([node[root[tree]], np.zeros(len(some), np.int64)]), mask=np.arange(len(a)) >= len(tree))
        return pa.table({"a": pa.array(a), "b": b, "others": pa.array(np.concatenate([np.zeros(len(tree), np.int64), others[some]]))})

    return rows.groupBy("key", "t", "label_hash", "dim", "i", "j").applyInArrow(compare, "a bigint, b bigint, others bigint")


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, hot_size: int = HOT) -> DataFrame:
    """``(vec_id, label, n_links, component_id, kept)`` for each row of ``vectors(vec_id, label, embedding, ...)``.

    Rows link when their labels are equal, their vectors equally long and the cosine, in double precision, is at least
    ``threshold``. ``n_links`` counts the other rows linked directly; ``component_id`` is the smallest vec_id reachable,
    the row's own if none; ``kept`` says that it is the row's own. Null and zero vectors, and those with a null or
    non-finite component, link with nothing, nor does anything under a null label. Copies are compared once, as one
    node with a number of rows. Rows that repeat a vec_id each count. A row without vec_id links like any other and is
    kept if its component has no vec_id. Vectors may be of any length; other columns are not read, whatever their
    names. An empty table gives an empty one.

    Buckets of over ``hot_size`` nodes take another way to the same links.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    plain = F.transform("embedding", lambda x: F.when(x == 0, 0).otherwise(x).cast(vectors.schema["embedding"].dataType.elementType))  # -0 is 0
    h1, h2 = F.xxhash64("label", plain), F.xxhash64(F.lit(7), "label", plain)
    rows = vectors.select("vec_id", "label", "embedding", F.when(usable, h1).alias("h1"), F.when(usable, h2).alias("h2"))
    groups = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes = settle(groups.select(F.monotonically_increasing_id().alias("node"), F.xxhash64("label").alias("label_hash"), "*"))
    largest = nodes.groupBy("label_hash").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    planes = Planes.for_size(largest, threshold)
    file = filed(nodes, planes)
    hot = settle(file.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > hot_size))
    many = not hot.isEmpty()
    links = settle(pair_links(file.join(spread(hot), "key", "left_anti") if many else file, nodes, planes, threshold))
    both = links.union(links.select("b", "a")).join(nodes.select(F.col("node").alias("b"), "n"), "b").select("a", F.col("n").alias("others"))
    edges = links
    if many:
        blocks = settle(block_links(file.join(spread(hot), "key"), nodes, planes, threshold))
        edges, both = links.union(blocks.where("b is not null").select("a", "b")), both.union(blocks.where("b is null").select("a", "others"))
    components = connected_components(edges).withColumnRenamed("node", "member")
    others = both.groupBy(F.col("a").alias("other_of")).agg(F.sum("others").alias("others"))
    joined = nodes.select("node", "low", "n", "h1", "h2").join(components, F.col("node") == F.col("member"), "left").join(others, F.col("node") == F.col("other_of"), "left")
    joined = joined.select("h1", "h2", "low", F.coalesce("component", "node").alias("component"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    least = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    named = settle(joined.join(spread(least), "component").select("h1", "h2", "component_id", "n_links"))
    out = rows.select("vec_id", "label", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", "label", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
