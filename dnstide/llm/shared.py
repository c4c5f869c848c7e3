"""What several operators use: settled tables, connected components, ASCII folding."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: [\x20\x09-\x0D]
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(docs: DataFrame, columns: list[str] | None = None) -> Column:
    """The columns of ``docs``, all or those named, in one struct ``row``, so that no name meets another; a name may
    hold dots."""
    names = ((c, c.replace("`", "``")) for c in (docs.columns if columns is None else columns))
    return F.struct(*(F.col(f"`{quoted}`").alias(c) for c, quoted in names)).alias("row")


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that ``row`` holds."""
    return rows.select(*(F.col("row")[c].alias(c) for c in columns))


def filter_texts(docs: DataFrame, keep: Callable) -> DataFrame:
    """The rows of ``docs`` that stay, columns as given: ``keep`` gives a flag for each text of an Arrow array."""

    def run(batches):
        for b in batches:
            yield b.select(["row"]).filter(pa.array(keep(b.column(1)), pa.bool_()))

    row = docs.select(whole_row(docs), F.col("text"))
    return unpacked(row.mapInArrow(run, StructType([row.schema["row"]])), docs.columns)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` or the context's checkpoint folder names. Where neither is set, as in
    tests, a local session makes a temporary one; on a cluster that would be a folder of one machine, so it raises."""
    at, own = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc().getCheckpointDir()
    if not at and own.isDefined():
        at = own.get()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Settled tables that results not yet written may read.
_settled: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete the settled tables of all operators so far; call it when their results are written or not wanted."""
    while _settled:
        discard(spark, _settled.pop())


def settle(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut, a lost executor costs nothing,
    and later plans know its real size."""
    if path is None:
        path = settled_path(df.sparkSession)
        _settled.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_held: dict = {}


def worker_memory(key: tuple, make: Callable):
    """What a worker process keeps from task to task: the last thing asked for, so that stages don't add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``flat``, one after another."""
    return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


class KnownIds:
    """The token ids of words, in bounded memory: ``words`` of them, ``chars`` characters."""

    def __init__(self, words: int, keep: int, chars: int):
        self.words, self.keep, self.chars = words, keep, chars
        self.places: dict = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.spans = np.zeros((1 << 12, 2), np.int64)  # by word: place and number of ids in flat
        self.held = 0

    def full(self, new: Iterable) -> bool:
        """Whether there is no room for ``new`` words."""
        new = list(new)
        return bool(self.places) and (len(self.places) + len(new) > self.words or self.held + sum(map(len, new)) > self.chars)

    def forget(self) -> None:
        """Keep the first words only, as frequent ones come early."""
        self.places = dict(islice(self.places.items(), self.keep))
        self.held = sum(map(len, self.places))
        if self.held > self.chars // 2:
            self.places, self.held = {}, 0
        self.used = int(self.spans[len(self.places) - 1].sum()) if self.places else 0

    def add(self, words: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember the ids of words that aren't known."""
        n, used = len(self.places), self.used
        while n + len(words) > len(self.spans):
            self.spans = np.concatenate([self.spans, np.zeros_like(self.spans)])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[used : used + len(ids)] = ids
        self.spans[n : n + len(words), 0] = used + np.cumsum(sizes) - sizes
        self.spans[n : n + len(words), 1] = sizes
        self.places.update(zip(words, range(n, n + len(words))))
        self.used += len(ids)
        self.held += sum(map(len, words))

    def join(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known words, one after another, and how many each has."""
        starts, sizes = self.spans[np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))].T
        return runs(self.flat, starts, sizes), sizes


def settled_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a settled table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows round robin, so that a join above shuffles both sides by itself and can split hot keys."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that sends neither side whole to the driver: Spark takes an exploded table for no larger than
    what it was exploded from, and would broadcast rows of many times its limit."""
    return df.hint("merge")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph with edges ``(a, b)``, as ``(node, component)`` for each node of an edge;
    ``component`` is the smallest node reached.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each is a minimum per node and a join, so
    no node's neighbours meet in one task, and a hub is split like any hot key of a join. A round ends in a settled
    table, and the one before is deleted. Null ends are ignored; loops give nothing.
    """
    spark, path = edges.sparkSession, settled_path(edges.sparkSession)
    low_high = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = settle(low_high.where(edges["a"].isNotNull() & edges["b"].isNotNull() & (F.col("u") != F.col("v"))).distinct(), path)
    state = _state(now)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = spread(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        lows = spread(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lows, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before_path, path = path, settled_path(spark)
        now = settle(small.union(lows.select("u", F.col("m").alias("v"))).distinct(), path)
        discard(spark, before_path)
        state, before = _state(now), state
        if state == before:
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
