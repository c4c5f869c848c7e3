"""History tables: files by day and batch, sorted by view and stamp, with a fine and a one-day table for each kind.
Writers write beside the table first and then rename, so that a reader sees whole batches."""

from __future__ import annotations

import tempfile
import uuid
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dnstide.functions.stamps import bound
from dnstide.sources.files import Folder

KEEP_DAYS = 90
#: Batches without a name of their own are called so and a number.
FRESH = "rows-"


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the folder that driver and executors share. Where none is set, as in tests, a local session makes
    a temporary one; on a cluster that would be a folder of one machine, so it raises."""
    base, own = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and own.isDefined():
        base = own.get()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def append(rows: DataFrame, path: str, batch: str | Column | None = None) -> None:
    """Add stamped rows to a table of files by day and batch; all that is there stays.

    A ``batch`` with a name, or a column of names, may be written again: it then replaces what has its name, in all
    days for a name, in the days of the new rows for a column. Without a name the rows are a batch of their own.
    One job at a time writes to a table.
    """
    repair(rows.sparkSession, path)
    if isinstance(batch, str) and batch.startswith(FRESH):
        raise ValueError(f"names that start with {FRESH} are given out by append")
    named = F.lit(f"{FRESH}{uuid.uuid4().hex}" if batch is None else batch) if not isinstance(batch, Column) else batch
    days = rows.withColumn("day", F.substring("stamp", 1, 8)).withColumn("batch", named.cast("string"))
    dealt = days.hint("rebalance", "day", "batch").sortWithinPartitions("day", "batch", "view", "stamp")
    root = Folder(rows.sparkSession, path)
    new = root.of(f"_new.{uuid.uuid4().hex}")
    dealt.write.partitionBy("day", "batch").parquet(new.path)
    stale = {x for x in root.names() if x.startswith("day=")} if isinstance(batch, str) else set()
    for day in [x for x in new.names() if x.startswith("day=")]:
        own, at, there = new.of(day), root.of(day), set(root.of(day).names())
        if not there:
            at.make()
        for name in [x for x in own.names() if x.startswith("batch=")]:
            if name in there:
                at.of(name).move(new.of(f"replaced.{day}.{name}"))
            own.of(name).move(at.of(name))
        stale.discard(day)
    for day in stale:
        root.of(day).of(f"batch={batch}").delete()
    new.delete()


def repair(spark: SparkSession, path: str) -> None:
    """Finish what a writer that was stopped had begun: a day whose new rows are written takes its place again."""
    root = Folder(spark, path)
    for name in root.names():
        if name.startswith("_old."):
            _, day, number = name.split(".")
            if not root.of(day).exists():
                new = root.of(f"_day.{day}.{number}")
                (new if new.exists() else root.of(name)).move(root.of(day))
            root.of(name).delete()
    for name in root.names():
        if name.startswith(("_new.", "_day.")):
            root.of(name).delete()


def _replace_day(spark: SparkSession, path: str, day: str, rows: DataFrame) -> None:
    """Put ``rows``, with their batches, in a day's place. Until its new rows are whole the day stays as it was; a
    writer that stops between the two renames is finished by repair."""
    root, number = Folder(spark, path), uuid.uuid4().hex
    new, old = root.of(f"_day.{day}.{number}"), root.of(f"_old.{day}.{number}")
    rows.drop("day").write.partitionBy("batch").parquet(new.path)
    root.of(day).move(old)
    new.move(root.of(day))
    old.delete()


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows with their day and batch as texts, as they were written: ``02`` is no number."""
    kept = spark.read.option("basePath", path).parquet(path).schema
    kinds = StructType([StructField(f.name, StringType() if f.name in ("day", "batch") else f.dataType) for f in kept])
    return spark.read.option("basePath", path).schema(kinds).parquet(path)


def compact(spark: SparkSession, path: str, before: str | None = None) -> None:
    """Lay the batches without a name of each day before the stamp's day together; named ones stay, as they may be
    written again."""
    repair(spark, path)
    root = Folder(spark, path)
    for day in root.names():
        fresh = [x for x in root.of(day).names() if x.startswith(f"batch={FRESH}")] if day.startswith("day=") else []
        if len(fresh) > 1 and (before is None or day[4:] < before[:8]):
            rows = _stored(spark, path).where(F.col("day") == day[4:])
            one = F.when(F.col("batch").startswith(FRESH), f"{FRESH}{uuid.uuid4().hex}").otherwise(F.col("batch"))
            _replace_day(spark, path, day, rows.withColumn("batch", one).hint("rebalance", "batch").sortWithinPartitions("batch", "view", "stamp"))


def read(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Stored rows with ``start <= stamp < end``; only the days between are read."""
    rows = _stored(spark, path)
    if start is not None:
        rows = rows.where((F.col("day") >= start[:8]) & (F.col("stamp") >= start))
    if end is not None:
        rows = rows.where((F.col("day") <= end[:8]) & (F.col("stamp") < end))
    return rows.drop("day", "batch")


def oldest(now: str, days: int = KEEP_DAYS) -> str:
    """The oldest stamp to keep at the stamp ``now``."""
    return (bound(now) - timedelta(days=days)).strftime("%Y%m%d%H%M%S")


def delete_before(spark: SparkSession, path: str, stamp: str) -> None:
    """Delete stored rows older than ``stamp``: the folders of whole days, and the day of the stamp is written anew
    without them, under the same batch names."""
    repair(spark, path)
    root = Folder(spark, path)
    for day in root.names():
        if day.startswith("day=") and day[4:] < stamp[:8]:
            root.of(day).delete()
    edge = f"day={stamp[:8]}"
    if root.of(edge).exists():
        rows = _stored(spark, path).where(F.col("day") == edge[4:])
        kept = rows.where(F.col("stamp") >= stamp)
        if kept.isEmpty():
            root.of(edge).delete()
        elif not rows.where(F.col("stamp") < stamp).isEmpty():
            _replace_day(spark, path, edge, kept.hint("rebalance", "batch").sortWithinPartitions("batch", "view", "stamp"))


def retention(spark: SparkSession, path: str, now: str, days: int = KEEP_DAYS) -> None:
    """Delete the stored rows that are more than ``days`` old at the stamp ``now``."""
    delete_before(spark, path, oldest(now, days))
