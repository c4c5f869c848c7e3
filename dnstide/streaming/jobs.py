"""The same statistics over a growing log. Windows follow the lines' own time; lines later than the watermark are
dropped. Logs arrive as closed files moved into a folder: a rotated file is a new file.

Results are written batch by batch: a batch's folder is replaced if the batch runs again, and the latest batch that
holds a group has its final figure."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dnstide.functions.names import valid_key
from dnstide.functions.stamps import stamp
from dnstide.operators.counters import keys_of
from dnstide.operators.topn import topn
from dnstide.plans.rollup import KINDS, named, snapshot_rows
from dnstide.sources import history
from dnstide.sources.files import Folder

LATE = "10 minutes"
#: How often a running job looks for new lines.
POLL = {"processingTime": "1 second"}


def follow(spark: SparkSession, folder: str, pattern: str = "*", since: datetime | None = None) -> DataFrame:
    """The lines of all files in the folder, those there and those to come; with ``since`` only of files last written
    then or later, so that a first start may begin at the log's end."""
    lines = spark.readStream.option("pathGlobFilter", pattern).text(folder)
    return lines if since is None else lines.where(F.col("_metadata.file_modification_time") >= F.lit(since)).select("value")


def stream_counts(records: DataFrame, late: str = LATE) -> DataFrame:
    """``kind, hour, key, name, count`` since the hour mark, for domains, clients, response codes and record types;
    ``hour`` is the end of the hour, at which the counts are flushed."""
    names = named(*map(F.col, ("domain", "client_ip", "rcode", "rtype")))
    told = records.withWatermark("ts", late).select("ts", F.explode(keys_of(F.col("view"), F.col("zone"))).alias("key"), names.alias("names"))
    rows = told.where(valid_key(F.col("key"))).select("ts", "key", F.inline("names")).where("name is not null")
    counts = rows.groupBy(F.window("ts", "1 hour").alias("w"), "kind", "key", "name").count()
    return counts.select("kind", stamp(F.col("w.end")).alias("hour"), "key", "name", "count")


def stream_qps(records: DataFrame, late: str = LATE) -> DataFrame:
    """``key, stamp, qps`` of each ten seconds with any query, stamped with their end."""
    told = records.withWatermark("ts", late).select("ts", F.explode(keys_of(F.col("view"), F.col("zone"))).alias("key")).where(valid_key(F.col("key")))
    counts = told.groupBy(F.window("ts", "10 seconds").alias("w"), "key").count()
    return counts.select("key", stamp(F.col("w.end")).alias("stamp"), (F.col("count") / 10.0).alias("qps"))


def start(stream: DataFrame, path: str, checkpoint: str, trigger: dict = POLL, change: Callable[[DataFrame], DataFrame] = lambda df: df, mode: str = "update") -> StreamingQuery:
    """Write each batch's changed rows, after ``change``, to its own folder under ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(write).start()


def latest(spark: SparkSession, path: str, *keys: str, only: Column | None = None) -> DataFrame:
    """What start() has written: of each group the row of its latest batch; ``only`` where a condition holds."""
    rows = spark.read.option("basePath", path).parquet(path)
    rows = rows.withColumns({c: F.col(c).cast("string") for c in keys if c in ("hour", "stamp")})
    return _latest_of(rows if only is None else rows.where(only), *keys)


def _latest_of(rows: DataFrame, *keys: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, *(F.col("r")[c].alias(c) for c in rest))


def live_topn(counts: DataFrame, n: int | None = None) -> DataFrame:
    """Top lists of the domains and clients of counts that stream_counts gave, per hour."""
    return topn(counts.where(F.col("kind").isin(*KINDS[:2])), n, "kind", "hour")


#: Batches of an hour that lie side by side before they are laid together.
DELTAS = 16


def start_snapshots(counts: DataFrame, path: str, table: str, checkpoint: str, trigger: dict = POLL, deltas: int = DELTAS) -> StreamingQuery:
    """Run stream_counts into folders by hour and batch under ``path`` and keep the hourly rows in the history
    ``table``: each batch writes the hours it has changed anew, whole, so that a running stream's history is as late as
    its last batch. Only those hours are read, and an hour is its laid-together counts and at most ``deltas`` batches.

    A batch's folder is ``<number>-0``; ``<number>-1`` holds all up to that number, and takes their place: a batch that
    runs again writes its own folder only.
    """

    def write(batch: DataFrame, number: int) -> None:
        # the session of a stream with state plans without adaptive execution, so that each of its tasks would write
        # a file for each hour: rows are laid down as they come, and dealt by hour in the session that began the stream
        spark, name = counts.sparkSession, f"{number:012d}-0"
        root = Folder(spark, path)
        raw = root.of("_raw").of(f"batch-{number:012d}")
        batch.write.mode("overwrite").parquet(raw.path)
        rows = spark.read.schema(batch.schema).parquet(raw.path).withColumn("batch", F.lit(name))
        rows.hint("rebalance", "hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("hour", "batch").parquet(path)
        raw.delete()
        changed = [x for x in root.names() if x.startswith("hour=") and root.of(x).of(f"batch={name}").exists()]
        for hour in changed:
            older = [x for x in root.of(hour).names() if x.startswith("batch=") and x < f"batch={name}"]
            if len(older) > deltas:
                _lay_together(spark, root, hour, older, f"batch={number - 1:012d}-1")
        if changed:
            held = _latest_of(_read_hours(spark, root, changed), "kind", "hour", "key", "name")
            history.append(snapshot_rows(held), table, F.concat(F.lit("hour-"), "stamp"))

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(write).start()


def _read_hours(spark: SparkSession, root: Folder, hours: list[str]) -> DataFrame:
    rows = spark.read.option("basePath", root.path)
    return rows.schema("kind string, key string, name string, count bigint, hour string, batch string").parquet(*(root.of(h).path for h in hours))


def _lay_together(spark: SparkSession, root: Folder, hour: str, older: list[str], name: str) -> None:
    """One folder of the latest counts in the place of an hour's older ones. They go last: beside it they say nothing
    new."""
    if not root.of(hour).of(name).exists():
        rows = _read_hours(spark, root, [hour]).where(F.concat(F.lit("batch="), "batch").isin(older))
        whole = root.of(f"_whole.{hour}.{name}")
        _latest_of(rows, "kind", "hour", "key", "name").drop("hour").write.mode("overwrite").parquet(whole.path)
        whole.move(root.of(hour).of(name))
    for x in older:
        if x != name:
            root.of(hour).of(x).delete()
