"""Query-log lines: reading, parsing, rejecting, and the latest ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed places of a line's fields, counted from 0.
CLIENT, VIEW, DOMAIN, RTYPE, RCODE, ZONE = 3, 6, 7, 9, 10, 17
TIME_FORMAT = "dd-MMM-yyyy HH:mm:ss.SSS"
#: A view with its colon at its place, and a zone at its own.
ACCEPTED = rf"^ *(?:[^ ]+ +){{{VIEW}}}[^ ]*: +(?:[^ ]+ +){{{ZONE - VIEW - 1}}}[^ ]"
LATEST = 1000


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of closed log files."""
    return spark.read.text(path)


def fields(lines: DataFrame) -> DataFrame:
    """``lines(value, ...)`` with ``ts, client_ip, view, domain, rtype, rcode, zone``, which stand between runs of
    blanks, and their number ``_n``. The view loses its colon; the zone loses its last character where more fields
    follow it. A line whose time can't be read has a null ``ts``; what a short line lacks is null."""
    at = lambda i: F.get("_tokens", F.lit(i))
    cut = lambda c: F.substring(c, F.lit(1), F.char_length(c) - 1)
    return lines.withColumn("_tokens", F.split(F.trim("value"), " +")).select(
        *lines.columns,
        F.try_to_timestamp(F.concat_ws(" ", at(0), at(1)), F.lit(TIME_FORMAT)).alias("ts"),
        at(CLIENT).alias("client_ip"),
        F.regexp_replace(at(VIEW), ":$", "").alias("view"),
        at(DOMAIN).alias("domain"),
        at(RTYPE).alias("rtype"),
        at(RCODE).alias("rcode"),
        F.when(F.size("_tokens") > ZONE + 1, cut(at(ZONE))).otherwise(at(ZONE)).alias("zone"),
        F.size("_tokens").alias("_n"),
    )


def accepted_lines(lines: DataFrame) -> DataFrame:
    """The fields of the lines that have all of them and a colon after the view. One pattern decides, so the filter
    reaches the scan without the parsing."""
    return fields(lines.where(F.col("value").rlike(ACCEPTED))).drop("_n")


def accepted(lines: DataFrame) -> DataFrame:
    return accepted_lines(lines).select("ts", "client_ip", "view", "domain", "rtype", "rcode", "zone")


def reason(value: Column) -> Column:
    """Why a line is rejected: the first missing of view, rcode and zone (what stands before one is there if it is), or
    colon; null if accepted."""
    n = F.size(F.split(F.trim(value), " +"))
    return F.when(value.rlike(ACCEPTED), F.lit(None)).when(n <= VIEW, "view").when(n <= RCODE, "rcode").when(n <= ZONE, "zone").otherwise("colon")


def rejected_counts(lines: DataFrame) -> DataFrame:
    """``(reason, count)``; accepted lines under ``accepted``."""
    return lines.groupBy(F.coalesce(reason(F.col("value")), F.lit("accepted")).alias("reason")).count()


def latest_log(lines: DataFrame, position: Column, n: int = LATEST, without: str = "127.0.0.1") -> DataFrame:
    """``(id, log)``: the last ``n`` lines that don't match the pattern ``without``, numbered from 0 in file order."""
    last = lines.where(~F.col("value").rlike(without)).select(position.alias("position"), F.col("value").alias("log")).orderBy(F.desc("position")).limit(n)
    return last.select((F.row_number().over(Window.orderBy("position")) - 1).alias("id"), "log")
