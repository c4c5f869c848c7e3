"""A DNS query log derived from the ``events`` table: a record and a raw line for each event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Record columns in SQL that Spark and DuckDB share; {S} is the engine's text type.
RECORD_SQL = """
event_id, ts,
CASE user_id % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'interval' ELSE 'cernet' END AS view,
concat('z', CAST(event_id % 4 AS {S}), '.com') AS zone,
concat(CASE WHEN event_id % 17 = 0 THEN 'a-label-long-enough-to-be-dropped.' ELSE '' END,
       event_type, CAST(user_id % 40 AS {S}), '.z', CAST(event_id % 4 AS {S}), '.com',
       CASE WHEN event_id % 2 = 0 THEN '.' ELSE '' END) AS domain,
CASE WHEN event_id % 29 = 0 THEN '127.0.0.1'
     WHEN event_id % 31 = 0 THEN concat('2001:db8::', CAST(user_id % 10 AS {S}))
     ELSE concat('10.', CAST(user_id % 4 AS {S}), '.', CAST(user_id % 256 AS {S}), '.', CAST(event_id % 16 AS {S})) END AS client_ip,
CASE event_id % 13 WHEN 0 THEN 'MX' WHEN 1 THEN 'AAAA' WHEN 2 THEN 'CNAME' WHEN 3 THEN 'NS' WHEN 4 THEN 'SOA' WHEN 5 THEN 'TXT'
     WHEN 6 THEN 'SPF' WHEN 7 THEN 'SRV' WHEN 8 THEN 'DNAME' WHEN 9 THEN 'NAPTR' WHEN 10 THEN 'PTR' ELSE 'A' END AS rtype,
CASE event_type WHEN 'error' THEN 'SERVFAIL' WHEN 'signup' THEN 'NXDOMAIN' WHEN 'purchase' THEN 'FORMERR' ELSE 'NOERROR' END AS rcode
"""


def lines_of(events: DataFrame) -> DataFrame:
    """``(position, value)``: the log's lines. Every 53rd lacks the colon after the view, every 59th ends early."""
    records = events.sparkSession.sql(f"SELECT {RECORD_SQL.replace('{S}', 'STRING')} FROM {{events}}", events=events.withColumn("ts", F.col("ts").cast("timestamp")))
    colon = F.when(F.col("event_id") % 53 == 0, "").otherwise(":")
    tail = F.when(F.col("event_id") % 59 == 0, "").otherwise(F.concat(F.lit(" + NS NE NT ND  NC "), "zone"))
    head = F.concat(F.date_format("ts", "dd-MMM-yyyy HH:mm:ss.SSS"), F.lit(" client "), "client_ip", F.lit(" "), (F.col("event_id") % 60000).cast("string"), F.lit(": view "), "view")
    value = F.concat(head, colon, F.lit(" "), "domain", F.lit(" IN "), "rtype", F.lit(" "), "rcode", tail)
    return records.select(F.col("event_id").alias("position"), value.alias("value"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(events(spark, sf_dir))
