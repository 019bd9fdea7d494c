"""Incremental jobs: batch queries over time windows, and their Structured Streaming twins.

A twin reads the same rows as a stream, drops state behind its watermark, and appends to a table; run with an
available-now trigger it ends with the rows of the batch query.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.registry import query
from wardflow.sources.tables import NOW, table

WINDOW = "10 minutes"
LATE = "2 hours"


def events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """The event table with an instant as `at`, as a batch or as a stream of its files."""
    rows = table(spark, sf_dir, "events")
    if stream:
        rows = spark.readStream.schema(rows.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def rate_windows(rows: DataFrame, length: str = WINDOW) -> DataFrame:
    """Hits of each user in tumbling windows."""
    counted = rows.groupBy(F.window("at", length).alias("w"), "user_id").agg(F.count("*").alias("hits"))
    return counted.select(F.unix_seconds(F.col("w.start")).alias("window_s"), "user_id", "hits")


def unique_events(rows: DataFrame) -> DataFrame:
    """Each event id once; a stream forgets ids that its watermark has passed."""
    return rows.dropDuplicatesWithinWatermark(["event_id"]) if rows.isStreaming else rows.dropDuplicates(["event_id"])


def usage(rows: DataFrame) -> DataFrame:
    """Events, users and value in whole units by day and type, each event once."""
    counted = unique_events(rows).groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(F.floor("value").cast("long")).alias("units"))
    return counted.select(F.unix_date(F.to_date("w.start")).alias("day_no"), "event_type", "events", "units")


def run_to_end(rows: DataFrame, space: str) -> DataFrame:
    """Runs a stream over what is there, then returns what it wrote. `space` is a folder that executors share."""
    spark = rows.sparkSession
    at = work_folder(spark, "stream", space)
    rows.writeStream.format("parquet").outputMode("append").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


def work_folder(spark: SparkSession, name: str, space: str | None = None) -> str:
    """A new folder in the shared one, which goes when the session ends."""
    at = f"{space or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove_folder, spark, at)
    return at


def remove_folder(spark: SparkSession, at: str) -> None:
    """Deletes a folder of the shared store, whichever store that is."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before: nothing is left to delete it with
        pass


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only a local session may do without one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.conf.get("spark.master", "").split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return at or f"file://{tempfile.mkdtemp(prefix='wardflow-stream-')}"


@query("SELECT epoch_us(ts) // 600000000 * 600 AS window_s, user_id, count(*) AS hits FROM events GROUP BY 1, 2")
def rate_limit_windows(spark, sf_dir):
    return rate_windows(events(spark, sf_dir))


@query("SELECT CAST(epoch_us(ts) // 86400000000 AS INTEGER) AS day_no, event_type, count(*) AS events, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS units FROM events GROUP BY 1, 2")
def usage_by_period(spark, sf_dir):
    return usage(events(spark, sf_dir))


@query("SELECT count(*) AS distinct_events FROM (SELECT DISTINCT event_id FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 3 = 0))")
def event_dedupe(spark, sf_dir):
    """A third of the events arrive twice."""
    e = events(spark, sf_dir)
    return unique_events(e.unionByName(e.where("event_id % 3 = 0"))).agg(F.count("*").alias("distinct_events"))


@query(f"SELECT event_id, date_diff('second', ts, TIMESTAMP '{NOW}') > 86400 AS too_late FROM events WHERE ts < TIMESTAMP '{NOW}' AND event_type = 'error'")
def late_rows(spark, sf_dir):
    """Follow-ups are worth sending within a day."""
    now = F.lit(NOW).cast("timestamp_ntz")
    e = events(spark, sf_dir).where((F.col("ts") < now) & (F.col("event_type") == "error"))
    return e.select("event_id", (F.expr(f"unix_seconds(timestamp'{NOW}')") - F.unix_seconds("at") > 86400).alias("too_late"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e), k AS (SELECT user_id, n, count(*) AS hits FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, max(hits) AS longest FROM k GROUP BY 1""")
def sessions(spark, sf_dir):
    """Sessions that end after six hours without an event."""
    s = events(spark, sf_dir).groupBy("user_id", F.session_window("at", "6 hours")).agg(F.count("*").alias("hits"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("hits").alias("longest"))


@query("SELECT epoch_us(ts) // 600000000 * 600 AS window_s, user_id, count(*) AS hits FROM events GROUP BY 1, 2 HAVING (epoch_us(any_value(ts)) // 600000000 + 1) * 600000000 <= (SELECT max(epoch_us(ts)) FROM events) - 7200000000")
def stream_rate_limit_windows(spark, sf_dir):
    """Windows that the watermark has closed."""
    return run_to_end(rate_windows(events(spark, sf_dir, stream=True).withWatermark("at", LATE)), shared_folder(spark))


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_event_dedupe(spark, sf_dir):
    """Each event once, by a stream that forgets ids behind its watermark."""
    e = events(spark, sf_dir, stream=True).withWatermark("at", LATE)
    return run_to_end(unique_events(e).select("event_id", "user_id", "event_type"), shared_folder(spark))
