"""Structured Streaming forms: running state a domain, event-time windows, first sightings, micro-batches to a sink."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import shared_dir
from ..plans.registry import query


def source(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of parquet files as a stream, with the schema of the files that are there."""
    schema = spark.read.option("recursiveFileLookup", "true").parquet(path).schema
    folder, _, last = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*").option("recursiveFileLookup", "true").parquet(path) if not last.endswith(".parquet") else spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", last).parquet(folder)


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and gives its result table: in append mode all batches, else the last, which holds
    the whole result. Batches are written to the shared folder, under their number, so that one that is run again replaces
    itself and nothing gathers in the driver."""
    at = f"{shared_dir(stream.sparkSession)}/sheaf-stream-{uuid.uuid4().hex}"
    done: dict[int, str] = {}

    def each(batch: DataFrame, number: int) -> None:
        done[number] = f"{at}/batch-{number:09d}"
        batch.write.mode("overwrite").parquet(done[number])

    process_stream(stream, each, f"{at}/checkpoint", mode).awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema)
    if not done:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return rows.parquet(*done.values()) if mode == "append" else rows.parquet(done[max(done)])


def running_domain_state(events: DataFrame) -> DataFrame:
    quality = F.least(F.col("value") / 200, F.lit(1.0))
    domain = F.concat(F.lit("host"), F.col("user_id").cast("string"), F.lit(".example.org"))
    return events.groupBy(domain.alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(quality), 6).alias("mean_quality"))


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts in event-time windows; rows later than `late` are left out."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    w = F.window("at", width, slide) if slide else F.window("at", width)
    return at.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return at.groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each key once, with state that the watermark bounds."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def process_stream(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", trigger: str | None = None):
    """Micro-batches to a sink of one's own; a failed batch is run again, so `each` should be idempotent by its number. Without
    a trigger interval the stream ends when all that is there is done."""
    writer = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def to_json_lines(stream: DataFrame, path: str, checkpoint: str):
    """A stream as JSON Lines, each batch once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


@query("stream_running_domain_state", """SELECT 'host' || CAST(user_id AS STRING) || '.example.org' AS domain, count(*) AS n, round(avg(least(value / 200, CAST(1 AS DOUBLE))), 6) AS mean_quality FROM events GROUP BY user_id""")
def stream_running_domain_state(spark, sf_dir):
    return drained(running_domain_state(source(spark, f"{sf_dir}/events.parquet")))


@query("stream_tumbling", "SELECT CAST(date_trunc('hour', ts) AS STRING) AS started, event_type, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type")
def stream_tumbling(spark, sf_dir):
    return drained(windowed(source(spark, f"{sf_dir}/events.parquet"))).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "event_type", "n")


@query("stream_sliding", """SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS started, event_type, count(*) AS n
    FROM (SELECT date_trunc('hour', ts) AS h, event_type FROM events UNION ALL SELECT date_trunc('hour', ts) - INTERVAL 1 HOUR, event_type FROM events) t GROUP BY h, event_type""")
def stream_sliding(spark, sf_dir):
    return drained(windowed(source(spark, f"{sf_dir}/events.parquet"), "2 hours", "1 hour")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "event_type", "n")


@query("stream_sessions", """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
    FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    return drained(sessions(source(spark, f"{sf_dir}/events.parquet"))).select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query("stateful_dedup", "SELECT count(DISTINCT user_id) AS n FROM events")
def stateful_dedup(spark, sf_dir):
    return drained(first_seen(source(spark, f"{sf_dir}/events.parquet"), ["user_id"], "400 days"), "append").agg(F.count(F.lit(1)).alias("n"))
