"""Streams: windowed counts with late data, and an upserted checkpoint of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.sources.files import last_by

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; ``ts`` is a timestamp, which watermarks need."""
    stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """hour, event_type, n, total: counts by the hour, closed when the watermark passes."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def run_to_end(result: DataFrame, uri: str, mode: str = "append", with_checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now, into Parquet below ``uri``, and reads that."""
    spark = result.sparkSession
    query = result.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", with_checkpoint or f"{uri}-progress").trigger(availableNow=True).start(uri)
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(uri)


def upsert(pairs: DataFrame, uri: str) -> None:
    """Appends a micro-batch of (source, translated, at) to the store; ``latest`` resolves it."""
    pairs.select("source", "translated", "at").write.mode("append").parquet(uri)


def latest(spark: SparkSession, uri: str) -> DataFrame:
    """The last translated of each source."""
    return last_by(spark.read.parquet(uri), "source", "at").select("source", "translated")
