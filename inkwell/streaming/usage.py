"""Usage events as a stream: the same roll-ups as in batch, kept up as events arrive."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-stream-")
    return f"{found.rstrip('/')}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events of Parquet files as they come; times become instants, which watermarks need."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may name a file, a plain path has to be a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_usage(events: DataFrame, late: str = "2 days") -> DataFrame:
    """day, event_type, n, cost; events more than `late` behind the latest are too late to count."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("cost")).select(F.col("w.start").alias("day"), "event_type", "n", "cost")


def priced(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Stream-static join: events with the price of their type, 1 where there is none."""
    return events.join(prices, "event_type", "left").withColumn("cost", F.col("value") * F.coalesce("price", F.lit(1.0)))


def first_within(events: DataFrame, keys: list[str], ttl: str = "10 minutes") -> DataFrame:
    """The first event of its keys within the time to live: the stream form of a result cache."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Process all that is there and return the result table; state and results are in the shared folder. Every batch has
    a folder of its own, so one that is run again replaces what it wrote."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    out = f"{folder}/result"

    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={n}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)
