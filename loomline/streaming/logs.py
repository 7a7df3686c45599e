"""Append-only clip logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CLIP_LOG = "clip_id string, run string, style string, text string, created_at timestamp, duration_s double, wav string"


def clip_stream(spark: SparkSession, folder: str, schema: str = CLIP_LOG, late: str = "1 day") -> DataFrame:
    """New rows of a folder of JSON-line logs; a clip that is logged again within the watermark counts once."""
    return spark.readStream.schema(schema).json(folder).withWatermark("created_at", late).dropDuplicatesWithinWatermark(["clip_id"])


def run_totals(clips: DataFrame, window: str = "1 hour") -> DataFrame:
    """Clips and seconds per run, style and hour of logging."""
    return clips.groupBy(F.window("created_at", window), "run", "style").agg(F.count("*").alias("clips"), F.sum("duration_s").alias("seconds"))


def follow(clips: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the stream to a Parquet table; `once` takes what is there and ends."""
    writer = clips.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def history(log: DataFrame, files: DataFrame, last: int = 30) -> DataFrame:
    """The newest rows whose file exists, newest first, with their address. `log` has a running number `at`."""
    here = log.join(files.select("file").distinct(), "file", "left_semi")
    return here.orderBy(F.col("at").desc()).limit(last).withColumn("url", F.concat(F.lit("/clips/"), "file"))
