"""Incremental ingest: new corpus files are counted as they arrive, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions.store import new_path


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files at a path, a file or a folder, as a stream of documents. A file is read from its folder by its very name."""
    folder, name = path.rstrip("/").rsplit("/", 1)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    single = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    return stream.option("pathGlobFilter", name).parquet(folder) if single else stream.parquet(path)


def counts_by(spark: SparkSession, path: str, pattern: str, group: str) -> DataFrame:
    """group, docs, hits from a stream that takes what is there and ends; the state is a row for each group."""
    top = new_path(spark, "ingest")
    rows = document_stream(spark, path).select(group, tx.count_overlapping(F.col("text"), pattern).alias("hits"))
    counts = rows.groupBy(group).agg(F.count("*").alias("docs"), F.sum("hits").alias("hits"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/out")

    q = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.parquet(f"{top}/out")


def windowed_events(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Event counts in tumbling windows of a stream, with a watermark for late rows."""
    at = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return at.groupBy(F.window("_at", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
