"""Structured Streaming forms: a watermarked window of recent items, deduplication, keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import web
from tidewire.shared import scratch_path


def read_stream(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The table ``name``, one file or a directory of files, as a stream; the schema is the files' own."""
    whole = f"{path}/{name}"
    stream = spark.readStream.schema(spark.read.parquet(whole).schema).option("maxFilesPerTrigger", 16)
    place = spark._jvm.org.apache.hadoop.fs.Path(whole)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return stream.parquet(whole)
    return stream.option("pathGlobFilter", name).parquet(path)


def hourly_counts(stream: DataFrame, ts: str, key: str, late: str = "26 hours") -> DataFrame:
    """Counts by hour and key; rows later than the watermark are dropped, as the batch window leaves them out."""
    return stream.withColumn("t", F.col(ts).cast("timestamp")).withWatermark("t", late).groupBy(F.window("t", "1 hour").alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), key, "n")


def deduplicated(stream: DataFrame, ts: str, url: str, late: str = "26 hours") -> DataFrame:
    """The first row of every canonical address within the watermark."""
    return stream.withColumn("t", F.col(ts).cast("timestamp")).withColumn("canonical", web.canonical_url(F.col(url))).withWatermark("t", late).dropDuplicatesWithinWatermark(["canonical"])


def run_once(stream: DataFrame) -> DataFrame:
    """Everything that is there now, written to the shared folder in append mode and read back; a window comes out when the watermark has passed it."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_updates(stream: DataFrame, *keys: str) -> DataFrame:
    """Everything that is there now, in update mode: a batch writes only the keys that it has changed, state behind the
    watermark is dropped, and of each key the last batch's values hold. A batch that is repeated after a failure writes
    its own folder again."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/part-{batch}")

    stream.writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").option("recursiveFileLookup", "true").parquet(out)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("x")).select(*keys, "x.*")
