"""Streams: usage windows, addresses seen before, latest states."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_windows(lines: DataFrame, minutes: int = 30, late: str = "2 hours") -> DataFrame:
    """Tumbling sums of usage lines (at, input, output) with a watermark; works on streams and tables alike."""
    x = lines.withColumn("at", F.col("at").cast("timestamp"))
    x = x.withWatermark("at", late) if lines.isStreaming else x
    return x.groupBy(F.window("at", f"{minutes} minutes").alias("w")).agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.count("*").alias("calls")).select(F.col("w.start").alias("start"), "input", "output", "calls")


def first_seen(links: DataFrame, url: str = "url", at: str = "fetch_time", late: str = "7 days") -> DataFrame:
    """Each address once: state is kept for the watermark's span, so it doesn't grow for ever."""
    x = links.withColumn("url_hash", F.substring(F.md5(url), 1, 8)).withColumn(at, F.col(at).cast("timestamp"))
    if not links.isStreaming:
        return x.groupBy("url_hash").agg(F.min(F.struct(at, url)).alias("s")).select("url_hash", f"s.{url}", f"s.{at}")
    return x.withWatermark(at, late).dropDuplicatesWithinWatermark(["url_hash"])


def latest_state(events: DataFrame, key: str, status: str, at: str) -> DataFrame:
    """(key, status, at): the last status of each key; ties go to the greater status."""
    return events.groupBy(key).agg(F.max(F.struct(at, status)).alias("s")).select(key, f"s.{status}", f"s.{at}")


def append_batches(stream: DataFrame, path: str, checkpoint: str, key: str):
    """Query that appends each batch's rows whose key isn't in the table yet; a batch run again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        try:
            new = new.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
