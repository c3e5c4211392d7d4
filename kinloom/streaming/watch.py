"""Watching a folder of lineage files: each new file is scanned and its violations appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinloom.operators.checks import Scan, violations
from kinloom.sources import lineage


def raw_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, lineno, raw) of the files that come to a folder. A file is one row until it is split, so its lines
    keep their numbers."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder)
    rows = files.select(F.input_file_name().alias("file_id"), F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), "\n\\z", "").alias("text"))
    return rows.select("file_id", F.posexplode(F.split("text", "\n")).alias("n", "raw")).select("file_id", (F.col("n") + 1).cast("long").alias("lineno"), "raw")


def watch(spark: SparkSession, folder: str, to: str, checkpoint: str, rules: tuple[str, ...] = (), once: bool = False) -> StreamingQuery:
    """Appends the violations of each new file to a Parquet table."""

    def batch(raw: DataFrame, number: int) -> None:
        kept = lineage.parse_lines(raw).persist()
        violations(Scan(kept), rules).withColumn("batch", F.lit(number)).write.mode("append").parquet(to)
        kept.unpersist()

    stream = raw_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="500 milliseconds")).start()
