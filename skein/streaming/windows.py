"""Windowed counts over a folder of arriving event files, an extension beyond batch parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.files import fresh


def windowed_counts(spark: SparkSession, folder: str, glob: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """start, event_type, n, total of tumbling windows over all files that are there now, by Structured Streaming.

    State is one row a window and type; each trigger's result replaces the last one's file, so a restarted query that
    repeats a batch gives the same table.
    """
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out, state = fresh(spark, "windows"), fresh(spark, "stream-state")
    result = counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
    query = (
        result.writeStream.outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True)
        .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)
