"""Documents as a stream. Parsing keeps no state, so all operators of `operators.documents` run in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_files(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as (doc_id, file_name, html)."""
    reader = spark.readStream.format("text").option("wholetext", True)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    meta = F.col("_metadata")
    return reader.load(path).select(F.xxhash64(meta["file_path"]).alias("doc_id"), meta["file_name"].alias("file_name"), F.col("value").alias("html"))


def write(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = True) -> StreamingQuery:
    """Appends to a folder; with `once` it takes what is there and ends."""
    writer = df.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
