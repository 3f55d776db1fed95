"""Readers and writers of HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_string(spark: SparkSession, html: str, doc_id: int = 0) -> DataFrame:
    """One document in memory, e.g. from standard input."""
    return spark.createDataFrame([(doc_id, html)], "doc_id bigint, html string")


def read_files(spark: SparkSession, path: str, pattern: str = "*.html", recursive: bool = False) -> DataFrame:
    """doc_id (a hash of the path), path, file_name, html of whole files: a file, a folder or a glob."""
    reader = spark.read.format("text").option("wholetext", True)
    if "*" not in path and not path.endswith((".html", ".htm")):
        reader = reader.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    meta = F.col("_metadata")
    return reader.load(path).select(F.xxhash64(meta["file_path"]).alias("doc_id"), meta["file_path"].alias("path"), meta["file_name"].alias("file_name"), F.col("value").alias("html"))


def read_table(spark: SparkSession, path: str, id_col: str, html_col: str) -> DataFrame:
    """Documents of a Parquet table; only the two columns are read."""
    return spark.read.parquet(path).select(F.col(id_col).cast("long").alias("doc_id"), F.col(html_col).alias("html"))


def write_text(df: DataFrame, path: str, text_col: str, mode: str = "errorifexists") -> None:
    """One file a document partition, a document a line group; use write_table to keep the ids."""
    df.select(F.col(text_col).alias("value")).write.mode(mode).text(path)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def show_text(df: DataFrame, text_col: str) -> str:
    """The texts of a few documents for standard output, each ended by a newline."""
    return "".join(t if t.endswith("\n") else t + "\n" for t in (r[0] or "" for r in df.select(text_col).collect()))
