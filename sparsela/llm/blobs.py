"""Whole binary files in any store that Spark reaches, written by its own committer.

The text sink writes a row's bytes and then its line separator. A file whose last
byte is a fixed ASCII character is therefore one row without that byte, in a
file of its own; the bytes need be no valid text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_blobs(df: DataFrame, column: str, last: str, path: str) -> None:
    """Each row's binary column becomes one file under path, ``last`` its last byte."""
    df.select(F.col(column).cast("string").alias("value")).write.option("lineSep", last).option("maxRecordsPerFile", 1).text(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of each file that write_blobs wrote under path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length", "content")
