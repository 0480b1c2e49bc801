"""Tables of the engine on storage: guarded writes and materialised steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors share; a local one only where none is set and the master
    is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sparsela-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def bound_batches(spark: SparkSession, most: int = 4_000_000) -> None:
    """Lowers the session's limit for the bytes of an Arrow batch, where it is larger. A
    lazy frame needs it when the caller runs it, so it stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, str(most))


def materialised(df: DataFrame, label: str) -> DataFrame:
    """df written to shared storage and read back, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discarded(df: DataFrame) -> None:
    """Removes what ``materialised`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(names: DataFrame, column: str) -> DataFrame:
    """(column, ord): the distinct values with their places from 0 in ascending order. Values
    are dealt out by ranges, and a range starts behind the counts of those before it."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = names.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
    rows = materialised(rows.select(column, F.monotonically_increasing_id().alias("_id")), "numbered")
    rows = rows.select(column, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shift = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return rows.join(shift, "_part").select(column, (F.col("_at") + F.col("_shift")).alias("ord"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


MARK = "_matrix_store"


def write_matrix_store(expr: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes (assay, layer, feature, cell, value): repeated places summed, zeros
    dropped, partitioned by assay and layer, clustered by cell. It overwrites only
    what is such a store itself."""
    from pyspark.sql import functions as F

    spark = expr.sparkSession
    if _exists(spark, path):
        if not overwrite:
            raise FileExistsError(path)
        if not _exists(spark, f"{path}/{MARK}"):
            raise ValueError(f"{path} is no matrix store; it is left alone")
    clean = expr.groupBy("assay", "layer", "feature", "cell").agg(F.sum("value").alias("value")).filter("value <> 0")
    clean.repartitionByRange("assay", "layer", "cell").sortWithinPartitions("assay", "layer", "cell", "feature").write.mode("overwrite").partitionBy("assay", "layer").parquet(path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MARK}")
    fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(fs_path, True).close()


def open_matrix_store(spark: SparkSession, path: str) -> DataFrame:
    if not _exists(spark, f"{path}/{MARK}"):
        raise ValueError(f"{path} is no matrix store")
    return spark.read.parquet(path)
