"""Sums, windows and votes over streams of records.

Every function takes a streaming (or batch) DataFrame and returns one; run()
drives a query to the end of what there is and gives its table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.store import shared_folder


def stream_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream of its files; path is a folder or one file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(df: DataFrame, mode: str = "complete", own_state: bool = False) -> DataFrame:
    """Runs the stream over all that is there now and returns its result table, which is
    on shared storage: complete keeps the last batch's table, append and update all
    batches' rows with their number ``batch``. Streams with a stateful processor
    (own_state) need the RocksDB store."""
    spark = df.sparkSession
    before = spark.conf.get(PROVIDER)
    if own_state:
        spark.conf.set(PROVIDER, ROCKSDB)
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    numbers: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number not in numbers:
            numbers.append(number)

    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    if not numbers:
        return spark.createDataFrame([], df.schema)
    if mode == "complete":
        return spark.read.schema(df.schema).parquet(f"{path}/batch={max(numbers)}")
    return spark.read.option("basePath", path).parquet(*[f"{path}/batch={k}" for k in sorted(numbers)])


def running_counts(records: DataFrame) -> DataFrame:
    """(cell, n_count, n_feature_records) as (cell, feature, value) records arrive."""
    return records.groupBy("cell").agg(F.sum("value").alias("n_count"), F.count(F.when(F.col("value") != 0, 1)).alias("n_records"))


def windowed_moments(records: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, feature, n, s, ss) per tumbling window of (ts, feature, value)."""
    w = F.window("ts", width)
    sums = records.withWatermark("ts", late).groupBy(w, "feature").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    return sums.select(F.col("window.start").alias("start"), "feature", "n", "s", "ss")


def sliding_percent(records: DataFrame, pattern: str, width: str = "1 day", slide: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(start, percent) of the values whose feature matches, per sliding window."""
    w = F.window("ts", width, slide)
    total = F.sum("value")
    hit = F.sum(F.when(F.col("feature").rlike(pattern), F.col("value")).otherwise(0.0))
    return records.withWatermark("ts", late).groupBy(w).agg((100 * hit / F.when(total == 0, 1.0).otherwise(total)).alias("percent")).select(F.col("window.start").alias("start"), "percent")


def sessions(records: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(cell, start, end, n, total) of a cell's records with no longer gap between."""
    w = F.session_window("ts", gap)
    sums = records.withWatermark("ts", late).groupBy(w, "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return sums.select("cell", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def online_votes(records: DataFrame, reference: DataFrame) -> DataFrame:
    """(cell, class, score): weights of arriving neighbours (cell, nbr, weight) by the
    class of the neighbour in a fixed reference (cell, class): a stream-static join."""
    labels = reference.select(F.col("cell").alias("nbr"), "class")
    return records.join(labels, "nbr").groupBy("cell", "class").agg(F.sum("weight").alias("score"))


def late_rows(records: DataFrame, late: str = "1 day") -> DataFrame:
    """(batch, n, n_late) of each micro-batch of (ts, ...): late are rows older than the
    largest time of the batches before less ``late``, those that a watermark drops. The
    driver keeps one time; a batch that is run anew writes its row again, and the row of
    the last attempt counts."""
    spark = records.sparkSession
    path = f"{shared_folder(spark)}/late-{uuid.uuid4().hex}"
    seen: dict[int, object] = {}

    def count(batch: DataFrame, number: int) -> None:
        before = [t for k, t in seen.items() if k < number and t is not None]
        limit = F.lit(max(before)) - F.expr(f"interval {late}") if before else None
        is_late = F.col("ts") < limit if before else F.lit(False)
        row = batch.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_late, 1)).alias("n_late"), F.max("ts").alias("hi")).first()
        seen[number] = row["hi"]
        spark.createDataFrame([(number, row["n"], row["n_late"])], "batch long, n long, n_late long").coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = records.writeStream.foreachBatch(count).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    numbers = sorted(seen)
    return spark.read.schema("batch long, n long, n_late long").parquet(*[f"{path}/batch={k}" for k in numbers])


class Welford(StatefulProcessor):
    """Running count, mean and sum of squared deviations of each feature."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("moments", "n long, mean double, m2 double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        n, mean, m2 = self.state.get() if self.state.exists() else (0, 0.0, 0.0)
        for part in rows:
            k = len(part)
            if not k:
                continue
            own = float(part["value"].mean())
            dev = float(((part["value"] - own) ** 2).sum())
            delta, total = own - mean, n + k
            m2 += dev + delta * delta * n * k / total
            mean += delta * k / total
            n = total
        self.state.update((n, mean, m2))
        yield pd.DataFrame({"feature": [key[0]], "n": [n], "mean": [mean], "variance": [m2 / (n - 1) if n > 1 else 0.0]})

    def close(self) -> None:
        pass


def running_variance(records: DataFrame) -> DataFrame:
    """(feature, n, mean, variance) by a stateful processor, a row per feature and
    batch; run it with mode update and own_state."""
    return records.groupBy("feature").transformWithStateInPandas(Welford(), "feature string, n long, mean double, variance double", "Update", "None")
