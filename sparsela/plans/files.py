"""Matrices of the fixture as files on shared storage, for the queries of the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.matrix import Matrix
from .store import shared_folder


def folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def write_lines(rows: DataFrame, order: str, line: F.Column, path: str) -> None:
    """One text file of lines in their order (small tables: names and fixtures)."""
    rows.select(F.col(order).alias("_o"), line.alias("value")).repartition(1).sortWithinPartitions("_o").select("value").write.text(path)


def write_10x(m: Matrix, path: str, types: bool = False) -> None:
    """matrix.mtx, barcodes.tsv and features.tsv below path; a type for each feature:
    names that begin with MT- are controls."""
    places = {key: table.select(key, (F.row_number().over(Window.orderBy("ord")) - 1).alias(at)) for key, table, at in (("feature", m.features, "i"), ("cell", m.cells, "j"))}
    kind = F.when(F.col("feature").startswith("MT-"), "Control").otherwise("Gene Expression") if types else F.lit("Gene Expression")
    write_lines(places["feature"], "i", F.concat_ws("\t", F.concat(F.lit("id"), F.col("i").cast("string")), "feature", kind), f"{path}/features.tsv")
    write_lines(places["cell"], "j", F.col("cell"), f"{path}/barcodes.tsv")
    entries = m.expr.join(places["feature"], "feature").join(places["cell"], "cell")
    lines = entries.select(F.struct(F.lit(2).alias("k"), "i", "j").alias("o"), F.concat_ws(" ", (F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"), F.col("value").cast("string")).alias("line"))
    spark = m.expr.sparkSession
    head = spark.createDataFrame([(0, "%%MatrixMarket matrix coordinate real general"), (1, f"{m.n_features} {m.n_cells} {entries.count()}")], "k int, line string")
    head = head.select(F.struct("k", F.lit(0).alias("i"), F.lit(0).alias("j")).alias("o"), "line")
    write_lines(head.unionByName(lines), "o", F.col("line"), f"{path}/matrix.mtx")


def write_csv(df: DataFrame, path: str) -> None:
    df.repartition(1).write.option("header", True).csv(path)
