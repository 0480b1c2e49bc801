"""Readers of matrix files and of spatial bundles, as tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.matrix import Matrix, dense_to_triplets, from_triplets, make_unique
from ..plans.store import _exists, numbered


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): a text file's lines with their numbers from 0. A line's place in
    its split is shifted by the counts of the splits before it."""
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_id"))
    rows = raw.select("value", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return rows.join(shift, "_part").select((F.col("_at") + F.col("_shift")).alias("n"), "value")


def tsv_column(spark: SparkSession, path: str, column: int) -> DataFrame:
    """(ord, name): one column of a headless TSV, empty where a line is short."""
    part = F.get(F.split("value", "\t"), F.lit(column))
    return numbered_lines(spark, path).select(F.col("n").alias("ord"), F.coalesce(part, F.lit("")).alias("name"))


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, value) of a Matrix Market file, plain or gzipped; places from 0. The
    size line is the first line that is no comment."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("_id"), F.trim("value").alias("value")).filter("value not like '\\%%' and value <> ''")
    size = lines.agg(F.min("_id")).first()[0]
    parts = F.split("value", r"\s+")
    entries = lines if size is None else lines.filter(F.col("_id") != size)
    return entries.select((parts[0].cast("long") - 1).alias("i"), (parts[1].cast("long") - 1).alias("j"), F.coalesce(F.get(parts, F.lit(2)).cast("double"), F.lit(1.0)).alias("value"))


def first_existing(spark: SparkSession, folder: str, names: Sequence[str]) -> str:
    for n in names:
        if _exists(spark, f"{folder}/{n}"):
            return f"{folder}/{n}"
    raise FileNotFoundError(f"none of {list(names)} in {folder}")


def read_10x(spark: SparkSession, folder: str, names: str = "symbols", unique: bool = True, types: bool = False) -> Matrix:
    """A features x cells folder: matrix.mtx, barcodes.tsv, and features.tsv or the
    older genes.tsv, each plain or gzipped. names: symbols or ids. With types the
    features keep the third column as feature_type."""
    mtx = first_existing(spark, folder, ["matrix.mtx.gz", "matrix.mtx"])
    feature_file = first_existing(spark, folder, ["features.tsv.gz", "features.tsv", "genes.tsv.gz", "genes.tsv"])
    barcodes = tsv_column(spark, first_existing(spark, folder, ["barcodes.tsv.gz", "barcodes.tsv"]), 0)
    features = tsv_column(spark, feature_file, 1 if names == "symbols" else 0)
    features = make_unique(features).select("ord", F.col("unique").alias("feature")) if unique else features.select("ord", F.col("name").alias("feature"))
    cells = barcodes.select("ord", F.col("name").alias("cell"))
    entries = read_mtx(spark, mtx).join(features.withColumnRenamed("ord", "i"), "i").join(cells.withColumnRenamed("ord", "j"), "j").select("feature", "cell", "value")
    if types:
        features = features.join(tsv_column(spark, feature_file, 2).withColumnRenamed("name", "feature_type"), "ord")
    return from_triplets(entries, features, cells)


def read_wide_table(spark: SparkSession, path: str, sep: str = ",") -> Matrix:
    """A features x cells text table with names in the first column and header."""
    wide = spark.read.option("header", True).option("sep", sep).option("inferSchema", True).csv(path)
    first, *cells = wide.columns
    long = dense_to_triplets(wide.select(F.col(f"`{first}`").alias("feature"), *[F.col(f"`{c}`").cast("double").alias(c) for c in cells]), "feature", cells, "cell")
    features = numbered_lines(spark, path).filter("n > 0").select((F.col("n") - 1).alias("ord"), F.regexp_replace(F.split("value", sep)[0], '^"|"$', "").alias("feature"))
    return from_triplets(long, features, spark.createDataFrame(list(enumerate(cells)), "ord long, cell string"))


def _cells_by_features(spark: SparkSession, wide: DataFrame, cell, drop: Sequence[str], blank: str | None = None) -> Matrix:
    names = [c for c in wide.columns if c not in drop and not (blank and c.lower().startswith(blank))]
    rows = wide.select(cell.cast("string").alias("cell"), *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    long = dense_to_triplets(rows, "cell", names)
    return from_triplets(long, spark.createDataFrame(list(enumerate(names)), "ord long, feature string"), numbered(rows, "cell"))


def _on_cells(m: Matrix, coordinates: DataFrame) -> DataFrame:
    """Coordinates of the matrix' cells, without nulls."""
    return coordinates.join(m.cells.select("cell"), "cell", "left_semi").na.drop(subset=["x", "y"])


def load_xenium(spark: SparkSession, folder: str, keep_controls: bool = False, image: str = "fov") -> tuple[Matrix, DataFrame]:
    """(matrix, centroids): features of type Gene Expression only, unless controls are kept."""
    m = read_10x(spark, f"{folder}/cell_feature_matrix", types=True)
    if not keep_controls:
        from ..operators.matrix import subset

        m = subset(m, features=m.features.filter("feature_type = 'Gene Expression'"))
    path = first_existing(spark, folder, ["cells.parquet", "cells.csv.gz", "cells.csv"])
    cells = spark.read.parquet(path) if path.endswith("parquet") else spark.read.option("header", True).option("inferSchema", True).csv(path)
    at = cells.select(F.lit(image).alias("image"), F.col("cell_id").cast("string").alias("cell"), F.col("x_centroid").cast("double").alias("x"), F.col("y_centroid").cast("double").alias("y"))
    return m, _on_cells(m, at)


def load_visium(spark: SparkSession, folder: str, filter_by_tissue: bool = True, image: str = "slice1") -> tuple[Matrix, DataFrame]:
    """(matrix, centroids): x is the pixel column, y the pixel row; tables with or
    without a header; only spots in tissue."""
    m = read_10x(spark, f"{folder}/filtered_feature_bc_matrix")
    path = first_existing(spark, f"{folder}/spatial", ["tissue_positions.csv", "tissue_positions_list.csv"])
    raw = spark.read.option("header", False).csv(path).toDF("cell", "in_tissue", "row", "col", "py", "px").filter("cell <> 'barcode'")
    at = raw.select(F.lit(image).alias("image"), "cell", F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"), F.col("in_tissue").cast("int").alias("in_tissue"))
    if filter_by_tissue:
        from ..operators.matrix import subset

        m = subset(m, cells=at.filter("in_tissue = 1"))
    return m, _on_cells(m, at).drop("in_tissue")


def load_cosmx(spark: SparkSession, expr_file: str, meta_file: str, image: str = "fov") -> tuple[Matrix, DataFrame]:
    """(matrix, centroids): wide cells x genes; a cell's id is fov_cell, cell 0 is
    background and left out."""
    read = spark.read.option("header", True).option("inferSchema", True)
    key = F.concat_ws("_", F.col("fov").cast("string"), F.col("cell_ID").cast("string"))
    m = _cells_by_features(spark, read.csv(expr_file).filter("cell_ID <> 0"), key, ["fov", "cell_ID"])
    meta = read.csv(meta_file)
    at = meta.select(F.lit(image).alias("image"), key.alias("cell"), F.col("CenterX_global_px").cast("double").alias("x"), F.col("CenterY_global_px").cast("double").alias("y"))
    return m, _on_cells(m, at)


def cell_id_column(columns: Sequence[str]) -> str:
    for name in ("EntityID", "cell", "cell_id", "Unnamed: 0", "_c0", ""):
        if name in columns:
            return name
    return columns[0]


def load_merscope(spark: SparkSession, expr_file: str, meta_file: str, keep_controls: bool = False, image: str = "fov") -> tuple[Matrix, DataFrame]:
    """(matrix, centroids): wide cells x genes; columns that begin with blank are controls."""
    read = spark.read.option("header", True).option("inferSchema", True)
    wide, meta = read.csv(expr_file), read.csv(meta_file)
    key = cell_id_column(wide.columns)
    m = _cells_by_features(spark, wide, F.col(f"`{key}`"), [key], None if keep_controls else "blank")
    at = meta.select(F.lit(image).alias("image"), F.col(f"`{cell_id_column(meta.columns)}`").cast("string").alias("cell"), F.col("center_x").cast("double").alias("x"), F.col("center_y").cast("double").alias("y"))
    return m, _on_cells(m, at)


# Names of the scale factors in their file.
FACTORS = {"spot": "spot_diameter_fullres", "fiducial": "fiducial_diameter_fullres", "hires": "tissue_hires_scalef", "lowres": "tissue_lowres_scalef"}


def read_scale_factors(spark: SparkSession, path: str) -> DataFrame:
    """(spot, fiducial, hires, lowres), NaN where one is missing."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(*[F.coalesce(F.get_json_object("value", f"$.{key}").cast("double"), F.lit(math.nan)).alias(name) for name, key in FACTORS.items()])


def read_tissue_image(spark: SparkSession, folder: str, resolution: str = "lowres") -> DataFrame:
    """(path, length, content) of the tissue picture, the other resolution where the
    one asked for is missing. Decoding is the caller's."""
    other = "hires" if resolution == "lowres" else "lowres"
    path = first_existing(spark, folder, [f"tissue_{resolution}_image.png", f"tissue_{other}_image.png"])
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


class MtxDataSource(DataSource):
    """``spark.read.format("mtx").load(path)``: (i, j, value) of a local Matrix Market
    file, read in byte ranges."""

    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return "i long, j long, value double"

    def reader(self, schema) -> DataSourceReader:
        return MtxReader(self.options)


class MtxReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.step = options["path"], int(options.get("rangebytes", 32 << 20))

    def partitions(self) -> list[InputPartition]:
        import os

        with open(self.path, "rb") as f:
            line = f.readline()
            while line.startswith(b"%"):
                line = f.readline()
            start = f.tell()
        size = os.path.getsize(self.path)
        return [InputPartition((a, min(size, a + self.step), start)) for a in range(start, max(size, start + 1), self.step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        a, b, start = partition.value
        with open(self.path, "rb") as f:
            f.seek(a)
            if a > start:
                f.seek(a - 1)
                f.readline()
            while f.tell() < b:
                parts = f.readline().split()
                if len(parts) >= 2:
                    yield int(parts[0]) - 1, int(parts[1]) - 1, float(parts[2]) if len(parts) > 2 else 1.0
