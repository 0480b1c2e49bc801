"""A whole object as a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..plans.catalog import Catalog
from ..plans.store import _exists

PARTS = ("layers", "reductions", "graphs", "neighbors", "images")


def export_bundle(catalog: Catalog, path: str) -> None:
    """Writes every table of the catalog below path, its names as folders."""
    catalog.cells.write.parquet(f"{path}/cells")
    for assay, features in catalog.features.items():
        features.write.parquet(f"{path}/features/{assay}")
    for part in PARTS:
        for key, df in getattr(catalog, part).items():
            df.write.parquet(f"{path}/{part}/" + ("/".join(key) if isinstance(key, tuple) else key))


def import_bundle(spark: SparkSession, path: str) -> Catalog:
    """The reverse; centroids of images stay images."""
    out = Catalog(spark.read.parquet(f"{path}/cells"))
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def folders(below: str) -> list[str]:
        if not _exists(spark, f"{path}/{below}"):
            return []
        return [s.getPath().getName() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{below}")) if s.isDirectory()]

    for assay in folders("features"):
        out.features[assay] = spark.read.parquet(f"{path}/features/{assay}")
        for layer in folders(f"layers/{assay}"):
            out.layers[assay, layer] = spark.read.parquet(f"{path}/layers/{assay}/{layer}")
    for part in PARTS[1:]:
        for name in folders(part):
            getattr(out, part)[name] = spark.read.parquet(f"{path}/{part}/{name}")
    if out.features:
        out.active_assay = next(iter(out.features))
    return out
