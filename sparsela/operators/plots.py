"""The tables behind the plots; drawing is left to the caller."""

from __future__ import annotations

import colorsys
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, quantiles
from .demux import density
from .matrix import Matrix, fetch_data

THEME = {"style": "white", "font": "sans-serif", "size": 10}


def hue_palette(n: int) -> list[str]:
    """n evenly spaced hues of one lightness and saturation, as hex."""
    return ["#" + "".join(f"{round(255 * c):02x}" for c in colorsys.hls_to_rgb((15 / 360 + k / max(n, 1)) % 1, 0.65, 0.75)) for k in range(n)]


def violin(m: Matrix, feature: str, by: str, points: int = 512) -> tuple[DataFrame, DataFrame]:
    """(group, i, x, density) by the nrd0 bandwidth, and (group, median)."""
    rows = fetch_data(m, [feature], [by]).select(F.col(by).cast("string").alias("group"), F.col(f"`{feature}`").alias("value"))
    return density(rows, "group", "value", points, "nrd0"), rows.groupBy("group").agg(F.percentile("value", 0.5).alias("median"))


def ridge(m: Matrix, feature: str, by: str, points: int = 300) -> DataFrame:
    rows = fetch_data(m, [feature], [by]).select(F.col(by).cast("string").alias("group"), F.col(f"`{feature}`").alias("value"))
    return density(rows, "group", "value", points, "scott")


def feature_plot(m: Matrix, feature: str, layout: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(cell, x, y, value, shown): shown is clamped at the two percentiles."""
    rows = fetch_data(m, [feature], (), layout, {"x": 1, "y": 2}).withColumnRenamed(feature, "value")
    lowest, highest = quantiles(rows, "value", [low, high])
    return rows.withColumn("shown", clamp(F.col("value"), lowest, highest))


def dim_plot(cells: DataFrame, layout: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(cell, x, y, group) and the groups' centres (group, x, y)."""
    rows = cells.join(layout, "cell").select("cell", F.element_at("vec", 1).alias("x"), F.element_at("vec", 2).alias("y"), F.col(by).cast("string").alias("group"))
    return rows, rows.groupBy("group").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def elbow(spark, stdev: Sequence[float]) -> DataFrame:
    return spark.createDataFrame([(k + 1, float(s)) for k, s in enumerate(stdev)], "dim int, stdev double")


def feature_scatter(m: Matrix, first: str, second: str, by: str) -> DataFrame:
    return fetch_data(m, [first, second], [by])


def variable_feature_plot(stats: DataFrame, chosen: DataFrame, score: str = "standardized") -> DataFrame:
    """(feature, mean, score, shown, variable): shown is cut at the 99.5 percentile."""
    cut = stats.agg(F.percentile(score, 0.995)).first()[0]
    marked = stats.join(chosen.select("feature", F.lit(True).alias("variable")), "feature", "left").fillna(False, ["variable"])
    return marked.select("feature", "mean", F.col(score).alias("score"), F.least(F.col(score), F.lit(float(cut or 0))).alias("shown"), "variable")


def heatmap(values: DataFrame, cells: DataFrame, features: Sequence[str], by: str, clip: float = 2.5) -> DataFrame:
    """(feature, cell, group, place, value): cells in the order of their groups; an
    absent feature is 0."""
    order = cells.select("cell", F.col(by).cast("string").alias("group"), F.row_number().over(Window.orderBy(by, "ord")).alias("place"))
    names = values.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    full = order.join(F.broadcast(names)).join(values, ["feature", "cell"], "left").fillna(0.0, ["value"])
    return full.select("feature", "cell", "group", "place", clamp(F.col("value"), -clip, clip).alias("value"))


def dim_heatmap(values: DataFrame, embedding: DataFrame, loadings: DataFrame, dim: int, n_features: int = 10, n_cells: int = 500, clip: float = 2.5) -> DataFrame:
    """(feature, cell, value) of the extreme features and cells of one dimension."""
    long = loadings.select("feature", F.element_at("vec", dim + 1).alias("l"))
    picked = long.orderBy(F.round("l", 9), "feature").limit(n_features).unionByName(long.orderBy(F.desc(F.round("l", 9)), "feature").limit(n_features)).select("feature").distinct()
    places = embedding.select("cell", F.element_at("vec", dim + 1).alias("e"))
    half = max(1, n_cells // 2)
    some = places.orderBy(F.round("e", 9), "cell").limit(half).unionByName(places.orderBy(F.desc(F.round("e", 9)), "cell").limit(half)).select("cell").distinct()
    grid = picked.join(F.broadcast(some))
    return grid.join(values, ["feature", "cell"], "left").fillna(0.0, ["value"]).select("feature", "cell", clamp(F.col("value"), -clip, clip).alias("value"))


def image_plot(centroids: DataFrame, values: DataFrame, factor: float = 1.0, radius: float | None = None, point_scale: float = 1.6) -> DataFrame:
    """(image, cell, x, y, value[, radius]) in image coordinates."""
    rows = centroids.select("image", "cell", (F.col("x") * factor).alias("x"), (F.col("y") * factor).alias("y")).join(values.select("cell", "value"), "cell", "left")
    return rows if radius is None else rows.withColumn("radius", F.lit(radius * factor * point_scale))


def perturbation_plot(calls: DataFrame, points: int = 300) -> DataFrame:
    """(call, i, x, density) of the scores of each call."""
    return density(calls, "call", "score", points, "scott")


def perturbation_heatmap(values: DataFrame, calls: DataFrame, features: Sequence[str]) -> DataFrame:
    """heatmap with the cells of a target by falling posterior."""
    order = calls.select("cell", "target", F.row_number().over(Window.orderBy("target", F.desc("posterior"), "cell")).alias("ord"))
    return heatmap(values, order, features, "target")
