"""Grouped sums and means over cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matrix import Matrix

IDENT_NAMES = ("ident", "idents", "seurat_annotations")  # fixed values: names of the active identity


def group_labels(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(cell, group): the columns joined by _; identity names stand for the active
    identity where there is no such column."""
    columns = [c if c in cells.columns or c not in IDENT_NAMES else "ident" for c in by]
    return cells.select("cell", F.concat_ws("_", *[F.col(c).cast("string") for c in columns]).alias("group"))


def _filled(m: Matrix, labels: DataFrame, sums: DataFrame) -> DataFrame:
    """A row for every feature and group that exists: groups are few."""
    grid = m.features.select("feature").join(labels.select("group").distinct())
    return grid.join(sums, ["feature", "group"], "left")


def aggregate_expression(m: Matrix, by: Sequence[str], features: Sequence[str] | None = None) -> DataFrame:
    """(feature, group, value): sums of the layer within groups of cells."""
    if features is not None:
        m = Matrix(m.expr.filter(F.col("feature").isin(list(features))), m.features.filter(F.col("feature").isin(list(features))), m.cells, m.name)
    labels = group_labels(m.cells, by)
    sums = m.expr.join(labels, "cell").groupBy("feature", "group").agg(F.sum("value").alias("value"))
    return _filled(m, labels, sums).fillna(0.0, ["value"])


def average_expression(m: Matrix, by: Sequence[str]) -> DataFrame:
    """(feature, group, value): means over the group's own size; of expm1 for the
    layer ``data``."""
    labels = group_labels(m.cells, by)
    sizes = labels.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    value = F.expm1("value") if m.name == "data" else F.col("value")
    sums = m.expr.join(labels, "cell").groupBy("feature", "group").agg(F.sum(value).alias("value"))
    return _filled(m, labels, sums).fillna(0.0, ["value"]).join(sizes, "group").select("feature", "group", (F.col("value") / F.col("_n")).alias("value"))


def group_metadata(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(group, ...): the metadata of each group's first cell."""
    labels = group_labels(cells, by)
    columns = [c for c in cells.columns if c not in ("cell", "ord")]
    rows = cells.join(labels, "cell").groupBy("group").agg(F.min_by(F.struct(*columns), "ord").alias("_r"))
    return rows.select("group", *[F.col(f"_r.{c}").alias(c) for c in columns if c != "group"])


def log_normalized_groups(groups: DataFrame, scale_factor: float = 1e4) -> DataFrame:
    """The object form of aggregated sums: log1p of relative sums by group."""
    totals = groups.groupBy("group").agg(F.sum("value").alias("_t"))
    return groups.join(totals, "group").select("feature", "group", F.log1p(F.col("value") / F.when(F.col("_t") == 0, 1.0).otherwise(F.col("_t")) * scale_factor).alias("value"))


def percent_expressed(m: Matrix) -> DataFrame:
    """(feature, share of cells above zero)."""
    hits = m.expr.groupBy("feature").agg(F.count(F.when(F.col("value") > 0, 1)).alias("_n"))
    return m.features.select("feature").join(hits, "feature", "left").select("feature", (F.coalesce("_n", F.lit(0)) / F.lit(float(m.n_cells))).alias("pct"))


def geometric_means(m: Matrix, eps: float = 1.0) -> DataFrame:
    """(feature, exp(mean(log(x + eps))) - eps), zeros counted."""
    n = float(m.n_cells)
    logs = m.expr.groupBy("feature").agg(F.sum(F.log(F.col("value") + eps)).alias("s"), F.count(F.lit(1)).alias("k"))
    zero = F.log(F.lit(float(eps)))
    full = m.features.select("feature").join(logs, "feature", "left").fillna(0.0, ["s"]).fillna(0, ["k"])
    return full.select("feature", (F.exp((F.col("s") + (n - F.col("k")) * zero) / n) - eps).alias("gmean"))


def dot_plot(m: Matrix, by: str, features: Sequence[str], clip: float = 2.5) -> DataFrame:
    """(feature, group, mean, pct, scaled): per group the mean of expm1, the share
    above zero, and the z-score of log1p(mean) across groups, clipped."""
    chosen = Matrix(m.expr.filter(F.col("feature").isin(list(features))), m.features.filter(F.col("feature").isin(list(features))), m.cells, m.name)
    labels = group_labels(m.cells, [by])
    sizes = labels.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    sums = chosen.expr.join(labels, "cell").groupBy("feature", "group").agg(F.sum(F.expm1("value")).alias("_s"), F.count(F.when(F.col("value") > 0, 1)).alias("_k"))
    full = _filled(chosen, labels, sums).fillna(0.0, ["_s"]).fillna(0, ["_k"]).join(sizes, "group")
    full = full.select("feature", "group", (F.col("_s") / F.col("_n")).alias("mean"), (F.col("_k") / F.col("_n")).alias("pct"))
    w = Window.partitionBy("feature")
    value = F.log1p("mean")
    sd = F.stddev_samp(value).over(w)
    z = F.when((sd == 0) | sd.isNull(), 0.0).otherwise((value - F.avg(value).over(w)) / sd)
    return full.withColumn("scaled", F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))


def label_votes(weights: DataFrame) -> DataFrame:
    """(cell, class, score) of the best class by summed weight; ties go to the first
    class in order. weights: cell, class, weight."""
    scores = weights.groupBy("cell", "class").agg(F.sum("weight").alias("score"))
    return scores.groupBy("cell").agg(F.min_by(F.struct("class", "score"), F.struct(-F.col("score"), F.col("class"))).alias("_b")).select("cell", "_b.class", "_b.score")


def composition(cells: DataFrame, group: str, condition: str, first: str, second: str) -> DataFrame:
    """(group, n_1, n_2, prop_1, prop_2, log2_ratio) of two conditions."""
    rows = cells.filter(F.col(condition).isin(first, second)).groupBy(F.col(group).alias("group")).agg(
        F.count(F.when(F.col(condition) == first, 1)).alias("n_1"), F.count(F.when(F.col(condition) == second, 1)).alias("n_2")
    )
    w = Window.partitionBy(F.lit(0))
    out = rows.withColumn("prop_1", F.col("n_1") / F.sum("n_1").over(w)).withColumn("prop_2", F.col("n_2") / F.sum("n_2").over(w))
    return out.withColumn("log2_ratio", F.when((F.col("prop_1") > 0) & (F.col("prop_2") > 0), F.log2(F.col("prop_2") / F.col("prop_1"))))
