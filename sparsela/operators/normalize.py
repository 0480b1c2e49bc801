"""Normalisation, scaling and regression of layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matrix import Matrix


def _with_totals(m: Matrix) -> DataFrame:
    totals = m.expr.groupBy("cell").agg(F.sum("value").alias("_total"))
    return m.expr.join(totals, "cell").withColumn("_total", F.when(F.col("_total") == 0, 1.0).otherwise(F.col("_total")))


def log_normalize(m: Matrix, scale_factor: float = 1e4) -> Matrix:
    """log1p(value / cell total * scale_factor); zeros stay zeros."""
    out = _with_totals(m).select("feature", "cell", F.log1p(F.col("value") / F.col("_total") * scale_factor).alias("value"))
    return m.of(out, "data")


def relative_counts(m: Matrix, scale_factor: float = 1.0) -> Matrix:
    out = _with_totals(m).select("feature", "cell", (F.col("value") / F.col("_total") * scale_factor).alias("value"))
    return m.of(out, "data")


def clr(m: Matrix, margin: int = 1) -> Matrix:
    """log1p(x / exp(sum of log1p over positive x / length)): margin 1 over the
    cells of a feature, 2 over the features of a cell; the length counts zeros."""
    key, n = ("feature", m.n_cells) if margin == 1 else ("cell", m.n_features)
    means = m.expr.groupBy(key).agg(F.exp(F.sum(F.when(F.col("value") > 0, F.log1p("value")).otherwise(0.0)) / n).alias("_mean"))
    return m.of(m.expr.join(means, key).select("feature", "cell", F.log1p(F.col("value") / F.col("_mean")).alias("value")), "data")


def feature_moments(m: Matrix) -> DataFrame:
    """(feature, mean, sd) over all cells, zeros counted, sd with n - 1."""
    n = float(m.n_cells)
    sums = m.expr.groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    full = m.features.select("feature").join(sums, "feature", "left").fillna(0.0)
    mean = F.col("s") / n
    variance = F.greatest(F.lit(0.0), (F.col("ss") / n - mean * mean) * (n / max(n - 1, 1)))
    return full.select("feature", mean.alias("mean"), F.sqrt(variance).alias("sd"))


def scale_data(m: Matrix, features: Sequence[str] | DataFrame, scale_max: float = 10.0) -> DataFrame:
    """Dense rows (feature, cell, value) of the chosen features: (x - mean) / sd,
    sd 0 as 1, clipped to +-scale_max on both sides.

    Only the chosen features are made dense: each by every cell of the axis.
    """
    chosen = m.features.filter(F.col("feature").isin(list(features))).select("feature") if not isinstance(features, DataFrame) else features.select("feature")
    stats = feature_moments(m).join(chosen, "feature", "left_semi")
    stats = stats.withColumn("sd", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))
    # every chosen feature meets every cell: that is what a dense layer is
    grid = m.cells.select("cell").join(stats)
    filled = grid.join(m.expr, ["feature", "cell"], "left").fillna(0.0, ["value"])
    z = (F.col("value") - F.col("mean")) / F.col("sd")
    return filled.select("feature", "cell", F.greatest(F.lit(-scale_max), F.least(F.lit(scale_max), z)).alias("value"))


def regress_out(m: Matrix, covariate: str, features: Sequence[str]) -> DataFrame:
    """Residuals (feature, cell, value) of least squares on an intercept and one
    metadata column, zeros of the matrix counted."""
    n = float(m.n_cells)
    x = m.cells.select("cell", F.col(covariate).cast("double").alias("x"))
    total = x.agg(F.avg("x").alias("mx"), F.sum(F.col("x") * F.col("x")).alias("sxx")).first()
    mx, sxx = total["mx"], total["sxx"] - n * total["mx"] ** 2
    chosen = m.expr.filter(F.col("feature").isin(list(features)))
    sums = chosen.join(x, "cell").groupBy("feature").agg(F.sum("value").alias("sy"), F.sum(F.col("value") * F.col("x")).alias("sxy"))
    slope = (F.col("sxy") - F.col("sy") * mx) / F.lit(sxx if sxx else 1.0)
    fit = sums.select("feature", slope.alias("b"), (F.col("sy") / n - slope * mx).alias("a"))
    grid = x.join(fit).join(chosen, ["feature", "cell"], "left").fillna(0.0, ["value"])
    return grid.select("feature", "cell", (F.col("value") - F.col("a") - F.col("b") * F.col("x")).alias("value"))


def regress_out_many(dense: DataFrame, cells: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """Residuals on an intercept and several columns, by the normal equations: X'X
    once, X'y per feature, both by aggregation; residuals by a join."""
    import numpy as np

    names = [f"_x{k}" for k in range(len(covariates) + 1)]
    x = cells.select("cell", F.lit(1.0).alias(names[0]), *[F.col(c).cast("double").alias(n) for c, n in zip(covariates, names[1:], strict=True)])
    row = x.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a in names for b in names]).first()
    inverse = np.linalg.pinv(np.array(row, dtype=float).reshape(len(names), -1))
    fit = dense.join(x, "cell").groupBy("feature").agg(*[F.sum(F.col("value") * F.col(a)).alias(a + "y") for a in names])
    betas = [sum((F.col(b + "y") * float(inverse[i, j]) for j, b in enumerate(names)), F.lit(0.0)).alias(f"_b{i}") for i in range(len(names))]
    joined = dense.join(fit.select("feature", *betas), "feature").join(x, "cell")
    fitted = sum((F.col(f"_b{i}") * F.col(a) for i, a in enumerate(names)), F.lit(0.0))
    return joined.select("feature", "cell", (F.col("value") - fitted).alias("value"))
