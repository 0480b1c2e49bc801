"""Variable features: standardised variance, mean-variance bins, dispersion."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matrix import Matrix


def vst_moments(m: Matrix) -> DataFrame:
    """(feature, ord, mean, variance, nnz) over all cells in one pass."""
    n = float(m.n_cells)
    sums = m.expr.groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"), F.count(F.lit(1)).alias("nnz"))
    full = m.features.select("feature", "ord").join(sums, "feature", "left").fillna(0.0, ["s", "ss"]).fillna(0, ["nnz"])
    mean = F.col("s") / n
    return full.select("feature", "ord", mean.alias("mean"), ((F.col("ss") / n - mean * mean) * (n / max(n - 1, 1))).alias("variance"), "nnz")


def loess(x: np.ndarray, y: np.ndarray, span: float = 0.3) -> np.ndarray:
    """Local quadratic fit with tricube weights at every x.

    A window holds the max(ceil(span*n), 6) nearest points; equal x share one fit.
    """
    n = len(x)
    k = min(n, max(math.ceil(span * n), 6))
    order = np.lexsort((y, x))
    xs, ys = x[order], y[order]
    at, inverse = np.unique(x, return_inverse=True)
    out = np.empty(len(at))
    lo = 0
    for q, x0 in enumerate(at):
        while lo + k < n and x0 - xs[lo] > xs[lo + k] - x0:
            lo += 1
        dx = xs[lo : lo + k] - x0
        reach = max(np.abs(dx).max(), 1e-10)
        w = np.clip(1 - (np.abs(dx) / reach) ** 3, 0, None) ** 3
        basis = np.stack([np.ones(k), dx, dx * dx])
        left, right = (basis * w) @ basis.T, (basis * w) @ ys[lo : lo + k]
        try:
            out[q] = np.linalg.solve(left, right)[0]
        except np.linalg.LinAlgError:
            out[q] = np.linalg.lstsq(left, right, rcond=None)[0][0]
    return out[inverse]


def expected_variance(moments: DataFrame, span: float = 0.3) -> DataFrame:
    """(feature, expected): 10 to the loess of log10 variance on log10 mean; features
    without variance have 0. The fit runs on the driver: a row per feature."""
    spark = moments.sparkSession
    rows = moments.select("feature", "mean", "variance").toPandas()
    rows["expected"] = 0.0
    varies = (rows["variance"] > 0).to_numpy()
    if varies.any():
        x, y = (np.log10(rows.loc[varies, c].to_numpy()) for c in ("mean", "variance"))
        rows.loc[varies, "expected"] = 10 ** loess(x, y, span)
    return spark.createDataFrame(rows[["feature", "expected"]], "feature string, expected double")


def standardized_variance(m: Matrix, moments: DataFrame, expected: DataFrame, clip: float | None = None) -> DataFrame:
    """(feature, ord, mean, variance, expected, standardized): variance of z clipped
    at sqrt(n); the absent cells count by a closed form."""
    n = float(m.n_cells)
    limit = clip if clip is not None else math.sqrt(n)
    fit = moments.join(expected, "feature").withColumn("sd", F.sqrt("expected"))
    z = F.least((F.col("value") - F.col("mean")) / F.col("sd"), F.lit(float(limit)))
    stored = m.expr.join(fit.filter("sd > 0").select("feature", "mean", "sd"), "feature").groupBy("feature").agg(F.sum(z * z).alias("zz"))
    zero = (n - F.col("nnz")) * F.pow(F.col("mean") / F.col("sd"), 2)
    value = F.when(F.col("sd") > 0, (F.coalesce("zz", F.lit(0.0)) + zero) / (n - 1)).otherwise(0.0)
    return fit.join(stored, "feature", "left").select("feature", "ord", "mean", "variance", "expected", value.alias("standardized"))


def top_features(df: DataFrame, score: str, n: int, digits: int = 9) -> DataFrame:
    """(feature, rank, score) of the n highest; ties go to the lower ord. The score is
    rounded first, since sums depend on the order of partitions."""
    order = Window.orderBy(F.desc(F.round(score, digits)), "ord")
    chosen = df.orderBy(F.desc(F.round(score, digits)), "ord").limit(n)
    return chosen.withColumn("rank", F.row_number().over(order)).select("feature", "rank", score)


def find_variable_features(m: Matrix, n: int = 2000, span: float = 0.3) -> DataFrame:
    """(feature, rank, standardized): the n features of highest standardised variance."""
    moments = vst_moments(m)
    return top_features(standardized_variance(m, moments, expected_variance(moments, span)), "standardized", n)


def expm1_moments(m: Matrix) -> DataFrame:
    """(feature, ord, mean, variance) of expm1 in two passes; an absent cell adds mean^2."""
    n = float(m.n_cells)
    means = m.expr.groupBy("feature").agg((F.sum(F.expm1("value")) / n).alias("mean"), F.count(F.lit(1)).alias("k"))
    off = m.expr.join(means.select("feature", "mean"), "feature").groupBy("feature").agg(F.sum(F.pow(F.expm1("value") - F.col("mean"), 2)).alias("q"))
    full = m.features.select("feature", "ord").join(means, "feature", "left").join(off, "feature", "left").fillna(0.0, ["mean", "q"]).fillna(0, ["k"])
    return full.select("feature", "ord", "mean", ((F.col("q") + (n - F.col("k")) * F.col("mean") * F.col("mean")) / (n - 1)).alias("variance"))


def dispersions(m: Matrix, bins: int = 20, method: str = "equal_width") -> DataFrame:
    """(feature, ord, mean, dispersion, bin, scaled): log1p mean, log variance/mean,
    and its z-score within bins of the mean; null for a bin of one feature.

    equal_width: bins over the range, closed to the right, the lowest value in the
    first. equal_frequency: ``bins`` quantile breaks of the positive means.
    """
    base = expm1_moments(m)
    mean = F.log1p("mean")
    dispersion = F.when(F.col("mean") == 0, 0.0).when(F.col("variance") == 0, float("-inf")).otherwise(F.log(F.col("variance") / F.col("mean")))
    rows = base.select("feature", "ord", mean.alias("mean"), dispersion.alias("dispersion"))
    if method == "equal_width":
        limits = rows.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi")).first()
        lo, width = limits["lo"], (limits["hi"] - limits["lo"]) / bins
        index = F.greatest(F.lit(0), F.ceil((F.col("mean") - lo) / F.lit(width if width else 1.0)).cast("int") - 1)
        rows = rows.withColumn("bin", F.least(F.lit(bins - 1), index))
    elif method == "equal_frequency":
        cuts = rows.filter("mean > 0").agg(F.percentile("mean", F.array(*[F.lit(i / (bins - 1)) for i in range(bins)]))).first()[0]
        above = sum(((F.col("mean") > c).cast("int") for c in cuts), F.lit(0)) - 1
        rows = rows.withColumn("bin", F.when(F.col("mean") == cuts[0], 0).when((F.col("mean") < cuts[0]) | (F.col("mean") > cuts[-1]), -1).otherwise(above))
    else:
        raise ValueError(f"unknown method {method!r}")
    w = Window.partitionBy("bin")
    sd = F.stddev_samp("dispersion").over(w)
    scaled = F.when((F.col("bin") >= 0) & (F.count(F.lit(1)).over(w) > 1) & (sd > 0), (F.col("dispersion") - F.avg("dispersion").over(w)) / sd)
    return rows.withColumn("scaled", scaled)


def dispersion_features(m: Matrix, select: str = "mvp", n: int = 2000, mean_cutoff: tuple[float, float] = (0.1, 8.0), cutoff: tuple[float, float] = (1.0, math.inf), **bins) -> DataFrame:
    """mvp: all features inside both open cutoffs; disp: the top n by raw
    dispersion. Both ranked by raw dispersion."""
    rows = dispersions(m, **bins)
    if select == "disp":
        return top_features(rows, "dispersion", n)
    inside = (F.col("mean") > mean_cutoff[0]) & (F.col("mean") < mean_cutoff[1]) & (F.col("scaled") > cutoff[0]) & (F.col("scaled") < cutoff[1])
    return rows.filter(inside).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("dispersion", 9)), "ord"))).select("feature", "rank", "dispersion")

