"""Differential expression: every test from sums over one pass where it can be."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi2_p, chi2_sf, normal_p, normal_two_sided, t_p
from . import regression
from .matrix import Matrix

PSEUDOCOUNT = 1.0


def two_groups(m: Matrix, first: Sequence[str], second: Sequence[str] | None = None, column: str = "ident", max_cells: int | None = None, seed: int = 1) -> DataFrame:
    """(cell, grp): 1 for the first identities, 2 for the second (default: the rest).
    max_cells keeps so many cells of each identity, chosen by a seeded hash."""
    ident = F.col(column)
    grp = F.when(ident.isin(list(first)), 1).when(F.lit(True) if second is None else ident.isin(list(second)), 2)
    cells = m.cells.select("cell", ident.alias("_i"), grp.alias("grp")).filter("grp is not null")
    if max_cells is not None:
        nth = F.row_number().over(Window.partitionBy("_i").orderBy(F.xxhash64("cell", F.lit(seed)), "cell"))
        cells = cells.withColumn("_k", nth).filter(F.col("_k") <= max_cells)
    return cells.select("cell", "grp")


def group_sums(m: Matrix, groups: DataFrame) -> DataFrame:
    """One row per feature: for each of the two groups its size, entries above zero,
    sums of expm1, x and x^2 (all and above zero)."""
    sizes = {r["grp"]: r["n"] for r in groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive = F.col("value") > 0
    aggregates = []
    for g in (1, 2):
        mine = F.col("grp") == g
        aggregates += [
            F.count(F.when(mine & positive, 1)).alias(f"pos{g}"),
            F.sum(F.when(mine, F.expm1("value")).otherwise(0.0)).alias(f"e{g}"),
            F.sum(F.when(mine, F.col("value")).otherwise(0.0)).alias(f"s{g}"),
            F.sum(F.when(mine, F.col("value") * F.col("value")).otherwise(0.0)).alias(f"q{g}"),
        ]
    sums = m.expr.join(groups, "cell").groupBy("feature").agg(*aggregates)
    names = [c for c in sums.columns if c != "feature"]
    full = m.features.select("feature", "ord").join(sums, "feature", "left").fillna(0.0, names).fillna(0, names)
    return full.withColumn("n1", F.lit(float(sizes.get(1, 0)))).withColumn("n2", F.lit(float(sizes.get(2, 0))))


def fold_changes(sums: DataFrame, min_pct: float = 0.1, threshold: float = 0.25) -> DataFrame:
    """Adds pct_1, pct_2 and avg_log2FC, and keeps the features that pass: the
    pseudocount is one count added to a group's sum."""
    out = sums.withColumn("pct_1", F.col("pos1") / F.col("n1")).withColumn("pct_2", F.col("pos2") / F.col("n2"))
    out = out.withColumn("avg_log2FC", F.log2((F.col("e1") + PSEUDOCOUNT) / F.col("n1")) - F.log2((F.col("e2") + PSEUDOCOUNT) / F.col("n2")))
    return out.filter(((F.col("pct_1") >= min_pct) | (F.col("pct_2") >= min_pct)) & ((F.lit(threshold) <= 0) | (F.abs("avg_log2FC") >= threshold)))


def rank_sums(m: Matrix, groups: DataFrame, survivors: DataFrame) -> DataFrame:
    """(feature, u, ties): Mann-Whitney U of group 1 and the sum of t^3 - t.

    Equal values of a feature are first counted by group, so that the sort is over
    distinct values; zeros are one tie block of their known size. Mid-ranks follow
    from the counts below each value.
    """
    chosen = m.expr.join(survivors.select("feature"), "feature", "left_semi").join(groups, "cell")
    counts = chosen.groupBy("feature", "value").agg(F.count(F.when(F.col("grp") == 1, 1)).alias("c1"), F.count(F.lit(1)).alias("c"))
    some = survivors.select("feature", F.col("n1").cast("long").alias("n1"), (F.col("n1") + F.col("n2")).cast("long").alias("n"))
    stored = counts.groupBy("feature").agg(F.sum("c1").alias("k1"), F.sum("c").alias("k"))
    zeros = some.join(stored, "feature", "left").select("feature", F.lit(0.0).alias("value"), (F.col("n1") - F.coalesce("k1", F.lit(0))).alias("c1"), (F.col("n") - F.coalesce("k", F.lit(0))).alias("c"))
    every = counts.unionByName(zeros).groupBy("feature", "value").agg(F.sum("c1").alias("c1"), F.sum("c").alias("c"))
    below = F.coalesce(F.sum("c").over(Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = every.withColumn("rank", below + (F.col("c") + 1) / 2)
    cube = F.col("c").cast("double")
    sums = ranked.groupBy("feature").agg(F.sum(F.col("c1") * F.col("rank")).alias("r1"), F.sum(cube * cube * cube - cube).alias("ties"))
    return sums.join(some, "feature").select("feature", (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"), "ties")


def wilcoxon(m: Matrix, groups: DataFrame, survivors: DataFrame) -> DataFrame:
    """(feature, u, z): tie- and continuity-corrected; z null where all are equal."""
    r = rank_sums(m, groups, survivors).join(survivors.select("feature", "n1", "n2"), "feature")
    n = F.col("n1") + F.col("n2")
    variance = F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    z = (F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2) - 0.5) / F.sqrt(variance)
    return r.select("feature", "u", F.when(variance > 1e-12, z).alias("z"))


def welch(sums: DataFrame) -> DataFrame:
    """Adds t and its Welch-Satterthwaite df."""
    out = sums
    for g in ("1", "2"):
        n = F.col(f"n{g}")
        out = out.withColumn(f"v{g}", (F.col(f"q{g}") - F.col(f"s{g}") * F.col(f"s{g}") / n) / (n - 1) / n)
    se = F.col("v1") + F.col("v2")
    t = F.when(se > 0, (F.col("s1") / F.col("n1") - F.col("s2") / F.col("n2")) / F.sqrt(se))
    df = F.when(se > 0, se * se / (F.col("v1") * F.col("v1") / (F.col("n1") - 1) + F.col("v2") * F.col("v2") / (F.col("n2") - 1)))
    return out.withColumn("t", t).withColumn("df", df).drop("v1", "v2")


def _bimod_loglik(n, pos, s, q):
    """Log likelihood of a point mass and a normal on what is above it."""
    rate = F.greatest(F.lit(1e-5), F.least(F.lit(1 - 1e-5), pos / n))
    variance = (q - s * s / pos) / (pos - 1)
    variance = F.when((pos < 2) | (variance <= 1e-14), 1.0).otherwise(variance)
    normal = -pos / 2 * F.log(2 * math.pi * variance) - (q - s * s / pos) / (2 * variance)
    return (n - pos) * F.log(1 - rate) + F.when(pos > 0, pos * F.log(rate) + normal).otherwise(0.0)


def bimodal(sums: DataFrame) -> DataFrame:
    """Adds lrt: twice the gain in likelihood of two groups over one (chi2, df 3)."""
    both = [F.col(c + "1") + F.col(c + "2") for c in ("n", "pos", "s", "q")]
    own = [_bimod_loglik(*[F.col(c + g) for c in ("n", "pos", "s", "q")]) for g in ("1", "2")]
    return sums.withColumn("lrt", F.greatest(F.lit(0.0), 2 * (own[0] + own[1] - _bimod_loglik(*both))))


def hurdle(sums: DataFrame) -> DataFrame:
    """Adds lrt and df of a hurdle model without covariates: the detection rate by
    a logistic, the level among detected by a normal model, both in closed form."""

    def binomial(k, n):
        return F.when(k > 0, k * F.log(k / n)).otherwise(0.0) + F.when(k < n, (n - k) * F.log((n - k) / n)).otherwise(0.0)

    p1, p2, n1, n2 = (F.col(c) for c in ("pos1", "pos2", "n1", "n2"))
    discrete = 2 * (binomial(p1, n1) + binomial(p2, n2) - binomial(p1 + p2, n1 + n2))
    has_d = (p1 + p2 > 0) & (p1 + p2 < n1 + n2) & (discrete > 0)
    s, q, p = F.col("s1") + F.col("s2"), F.col("q1") + F.col("q2"), p1 + p2
    pooled = q - s * s / p
    within = q - F.col("s1") * F.col("s1") / p1 - F.col("s2") * F.col("s2") / p2
    level = p * F.log(pooled / within)
    has_l = (p >= 3) & (p1 > 0) & (p2 > 0) & (within > 1e-14) & (level > 0)
    df = has_d.cast("int") + F.coalesce(has_l.cast("int"), F.lit(0))
    return sums.withColumn("lrt", F.when(has_d, discrete).otherwise(0.0) + F.when(has_l, level).otherwise(0.0)).withColumn("df", df)


TESTS = ("wilcox", "roc", "t", "bimod", "mast", "LR", "negbinom")


def regression_test(m: Matrix, groups: DataFrame, survivors: DataFrame, test: str, latent: Sequence[str] = ()) -> DataFrame:
    """(feature, p) of a model per feature (LR, negbinom, or mast with covariates), with
    metadata columns as covariates. All features are fitted together in rounds of sums;
    without covariates negbinom needs counts by feature, group and value only."""
    spark = m.expr.sparkSession
    if test == "negbinom" and not latent:
        return _negbinom_from_counts(m, groups, survivors)
    names = [r[0] for r in survivors.select("feature", "ord").orderBy("ord").collect()]
    if not names:
        return spark.createDataFrame([], "feature string, p double")
    rounds = regression.Rounds(m, groups, names, latent)
    if test == "mast":
        statistic, df = regression.hurdle_with_covariates(rounds, len(latent))
        p = np.where(df > 0, chi2_sf(statistic, np.maximum(df, 1.0)), 1.0)
    elif test == "LR":
        gain = regression.logistic_gain(rounds, len(latent))
        p = np.where(np.isfinite(gain) & (gain > 0), chi2_sf(np.maximum(np.nan_to_num(gain), 0.0), 1.0), 1.0)
    else:
        z = regression.negative_binomial_wald(rounds, len(latent))
        p = np.where(np.isfinite(z), normal_two_sided(np.nan_to_num(z)), 1.0)
    return spark.createDataFrame([(f, float(x)) for f, x in zip(names, p, strict=True)], "feature string, p double")


def _negbinom_from_counts(m: Matrix, groups: DataFrame, survivors: DataFrame) -> DataFrame:
    """Zeros are counted from the groups' sizes."""
    stored = m.expr.join(survivors.select("feature"), "feature", "left_semi").join(groups, "cell").groupBy("feature", (F.col("grp") == 1).cast("double").alias("one"), "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = groups.groupBy((F.col("grp") == 1).cast("double").alias("one")).agg(F.count(F.lit(1)).alias("size"))
    seen = stored.groupBy("feature", "one").agg(F.sum("n").alias("k"))
    zeros = survivors.select("feature").join(sizes).join(seen, ["feature", "one"], "left").select("feature", "one", F.lit(0.0).alias("value"), (F.col("size") - F.coalesce("k", F.lit(0))).alias("n"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        z = regression.negative_binomial_by_counts(*(rows[c].to_numpy(dtype=float) for c in ("value", "one", "n")))
        return pd.DataFrame({"feature": [key[0]], "p": [float(normal_two_sided(np.array([z]))[0]) if math.isfinite(z) else 1.0]})

    every = stored.select("feature", "one", "value", "n").unionByName(zeros).filter("n > 0")
    return every.groupBy("feature").applyInPandas(run, "feature string, p double")


def find_markers(
    m: Matrix, first: Sequence[str], second: Sequence[str] | None = None, test: str = "wilcox", column: str = "ident",
    min_pct: float = 0.1, threshold: float = 0.25, only_pos: bool = False, latent: Sequence[str] = (), max_cells: int | None = None, counts: Matrix | None = None,
) -> DataFrame:
    """(feature, p, avg_log2FC, pct_1, pct_2, p_adj) sorted by p; for roc
    (feature, auc, power, avg_diff, ...) by power. Bonferroni over all features of
    the layer. ``counts`` is the layer of the count models (default: m itself); latent
    names covariates of LR, negbinom and mast."""
    if test not in TESTS:
        raise ValueError(f"no test {test!r}: choose from {TESTS}")
    groups = two_groups(m, first, second, column, max_cells)
    sums = fold_changes(group_sums(m, groups), min_pct, threshold)
    if test in ("wilcox", "roc"):
        w = wilcoxon(m, groups, sums)
        out = sums.join(w, "feature")
        if test == "roc":
            auc = F.col("u") / (F.col("n1") * F.col("n2"))
            out = out.withColumn("auc", auc).withColumn("power", F.abs(2 * auc - 1)).withColumn("avg_diff", F.col("s1") / F.col("n1") - F.col("s2") / F.col("n2"))
            out = out.filter("avg_log2FC > 0") if only_pos else out
            return out.select("feature", "auc", "power", "avg_diff", "avg_log2FC", "pct_1", "pct_2").orderBy(F.desc("power"), "feature")
        out = out.withColumn("p", F.coalesce(F.least(F.lit(1.0), normal_p(F.greatest("z", F.lit(0.0)))), F.lit(1.0)))
    elif test == "t":
        out = welch(sums)
        out = out.withColumn("p", F.when(F.col("t").isNull(), 1.0).otherwise(F.nanvl(t_p(F.coalesce("t", F.lit(0.0)), F.coalesce("df", F.lit(1.0))), F.lit(1.0))))
    elif test == "bimod":
        out = bimodal(sums).withColumn("p", chi2_p("lrt", F.lit(3.0)))
    elif test == "mast" and not latent:
        out = hurdle(sums)
        out = out.withColumn("p", F.when(F.col("df") == 0, 1.0).otherwise(chi2_p("lrt", F.greatest(F.col("df").cast("double"), F.lit(1.0)))))
    else:
        out = sums.join(regression_test(counts or m, groups, sums, test, latent), "feature")
    if only_pos:
        out = out.filter("avg_log2FC > 0")
    adjusted = F.least(F.lit(1.0), F.col("p") * float(m.n_features))
    return out.select("feature", "p", "avg_log2FC", "pct_1", "pct_2", adjusted.alias("p_adj")).orderBy("p", F.desc("avg_log2FC"), "feature")


def cluster_sums(m: Matrix, column: str = "ident") -> DataFrame:
    """(cluster, feature, own and rest sums): every cluster against all other cells,
    from one aggregate and its totals."""
    cells = m.cells.select("cell", F.col(column).cast("string").alias("cluster"))
    sizes = cells.groupBy("cluster").agg(F.count(F.lit(1)).cast("double").alias("n1"))
    positive = F.col("value") > 0
    own = m.expr.join(cells, "cell").groupBy("feature", "cluster").agg(
        F.count(F.when(positive, 1)).alias("pos1"), F.sum(F.expm1("value")).alias("e1"), F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("q1")
    )
    full = m.features.select("feature", "ord").join(sizes).join(own, ["feature", "cluster"], "left").fillna(0.0, ["e1", "s1", "q1"]).fillna(0, ["pos1"])
    w = Window.partitionBy("feature")
    for c in ("pos", "e", "s", "q", "n"):
        full = full.withColumn(f"{c}2", F.sum(f"{c}1").over(w) - F.col(f"{c}1"))
    return full


def find_all_markers(m: Matrix, column: str = "ident", min_pct: float = 0.1, threshold: float = 0.25, return_thresh: float = 0.01, only_pos: bool = False) -> DataFrame:
    """Wilcoxon markers of every cluster against the rest, in one pass: values are
    counted by cluster once, ranks come from the feature's totals."""
    sums = fold_changes(cluster_sums(m, column), min_pct, threshold)
    cells = m.cells.select("cell", F.col(column).cast("string").alias("cluster"))
    tested = sums.select("feature", "cluster", F.col("n1").cast("long").alias("n1"), (F.col("n1") + F.col("n2")).cast("long").alias("n"))
    counts = m.expr.join(tested.select("feature").distinct(), "feature", "left_semi").join(cells, "cell").groupBy("feature", "value", "cluster").agg(F.count(F.lit(1)).alias("c1"))
    values = counts.groupBy("feature", "value").agg(F.sum("c1").alias("c"))
    n = float(m.n_cells)
    zero = values.groupBy("feature").agg((F.lit(n) - F.sum("c")).cast("long").alias("z"))
    below = F.coalesce(F.sum("c").over(Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = F.when(F.col("value") > 0, F.col("z")).otherwise(0)
    ranked = values.join(zero, "feature").withColumn("rank", below + shift + (F.col("c") + 1) / 2)
    negative = F.coalesce(F.sum(F.when(F.col("value") < 0, F.col("c"))), F.lit(0))
    cube = F.col("c").cast("double")
    ties = ranked.groupBy("feature").agg(F.sum(cube * cube * cube - cube).alias("t"), F.first("z").alias("z"), negative.alias("neg"))
    zd = F.col("z").cast("double")
    ties = ties.select("feature", "z", (F.col("t") + zd * zd * zd - zd).alias("ties"), (F.col("neg") + (F.col("z") + 1) / 2).alias("zero_rank"))
    r1 = counts.join(ranked.select("feature", "value", "rank"), ["feature", "value"]).groupBy("feature", "cluster").agg(F.sum(F.col("c1") * F.col("rank")).alias("r"), F.sum("c1").alias("k1"))
    out = sums.join(ties, "feature").join(r1, ["feature", "cluster"], "left").fillna(0.0, ["r"]).fillna(0, ["k1"])
    u = F.col("r") + (F.col("n1") - F.col("k1")) * F.col("zero_rank") - F.col("n1") * (F.col("n1") + 1) / 2
    total = F.col("n1") + F.col("n2")
    variance = F.col("n1") * F.col("n2") / 12 * ((total + 1) - F.col("ties") / (total * (total - 1)))
    out = out.withColumn("z", F.when(variance > 1e-12, (F.abs(u - F.col("n1") * F.col("n2") / 2) - 0.5) / F.sqrt(variance)))
    out = out.withColumn("p", F.coalesce(F.least(F.lit(1.0), normal_p(F.greatest("z", F.lit(0.0)))), F.lit(1.0))).filter(F.col("p") < return_thresh)
    if only_pos:
        out = out.filter("avg_log2FC > 0")
    adjusted = F.least(F.lit(1.0), F.col("p") * float(m.n_features))
    return out.select("cluster", "feature", "z", "p", "avg_log2FC", "pct_1", "pct_2", adjusted.alias("p_adj")).orderBy(F.expr("try_cast(cluster AS INT)").asc_nulls_last(), "cluster", "p", F.desc("avg_log2FC"))


def find_conserved_markers(m: Matrix, first: Sequence[str], grouping: str, levels: Sequence[str], column: str = "ident", **kwargs) -> DataFrame:
    """(feature, max_p, combined_p, n_levels) of the features found in every level
    of a metadata column; p-values are combined by Fisher's method, for which the
    chi-square tail of even degrees of freedom is a finite sum."""
    parts = None
    for level in levels:
        some = m.cells.filter(F.col(grouping) == level)
        from .matrix import subset

        found = find_markers(subset(m, cells=some), first, column=column, **kwargs).select("feature", "p", F.lit(level).alias("level"))
        parts = found if parts is None else parts.unionByName(found)
    k = len(levels)
    half = -F.sum(F.log(F.greatest("p", F.lit(1e-300))))
    joined = parts.groupBy("feature").agg(F.count(F.lit(1)).alias("n_levels"), F.max("p").alias("max_p"), F.min("p").alias("_least"), half.alias("_x")).filter(F.col("n_levels") == k)
    term = F.exp(-F.col("_x")) * sum((F.pow("_x", F.lit(i)) / math.factorial(i) for i in range(k)), F.lit(0.0))
    combined = F.col("_least") if k == 1 else F.least(F.lit(1.0), term)
    return joined.select("feature", "max_p", combined.alias("combined_p"), "n_levels").orderBy("combined_p", "feature")


def pseudobulk_size_factors(groups: DataFrame) -> DataFrame:
    """(group, size_factor): median over features without zeros of the ratio to the
    geometric mean. groups: feature, group, value."""
    w = Window.partitionBy("feature")
    logs = groups.withColumn("_low", F.min("value").over(w)).withColumn("_mean", F.avg(F.log("value")).over(w)).filter("_low > 0")
    return logs.groupBy("group").agg(F.exp(F.percentile(F.log("value") - F.col("_mean"), 0.5)).alias("size_factor"))


def pseudobulk_test(groups: DataFrame, conditions: dict[str, str], first: str) -> DataFrame:
    """(feature, log2FC, stat, p, padj) between two conditions of pseudobulk samples:
    median-of-ratios size factors, a negative binomial model per feature, Wald test."""
    from ..functions.columns import benjamini_hochberg

    factors = {r["group"]: r["size_factor"] for r in pseudobulk_size_factors(groups).collect()}
    samples = sorted(conditions)
    offset = np.log([factors.get(s, 1.0) for s in samples])
    group = np.array([conditions[s] == first for s in samples], dtype=float)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = dict(zip(rows["group"], rows["value"], strict=True))
        y = np.array([found.get(s, 0.0) for s in samples])
        x = np.stack([np.ones(len(y)), group], axis=1)
        if y.sum() == 0:
            return pd.DataFrame({"feature": [key[0]], "log2FC": [0.0], "stat": [0.0], "p": [1.0]})
        scaled = y / np.exp(offset)
        resid = np.concatenate([scaled[group == g] - scaled[group == g].mean() for g in (0, 1) if (group == g).any()])
        mean = scaled.mean()
        alpha = max(1e-8, (resid.var(ddof=min(2, len(resid) - 1)) - mean * np.exp(-offset).mean()) / mean**2)
        beta = np.array([math.log(max(mean, 1e-8)), 0.0])
        for _ in range(100):
            mu = np.exp(np.clip(x @ beta + offset, -30, 30))
            w = mu / (1 + alpha * mu)
            step = np.linalg.lstsq((x * w[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ ((y - mu) / (1 + alpha * mu)) - 1e-6 * beta, rcond=None)[0]
            beta += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-9:
                break
        se = math.sqrt(np.linalg.pinv((x * w[:, None]).T @ x)[1, 1])
        stat = beta[1] / se if se > 0 else 0.0
        return pd.DataFrame({"feature": [key[0]], "log2FC": [beta[1] / math.log(2)], "stat": [stat], "p": [math.erfc(abs(stat) / math.sqrt(2))]})

    tested = groups.groupBy("feature").applyInPandas(run, "feature string, log2FC double, stat double, p double")
    return benjamini_hochberg(tested)
