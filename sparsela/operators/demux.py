"""Sample tags: thresholds by cluster backgrounds or by modes, and the calls."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import pair_label, tag_call
from ..functions.special import digamma, lgamma
from .matrix import Matrix
from .normalize import clr


def medoids(points: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of k medoids of a small sample: greedy build, then swaps while
    one lowers the total distance."""
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    chosen: list[int] = []
    near = np.full(len(points), d.max() * 1.1 + 1)
    for _ in range(k):
        gain = np.maximum(near[None] - d, 0).sum(axis=1)
        gain[chosen] = -1
        best = int(len(gain) - 1 - np.argmax(gain[::-1]))
        chosen.append(best)
        near = np.minimum(near, d[best])
    while True:
        cost, swap = near.sum() - 1e-12, None
        for i in range(k):
            rest = np.min(d[[c for j, c in enumerate(chosen) if j != i]], axis=0) if k > 1 else np.full(len(points), np.inf)
            totals = np.minimum(rest[None], d).sum(axis=1)
            totals[chosen] = np.inf
            if totals.min() < cost:
                cost, swap = totals.min() - 1e-12, (i, int(np.argmin(totals)))
        if swap is None:
            return np.array(chosen)
        chosen[swap[0]] = swap[1]
        near = np.min(d[chosen], axis=0)


def clara(points: DataFrame, k: int, samples: int = 100, size: int | None = None, seed: int = 0) -> DataFrame:
    """(cell, cluster): medoids of small samples (40 + 2k rows each), the best by the
    mean distance of all points. points: (cell, vec). Samples are drawn by hash in
    one pass; all candidates are judged in one aggregate."""
    spark = points.sparkSession
    n = points.count()
    if not 1 <= k < n:
        raise ValueError(f"k must be between 1 and {n - 1}")
    size = min(n, size or 40 + 2 * k)
    samples = 1 if size >= n else samples
    wanted = spark.range(samples).select(F.col("id").alias("s"))
    key = F.xxhash64("s", "cell", F.lit(seed))
    share = min(1.0, 3.0 * size / n)
    drawn = points.join(F.broadcast(wanted)).filter(F.pmod(key, F.lit(1 << 30)) < share * (1 << 30)).withColumn("_k", F.row_number().over(Window.partitionBy("s").orderBy(key, "cell"))).filter(F.col("_k") <= size)
    by_sample: dict[int, list] = {}
    for r in drawn.select("s", "vec").collect():
        by_sample.setdefault(r["s"], []).append(r["vec"])
    found = [np.array(v)[medoids(np.array(v, dtype=float), k)] for _, v in sorted(by_sample.items()) if len(v) > k]

    centres = np.stack(found)

    def gaps(vectors: list) -> np.ndarray:
        """Distances of rows to every medoid of every sample."""
        x = np.array(vectors, dtype=float).reshape(len(vectors), -1)
        return np.sqrt(np.maximum(((x[:, None, None, :] - centres[None]) ** 2).sum(axis=3), 0))

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(centres))
        for b in batches:
            vectors = b.column(0).to_pylist()
            for lo in range(0, len(vectors), 512):
                total += gaps(vectors[lo : lo + 512]).min(axis=2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["s", "cost"])

    sums = points.select("vec").mapInArrow(costs, "s int, cost double").groupBy("s").agg(F.sum("cost").alias("cost")).collect()
    best = centres[min(sums, key=lambda r: (round(r["cost"], 9), r["s"]))["s"]]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), dtype=float).reshape(b.num_rows, -1)
            d = ((x[:, None] - best[None]) ** 2).sum(axis=2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d.argmin(axis=1).astype(np.int64))], ["cell", "cluster"])

    return points.select(F.col("cell").cast("string"), "vec").mapInArrow(nearest, "cell string, cluster long")


def negbinom_quantile(values: np.ndarray, q: float, weights: np.ndarray | None = None) -> float:
    """The q quantile of a negative binomial fitted by maximum likelihood; of a
    Poisson where the values are not overdispersed. weights: how often each value is there."""
    n = np.ones(len(values)) if weights is None else np.asarray(weights, dtype=float)
    total = n.sum()
    mean = float((values * n).sum() / total) if total else 0.0
    var = float((n * (values - mean) ** 2).sum() / (total - 1)) if total > 1 else 0.0
    if mean <= 0:
        return 0.0
    theta = math.inf
    if var > mean:
        theta = mean * mean / (var - mean)
        for _ in range(100):
            # Newton in log theta on the profile score
            h = 1e-4
            score = [float((n * (digamma(values + t) - digamma(t) + math.log(t / (t + mean)) + 1 - (values + t) / (t + mean))).sum() * t) for t in (theta, theta * math.exp(h))]
            slope = (score[1] - score[0]) / h
            step = -score[0] / slope if slope < 0 else math.copysign(0.5, score[0])
            theta *= math.exp(min(1.0, max(-1.0, step)))
            if abs(step) < 1e-8 or theta > 1e8:
                break
    below, k = 0.0, 0
    while True:
        if theta > 1e8:
            log_p = -mean + k * math.log(mean) - math.lgamma(k + 1)
        else:
            log_p = float(lgamma(k + theta) - lgamma(theta)) - math.lgamma(k + 1) + theta * math.log(theta / (theta + mean)) + k * math.log(mean / (theta + mean))
        below += math.exp(log_p)
        if below >= q or k > 10_000_000:
            return float(k)
        k += 1


def tag_vectors(m: Matrix, tags: Sequence[str]) -> DataFrame:
    """(cell, vec): a column per tag, zeros filled."""
    wide = m.expr.groupBy("cell").pivot("feature", list(tags)).agg(F.first("value"))
    full = m.cells.select("cell").join(wide, "cell", "left").fillna(0.0)
    return full.select("cell", F.array(*[F.col(f"`{t}`") for t in tags]).alias("vec"))


def call_cells(data: DataFrame, positive: DataFrame, tags: DataFrame) -> DataFrame:
    """(cell, n_positive, call, max_tag, second_tag, margin, hash_id) from normalised
    values (cell, feature, value; zeros included) and positive (cell, feature)."""
    rows = data.join(tags.select("feature", "ord"), "feature")
    nth = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("value"), "ord"))
    top = rows.withColumn("_k", nth).filter("_k <= 2").groupBy("cell").agg(
        F.max(F.when(F.col("_k") == 1, F.col("feature"))).alias("max_tag"), F.max(F.when(F.col("_k") == 2, F.col("feature"))).alias("second_tag"),
        F.max(F.when(F.col("_k") == 1, F.col("value"))).alias("_a"), F.max(F.when(F.col("_k") == 2, F.col("value"))).alias("_b"),
    )
    hits = positive.groupBy("cell").agg(F.count(F.lit(1)).alias("n_positive"))
    out = top.join(hits, "cell", "left").fillna(0, ["n_positive"])
    call = tag_call(F.col("n_positive"))
    label = F.when(call == "Singlet", F.col("max_tag")).when(call == "Doublet", pair_label(F.col("max_tag"), F.col("second_tag"))).otherwise("Negative")
    return out.select("cell", "n_positive", call.alias("call"), "max_tag", "second_tag", (F.col("_a") - F.col("_b")).alias("margin"), label.alias("classification"), F.when(call == "Doublet", "Doublet").otherwise(label).alias("hash_id"))


def dense_values(m: Matrix) -> DataFrame:
    """(cell, feature, value) with zeros: for the few features of a tag panel."""
    return m.cells.select("cell").join(F.broadcast(m.features.select("feature"))).join(m.expr, ["cell", "feature"], "left").fillna(0.0, ["value"])


def hto_demux(m: Matrix, quantile: float = 0.99, margin: int = 1, method: str = "clara", samples: int = 100, seed: int = 0) -> tuple[DataFrame, dict[str, float]]:
    """Calls (see call_cells) and cutoffs: cells in tags + 1 clusters of normalised
    counts; each tag's cutoff is a negative binomial quantile of its counts in the
    cluster where it is lowest; positive above it."""
    tags = [r[0] for r in m.features.orderBy("ord").select("feature").collect()]
    if len(tags) < 2:
        raise ValueError("at least two tags are needed")
    normal = clr(m, margin)
    points = tag_vectors(normal, tags)
    if method == "clara":
        labels = clara(points, len(tags) + 1, samples, seed=seed)
    else:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = points.select("cell", array_to_vector("vec").alias("features"))
        labels = KMeans(k=len(tags) + 1, seed=seed, predictionCol="cluster").fit(rows).transform(rows).select("cell", F.col("cluster").cast("long").alias("cluster"))
    data = dense_values(normal)
    means = data.join(labels, "cell").groupBy("feature", "cluster").agg(F.avg(F.expm1("value")).alias("mean"))
    lowest = means.groupBy("feature").agg(F.min_by("cluster", F.struct("mean", "cluster")).alias("cluster"))
    counts = dense_values(m)
    background = counts.join(labels, "cell").join(F.broadcast(lowest), ["feature", "cluster"]).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    cutoffs: dict[str, float] = {}
    by_tag: dict[str, list] = {}
    for r in background.collect():
        by_tag.setdefault(r["feature"], []).append((r["value"], r["n"]))
    for tag, pairs in by_tag.items():
        cutoffs[tag] = negbinom_quantile(np.array([v for v, _ in pairs]), quantile, np.array([n for _, n in pairs]))
    limit = m.expr.sparkSession.createDataFrame(list(cutoffs.items()), "feature string, cutoff double")
    positive = counts.join(F.broadcast(limit), "feature").filter("value > cutoff").select("cell", "feature")
    return call_cells(data, positive, m.features), cutoffs


def density(values: DataFrame, by: str, column: str, points: int = 100, bandwidth: str = "scott") -> DataFrame:
    """(by, i, x, density) of a Gaussian kernel estimate on an even grid over each
    group's range. scott: sd * n^-1/5; nrd0: 0.9 * min(sd, IQR / 1.34) * n^-1/5.
    Equal values are counted first, and the grid is ``points`` rows a group."""
    stats = values.groupBy(by).agg(
        F.count(column).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"), F.stddev_samp(column).alias("sd"), F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).alias("q")
    ).filter("hi > lo")
    spread = F.col("sd") if bandwidth == "scott" else 0.9 * F.least(F.col("sd"), F.when(F.col("q")[1] > F.col("q")[0], (F.col("q")[1] - F.col("q")[0]) / 1.34).otherwise(F.col("sd")))
    stats = stats.withColumn("bw", spread * F.pow("n", F.lit(-0.2)))
    grid = stats.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    counted = values.groupBy(by, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c")).filter("_v is not null")
    u = (F.col("x") - F.col("_v")) / F.col("bw")
    rows = counted.join(F.broadcast(grid), by).groupBy(by, "i", "x", "n", "bw").agg(F.sum(F.col("_c") * F.exp(-u * u / 2)).alias("_s"))
    return rows.select(by, "i", "x", (F.col("_s") / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))).alias("density"))


def local_maxima(curve: DataFrame, by: str) -> DataFrame:
    """The rows of a density where it rose and does not rise further; the ends count."""
    w = Window.partitionBy(by).orderBy("i")
    rose = F.coalesce(F.col("density") > F.lag("density").over(w), F.lit(True))
    rises = F.coalesce(F.lead("density").over(w) > F.col("density"), F.lit(False))
    return curve.withColumn("_p", rose & ~rises).filter("_p").drop("_p")


def modes(data: DataFrame) -> DataFrame:
    """(feature, lo, hi): each tag's two tallest modes, in order; tags with one are out."""
    peaks = local_maxima(density(data, "feature", "value"), "feature")
    nth = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("density"), "i"))
    two = peaks.withColumn("_k", nth).filter("_k <= 2")
    return two.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")).filter("n = 2").drop("n")


def multiseq_demux(m: Matrix, quantile: float = 0.7, auto: bool = False, max_rounds: int = 5, quantiles: Sequence[float] | None = None, margin: int = 1) -> tuple[DataFrame, float]:
    """(cell, n_positive, classification) and the quantile used: cutoffs lie a share of
    the way from a tag's lower to its higher mode. auto sweeps the shares for most
    singlets, sets negatives aside and repeats."""
    data = dense_values(clr(m, margin))
    shares = list(quantiles) if quantiles is not None else [round(0.1 + 0.05 * k, 4) for k in range(17)]
    order = m.features.select("feature", "ord")

    def positives(rows: DataFrame, found: DataFrame, q: float) -> DataFrame:
        cut = F.col("lo") + q * (F.col("hi") - F.col("lo"))
        return rows.join(F.broadcast(found), "feature").withColumn("_hit", F.col("value") >= cut)

    aside, now, used = None, data, quantile
    for _ in range(max_rounds if auto else 1):
        found = modes(now)
        if auto:
            sweep = positives(now, found, 0.0).select("cell", *[(F.col("value") >= F.col("lo") + q * (F.col("hi") - F.col("lo"))).cast("int").alias(f"q{i}") for i, q in enumerate(shares)])
            per_cell = sweep.groupBy("cell").agg(*[F.sum(f"q{i}").alias(f"q{i}") for i in range(len(shares))])
            singles = per_cell.agg(*[F.sum((F.col(f"q{i}") == 1).cast("int")) for i in range(len(shares))]).first()
            used = shares[int(np.argmax([x or 0 for x in singles]))]
        hits = positives(now, found, used).filter("_hit").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        negative = now.select("cell").distinct().join(hits, "cell", "left_anti")
        if not auto or negative.isEmpty():
            break
        aside = negative if aside is None else aside.unionByName(negative)
        now = now.join(negative, "cell", "left_anti")
    hits = positives(now, modes(now), used).filter("_hit").join(order, "feature")
    calls = hits.groupBy("cell").agg(F.count(F.lit(1)).alias("n_positive"), F.min_by("feature", "ord").alias("_tag"))
    every = data.select("cell").distinct().join(calls, "cell", "left").fillna(0, ["n_positive"])
    label = F.when(F.col("n_positive") == 0, "Negative").when(F.col("n_positive") == 1, F.col("_tag")).otherwise("Doublet")
    return every.select("cell", "n_positive", label.alias("classification")), used
