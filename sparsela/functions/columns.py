"""Column expressions: kernels, vector arithmetic, calls."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import materialised


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(v: Column) -> Column:
    """Unit length; the zero vector stays, a vector with a value that is not finite becomes zero."""
    n = norm(v)
    bad = F.isnan(n) | (n == float("inf"))
    return F.when(bad, F.transform(v, lambda x: F.lit(0.0))).otherwise(F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n)))


def take_dims(v: Column, dims: Sequence[int]) -> Column:
    """The 0-based dimensions of a vector, in their order."""
    return F.array(*[F.element_at(v, d + 1) for d in dims])


def tricube(u: Column) -> Column:
    """(1 - |u|^3)^3 inside the unit interval."""
    return F.when(F.abs(u) < 1, F.pow(1 - F.pow(F.abs(u), 3), 3)).otherwise(0.0)


def epanechnikov(u: Column) -> Column:
    return F.when(F.abs(u) < 1, 0.75 * (1 - u * u)).otherwise(0.0)


def gaussian(u: Column) -> Column:
    return F.exp(-u * u / 2)


def exponential_kernel(d: Column, bandwidth: Column) -> Column:
    """exp(-max(d, 0) / bandwidth)."""
    return F.exp(-F.greatest(d, F.lit(0.0)) / bandwidth)


def anchor_kernel(d: Column, d_last: Column, score: Column, sd: float = 1.0) -> Column:
    """1 - exp(-(1 - d/d_last) * score / (2/sd)^2)."""
    return 1 - F.exp(-(1 - d / F.when(d_last == 0, 1.0).otherwise(d_last)) * score / (2 / sd) ** 2)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def cell_cycle_phase(s: Column, g2m: Column) -> Column:
    return F.when((s <= 0) & (g2m <= 0), "G1").when(s > g2m, "S").otherwise("G2M")


def tag_call(positive: Column) -> Column:
    return F.when(positive == 0, "Negative").when(positive == 1, "Singlet").otherwise("Doublet")


def pair_label(a: Column, b: Column) -> Column:
    return F.array_join(F.array_sort(F.array(a, b)), "_")


def stars(p: Column) -> Column:
    """Significance marks by upper-closed bins of an adjusted p-value."""
    return F.when(p <= 0.001, "***").when(p <= 0.01, "**").when(p <= 0.05, "*").otherwise("ns")


def bare_symbol(name: Column) -> Column:
    """Upper case without anything but letters and digits."""
    return F.upper(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def benjamini_hochberg(df: DataFrame, p: str = "p", into: str = "padj", by: Sequence[str] = ()) -> DataFrame:
    """Adds p * n / rank, made monotone from the largest p down, at most 1. The
    windows are over the rows of a test (one per feature), ties taken together."""
    part = [F.col(c) for c in by] or [F.lit(0)]
    whole = Window.partitionBy(*part)
    upto = whole.orderBy(p).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = df.withColumn("_raw", F.col(p) * F.count(F.lit(1)).over(whole) / F.count(F.lit(1)).over(upto))
    from_top = whole.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn(into, F.least(F.lit(1.0), F.min("_raw").over(from_top))).drop("_raw")


def fetch_scale(raw: Column, low: Column, high: Column) -> Column:
    """(raw - low) / (high - low) within [0, 1]; 1 where the range is empty."""
    return F.when(high <= low, 1.0).otherwise(clamp((raw - low) / (high - low), 0.0, 1.0))


def quantiles(df: DataFrame, column: str, at: Sequence[float]) -> list[float]:
    """Linearly interpolated quantiles of a column, exact, nulls left out: equal values are
    counted, the counts are dealt out by ranges of values and summed in each, and only the
    rows around the wanted ranks come to the driver. 0 for no rows."""
    counts = materialised(
        df.select(F.col(column).cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
        .repartitionByRange("v").withColumn("part", F.spark_partition_id()),
        "quantiles",
    )
    sums = {r["part"]: (r["c"], r["lo"]) for r in counts.groupBy("part").agg(F.sum("c").alias("c"), F.min("v").alias("lo")).collect()}
    n = sum(c for c, _ in sums.values())
    if not n:
        return [0.0 for _ in at]
    before, done = {}, 0
    for part, (c, _) in sorted(sums.items(), key=lambda x: x[1][1]):
        before[part] = done
        done += c
    places = [q * (n - 1) for q in at]
    wanted = sorted({k for p in places for k in (math.floor(p), math.ceil(p))})
    parts = sorted({part for part, b in before.items() if any(b <= k < b + sums[part][0] for k in wanted)})
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shift = F.element_at(F.create_map(*[F.lit(x) for p in parts for x in (p, before[p])]), F.col("part"))
    rows = counts.filter(F.col("part").isin(parts)).withColumn("hi", upto + shift)
    near = rows.filter(F.array_max(F.transform(F.array(*[F.lit(k) for k in wanted]), lambda k: (k >= F.col("hi") - F.col("c")) & (k < F.col("hi"))))).collect()

    def value(k: int) -> float:
        return next(r["v"] for r in near if r["hi"] - r["c"] <= k < r["hi"])

    return [value(math.floor(p)) + (p - math.floor(p)) * (value(math.ceil(p)) - value(math.floor(p))) for p in places]
