"""Gene-programme scores, cell-cycle phases, perturbation signatures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bare_symbol, cell_cycle_phase
from ..plans.store import bound_batches, materialised
from .matrix import Matrix


def resolve_symbols(features: DataFrame, names: DataFrame) -> DataFrame:
    """(name, feature): exact names, else the first feature (by ord) that is equal but
    for case and punctuation."""
    exact = names.join(features.select("feature"), names["name"] == F.col("feature"), "left_semi").select("name", F.col("name").alias("feature"))
    rest = names.join(exact.select("name"), "name", "left_anti").withColumn("_k", bare_symbol(F.col("name")))
    loose = features.withColumn("_k", bare_symbol(F.col("feature"))).groupBy("_k").agg(F.min_by("feature", "ord").alias("feature"))
    return exact.unionByName(rest.join(loose, "_k").select("name", "feature"))


def program_means(m: Matrix, programs: DataFrame) -> DataFrame:
    """(program, cell, mean) over the features of each programme (program, feature);
    a feature listed twice counts twice; an empty programme gives 0."""
    sizes = programs.groupBy("program").agg(F.count(F.lit(1)).alias("_k"))
    sums = m.expr.join(programs, "feature").groupBy("program", "cell").agg(F.sum("value").alias("_s"))
    grid = m.cells.select("cell").join(F.broadcast(sizes))
    return grid.join(sums, ["program", "cell"], "left").select("program", "cell", F.coalesce(F.col("_s") / F.col("_k"), F.lit(0.0)).alias("mean"))


def expression_bins(m: Matrix, n_bins: int = 24) -> DataFrame:
    """(feature, ord, mean, bin): equal-frequency bins of mean expression, by linearly
    interpolated quantile edges with repeated ones dropped, closed to the right."""
    sums = m.expr.groupBy("feature").agg(F.sum("value").alias("_s"))
    rows = m.features.select("feature", "ord").join(sums, "feature", "left").select("feature", "ord", (F.coalesce("_s", F.lit(0.0)) / float(m.n_cells)).alias("mean"))
    n = min(n_bins, m.n_features)
    edges = sorted(set(rows.agg(F.percentile("mean", F.array(*[F.lit(i / n) for i in range(n + 1)]))).first()[0]))
    index = sum(((F.col("mean") > e).cast("int") for e in edges[1:-1]), F.lit(0))
    return rows.withColumn("bin", index)


def control_features(bins: DataFrame, programs: DataFrame, n_control: int = 100, seed: int = 1) -> DataFrame:
    """(program, feature): for each feature of a programme n_control of its bin, drawn
    by hash; each control counts once in a programme."""
    wanted = programs.join(bins.select("feature", "bin"), "feature").select("program", F.col("feature").alias("_of"), "bin").distinct()
    rows = wanted.join(bins.select("feature", "bin"), "bin")
    nth = F.row_number().over(Window.partitionBy("program", "_of").orderBy(F.xxhash64("program", "_of", "feature", F.lit(seed)), "feature"))
    return rows.withColumn("_k", nth).filter(F.col("_k") <= n_control).select("program", "feature").distinct()


def module_scores(m: Matrix, programs: dict[str, Sequence[str]], n_bins: int = 24, n_control: int = 100, seed: int = 1) -> DataFrame:
    """(program, cell, score): mean of the programme less mean of its controls."""
    rows = [(p, f) for p, fs in programs.items() for f in fs]
    table = m.expr.sparkSession.createDataFrame(rows, "program string, feature string").join(m.features.select("feature"), "feature", "left_semi")
    controls = control_features(expression_bins(m, n_bins), table, n_control, seed)
    own = program_means(m, table)
    other = program_means(m, controls).withColumnRenamed("mean", "_c")
    return own.join(other, ["program", "cell"], "left").select("program", "cell", (F.col("mean") - F.coalesce("_c", F.lit(0.0))).alias("score"))


def cell_cycle(m: Matrix, s_genes: Sequence[str], g2m_genes: Sequence[str], **kwargs) -> DataFrame:
    """(cell, s_score, g2m_score, phase)."""
    scores = module_scores(m, {"S": s_genes, "G2M": g2m_genes}, **kwargs)
    wide = scores.groupBy("cell").agg(F.max(F.when(F.col("program") == "S", F.col("score"))).alias("s_score"), F.max(F.when(F.col("program") == "G2M", F.col("score"))).alias("g2m_score"))
    wide = wide.fillna(0.0)
    return wide.withColumn("phase", cell_cycle_phase(F.col("s_score"), F.col("g2m_score")))


def perturbation_signature(m: Matrix, embedding: DataFrame, controls: DataFrame, features: Sequence[str], k: int = 20) -> DataFrame:
    """(feature, cell, value): each value less the mean of the cell's k nearest control
    cells in an embedding (cell, ord, vec); dense over the chosen features. With no
    control cell every value stays as it is."""
    from .linalg import cell_rows, dense_rows, weighted_rows
    from .neighbors import knn

    names = [r[0] for r in m.features.filter(F.col("feature").isin(list(features))).select("feature").distinct().orderBy("feature").collect()]
    if not names:
        return m.expr.limit(0).select("feature", "cell", F.col("value").cast("double").alias("value"))
    p = len(names)
    rows = materialised(cell_rows(m, names), "rows")
    near = knn(embedding.join(controls.select("cell"), "cell", "left_semi"), k, query=embedding).select("cell", F.col("nbr").alias("other"), F.lit(1.0).alias("weight"))
    around = weighted_rows(near, rows, "left")
    full = m.cells.select("cell").join(rows, "cell", "left").join(around.withColumnsRenamed({"at": "_at", "value": "_v", "n": "_n"}), "cell", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.fill_null(b.column("_n"), 1).to_numpy(zero_copy_only=False).astype(float)
            pair = zip(dense_rows(b.column("at"), b.column("value"), p), dense_rows(b.column("_at"), b.column("_v"), p), strict=True)
            for (lo, own), (_, mean) in pair:
                out = own - mean / size[lo : lo + len(own), None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, p, dtype=np.int32)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("cell").slice(lo, len(own)), lists], ["cell", "v"])

    bound_batches(m.expr.sparkSession)
    wide = full.mapInArrow(run, "cell string, v array<double>").select("cell", F.posexplode("v").alias("_i", "value"))
    return wide.select(F.element_at(F.array(*[F.lit(x) for x in names]), F.col("_i") + 1).alias("feature"), "cell", "value")
