"""Several operators in a row: integration, mapping, sketches, niches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import l2_normalise
from ..plans.store import materialised
from . import linalg, mapping, models, spatial
from .matrix import Matrix, subset
from .neighbors import knn
from .normalize import feature_moments


def scaled_values(m: Matrix, names: Sequence[str], mean: Sequence[float], sd: Sequence[float]) -> tuple[DataFrame, list[float], list[float]]:
    """Entries of the chosen features with the given centre and scale attached."""
    table = m.expr.sparkSession.createDataFrame([(f, float(a), float(b)) for f, a, b in zip(names, mean, sd, strict=True)], "feature string, mean double, sd double")
    return m.expr.join(F.broadcast(table), "feature"), list(mean), list(sd)


def project_onto(m: Matrix, pca: dict) -> DataFrame:
    """(cell, ord, vec): cells of another dataset in a reference's components, centred
    and scaled as the reference was. Absent entries come in through the centre alone."""
    rows = {r["feature"]: r["vec"] for r in pca["loadings"].collect()}
    basis = np.array([rows[f] for f in pca["names"]]) / np.asarray(pca["sd"], dtype=float)[:, None]
    return linalg._projected(m, linalg.cell_rows(m, pca["names"]), basis, np.asarray(pca["mean"], dtype=float) @ basis)


def integration_features(parts: Sequence[Matrix], features: Sequence[str]) -> list[str]:
    """The features that all datasets have, with a spread in each, in their order."""
    shared = mapping.shared_features(parts[0].features, *[p.features for p in parts[1:]])
    varying = mapping.varying_everywhere([feature_moments(p) for p in parts])
    rows = shared.join(varying, "feature", "left_semi").filter(F.col("feature").isin(list(features))).orderBy("ord")
    return [r["feature"] for r in rows.select("feature", "ord").collect()]


def _written(m: Matrix) -> Matrix:
    """The layer in shared storage, once: a part of a layer that is read in several passes."""
    return m if hasattr(m.expr, "written_path") else m.of(materialised(m.expr.select("feature", "cell", "value"), "part"))


def _near_by_values(a: Matrix, b: Matrix, loadings: DataFrame, dims: int, k_filter: int) -> Callable[[DataFrame], DataFrame] | None:
    """Chooses pairs (cell1, cell2) that are near by the values of the features with the
    most extreme loadings; None where that is no choice."""
    chosen = linalg.top_dim_features(loadings, most=max(2 * dims, 200))
    if not chosen or min(a.n_cells, b.n_cells) < k_filter:
        return None

    def keep(pairs: DataFrame) -> DataFrame:
        units = (linalg.dense_cells(m, chosen).withColumn("vec", l2_normalise(F.col("vec"))) for m in (a, b))
        return mapping.near_anchors(pairs, *units, k_filter)

    return keep


def find_integration_anchors(a: Matrix, b: Matrix, features: Sequence[str], reduction: str = "cca", dims: int = 30, k_anchor: int = 5, k_filter: int | None = 200, k_score: int = 30) -> DataFrame:
    """(cell1, cell2, score) in a joint (cca) or in reciprocal (rpca) spaces. With cca only
    pairs stay, and are scored, whose second cell is among the first's k_filter neighbours
    by the layers' values of the features with the most extreme loadings, at unit length;
    all of them where a dataset has fewer cells. rpca has no such filter."""
    a, b = _written(a), _written(b)
    names = integration_features([a, b], features)
    if reduction == "cca":
        both = linalg.run_cca(a, b, names, dims)
        x, y = (materialised(both["cells"].filter(F.col("dataset") == d).select("cell", "ord", "vec"), "unit") for d in "ab")
        keep = _near_by_values(a, b, both["loadings"], dims, k_filter) if k_filter else None
        return mapping.find_anchors(x, y, k_anchor, k_score, keep)
    pa, pb = linalg.run_pca(a, names, dims), linalg.run_pca(b, names, dims)
    unit = lambda e: materialised(e.withColumn("vec", l2_normalise(F.col("vec"))), "unit")  # noqa: E731  searched twice or more
    in_a = unit(pa["cells"]), unit(project_onto(b, pa))
    in_b = unit(project_onto(a, pb)), unit(pb["cells"])
    k = max(k_anchor, k_score)
    ab, ba = knn(in_b[1], k, query=in_b[0]), knn(in_a[0], k, query=in_a[1])
    return mapping.anchors_from(ab, ba, in_a[0], in_b[1], k_anchor, k_score)


def integrate_layers(m: Matrix, embedding: DataFrame, by: str, features: Sequence[str], method: str = "harmony", dims: int = 30, k_weight: int = 100) -> DataFrame:
    """(cell, vec): an embedding corrected for a metadata column. harmony on the
    embedding itself; cca and rpca by anchors to the largest batch."""
    if method == "harmony":
        return linalg.run_harmony(embedding, m.cells.select("cell", F.col(by).alias("batch"))).select("cell", "vec")
    if method not in ("cca", "rpca"):
        raise ValueError(f"unknown method {method!r}")
    sizes = m.cells.groupBy(by).count().orderBy(F.desc("count"), by).collect()
    parts = {r[0]: _written(subset(m, cells=m.cells.filter(F.col(by) == r[0]))) for r in sizes}
    first, *others = parts
    reference = embedding.join(parts[first].cells.select("cell"), "cell", "left_semi")
    out = reference.select("cell", "vec")
    for name in others:
        query = embedding.join(parts[name].cells.select("cell"), "cell", "left_semi")
        anchors = find_integration_anchors(parts[first], parts[name], features, method, dims, k_filter=None)
        moved = mapping.integrate_embeddings(anchors, reference, query, k_weight)
        out = out.unionByName(moved.join(query.select("cell"), "cell", "left_semi"))
    return out


def find_transfer_anchors(reference: Matrix, query: Matrix, features: Sequence[str], dims: int = 30, k_anchor: int = 5, k_filter: int = 200, k_score: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(anchors, reference embedding, query embedding): the query projected on the
    reference's components, both of unit length."""
    reference, query = _written(reference), _written(query)
    names = integration_features([reference, query], features)
    pca = linalg.run_pca(reference, names, dims)
    a, b = (materialised(e.withColumn("vec", l2_normalise(F.col("vec"))), "unit") for e in (pca["cells"], project_onto(query, pca)))
    return materialised(mapping.filter_anchors(mapping.find_anchors(a, b, k_anchor, k_score), a, b, k_filter), "filtered"), a, b


def map_query(reference: Matrix, query: Matrix, features: Sequence[str], labels: DataFrame, layout: DataFrame | None = None, dims: int = 30, k_weight: int = 50) -> DataFrame:
    """(cell, class, score[, vec]): transferred labels and, with a reference layout
    (cell, vec), places in it."""
    anchors, a, b = find_transfer_anchors(reference, query, features, dims)
    out = mapping.transfer_labels(mapping.anchor_weights(anchors, b, min(k_weight, anchors.select("cell2").distinct().count())), labels)
    return out if layout is None else out.join(mapping.place_by_neighbors(b, a, layout), "cell")


def sketch_data(m: Matrix, features: Sequence[str], n: int = 5000, method: str = "leverage", seed: int = 123) -> Matrix:
    """A matrix of n cells, drawn by leverage or evenly."""
    scores = linalg.leverage_scores(m, features, seed=seed) if method == "leverage" else m.cells.select("cell", F.lit(1.0).alias("score"))
    return subset(m, cells=linalg.weighted_sample(scores, n, seed))


def project_data(full: Matrix, sketch: Matrix, features: Sequence[str], labels: DataFrame, dims: int = 30, k: int = 50) -> DataFrame:
    """(cell, class, score) for all cells from a labelled sketch of them."""
    pca = linalg.run_pca(sketch, features, dims)
    return mapping.project_labels(project_onto(full, pca), pca["cells"], labels, k)


def build_niche_assay(centroids: DataFrame, labels: DataFrame, k: int = 20, n_niches: int = 4, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(counts of neighbour categories as feature, cell, value; niches by cell)."""
    near = spatial.local_neighborhood(centroids, labels, k)
    entries = near.filter("n > 0").select(F.col("category").alias("feature"), "cell", F.col("n").cast("double").alias("value"))
    return entries, spatial.niches(near, n_niches, seed)


def mixscape_lda(m: Matrix, calls: DataFrame, control: str, de_features: dict[str, Sequence[str]], n_pcs: int = 10) -> DataFrame:
    """(cell, vec): discriminants over the components of every target's features,
    each fitted on its perturbed cells and the controls; calls: (cell, label)."""
    blocks = None
    for k, (target, features) in enumerate(sorted(de_features.items())):
        some = calls.filter(F.col("label").isin(target, control)).select("cell")
        pca = linalg.run_pca(subset(m, cells=some), features, n_pcs)
        part = project_onto(m, pca).select("cell", F.col("vec").alias(f"v{k}"))
        blocks = part if blocks is None else blocks.join(part, "cell")
    columns = [c for c in blocks.columns if c != "cell"]
    joined = blocks.select("cell", F.flatten(F.array(*columns)).alias("vec"))
    width = len(joined.first()["vec"])
    return models.discriminants(joined, calls, width)
