"""Catalog, stores, sources, streams, and operators that SQL can't express."""

import gzip

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparsela.functions.columns import norm
from sparsela.operators import clustering as cl
from sparsela.operators import demux as dm
from sparsela.operators import linalg as la
from sparsela.operators import mapping as mp
from sparsela.operators import markers as mk
from sparsela.operators import matrix as mx
from sparsela.operators import models as md
from sparsela.operators import neighbors as nb
from sparsela.operators import normalize as nz
from sparsela.operators import plots as pl
from sparsela.operators import scores as sc
from sparsela.operators import spatial as sp
from sparsela.operators import variable as vf
from sparsela.plans.catalog import Catalog
from sparsela.plans.store import open_matrix_store, write_matrix_store
from sparsela.sources import tables as src
from sparsela.sources.bundle import export_bundle, import_bundle
from sparsela.streaming import running as st


@pytest.fixture(scope="module")
def planted(spark):
    """90 cells in three groups with ten marker features each, of 40 features."""
    rng = np.random.default_rng(0)
    group = np.repeat([0, 1, 2], 30)
    rate = np.full((40, 90), 0.5)
    for g in range(3):
        rate[g * 10 : g * 10 + 10][:, group == g] = 6
    y = rng.poisson(rate)
    rows = [(f"f{i}", f"c{j:02d}", float(y[i, j])) for i in range(40) for j in range(90) if y[i, j]]
    features = spark.createDataFrame([(f"f{i}", i) for i in range(40)], "feature string, ord long")
    cells = spark.createDataFrame([(f"c{j:02d}", j, f"t{group[j]}", f"b{j % 2}") for j in range(90)], "cell string, ord long, ident string, batch string")
    return mx.from_triplets(spark.createDataFrame(rows, "feature string, cell string, value double"), features, cells), y, group


@pytest.fixture(scope="module")
def spread(spark):
    """200 features of many means over 120 cells; eight differ between the halves."""
    rng = np.random.default_rng(8)
    mean = np.exp(rng.normal(1, 1, 200))
    rate = np.repeat(mean[:, None], 120, axis=1)
    rate[:8, :60] = 12
    rate[:8, 60:] = 1
    y = rng.poisson(rate)
    rows = [(f"f{i}", f"c{j:03d}", float(y[i, j])) for i in range(200) for j in range(120) if y[i, j]]
    features = spark.createDataFrame([(f"f{i}", i) for i in range(200)], "feature string, ord long")
    cells = spark.createDataFrame([(f"c{j:03d}", j) for j in range(120)], "cell string, ord long")
    return mx.from_triplets(spark.createDataFrame(rows, "feature string, cell string, value double"), features, cells)


@pytest.fixture(scope="module")
def reduced(planted):
    m, _, _ = planted
    out = la.run_pca(nz.log_normalize(m), n_pcs=5)
    cells = out["cells"].cache()
    cells.count()
    return out, cells


def purity(labels, group):
    return sum(np.bincount(group[labels == c]).max() for c in set(labels)) / len(group)


def test_pca_is_the_svd(planted, reduced):
    m, y, _ = planted
    out, cells = reduced
    x = np.log1p(y / np.maximum(y.sum(axis=0), 1) * 1e4)
    sd = x.std(axis=1, ddof=1, keepdims=True)
    z = (x - x.mean(axis=1, keepdims=True)) / np.where(sd == 0, 1, sd)
    u, s, _ = np.linalg.svd(z.T, full_matrices=False)
    assert out["stdev"] == pytest.approx(s[:5] / np.sqrt(89), rel=1e-8)
    got = np.array([r["vec"] for r in cells.orderBy("ord").collect()])
    assert np.abs((got * (u[:, :5] * s[:5])).sum(axis=0)) == pytest.approx(s[:5] ** 2, rel=1e-6)
    assert all(got[np.abs(got[:, k]).argmax(), k] > 0 for k in range(5))


def test_clusters_markers_and_partition_invariance(planted, reduced):
    m, _, group = planted
    _, cells = reduced
    snn = nb.snn_graph(nb.knn(cells, 10, block=17), 10)
    found = cl.find_clusters(snn, m.cells, [0.5])
    labels = np.array([r["clusters"] for r in found.join(m.cells.select("cell", "ord"), "cell").orderBy("ord").collect()])
    assert purity(labels, group) > 0.95
    assert cl.modularity(snn, found.select("cell", F.col("clusters").alias("cluster"))) > 0.3
    data = nz.log_normalize(m)
    top = mk.find_all_markers(data).groupBy("cluster").agg(F.collect_list("feature").alias("f")).collect()
    assert {r["cluster"]: set(r["f"][:10]) for r in top} == {f"t{g}": {f"f{g * 10 + k}" for k in range(10)} for g in range(3)}
    one = mk.find_markers(data, ["t0"], threshold=0.0, min_pct=0.0).select("feature", F.round("p", 12).alias("p")).collect()
    shuffled = data.of(data.expr.repartition(7, F.rand(1)))
    assert {tuple(r) for r in one} == {tuple(r) for r in mk.find_markers(shuffled, ["t0"], threshold=0.0, min_pct=0.0).select("feature", F.round("p", 12).alias("p")).collect()}
    every = {r["feature"]: r["p"] for r in mk.find_all_markers(data, threshold=0.0, min_pct=0.0, return_thresh=2).filter("cluster = 't0'").collect()}
    assert all(every[r["feature"]] == pytest.approx(r["p"], abs=1e-9) for r in one)


def test_markers_agree_on_the_planted(planted):
    m, _, _ = planted
    data = nz.log_normalize(m)
    want = {f"f{k}" for k in range(10)}
    for test in ("wilcox", "t", "bimod", "mast", "LR", "negbinom"):
        found = mk.find_markers(data, ["t0"], test=test, only_pos=True, counts=m).limit(10).collect()
        assert {r["feature"] for r in found} == want, test
    limited = mk.two_groups(m, ["t0"], max_cells=5)
    assert {r["grp"]: r["count"] for r in limited.groupBy("grp").count().collect()} == {1: 5, 2: 10}


def test_label_propagation_and_singletons(spark, planted):
    m, _, group = planted
    edges = spark.createDataFrame([(f"c{a:02d}", f"c{b:02d}", 1.0) for a in range(90) for b in range(a + 1, 90) if group[a] == group[b] and (a + b) % 3 == 0], "src string, dst string, weight double")
    got = cl.label_propagation(edges, m.cells)
    labels = np.array([r["cluster"] for r in got.join(m.cells.select("cell", "ord"), "cell").orderBy("ord").collect()])
    assert purity(np.unique(labels, return_inverse=True)[1], group) == 1


def test_ica_spca_leverage_jackstraw(planted, reduced):
    m, _, group = planted
    data = nz.log_normalize(m)
    out, cells = reduced
    sources = np.array([r["vec"] for r in la.run_ica(cells, 3).orderBy("ord").collect()])
    assert np.abs(np.corrcoef(sources.T) - np.eye(3)).max() < 0.05
    graph = nb.knn_graph(nb.knn(cells, 5))
    assert len(la.run_spca(data, graph, [f"f{k}" for k in range(30)], 3)["values"]) == 3
    names = [f"f{k}" for k in range(20)]
    scores = [r["score"] for r in la.leverage_scores(m, names).collect()]
    assert sum(scores) == pytest.approx(20, abs=1e-6)
    assert len({r[0] for r in la.weighted_sample(la.leverage_scores(m, names, n_sketch=40), 10).collect()}) == 10
    p = la.jack_straw(data, [f"f{k}" for k in range(40)], dims=3, replicates=20)
    first = {r["feature"]: r["p"] for r in p.filter("dim = 0").collect()}
    assert np.mean([first[f"f{k}"] for k in range(30)]) < np.mean([first[f"f{k}"] for k in range(30, 40)])
    assert la.score_jack_straw(p, 0.05).count() == 3
    assert la.top_loadings(out["loadings"], 3).filter("dim = 0").count() == 6


def test_sctransform_glmpca_layouts(planted, reduced, spread):
    m, _, group = planted
    _, cells = reduced
    out = md.sctransform(spread, n_features=16, min_cells=1)
    residual = out["residuals"].groupBy("feature").agg(F.var_samp("value").alias("v")).join(out["variances"], "feature").collect()
    assert all(r["v"] == pytest.approx(r["residual_variance"], rel=1e-6) for r in residual)
    assert {f"f{k}" for k in range(8)} <= {r["feature"] for r in out["top"].collect()}
    factors, deviance = md.glm_pca(m, [f"f{k}" for k in range(40)], 2, rounds=30)
    x = np.array([r["vec"] for r in factors.orderBy("cell").collect()])
    gap = np.linalg.norm(x[group == 0].mean(axis=0) - x[group == 1].mean(axis=0))
    assert np.isfinite(deviance) and gap > 2 * x[group == 0].std()
    graph = md.fuzzy_graph(nb.knn(cells, 10))
    for layout in (md.run_tsne(cells, 10, 250), md.run_umap(cells, graph, rounds=100)):
        y = np.array([r["vec"] for r in layout.orderBy("cell").collect()])
        centres = np.array([y[group == g].mean(axis=0) for g in range(3)])
        assert purity(((y[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1), group) > 0.9


def test_spca_is_that_of_the_symmetrised_graph(spark):
    """Loops, repeated edges, both directions and cells without entries, against dense sums;
    an edge comes to one task once."""
    rng = np.random.default_rng(6)
    x = rng.poisson(0.8, (40, 6)).astype(float)
    x[3] = 0
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(*rng.integers(0, 40, (2, 150)), rng.random(150), strict=True)] + [(5, 5, 2.0), (1, 2, 1.0), (2, 1, 1.0)]
    expr = [(f"f{i}", f"c{c}", x[c, i]) for c in range(40) for i in range(6) if x[c, i]]
    m = mx.Matrix(spark.createDataFrame([(f, c, float(v)) for f, c, v in expr], "feature string, cell string, value double"), spark.createDataFrame([(f"f{i}", i) for i in range(6)], "feature string, ord long"), spark.createDataFrame([(f"c{c}", c) for c in range(40)], "cell string, ord long"))
    out = la.run_spca(m, spark.createDataFrame([(f"c{a}", f"c{b}", w) for a, b, w in edges], "src string, dst string, weight double"), [f"f{i}" for i in range(6)], 3)
    g = np.zeros((40, 40))
    for a, b, w in edges:
        g[a, b] += w / 2
        g[b, a] += w / 2
    values, vectors = np.linalg.eigh(x.T @ g @ x)
    assert out["values"] == pytest.approx(values[::-1][:3])
    got = np.array([r["vec"] for r in out["cells"].orderBy("ord").collect()])
    assert np.abs(got) == pytest.approx(np.abs(x @ vectors[:, ::-1][:, :3]))


def test_entries_come_to_dense_blocks_whole():
    """Null and empty lists and sliced batches, in blocks of several rows."""
    at = pa.array([[9], [0, 2], None, [], [1]], pa.list_(pa.int32())).slice(1)
    value = pa.array([[9.0], [3.0, 4.0], None, [], [5.0]], pa.list_(pa.float64())).slice(1)
    parts = list(la.dense_rows(at, value, 3))
    assert np.concatenate([x for _, x in parts]).tolist() == [[3, 0, 4], [0, 0, 0], [0, 0, 0], [0, 5, 0]]
    wide = 1 << 18
    assert [lo for lo, _ in la.dense_rows(at, value, wide)] == [0, 2]


def _dense_glm_pca(y, size, n, family, theta, rounds, penalty=1.0, seed=0):
    """The same steps on one dense matrix, cells by name."""
    p, cells = y.shape
    total = y.sum(axis=0)
    offset = np.log(np.maximum(total / total.mean(), 1e-8))
    base = np.log(np.maximum(y.mean(axis=1) / np.exp(offset).mean(), 1e-8))
    u = np.random.default_rng(seed).normal(0, 1e-2, (p, n))
    v = np.concatenate([np.random.default_rng([seed, k]).normal(0, 1e-2, (min(size, cells - k * size), n)) for k in range(-(-cells // size))])

    def mean(u, v):
        return np.exp(np.clip(base[:, None] + offset[None] + u @ v.T, -30, 30))

    def deviance(mu):
        part = np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0)
        return 2 * float((part - (y - mu)).sum() if family == "poisson" else (part - (y + theta) * np.log((y + theta) / (mu + theta))).sum())

    last = deviance(mean(u, v))
    for _ in range(rounds):
        for which in (0, 1):
            mu = mean(u, v)
            scale = 1 if family == "poisson" else 1 + mu / theta
            slope, weight, old, step = (y - mu) / scale, mu / scale, (u, v), 1.0
            move = (slope @ v - penalty * u) / (weight @ (v * v) + penalty) if which == 0 else (slope.T @ u - penalty * v) / (weight.T @ (u * u) + penalty)
            for _ in range(10):
                u, v = (old[0] + step * move, v) if which == 0 else (u, old[1] + step * move)
                now = deviance(mean(u, v))
                if now <= last * (1 + 1e-9) + 1e-9:
                    break
                step /= 2
        last = now
    _, s, b = np.linalg.svd(u @ v.T, full_matrices=False)
    return np.abs(b[:n].T * s[:n]), last


@pytest.mark.parametrize("family", ["poisson", "nb"])
def test_glm_pca_in_blocks_is_that_of_one_matrix(spark, family):
    rng = np.random.default_rng(2)
    y = rng.poisson(np.exp(0.5 + rng.normal(0, 0.9, (7, 2)) @ rng.normal(0, 0.9, (2, 150)))).astype(float)
    y[:, 70] = 0
    expr = [(f"f{i}", f"c{c:03d}", float(y[i, c])) for i in range(7) for c in range(150) if y[i, c]]
    features = spark.createDataFrame([(f"f{i}", i) for i in range(7)], "feature string, ord long")
    cells = spark.createDataFrame([(f"c{c:03d}", c) for c in range(150)], "cell string, ord long")
    m = mx.Matrix(spark.createDataFrame(expr, "feature string, cell string, value double"), features, cells)
    got, deviance = md.glm_pca(m, [f"f{i}" for i in range(7)], 2, family, 5.0, rounds=4, tol=0.0, block=64)
    want, least = _dense_glm_pca(y, 64, 2, family, 5.0, 4)
    assert deviance == pytest.approx(least, rel=1e-9)
    assert np.abs(np.array([r["vec"] for r in got.orderBy("cell").collect()])) == pytest.approx(want, abs=1e-7)


def test_glm_pca_of_more_cells_than_one_matrix_held(spark):
    cells = spark.range(20_050).select(F.concat(F.lit("c"), F.col("id")).alias("cell"), F.col("id").alias("ord"))
    features = spark.createDataFrame([(f"f{i}", i) for i in range(4)], "feature string, ord long")
    expr = cells.select("cell", F.explode(F.array(*[F.lit(f"f{i}") for i in range(4)])).alias("feature"), "ord")
    expr = expr.select("feature", "cell", (F.pmod(F.xxhash64("feature", "cell"), F.lit(5))).cast("double").alias("value")).filter("value > 0")
    got, deviance = md.glm_pca(mx.Matrix(expr, features, cells), [f"f{i}" for i in range(4)], 2, rounds=1)
    assert got.count() == 20_050 and np.isfinite(deviance)


def test_perturbation(spark, planted):
    m, _, group = planted
    data = nz.log_normalize(m)
    dense = nz.scale_data(data, [f"f{k}" for k in range(20)])
    cells = m.cells.select("cell", F.when(F.col("ident") == "t0", "NT").when(F.col("ident") == "t1", "A").otherwise("B").alias("target"))
    de = spark.createDataFrame([(t, f"f{k}") for t in "AB" for k in range(20)], "target string, feature string")
    calls = md.mixscape(dense, cells, "NT", de)
    assert calls.filter("target = 'A'").filter("call = 'A KO'").count() >= 28
    lda = md.discriminants(m.cells.join(la.run_pca(data, n_pcs=4)["cells"].drop("ord"), "cell").select("cell", "vec"), m.cells.select("cell", F.col("ident").alias("label")), 4)
    x = np.array([r["vec"] for r in lda.orderBy("cell").collect()])
    assert x.shape == (90, 2)
    assert pl.perturbation_heatmap(dense, calls, ["f1"]).count() == 60 and pl.perturbation_plot(calls, 10).count() > 0


def test_harmony_moves_batches_together(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{i:03d}", i, (rng.normal(0, 1, 3) + np.array([5 * (i % 2), 0, 0]) + np.array([0, 4 * (i % 3), 0])).tolist(), f"b{i % 2}") for i in range(240)]
    df = spark.createDataFrame(rows, "cell string, ord long, vec array<double>, batch string")
    out = la.run_harmony(df.drop("batch"), df.select("cell", "batch"), n_clusters=6)
    x = np.array([r["vec"] for r in out.orderBy("ord").collect()])
    before = np.array([r[2] for r in rows])
    even = np.arange(240) % 2 == 0
    gap = lambda z: np.linalg.norm(z[even].mean(axis=0) - z[~even].mean(axis=0))
    assert gap(x) < 0.6 * gap(before)


def test_mapping(spark, planted, reduced):
    m, _, group = planted
    _, cells = reduced
    a, b = cells.filter("ord % 2 = 0"), cells.filter("ord % 2 = 1")
    labels = m.cells.select("cell", F.col("ident").alias("class"))
    got = mp.project_labels(b, a, labels, 10).join(labels.withColumnRenamed("class", "true"), "cell").collect()
    assert np.mean([r["class"] == r["true"] for r in got]) > 0.95
    anchors = mp.filter_anchors(mp.find_anchors(a, b, 5, 10), a, b, 200)
    weights = mp.anchor_weights(anchors, b, 10)
    sums = weights.groupBy("cell").agg(F.sum("weight").alias("w")).collect()
    assert all(r["w"] == pytest.approx(1) for r in sums)
    data = nz.log_normalize(m)
    ref, query = (mx.subset(data, cells=x).expr for x in (a, b))
    assert mp.transfer_values(weights, ref).filter("value < 0").count() == 0
    assert mp.integrate_data(anchors, ref, query, weights).select("cell").distinct().count() == 90
    assert mp.integrate_embeddings(anchors, a, b, 10).count() == 90
    assert mp.place_by_neighbors(b, a, a.select("cell", "vec"), 5).count() == b.count()
    loadings = reduced[0]["loadings"]
    scaled = nz.scale_data(data, [f"f{k}" for k in range(40)])
    assert mp.project(scaled, loadings).join(cells.withColumnRenamed("vec", "v"), "cell").filter(norm(F.zip_with("vec", "v", lambda x, y: x - y)) > 1e-6).count() == 0
    with pytest.raises(ValueError, match="k_weight"):
        mp.anchor_weights(anchors.limit(3).withColumn("cell2", F.lit("c01")), b, 3)


def test_multimodal_prefers_the_informative(planted, reduced):
    m, _, _ = planted
    _, cells = reduced
    noise = cells.withColumn("vec", F.array(F.rand(1), F.rand(2), F.rand(3)))
    out = nb.multimodal_neighbors(cells, noise, 8, 20)
    assert out["neighbors"].groupBy("cell").count().filter("count <> 8").count() == 0
    assert out["weights"].agg(F.avg("w1")).first()[0] > 0.5


def test_tags(spark):
    rng = np.random.default_rng(5)
    rows = []
    for j in range(150):
        for t in range(3):
            rows.append((f"T{t}", f"c{j:03d}", float(rng.poisson(120 if j % 3 == t or (j >= 140 and t == (j + 1) % 3) else 4))))
    features = spark.createDataFrame([(f"T{t}", t) for t in range(3)], "feature string, ord long")
    cells = spark.createDataFrame([(f"c{j:03d}", j) for j in range(150)], "cell string, ord long")
    m = mx.from_triplets(spark.createDataFrame(rows, "feature string, cell string, value double"), features, cells)
    truth = {f"c{j:03d}": "Doublet" if j >= 140 else f"T{j % 3}" for j in range(150)}
    for method in ("clara", "kmeans"):
        calls, cutoffs = dm.hto_demux(m, samples=10, method=method)
        got = {r["cell"]: r["hash_id"] for r in calls.collect()}
        assert np.mean([got[c] == t for c, t in truth.items()]) > 0.95 and all(4 < c < 60 for c in cutoffs.values())
    for auto in (False, True):
        calls, used = dm.multiseq_demux(m, auto=auto)
        got = {r["cell"]: r["classification"] for r in calls.collect()}
        assert np.mean([got[c] == t for c, t in truth.items()]) > 0.9 and 0 < used < 1


def test_module_scores(planted):
    m, _, group = planted
    data = nz.log_normalize(m)
    out = sc.module_scores(data, {"P": [f"f{k}" for k in range(5)], "none": ["absent"]}, n_bins=4, n_control=5)
    score = {r["cell"]: r["score"] for r in out.filter("program = 'P'").collect()}
    assert np.mean([score[f"c{j:02d}"] for j in range(30)]) > np.mean([score[f"c{j:02d}"] for j in range(30, 90)]) + 0.5
    names = data.expr.sparkSession.createDataFrame([("F-1",), ("f2",), ("zz",)], "name string")
    assert {(r["name"], r["feature"]) for r in sc.resolve_symbols(m.features, names).collect()} == {("F-1", "f1"), ("f2", "f2")}


def test_spatial_forms_agree(spark):
    rng = np.random.default_rng(6)
    xy = rng.random((80, 2)) * 10
    value = np.where(xy[:, 0] > 5, 3.0, 0.0)
    noise = rng.poisson(1.0, 80).astype(float)
    at = spark.createDataFrame([("i", f"c{i:02d}", i, *map(float, xy[i])) for i in range(80)], "image string, cell string, ord long, x double, y double")
    rows = [(f, f"c{i:02d}", float(v[i])) for f, v in (("a", value), ("b", noise)) for i in range(80) if v[i]]
    values = spark.createDataFrame(rows, "feature string, cell string, value double")
    base = 1 / np.where(np.eye(80, dtype=bool), np.inf, ((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    w = base / base.sum(axis=1, keepdims=True)
    z = {f: v - v.mean() for f, v in (("a", value), ("b", noise))}
    got = {r["feature"]: r for r in sp.morans_i_inverse_square(values, at, ["a", "b"]).collect()}
    for f in "ab":
        assert got[f]["moransi"] == pytest.approx(z[f] @ w @ z[f] / (z[f] @ z[f]), rel=1e-9)
    assert got["a"]["rank"] == 1 and got["a"]["p"] < 0.01
    near = {r["feature"]: r["moransi"] for r in sp.morans_i(values, at, sp.knn_weights(at, 5)).collect()}
    assert near["a"] > 0.5 > near["b"]
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    spacing = np.median(np.where(np.eye(80, dtype=bool), np.inf, d).min(axis=1))
    u = (d - 2 * spacing) / spacing
    k = np.where((np.abs(u) < 1) & ~np.eye(80, dtype=bool), 1 - u**2, 0)
    want = {f: ((k.sum(axis=1) * v * v).sum() - v @ k @ v) / k.sum() / (v @ v / 80) for f, v in z.items()}
    got = {r["feature"]: r["markvariogram"] for r in sp.mark_variogram(values, at, 2.0, 1.0).collect()}
    assert got == {f: pytest.approx(x, rel=1e-9) for f, x in want.items()}
    twins = at.unionByName(at.limit(1).withColumn("cell", F.lit("twin")))
    with pytest.raises(Exception, match="share their coordinates"):
        sp.morans_i_inverse_square(values, twins, ["a"])
    assert sp.create_fovs(at.withColumn("who", F.lit("a b")), "who").select("image").distinct().first()[0] == "a_b"
    with pytest.raises(ValueError, match="missing"):
        sp.create_centroids(at.drop("x"))


def test_catalog(planted, reduced, tmp_path):
    m, _, _ = planted
    _, cells = reduced
    obj = Catalog.create(m, min_cells=3, min_features=5)
    obj = obj.with_layer("data", nz.log_normalize(obj.matrix("counts")).expr).log("normalize", "RNA", scale=1e4)
    obj.reductions["pca"] = cells
    obj.graphs["snn"] = nb.snn_graph(nb.knn(cells, 5), 5)
    obj.neighbors["nn"] = nb.knn(cells, 5)
    part = obj.set_ident("batch").subset(idents=["b0"])
    assert len(part) == 45 and part.neighbors == {} and part.reductions["pca"].count() == 45
    assert part.graphs["snn"].join(part.cells, F.col("src") == F.col("cell"), "left_anti").count() == 0
    assert obj.layers_list("^d") == ["data"] and obj.matrix().name == "data" and obj.without_layer("data").layers_list() == ["counts"]
    renamed = obj.rename_cells(obj.cells.select("cell", F.concat(F.lit("n"), "cell").alias("new")))
    assert renamed.graphs["snn"].filter("src not like 'n%' or dst not like 'n%'").count() == 0
    assert renamed.neighbors["nn"].filter("cell not like 'n%' or nbr not like 'n%'").count() == 0
    both = obj.merge([obj], ["a", "b"])
    with pytest.raises(ValueError, match="kinds"):
        obj.merge([obj.copy(kinds={"RNA": "fixed"})], ["a", "b"])
    assert len(both) == 2 * len(obj) and both.matrix("counts").expr.count() == 2 * obj.layers["RNA", "counts"].count()
    assert obj.command_table().first()["key"] == "normalize.RNA" and "ident" in obj["ident"].columns
    with pytest.raises(ValueError):
        obj.with_key("pca", "PC")
    assert obj.with_key("pca", "PC_").keys == {"pca": "PC_"}
    export_bundle(obj, f"{tmp_path}/o")
    back = import_bundle(m.expr.sparkSession, f"{tmp_path}/o")
    assert back.layers.keys() == obj.layers.keys() and len(back) == len(obj) and back.reductions["pca"].count() == 90


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("RNA", "counts", "f", "c", 1.0), ("RNA", "counts", "f", "c", 2.0), ("RNA", "counts", "g", "c", 0.0)], "assay string, layer string, feature string, cell string, value double")
    write_matrix_store(rows, f"{tmp_path}/s")
    assert [r["value"] for r in open_matrix_store(spark, f"{tmp_path}/s").collect()] == [3.0]
    with pytest.raises(FileExistsError):
        write_matrix_store(rows, f"{tmp_path}/s")
    write_matrix_store(rows, f"{tmp_path}/s", overwrite=True)
    (tmp_path / "other").mkdir()
    with pytest.raises(ValueError, match="no matrix store"):
        write_matrix_store(rows, f"{tmp_path}/other", overwrite=True)


def write_10x(folder, gz=True):
    folder.mkdir(parents=True)
    opened = (lambda n: gzip.open(folder / (n + ".gz"), "wt")) if gz else (lambda n: open(folder / n, "w"))
    with opened("matrix.mtx") as f:
        f.write("%%MatrixMarket matrix coordinate integer general\n%\n3 2 3\n1 1 5\n3 1 2\n2 2 7\n")
    with opened("features.tsv" if gz else "genes.tsv") as f:
        f.write("E1\tA\tGene Expression\nE2\tB\tGene Expression\nE3\tA\tNegative Control\n")
    with opened("barcodes.tsv") as f:
        f.write("AA-1\nCC-1\n")


@pytest.mark.parametrize("gz", [True, False])
def test_read_10x(spark, tmp_path, gz):
    write_10x(tmp_path / "m", gz)
    m = src.read_10x(spark, str(tmp_path / "m"))
    assert {tuple(r) for r in m.expr.collect()} == {("A", "AA-1", 5.0), ("A.1", "AA-1", 2.0), ("B", "CC-1", 7.0)}
    assert [r["feature"] for r in m.features.orderBy("ord").collect()] == ["A", "B", "A.1"]


def test_mtx_data_source(spark, tmp_path):
    write_10x(tmp_path / "m", False)
    spark.dataSource.register(src.MtxDataSource)
    want = {(0, 0, 5.0), (2, 0, 2.0), (1, 1, 7.0)}
    for step in ("1", "7", "1000"):
        assert {tuple(r) for r in spark.read.format("mtx").option("rangebytes", step).load(f"{tmp_path}/m/matrix.mtx").collect()} == want
    assert {tuple(r) for r in src.read_mtx(spark, f"{tmp_path}/m/matrix.mtx").collect()} == want


def test_spatial_bundles(spark, tmp_path):
    write_10x(tmp_path / "x" / "cell_feature_matrix")
    (tmp_path / "x" / "cells.csv").write_text("cell_id,x_centroid,y_centroid\nAA-1,1.5,2\nCC-1,,3\nZZ-1,1,1\n")
    m, at = src.load_xenium(spark, f"{tmp_path}/x")
    assert m.n_features == 2 and [r["cell"] for r in at.collect()] == ["AA-1"]
    write_10x(tmp_path / "v" / "filtered_feature_bc_matrix")
    (tmp_path / "v" / "spatial").mkdir()
    (tmp_path / "v" / "spatial" / "tissue_positions.csv").write_text("barcode,in_tissue,array_row,array_col,pxl_row_in_fullres,pxl_col_in_fullres\nAA-1,1,0,0,10,20\nCC-1,0,0,1,11,21\n")
    (tmp_path / "v" / "spatial" / "scalefactors_json.json").write_text('{"spot_diameter_fullres": 80.5, "tissue_lowres_scalef": 0.05}')
    (tmp_path / "v" / "spatial" / "tissue_hires_image.png").write_bytes(b"png")
    m, at = src.load_visium(spark, f"{tmp_path}/v")
    assert [(r["cell"], r["x"], r["y"]) for r in at.collect()] == [("AA-1", 20.0, 10.0)] and m.n_cells == 1
    factors = src.read_scale_factors(spark, f"{tmp_path}/v/spatial/scalefactors_json.json").first()
    assert factors["spot"] == 80.5 and np.isnan(factors["hires"])
    assert bytes(src.read_tissue_image(spark, f"{tmp_path}/v/spatial").first()["content"]) == b"png"
    (tmp_path / "e.csv").write_text("fov,cell_ID,A,B\n1,0,9,9\n1,1,3,0\n1,2,0,4\n")
    (tmp_path / "n.csv").write_text("fov,cell_ID,CenterX_global_px,CenterY_global_px\n1,1,5,6\n1,2,7,8\n")
    m, at = src.load_cosmx(spark, f"{tmp_path}/e.csv", f"{tmp_path}/n.csv")
    assert {tuple(r) for r in m.expr.collect()} == {("A", "1_1", 3.0), ("B", "1_2", 4.0)} and at.count() == 2
    (tmp_path / "g.csv").write_text("cell,A,Blank-1\n11,3,1\n12,2,0\n")
    (tmp_path / "k.csv").write_text("EntityID,center_x,center_y\n11,5,6\n12,7,8\n")
    m, at = src.load_merscope(spark, f"{tmp_path}/g.csv", f"{tmp_path}/k.csv")
    assert m.n_features == 1 and at.count() == 2
    (tmp_path / "w.csv").write_text("gene,c1,c2\nA,0,2\nB,1,0\n")
    m = src.read_wide_table(spark, f"{tmp_path}/w.csv")
    assert {tuple(r) for r in m.expr.collect()} == {("A", "c2", 2.0), ("B", "c1", 1.0)}


def test_streams_match_batches_over_several_files(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("cell"), F.col("event_type").alias("feature"), "value")
    events.repartition(5).write.parquet(f"{tmp_path}/e")
    stream = st.stream_table(spark, f"{tmp_path}/e", 2)
    one = {tuple(r) for r in st.run(st.running_counts(stream)).select("cell", F.round("n_count", 6), "n_records").collect()}
    assert one == {tuple(r) for r in st.running_counts(events).select("cell", F.round("n_count", 6), "n_records").collect()}
    rows = st.run(st.running_variance(stream), "update", own_state=True).groupBy("feature").agg(F.max_by(F.struct("mean", "variance"), "n").alias("m"), F.max("n").alias("n")).collect()
    want = {r["feature"]: r for r in events.groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance")).collect()}
    for r in rows:
        assert (r["n"], r["m"]["mean"], r["m"]["variance"]) == (want[r["feature"]]["n"], pytest.approx(want[r["feature"]]["mean"]), pytest.approx(want[r["feature"]]["variance"]))
    late = st.windowed_moments(st.stream_table(spark, f"{tmp_path}/e", 1), late="0 seconds")
    assert st.run(late, "append").agg(F.sum("n")).first()[0] <= events.count()


def test_variable_features_find_the_planted(planted, spread):
    m, _, _ = planted
    top = {r["feature"] for r in vf.find_variable_features(spread, 12).collect()}
    assert {f"f{k}" for k in range(8)} <= top
    assert vf.dispersions(nz.log_normalize(m), 10, "equal_frequency").filter("bin < -1 or bin > 9").count() == 0
    many = nz.regress_out_many(nz.scale_data(nz.log_normalize(m), ["f1", "f2"]), m.cells.withColumn("k", F.col("ord").cast("double")), ["k"])
    assert abs(many.join(m.cells, "cell").agg(F.corr("value", "ord")).first()[0]) < 1e-9


def test_modularity_raises_above_its_bound(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, weight double")
    cells = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "cell string, ord int")
    with pytest.raises(ValueError, match="edges"):
        cl.communities(edges, cells, max_edges=1)


def test_mark_variogram_query_has_all_features(spark, sf_dir):
    from sparsela.plans import fixture as fix
    from sparsela.plans.operator_queries import mark_variogram

    assert mark_variogram(spark, sf_dir).count() == fix.data(spark, sf_dir).expr.select("feature").distinct().count()
