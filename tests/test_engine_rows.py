"""Operators that keep a cell's entries together: against brute force, and what they may not do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsela.operators import scores as sc
from sparsela.operators import spatial as sp
from sparsela.operators.matrix import Matrix


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("metric", [2.0, 0.5])
def test_mark_variogram_writes_no_pairs(spark, monkeypatch, metric):
    rng = np.random.default_rng(3)
    xy = rng.random((300, 2)) * 10
    xy[:120] = xy[0] + rng.random((120, 2)) * 0.1  # a crowd in one square
    marks = {f: rng.poisson(1.0, 300).astype(float) for f in "ab"}
    at = spark.createDataFrame([("i", f"c{i}", i, *map(float, xy[i])) for i in range(300)], "image string, cell string, ord long, x double, y double")
    values = spark.createDataFrame([(f, f"c{i}", float(v[i])) for f, v in marks.items() for i in range(300) if v[i]], "feature string, cell string, value double")
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    spacing = np.median(np.where(np.eye(300, dtype=bool), np.inf, d).min(axis=1))
    u = (d - metric * spacing) / spacing
    k = np.where((np.abs(u) < 1) & ~np.eye(300, dtype=bool), 1 - u**2, 0)
    want = {f: ((k.sum(axis=1) * v * v).sum() - v @ k @ v) / k.sum() / v.var() for f, v in marks.items()}

    def written(*_):
        raise AssertionError("pairs times features: the table that filled the disk")

    monkeypatch.setattr(sp, "band_pairs", written)
    monkeypatch.setattr(sp, "BAND_CELLS", 16, raising=False)
    monkeypatch.setattr(sp, "BAND_FEATURES", 1, raising=False)
    got = {r["feature"]: r["markvariogram"] for r in sp.mark_variogram(values, at, metric, 1.0).collect()}
    assert got == {f: pytest.approx(x, rel=1e-9) for f, x in want.items()}


def test_perturbation_signature_joins_rows_of_cells(spark):
    rng = np.random.default_rng(4)
    x, vec = rng.poisson(0.7, (40, 6)).astype(float), rng.random((40, 2))
    x[3] = x[7] = 0  # cells without entries, one of them a control
    cells = spark.createDataFrame([(f"c{i}", i) for i in range(40)], "cell string, ord long")
    features = spark.createDataFrame([(f"f{j}", j) for j in range(6)], "feature string, ord long")
    expr = spark.createDataFrame([(f"f{j}", f"c{i}", float(x[i, j])) for i in range(40) for j in range(6) if x[i, j]], "feature string, cell string, value double")
    e = spark.createDataFrame([(f"c{i}", i, [float(a) for a in vec[i]]) for i in range(40)], "cell string, ord long, vec array<double>")
    m, names = Matrix(expr, features, cells), ["f5", "f1", "f2", "none"]
    out = sc.perturbation_signature(m, e, cells.filter("ord < 12"), names, 4)
    near = np.argsort(((vec[:, None] - vec[None, :12]) ** 2).sum(axis=2), axis=1)[:, :4]
    want = x - x[near].mean(axis=1)
    got = {(r["feature"], r["cell"]): r["value"] for r in out.collect()}
    assert got == {(f"f{j}", f"c{i}"): pytest.approx(want[i, j], abs=1e-12) for i in range(40) for j in (5, 1, 2)}
    alone = sc.perturbation_signature(m, e, cells.filter("ord < 0"), names, 4)
    assert alone.agg(F.sum("value")).first()[0] == pytest.approx(x[:, [5, 1, 2]].sum())
    # no join of a row for every feature of every neighbour
    assert "[feature" not in "".join(line for line in _plan(out).splitlines() if "Join" in line)


def test_transfers_join_rows_of_cells(spark):
    from sparsela.operators import mapping as mp

    rng = np.random.default_rng(5)
    ref, own = rng.random((6, 3)), rng.random((5, 3))
    ref[2] = 0
    pairs = {(c, a, b): rng.random() for c in range(5) for a, b in ((0, 1), (2, 1), (4, 3), (5, 0)) if (a + b + c) % 2}
    weights = spark.createDataFrame([(f"c{c}", f"c{a}", f"c{b}", w) for (c, a, b), w in pairs.items()], "cell string, cell1 string, cell2 string, weight double")
    # the datasets share their cells' names
    long = lambda x: spark.createDataFrame([(f"f{j}", f"c{i}", float(v)) for (i, j), v in np.ndenumerate(x) if v], "feature string, cell string, value double")
    anchors = weights.select("cell1", "cell2").distinct()
    rows = lambda df: {(r["feature"], r["cell"]): r["value"] for r in df.collect()}
    moved, passed = own.copy(), np.zeros_like(own)
    for (c, a, b), w in pairs.items():
        moved[c] += w * (ref[a] - own[b])
        passed[c] += w * ref[a]
    values = mp.transfer_values(weights, long(ref))
    assert rows(values) == {(f"f{j}", f"c{i}"): pytest.approx(v) for (i, j), v in np.ndenumerate(passed) if v}
    whole = mp.integrate_data(anchors, long(ref), long(own), weights)
    assert whole.count() == 15 + 15
    query = rows(whole.exceptAll(long(ref)))
    assert query == {(f"f{j}", f"c{i}"): pytest.approx(v) for (i, j), v in np.ndenumerate(moved)}
    # no row for each feature of each pair
    for df in (values, whole):
        assert "keys=[feature" not in df._jdf.queryExecution().executedPlan().toString()


def test_integrated_embeddings_are_not_taken_apart(spark):
    from sparsela.operators import mapping as mp

    rng = np.random.default_rng(6)
    frame = lambda p, n: spark.createDataFrame([(f"{p}{i}", i, rng.random(3).tolist()) for i in range(n)], "cell string, ord long, vec array<double>")
    a, b = frame("a", 12), frame("b", 10)
    anchors = spark.createDataFrame([(f"a{i}", f"b{i}", 0.5) for i in range(8)], "cell1 string, cell2 string, score double")
    out = mp.integrate_embeddings(anchors, a, b, 4)
    x, y = ({r["cell"]: np.array(r["vec"]) for r in e.collect()} for e in (a, b))
    want = {c: v.copy() for c, v in (x | y).items()}
    for r in mp.anchor_weights(anchors, b, 4).collect():
        want[r["cell"]] += r["weight"] * (x[r["cell1"]] - y[r["cell2"]])
    assert {r["cell"]: r["vec"] for r in out.collect()} == {c: pytest.approx(v.tolist()) for c, v in want.items()}
    assert "posexplode" not in _plan(out)


def test_find_clusters_reads_its_graph_once(spark):
    from sparsela.operators import clustering as cl

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    pairs = [(a, b) for g in (range(5), range(5, 10)) for a in g for b in g] + [(4, 5), (5, 4), (10, 0), (0, 10)]
    edges = spark.createDataFrame([(f"c{a}", f"c{b}", 1.0) for a, b in pairs], "src string, dst string, weight double").mapInArrow(counted, "src string, dst string, weight double")
    cells = spark.createDataFrame([(f"c{i}", i) for i in range(11)], "cell string, ord long")
    got = {r["cell"]: r["clusters"] for r in cl.find_clusters(edges, cells, [0.5, 1.0]).collect()}
    assert len({got[f"c{i}"] for i in range(5)}) == 1 and got["c0"] != got["c9"]
    assert read.value == len(pairs)
