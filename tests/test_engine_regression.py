"""Regressions in rounds, widths of kernels, neighbours on a grid, blocks and arrays."""

import dataclasses
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsela.functions.special import chi2_sf
from sparsela.operators import markers as mk
from sparsela.operators import matrix as mx
from sparsela.operators import models as md
from sparsela.operators import neighbors as nb
from sparsela.operators import spatial as sp
from sparsela.streaming import running as st


N = 140


@pytest.fixture(scope="module")
def counted(spark):
    """140 cells, a covariate that drives f0, a group that drives f1, noise in f2."""
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, N)
    group = np.arange(N) % 2
    y = np.stack([rng.poisson(np.exp(-0.3 + 0.6 * x)), rng.poisson(np.exp(-0.5 + group)), rng.poisson(0.8, N)]).astype(float)
    rows = [(f"f{i}", f"c{j:03d}", float(y[i, j])) for i in range(3) for j in range(N) if y[i, j]]
    cells = spark.createDataFrame([(f"c{j:03d}", j, f"t{group[j]}", float(x[j]), 1.0) for j in range(N)], "cell string, ord long, ident string, x double, one double")
    features = spark.createDataFrame([(f"f{i}", i) for i in range(3)], "feature string, ord long")
    return mx.from_triplets(spark.createDataFrame(rows, "feature string, cell string, value double"), features, cells), y, x, group


def p_of(m, test, **more):
    return {r["feature"]: r["p"] for r in mk.find_markers(m, ["t1"], test=test, min_pct=0.0, threshold=0.0, **more).collect()}


def logistic(y, x):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x, x.T @ (y - mu))
    mu = 1 / (1 + np.exp(-x @ beta))
    return -2 * (y * np.log(mu) + (1 - y) * np.log(1 - mu)).sum()


def test_logistic_against_one_feature_at_a_time(counted):
    m, y, x, group = counted
    one = np.ones((N, 1))
    for latent, extra in (((), np.empty((N, 0))), (("x",), x[:, None])):
        got = p_of(m, "LR", latent=latent)
        for i in range(3):
            gain = logistic(group, np.hstack([one, extra])) - logistic(group, np.hstack([one, y[i][:, None], extra]))
            assert got[f"f{i}"] == pytest.approx(float(chi2_sf(np.array([gain]), 1)[0]), rel=1e-6)


def test_hurdle_with_covariates(counted):
    m, y, x, group = counted
    plain, same, real = p_of(m, "mast"), p_of(m, "mast", latent=("one",)), p_of(m, "mast", latent=("x",))
    assert same == {f: pytest.approx(p, abs=1e-8) for f, p in plain.items()}
    one = np.ones((N, 1))
    for i in range(3):
        seen = y[i] > 0
        null, full = np.hstack([one, x[:, None]]), np.hstack([one, group[:, None], x[:, None]])
        statistic, df = 0.0, 0
        if 0 < seen.sum() < N and (gain := logistic(seen, null) - logistic(seen, full)) > 1e-9:
            statistic, df = gain, 1
        rss = [((y[i][seen] - d[seen] @ np.linalg.lstsq(d[seen], y[i][seen], rcond=None)[0]) ** 2).sum() for d in (null, full)]
        statistic, df = statistic + seen.sum() * math.log(rss[0] / rss[1]), df + 1
        assert real[f"f{i}"] == pytest.approx(float(chi2_sf(np.array([statistic]), df)[0]), rel=1e-5)
    assert real["f1"] < 1e-4 < real["f2"]


def test_negative_binomial_both_ways(counted):
    m, _, _, _ = counted
    plain, same = p_of(m, "negbinom"), p_of(m, "negbinom", latent=("one",))
    assert same == {f: pytest.approx(p, rel=1e-3, abs=1e-6) for f, p in plain.items()}
    assert p_of(m, "negbinom", latent=("x",))["f1"] < 1e-4 and plain["f1"] < 1e-4
    with pytest.raises(ValueError, match="no test"):
        p_of(m, "wilcoxon")


def test_widths_and_poisson():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 2, 1500)
    assert md.sheather_jones(x) == pytest.approx(1.06 * 2 * 1500**-0.2, rel=0.15)
    two = np.concatenate([rng.normal(-6, 0.5, 700), rng.normal(6, 0.5, 700)])
    assert md.sheather_jones(two) < 0.3 * 1.06 * two.std() * 1400**-0.2
    assert md.sheather_jones(np.ones(10)) == 1.0
    y = rng.poisson(np.exp(0.3 + 0.7 * x / 2)).astype(float)
    beta, mu = md.poisson_offset_fit(y, np.stack([np.ones(1500), x], axis=1))
    assert beta == pytest.approx([0.3, 0.35], abs=0.08) and mu.sum() == pytest.approx(y.sum())
    assert md.poisson_offset_fit(y, np.ones((1500, 1)))[0][0] == pytest.approx(math.log(y.mean()))


@pytest.mark.parametrize("shape", ["even", "clusters", "line", "same"])
def test_grid_gives_the_same_neighbours(spark, shape):
    rng = np.random.default_rng(4)
    xy = {
        "even": rng.random((300, 2)) * 100,
        "clusters": np.concatenate([rng.normal(0, 0.01, (150, 2)), rng.normal(50, 5, (149, 2)), [[900, 900]]]),
        "line": np.stack([np.arange(300) / 3, np.zeros(300)], axis=1),
        "same": np.zeros((300, 2)),
    }[shape]
    points = spark.createDataFrame([(f"p{i}", i, [float(a), float(b)]) for i, (a, b) in enumerate(xy)], "cell string, ord long, vec array<double>")
    for kwargs in ({"exclude_self": True}, {"query": points.filter("ord % 3 = 0")}):
        rows = [sorted((r["cell"], r["rank"], r["nbr"], round(r["dist"], 9)) for r in f(points, 5, **kwargs).collect()) for f in (sp.grid_knn, nb.knn)]
        assert rows[0] == rows[1]


def test_blocks_and_arrays(spark, counted):
    m, y, _, _ = counted
    blocks = list(mx.col_blocks(m, 25))
    assert [k for k, _ in blocks] == [0, 1, 2, 3, 4, 5] and [b.n_cells for _, b in blocks] == [25, 25, 25, 25, 25, 15]
    assert sum(b.expr.count() for _, b in blocks) == m.expr.count()
    data, indices, starts = mx.to_arrays(m)
    dense = np.zeros_like(y)
    for j in range(N):
        dense[indices[starts[j] : starts[j + 1]], j] = data[starts[j] : starts[j + 1]]
    assert (dense == y).all()
    with pytest.raises(ValueError, match="entries"):
        mx.to_arrays(m, 3)


def test_late_rows(spark, tmp_path):
    days = [["2024-01-10", "2024-01-11"], ["2024-01-09", "2024-01-12", "2024-01-10"], ["2024-01-10", "2024-01-12"]]
    for part in days:
        spark.createDataFrame([(d,) for d in part], "d string").select(F.col("d").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/l")
    rows = st.late_rows(st.stream_table(spark, f"{tmp_path}/l", 1), "1 day").orderBy("batch").collect()
    assert [(r["n"], r["n_late"]) for r in rows] == [(2, 0), (3, 1), (2, 1)]


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from sparsela.plans import store

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        store.shared_folder(Session())
    assert dataclasses.is_dataclass(mx.Matrix)


def test_quantiles(spark):
    from sparsela.functions.columns import quantiles

    rng = np.random.default_rng(9)
    for x in (rng.normal(0, 1, 501), rng.integers(0, 4, 300).astype(float), np.array([3.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
        assert quantiles(df, "v", [0.0, 0.05, 0.5, 0.95, 1.0]) == pytest.approx(list(np.quantile(x, [0, 0.05, 0.5, 0.95, 1])))
    assert quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [0.0]


def test_numbered_rows_are_in_order(spark):
    from sparsela.plans.store import numbered

    names = [f"n{(k * 7919) % 1000:04d}" for k in range(1000)]
    rows = numbered(spark.createDataFrame([(n,) for n in names + names[:50]], "cell string").repartition(7), "cell").collect()
    assert {r["cell"]: r["ord"] for r in rows} == {n: k for k, n in enumerate(sorted(names))}
