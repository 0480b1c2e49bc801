"""Functions in NumPy: special functions, smoothers, tests in closed form."""

import math

import numpy as np
import pytest

from sparsela.functions import special as f
from sparsela.operators.clustering import Leiden, Louvain, resolution_label
from sparsela.operators.demux import medoids, negbinom_quantile
from sparsela.operators.models import nb_theta, second_normal
from sparsela.operators.plots import hue_palette
from sparsela.operators.variable import loess


def test_tails():
    assert f.normal_two_sided(np.array([1.959963984540054]))[0] == pytest.approx(0.05, abs=1e-12)
    assert f.chi2_sf(np.array([3.841458820694124, 7.814727903251179]), np.array([1, 3])) == pytest.approx([0.05, 0.05], abs=1e-10)
    assert f.chi2_sf(np.array([1400.0]), 1)[0] < 1e-300 and f.chi2_sf(np.array([0.0]), 2)[0] == 1
    assert f.t_two_sided(np.array([2.2281388519649385, 0.0]), np.array([10, 5])) == pytest.approx([0.05, 1.0], abs=1e-10)


def test_gamma_functions():
    assert f.digamma(np.array([1.0, 0.1])) == pytest.approx([-0.5772156649015329, -10.423754940411076], rel=1e-10)
    assert f.trigamma(np.array([1.0, 5.0])) == pytest.approx([math.pi**2 / 6, 0.22132295573711533], rel=1e-9)
    assert f.lgamma(np.array([5.0]))[0] == pytest.approx(math.log(24))


def test_fisher():
    assert f.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857, abs=1e-9)
    assert f.fisher_exact(8, 2, 1, 5) == pytest.approx(0.03496503496, abs=1e-9)
    assert f.fisher_exact(5, 5, 5, 5) == pytest.approx(1)


def test_loess_is_exact_on_a_parabola():
    x = np.linspace(-2, 3, 80)
    assert loess(x, 1 + 2 * x - 3 * x * x) == pytest.approx(1 + 2 * x - 3 * x * x, abs=1e-8)
    order = np.random.default_rng(0).permutation(80)
    y = np.sin(x)
    assert loess(x[order], y[order]) == pytest.approx(loess(x, y)[order], abs=1e-12)


def test_theta_and_quantile():
    rng = np.random.default_rng(1)
    y = rng.negative_binomial(5, 5 / (5 + 20), 4000).astype(float)
    assert nb_theta(y, np.full(len(y), y.mean())) == pytest.approx(5, rel=0.1)
    assert abs(negbinom_quantile(y, 0.99) - np.quantile(y, 0.99)) <= 3
    assert negbinom_quantile(np.zeros(5), 0.99) == 0 and negbinom_quantile(np.full(50, 4.0), 0.99) >= 7


def test_second_normal():
    rng = np.random.default_rng(2)
    first = rng.normal(0, 1, 200)
    x = np.concatenate([rng.normal(6, 1, 60), rng.normal(0, 1, 40)])
    post = second_normal(x, float(first.mean()), float(first.std()))
    assert (post[:60] > 0.5).mean() > 0.95 and (post[60:] > 0.5).mean() < 0.1
    assert second_normal(np.array([1.0]), 0, 1).tolist() == [0.0]
    weighted = negbinom_quantile(np.array([0.0, 3.0, 9.0]), 0.9, np.array([50, 30, 20]))
    assert weighted == negbinom_quantile(np.repeat([0.0, 3.0, 9.0], [50, 30, 20]), 0.9)


def test_medoids():
    points = np.array([[0, 0], [0, 1], [1, 0], [9, 9], [9, 10], [10, 9]], dtype=float)
    assert set(medoids(points, 2)) == {0, 3}


@pytest.mark.parametrize("method", [Louvain, Leiden])
def test_communities_are_the_cliques(method):
    src, dst = zip(*[(a + o, b + o) for o in (0, 6, 12) for a in range(6) for b in range(a + 1, 6)], (0, 6), (6, 12))
    labels = method(18, np.array(src), np.array(dst), np.ones(len(src)), 1.0, 0).run()
    assert len(set(labels)) == 3 and all(len(set(labels[o : o + 6])) == 1 for o in (0, 6, 12))


@pytest.mark.parametrize(("r", "text"), [(0.5, "0.5"), (1, "1"), (0.8, "0.8"), (100000, "1e+05"), (0.00001, "1e-05"), (1.25, "1.25")])
def test_resolution_label(r, text):
    assert resolution_label(r) == text


def test_palette():
    colours = hue_palette(5)
    assert len(set(colours)) == 5 and all(len(c) == 7 and c[0] == "#" for c in colours)
