"""Regressions of every feature at once: normal equations by aggregation, in rounds.

Cells stay in their tasks. A task holds one block of cells, dense over the tested
features, and gives sums of a few numbers a feature; the driver keeps the coefficients
(features by columns) and solves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import digamma, lgamma, trigamma
from ..plans.store import materialised
from .linalg import cell_rows
from .matrix import Matrix

#: Numbers of a dense block.
BLOCK = 4_000_000


class Rounds:
    """Cells with their covariates and entries, written once, and passes over them."""

    def __init__(self, m: Matrix, groups: DataFrame, features: Sequence[str], latent: Sequence[str]) -> None:
        self.features, self.spark = list(features), m.expr.sparkSession
        covariates = F.array(*[F.col(c).cast("double") for c in latent]) if latent else F.array().cast("array<double>")
        cells = groups.join(m.cells.select("cell", covariates.alias("x")), "cell")
        self.rows = materialised(cells.join(cell_rows(m, self.features), "cell", "left").select((F.col("grp") == 1).cast("double").alias("one"), "x", "at", "value"), "regression")

    def sums(self, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum over blocks of of(one, x, values): one number each for a cell, a row of
        covariates, and a row over features; gives features x numbers."""
        p = len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            step = max(1, BLOCK // max(p, 1))
            for b in batches:
                one = np.array(b.column(0).to_pylist(), dtype=float)
                x = np.array(b.column(1).to_pylist(), dtype=float).reshape(len(one), -1)
                at, value = b.column(2).to_pylist(), b.column(3).to_pylist()
                for lo in range(0, len(one), step):
                    hi = min(len(one), lo + step)
                    dense = np.zeros((hi - lo, p))
                    for k in range(lo, hi):
                        if at[k] is not None:
                            dense[k - lo, at[k]] = value[k]
                    part = of(one[lo:hi], x[lo:hi], dense)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(list(range(p)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["f", "v"])

        parts = self.rows.mapInArrow(run, "f int, v array<double>").select("f", F.posexplode("v").alias("k", "v")).groupBy("f", "k").agg(F.sum("v").alias("v")).collect()
        out = np.zeros((p, 1 + max((r["k"] for r in parts), default=-1)))
        for r in parts:
            out[r["f"], r["k"]] = r["v"]
        return out


Design = Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


def columns(group: bool, value: bool) -> Design:
    """The model's columns, each of cells by features: one, then the group, the value and
    the covariates where they belong to it."""

    def of(one: np.ndarray, x: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
        shape = values.shape
        wide = [np.ones(shape)]
        if group:
            wide.append(np.broadcast_to(one[:, None], shape))
        if value:
            wide.append(values)
        return [*wide, *(np.broadcast_to(x[:, [j]], shape) for j in range(x.shape[1]))]

    return of


def _equations(design: list[np.ndarray], weight: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Upper triangle of X'WX and X't, a row of numbers for each feature."""
    k = len(design)
    return [(weight * design[a] * design[b]).sum(axis=0) for a in range(k) for b in range(a, k)] + [(d * target).sum(axis=0) for d in design]


def _solved(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(steps, matrices) from the sums of _equations."""
    matrices = np.zeros((len(sums), k, k))
    at = 0
    for a in range(k):
        for b in range(a, k):
            matrices[:, a, b] = matrices[:, b, a] = sums[:, at]
            at += 1
    return np.stack([np.linalg.lstsq(m, v, rcond=None)[0] for m, v in zip(matrices, sums[:, at : at + k], strict=True)]), matrices


def logistic_deviance(rounds: Rounds, k: int, design: Design, response: Callable, most: int = 40) -> np.ndarray:
    """Deviance of a logistic regression of each feature; response(one, values) is 0 or 1."""
    beta = np.zeros((len(rounds.features), k))
    last = np.full(len(beta), np.inf)
    for _ in range(most):

        def of(one, x, values, beta=beta):
            parts = design(one, x, values)
            y = response(one, values)
            eta = np.clip(sum(d * beta[:, j] for j, d in enumerate(parts)), -30, 30)
            mu = 1 / (1 + np.exp(-eta))
            safe = np.clip(mu, 1e-12, 1 - 1e-12)
            deviance = -2 * (y * np.log(safe) + (1 - y) * np.log(1 - safe)).sum(axis=0)
            return np.stack([*_equations(parts, np.maximum(mu * (1 - mu), 1e-10), y - mu), deviance], axis=1)

        sums = rounds.sums(of)
        now = sums[:, -1]
        if np.abs(now - last).max() < 1e-9 * (1 + np.abs(now).max()):
            break
        last = now
        beta = beta + np.clip(_solved(sums, k)[0], -10, 10)
    return last if not np.isfinite(now).all() else now


def level_fit(rounds: Rounds, k: int, design: Design) -> tuple[np.ndarray, np.ndarray]:
    """(cells above zero, residual sum of squares among them) of least squares."""

    def of(one, x, values):
        seen = (values > 0).astype(float)
        return np.stack([*_equations(design(one, x, values), seen, values * seen), seen.sum(axis=0), (values * values).sum(axis=0)], axis=1)

    sums = rounds.sums(of)
    steps, _ = _solved(sums, k)
    right = sums[:, -2 - k : -2]
    return sums[:, -2], np.maximum(sums[:, -1] - (steps * right).sum(axis=1), 0.0)


def hurdle_with_covariates(rounds: Rounds, k_latent: int) -> tuple[np.ndarray, np.ndarray]:
    """(statistic, df) of each feature: likelihood ratio of the group in a logistic model
    of detection plus in a normal model of the level, both with the covariates. A part
    without information, or without gain, does not count."""

    def seen(one, values):
        return (values > 0).astype(float)

    gain = logistic_deviance(rounds, 1 + k_latent, columns(False, False), seen) - logistic_deviance(rounds, 2 + k_latent, columns(True, False), seen)
    n, rss0 = level_fit(rounds, 1 + k_latent, columns(False, False))
    _, rss1 = level_fit(rounds, 2 + k_latent, columns(True, False))
    ones = rounds.sums(lambda one, x, values: np.stack([np.full(values.shape[1], one.sum()), np.full(values.shape[1], float(len(one))), ((values > 0) * one[:, None]).sum(axis=0)], axis=1))
    both = (ones[:, 2] > 0) & (ones[:, 2] < n)
    with np.errstate(divide="ignore", invalid="ignore"):
        level = n * np.log(rss0 / rss1)
    has_d = (n > 0) & (n < ones[:, 1]) & (gain > 1e-9)
    has_l = (n > 2 + k_latent) & both & (rss1 > 1e-14) & np.isfinite(level) & (level > 1e-9)
    return np.where(has_d, gain, 0.0) + np.where(has_l, level, 0.0), has_d.astype(float) + has_l


def logistic_gain(rounds: Rounds, k_latent: int) -> np.ndarray:
    """What the value adds to a logistic model of the group by the covariates."""

    def is_one(one, values):
        return np.broadcast_to(one[:, None], values.shape)

    return logistic_deviance(rounds, 1 + k_latent, columns(False, False), is_one) - logistic_deviance(rounds, 2 + k_latent, columns(False, True), is_one)


def negative_binomial_wald(rounds: Rounds, k_latent: int, most: int = 60) -> np.ndarray:
    """z of the group in a negative binomial regression of each feature on group and
    covariates; coefficients and the dispersion's logarithm move together, a Newton step
    of each a round."""
    k = 2 + k_latent
    design = columns(True, False)
    first = rounds.sums(lambda one, x, v: np.stack([v.sum(axis=0), (v * v).sum(axis=0), np.full(v.shape[1], float(len(v)))], axis=1))
    mean = np.maximum(first[:, 0] / first[:, 2], 1e-8)
    variance = first[:, 1] / first[:, 2] - mean**2
    log_theta = np.log(np.clip(mean**2 / np.maximum(variance - mean, 1e-6), 1e-3, 1e5))
    beta = np.zeros((len(mean), k))
    beta[:, 0] = np.log(mean)
    matrices = None
    for _ in range(most):
        theta = np.exp(log_theta)

        def of(one, x, v, beta=beta, theta=theta):
            parts = design(one, x, v)
            mu = np.exp(np.clip(sum(d * beta[:, j] for j, d in enumerate(parts)), -30, 30))
            score = digamma(v + theta) - digamma(theta) + np.log(theta / (theta + mu)) + 1 - (v + theta) / (theta + mu)
            slope = trigamma(v + theta) - trigamma(theta) + 1 / theta - 2 / (theta + mu) + (v + theta) / (theta + mu) ** 2
            return np.stack([*_equations(parts, mu / (1 + mu / theta), (v - mu) / (1 + mu / theta)), score.sum(axis=0), slope.sum(axis=0)], axis=1)

        sums = rounds.sums(of)
        step, matrices = _solved(sums, k)
        s, d = sums[:, -2], sums[:, -1]
        curve = theta * s + theta * theta * d
        move = np.where(curve < 0, -theta * s / np.where(curve < 0, curve, -1), np.copysign(0.5, s))
        move = np.clip(move, -1, 1)
        beta = beta + np.clip(step, -3, 3)
        moved = np.clip(log_theta + move, np.log(1e-3), np.log(1e5))
        done = np.abs(step).max() < 1e-7 and np.abs(moved - log_theta).max() < 1e-6
        log_theta = moved
        if done:
            break
    inverse = np.stack([np.linalg.pinv(m) for m in matrices])
    with np.errstate(divide="ignore", invalid="ignore"):
        z = beta[:, 1] / np.sqrt(inverse[:, 1, 1])
    return np.where(first[:, 0] > 0, z, np.nan)


def negative_binomial_by_counts(value: np.ndarray, one: np.ndarray, n: np.ndarray) -> float:
    """The same z without covariates, from (value, group, number of cells): the means are
    the groups' own for any dispersion, which a golden search of the profile finds."""
    total = [n[one == g].sum() for g in (0, 1)]
    mean = [float((value * n)[one == g].sum() / t) if t else 0.0 for g, t in zip((0, 1), total, strict=True)]
    if min(mean) <= 0:
        return float("nan")
    mu = np.where(one == 1, mean[1], mean[0])

    def loglik(log_theta: float) -> float:
        theta = np.exp(log_theta)
        return float((n * (lgamma(value + theta) - lgamma(np.full(len(value), theta)) + theta * np.log(theta / (theta + mu)) + value * np.log(mu / (theta + mu)))).sum())

    lo, hi, golden = np.log(1e-3), np.log(1e5), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        lo, hi = (lo, b) if loglik(a) > loglik(b) else (a, hi)
    theta = np.exp((lo + hi) / 2)
    weight = [t * m / (1 + m / theta) for t, m in zip(total, mean, strict=True)]
    return float(np.log(mean[1] / mean[0]) / np.sqrt(1 / weight[0] + 1 / weight[1]))
