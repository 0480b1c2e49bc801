"""Tail probabilities as DuckDB expressions, for the SQL beside the queries."""

from __future__ import annotations

TERMS = 500


def gamma_p(a: str, x: str) -> str:
    """The regularised lower incomplete gamma function, by its series of positive terms."""
    return f"CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} > 150 THEN 1.0 ELSE list_sum(list_transform(range(0, {TERMS}), lambda i: exp(({a} + i) * ln({x}) - {x} - lgamma({a} + i + 1)))) END"


def chi2_sf(x: str, df: str) -> str:
    return f"greatest(0.0, 1 - ({gamma_p(f'(({df}) / 2.0)', f'(({x}) / 2.0)')}))"


def normal_two_sided(z: str) -> str:
    return chi2_sf(f"(({z}) * ({z}))", "1")


def t_two_sided(t: str, df: str) -> str:
    """1 - I_y(1/2, df/2) with y = t^2 / (df + t^2), by the hypergeometric series."""
    y, b = f"(({t}) * ({t}) / (({df}) + ({t}) * ({t})))", f"(({df}) / 2.0)"
    term = f"exp((i + 0.5) * ln({y}) + {b} * ln(1 - {y}) + lgamma(i + 0.5 + {b}) - lgamma({b}) - lgamma(i + 1.5))"
    return f"CASE WHEN {t} = 0 THEN 1.0 WHEN abs({t}) > 12 THEN 0.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, {TERMS}), lambda i: {term}))) END"


def log_binomial(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
