"""Queries against their SQL in DuckDB, on the smallest tables."""

import datetime

import duckdb
import pandas as pd
import pytest

from sparsela.plans import more_queries, operator_queries  # noqa: F401
from sparsela.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(frame):
    def value(x):
        if x is None or (isinstance(x, float) and x != x) or x is pd.NaT:
            return None
        if isinstance(x, float):
            return round(x, 6) + 0.0
        return str(x) if isinstance(x, (datetime.datetime, pd.Timestamp)) else x

    columns = sorted(frame.columns)
    return sorted((tuple(value(x) for x in row) for row in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def cells_of(spark, sf_dir, table="customer", prefix="c", key="c_custkey"):
    return {f"{prefix}{r[0]}" for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect()}


def between(low, high):
    return lambda v: v.dropna().between(low, high).all()


def finite(v):
    return v.notna().all() and v.abs().lt(1e9).all()


#: What holds for queries that SQL can't express: their keys, how many rows each, and
#: properties of columns. Values against planted truth are in test_engine_objects.
FEATURES = {f"MT-{k}" for k in range(6)} | {f"g{k}" for k in range(6, 120)}
HOLDS = {
    "find_variable_features": ("feature", 40, {}),
    "find_markers_LR": ("feature", FEATURES, {"p": between(0, 1), "p_adj": between(0, 1)}),
    "find_markers_negbinom": ("feature", FEATURES, {"p": between(0, 1), "pct_1": between(0, 1)}),
    "pseudobulk_test": ("feature", FEATURES, {"p": between(0, 1), "padj": between(0, 1), "stat": finite}),
    "find_clusters": ("cell", "emb", {"clusters": lambda v: v.nunique() > 1}),
    "find_clusters_leiden": ("cell", "emb", {"clusters": lambda v: v.nunique() > 1}),
    "multimodal_neighbors": ("cell", "emb", {"w1": between(0, 1)}),
    "pca": ("cell", "cells", {"pc_1": finite, "pc_2": finite}),
    "leverage_scores": ("cell", "cells", {"score": between(0, 1.000001)}),
    "sketch_data": ("cell", 100, {}),
    "cca": ("cell", None, {"v1": between(0, 1), "v2": between(0, 1)}),
    "harmony": ("cell", "emb", {"v1": finite}),
    "niches": ("cell", "cells", {"niche": between(1, 4)}),
    "hto_demux": ("cell", "cells", {"call": lambda v: set(v) <= {"Negative", "Singlet", "Doublet"}}),
    "viz_dim_loadings": (None, None, {"loading": between(-1, 1)}),
    "variable_feature_plot": ("feature", FEATURES, {"variable": lambda v: v.sum() == 20}),
    "elbow": ("dim", 10, {"stdev": lambda v: v.is_monotonic_decreasing and (v > 0).all()}),
    "dim_heatmap": (None, None, {"value": between(-2.5, 2.5)}),
    "integration_anchors_cca": (None, None, {"score": between(0, 1)}),
    "integration_anchors_rpca": (None, None, {"score": between(0, 1)}),
    "integrate_layers": ("cell", "cells", {"v1": finite}),
    "map_query": ("cell", None, {"score": between(0, 1.000001)}),
    "project_data": ("cell", "cells", {"score": between(0, 1.000001)}),
    "sctransform": ("feature", FEATURES, {"residual_variance": between(0, 1000)}),
    "discriminants": ("cell", "cells", {"v1": finite}),
    "mixscape": ("cell", None, {"call": lambda v: v.str.endswith((" KO", " NP")).all()}),
    "fuzzy_graph": (None, None, {"weight": between(0, 1)}),
    "jack_straw": (None, 360, {"p": between(0, 1)}),
    "ica": ("cell", "cells", {"v1": finite}),
    "spca": ("feature", FEATURES, {"v1": between(0, 1)}),
    "clara": ("cell", "emb", {"cluster": between(0, 3)}),
    "run_tsne": ("cell", "emb", {"v1": finite}),
    "run_umap": ("cell", "emb", {"v1": finite}),
    "glm_pca": ("cell", "cells", {"v1": finite}),
    "top_dim_features": ("feature", None, {}),
}


def test_every_query_is_held_by_something():
    assert set(QUERIES) - set(ORACLE_SQL) == set(HOLDS)


@pytest.mark.parametrize("name", sorted(HOLDS))
def test_holds(spark, sf_dir, name):
    key, rows, columns = HOLDS[name]
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = {"cells": lambda: cells_of(spark, sf_dir), "emb": lambda: cells_of(spark, sf_dir, "embeddings", "v", "vec_id")}[rows]() if isinstance(rows, str) else rows
    assert len(got) == (len(want) if isinstance(want, set) else want) if want is not None else len(got) > 0
    if key:
        assert got[key].is_unique and (not isinstance(want, set) or set(got[key]) == want)
    for column, holds in columns.items():
        assert holds(got[column]), (column, got[column].describe())
