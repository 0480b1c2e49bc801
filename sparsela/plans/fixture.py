"""A labelled matrix out of the order tables, with SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import Matrix, from_triplets
from ..operators.normalize import log_normalize
from .store import _exists, shared_folder

N_FEATURES = 120


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feature_name(number) -> F.Column:
    return F.concat(F.when(number < 6, "MT-").otherwise("g"), number.cast("string"))


def features(spark: SparkSession) -> DataFrame:
    return spark.range(N_FEATURES).select(feature_name(F.col("id")).alias("feature"), F.col("id").alias("ord"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("cell"), F.col("c_custkey").cast("long").alias("ord"), F.col("c_mktsegment").alias("ident"),
        F.concat(F.lit("b"), (F.col("c_nationkey") % 3).cast("string")).alias("batch"), F.col("c_acctbal").alias("depth"),
    )


#: Where the layers of an application and folder of tables are written.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def _layer(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A layer is written to shared storage once for an application, and read from there."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN or not _exists(spark, _WRITTEN[key]):
        path = f"{shared_folder(spark)}/layer-{name}-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.schema("feature string, cell string, value double").parquet(_WRITTEN[key])


def counts(spark: SparkSession, sf_dir: str) -> Matrix:
    """What each customer (cell) ordered of each of 120 groups of parts (features)."""
    expr = _layer(spark, sf_dir, "counts", lambda: _counts(spark, sf_dir).expr.select("feature", "cell", "value"))
    return Matrix(expr, features(spark), cells(spark, sf_dir))


def _counts(spark: SparkSession, sf_dir: str) -> Matrix:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        feature_name(F.col("l_partkey") % N_FEATURES).alias("feature"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("cell"), F.col("l_quantity").alias("value")
    )
    return from_triplets(rows, features(spark), cells(spark, sf_dir))


def data(spark: SparkSession, sf_dir: str) -> Matrix:
    m = counts(spark, sf_dir)
    return m.of(_layer(spark, sf_dir, "data", lambda: log_normalize(m).expr.select("feature", "cell", "value")), "data")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("long")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("i"), (k % 2).cast("string")).alias("image"), F.concat(F.lit("c"), k.cast("string")).alias("cell"), k.alias("ord"),
        ((k * 7919) % 1009 / 10.0).alias("x"), ((k * 104729) % 997 / 10.0).alias("y"),
    )


def embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("cell"), F.col("vec_id").alias("ord"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("label"))


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as vertices of outlines: one ring per order."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.lit("i").alias("image"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("cell"), F.col("l_linenumber").cast("int").alias("vertex"),
        F.col("l_quantity").alias("x"), (F.col("l_partkey") % 50).cast("double").alias("y"),
    ).dropDuplicates(["cell", "vertex", "x", "y"])


# -- the same in SQL -------------------------------------------------------

FEATURE_SQL = "CASE WHEN {0} < 6 THEN 'MT-' ELSE 'g' END || CAST({0} AS VARCHAR)"

PARTS = {
    "features": (f"SELECT {FEATURE_SQL.format('id')} AS feature, id AS ord FROM (SELECT unnest(range({N_FEATURES})) AS id)", ()),
    "cells": ("SELECT 'c' || c_custkey AS cell, CAST(c_custkey AS BIGINT) AS ord, c_mktsegment AS ident, 'b' || (c_nationkey % 3) AS batch, c_acctbal AS depth FROM customer", ()),
    "expr": (f"SELECT {FEATURE_SQL.format(f'(l_partkey % {N_FEATURES})')} AS feature, 'c' || o_custkey AS cell, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING sum(l_quantity) <> 0", ()),
    "totals": ("SELECT cell, sum(value) AS total FROM expr GROUP BY cell", ("expr",)),
    "data": ("SELECT feature, cell, ln(1 + value / total * 10000) AS value FROM expr JOIN totals USING (cell)", ("expr", "totals")),
    "n": ("SELECT CAST(count(*) AS DOUBLE) AS n FROM customer", ()),
    "centroids": ("SELECT 'i' || (c_custkey % 2) AS image, 'c' || c_custkey AS cell, CAST(c_custkey AS BIGINT) AS ord, ((CAST(c_custkey AS BIGINT) * 7919) % 1009) / 10.0 AS x, ((CAST(c_custkey AS BIGINT) * 104729) % 997) / 10.0 AS y FROM customer", ()),
    "emb": ("SELECT 'v' || vec_id AS cell, vec_id AS ord, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS VARCHAR) AS label FROM embeddings", ()),
    "rings": ("SELECT DISTINCT 'i' AS image, 'o' || l_orderkey AS cell, CAST(l_linenumber AS BIGINT) AS vertex, l_quantity AS x, CAST(l_partkey % 50 AS DOUBLE) AS y FROM lineitem", ()),
    "knn10": ("SELECT * FROM (SELECT a.cell, b.cell AS nbr, list_distance(a.vec, b.vec) AS dist, row_number() OVER (PARTITION BY a.cell ORDER BY round(list_distance(a.vec, b.vec), 12), b.ord) AS rank FROM emb a CROSS JOIN emb b) WHERE rank <= 10", ("emb",)),
    "snn": ("SELECT a.cell AS src, b.cell AS dst, count(*) / (20.0 - count(*)) AS weight FROM knn10 a JOIN knn10 b USING (nbr) GROUP BY 1, 2 HAVING count(*) / (20.0 - count(*)) >= 1 / 15.0", ("emb", "knn10")),
    "space6": ("SELECT * FROM (SELECT a.cell, b.cell AS nbr, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist, row_number() OVER (PARTITION BY a.cell ORDER BY round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 12), b.ord) AS rank FROM centroids a CROSS JOIN centroids b WHERE a.cell <> b.cell) WHERE rank <= 6", ("centroids",)),
    "sums": (
        """SELECT f.feature, f.ord, coalesce(pos1, 0) AS pos1, coalesce(pos2, 0) AS pos2, coalesce(e1, 0) AS e1, coalesce(e2, 0) AS e2, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2,
           coalesce(q1, 0) AS q1, coalesce(q2, 0) AS q2, (SELECT CAST(count(*) AS DOUBLE) FROM cells WHERE ident = 'BUILDING') AS n1, (SELECT CAST(count(*) AS DOUBLE) FROM cells WHERE ident <> 'BUILDING') AS n2
           FROM features f LEFT JOIN (SELECT feature,
             count(*) FILTER (ident = 'BUILDING' AND value > 0) AS pos1, count(*) FILTER (ident <> 'BUILDING' AND value > 0) AS pos2,
             sum(exp(value) - 1) FILTER (ident = 'BUILDING') AS e1, sum(exp(value) - 1) FILTER (ident <> 'BUILDING') AS e2,
             sum(value) FILTER (ident = 'BUILDING') AS s1, sum(value) FILTER (ident <> 'BUILDING') AS s2,
             sum(value * value) FILTER (ident = 'BUILDING') AS q1, sum(value * value) FILTER (ident <> 'BUILDING') AS q2
             FROM data JOIN cells USING (cell) GROUP BY 1) USING (feature)""",
        ("features", "cells", "expr", "totals", "data"),
    ),
}


def sql(body: str, *needs: str) -> str:
    """A statement with the named parts, and those they need, as common tables."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in PARTS[name][1]:
            add(x)
        if name not in order:
            order.append(name)

    for x in needs:
        add(x)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{x} AS ({PARTS[x][0]})" for x in order) + "\n" + body
