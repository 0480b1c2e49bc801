"""Connected components: forests of tasks, then one task, or alternating large-star and
small-star where there are too many edges for one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, staged

#: Edges that one task holds at a time.
FEW_EDGES = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node that is not its component's smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _forests(most: int) -> Callable:
    """Edges to stars with the same components, held at most about ``most`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return stars(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= most:
                held = [joined()]
                n = len(held[0][0])
                if n > most // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in held[0]], ["a", "b"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in joined()], ["a", "b"])

    return run


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b), a > b.

    large: every node's larger neighbours are joined to its smallest neighbour,
    itself counted; small: its smaller neighbours and itself are.
    """
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = around.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        out = (
            around.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        )
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _rooted_stars(now: DataFrame) -> DataFrame:
    """(node, root) of stars (a, b), the roots themselves included."""
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def connected_components(edges: DataFrame, max_rounds: int = 50, few: int = FEW_EDGES) -> DataFrame:
    """(node, root) for every node that has an edge other than a loop; root is the
    smallest node that can be reached.

    edges: long columns a and b, in any order; loops and repeats are harmless.
    Every task first brings its edges down to stars, so that no cycle or repeat of a
    task is left, and these are written to shared storage. Up to ``few`` of them are
    joined by one task. More take rounds of large-star and small-star, each written to
    shared storage: it ends when a round changes nothing, and raises if max_rounds (far
    above the logarithm of any path) do not suffice. A hub is a key whose rows have one
    partner each, so Spark splits it.
    """
    spark = edges.sparkSession
    own = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    now = staged(own.mapInArrow(_forests(few), "a long, b long"), "cc")
    n = now.count()
    if n == 0:
        return spark.createDataFrame([], "node long, root long")
    if n <= few:
        last, now = now, staged(now.coalesce(1).mapInArrow(_forests(2 * few), "a long, b long"), "cc")
        discard(last)
        return _rooted_stars(now)
    return _by_rounds(spark, now, max_rounds)


def _by_rounds(spark: SparkSession, edges: DataFrame, max_rounds: int) -> DataFrame:
    now = staged(edges.distinct(), "cc")
    discard(edges)

    def print_of(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s")).collect()[0]
        return row["n"], row["s"]

    before = print_of(now)
    for _ in range(max_rounds):
        last, now = now, staged(_star(_star(now, True), False), "cc")
        discard(last)
        after = print_of(now)
        if after == before:
            return _rooted_stars(now)
        before = after
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
