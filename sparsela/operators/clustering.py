"""Communities of a graph, and what follows: renumbering, singletons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolution_label(r: float) -> str:
    """A number as text: the shorter of fixed and scientific, 15 digits at most."""
    fixed, short = f"{r:.15f}".rstrip("0").rstrip("."), f"{r:.15g}"
    mantissa, e, power = f"{r:.14e}".partition("e")
    scientific = f"{mantissa.rstrip('0').rstrip('.')}e{int(power):+03d}"
    return scientific if len(scientific) < len(fixed) else (fixed if len(fixed) <= len(short) or "e" in short else short)


def upper_edges(edges: DataFrame) -> DataFrame:
    """One row per undirected edge, from the smaller end."""
    return edges.filter("src < dst")


class Louvain:
    """Greedy modularity on arrays: local moves in a seeded order, then one node
    per community, until nothing moves."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, resolution: float, seed: int) -> None:
        self.n, self.resolution, self.rng = n, resolution, np.random.default_rng(seed)
        self.src, self.dst, self.weight = src, dst, weight

    def run(self) -> np.ndarray:
        member = np.arange(self.n)
        n, src, dst, w = self.n, self.src, self.dst, self.weight
        while True:
            moved = self._level(n, src, dst, w)
            labels, found = np.unique(moved, return_inverse=True)
            member = found[member]
            if len(labels) == n:
                return member
            a, b = found[src], found[dst]
            key, at = np.unique(np.minimum(a, b) * len(labels) + np.maximum(a, b), return_inverse=True)
            w = np.bincount(at, weights=w, minlength=len(key))
            n, src, dst = len(labels), key // len(labels), key % len(labels)

    @staticmethod
    def _around(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        """Degrees, and each node's neighbours and weights as slices."""
        loop = src == dst
        degree = np.bincount(src, weights=w, minlength=n) + np.bincount(dst, weights=w, minlength=n)
        a = np.concatenate((src[~loop], dst[~loop]))
        order = np.argsort(a, kind="stable")
        b = np.concatenate((dst[~loop], src[~loop]))[order]
        x = np.concatenate((w[~loop], w[~loop]))[order]
        return degree, np.concatenate(([0], np.cumsum(np.bincount(a, minlength=n)))), b, x

    def _level(self, n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        degree, at, b, x = self._around(n, src, dst, w)
        total = degree.sum()
        label = np.arange(n) if start is None else start.copy()
        weight_of = np.bincount(label, weights=degree, minlength=n)
        if total == 0:
            return label
        # lists of the nodes' numbers are read faster one by one; the edges stay arrays
        label, weight_of, degree, at, total = label.tolist(), weight_of.tolist(), degree.tolist(), at.tolist(), float(total)
        changed = True
        while changed:
            changed = False
            for i in self.rng.permutation(n).tolist():
                near = slice(at[i], at[i + 1])
                if near.start == near.stop:
                    continue
                sums: dict[int, float] = {}
                for j, v in zip(b[near].tolist(), x[near].tolist(), strict=True):
                    c = label[j]
                    sums[c] = sums.get(c, 0.0) + v
                own = label[i]
                weight_of[own] -= degree[i]
                scale = self.resolution * degree[i] / total
                best, gain = own, sums.get(own, 0.0) - scale * weight_of[own]
                for c, v in sums.items():
                    g = v - scale * weight_of[c]
                    if g > gain + 1e-12:
                        best, gain = c, g
                weight_of[best] += degree[i]
                if best != own:
                    label[i] = best
                    changed = True
        return np.array(label, dtype=np.int64)


class Leiden(Louvain):
    """Local moves as above; then each community is split into parts that hold
    together, and the parts become the nodes of the next round, which starts from the
    communities. So a community never falls apart inside."""

    def run(self) -> np.ndarray:
        member = np.arange(self.n)
        n, src, dst, w = self.n, self.src, self.dst, self.weight
        start = None
        while True:
            moved = self._level(n, src, dst, w, start)
            parts, found = np.unique(self._refined(n, src, dst, w, moved), return_inverse=True)
            if len(parts) == n:
                return np.unique(moved, return_inverse=True)[1][member]
            member = found[member]
            _, community = np.unique(moved, return_inverse=True)
            start = np.zeros(len(parts), dtype=np.int64)
            start[found] = community
            a, b = found[src], found[dst]
            key, at = np.unique(np.minimum(a, b) * len(parts) + np.maximum(a, b), return_inverse=True)
            w = np.bincount(at, weights=w, minlength=len(key))
            n, src, dst = len(parts), key // len(parts), key % len(parts)

    def _refined(self, n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, community: np.ndarray) -> np.ndarray:
        degree, at, b, x = self._around(n, src, dst, w)
        total = degree.sum() or 1.0
        label, weight_of, size = np.arange(n), degree.copy(), np.ones(n, dtype=np.int64)
        for i in self.rng.permutation(n):
            if size[label[i]] > 1:
                continue
            sums: dict[int, float] = {}
            for j, v in zip(b[at[i] : at[i + 1]].tolist(), x[at[i] : at[i + 1]].tolist(), strict=True):
                if community[j] == community[i] and label[j] != label[i]:
                    sums[int(label[j])] = sums.get(int(label[j]), 0.0) + v
            best, gain = -1, 1e-12
            for c, v in sums.items():
                g = v - self.resolution * degree[i] * weight_of[c] / total
                if g > gain:
                    best, gain = c, g
            if best >= 0:
                weight_of[best] += degree[i]
                weight_of[label[i]] -= degree[i]
                size[best] += 1
                size[label[i]] -= 1
                label[i] = best
        return label


ALGORITHMS = {1: Louvain, 2: Louvain, 4: Leiden}


def modularity(edges: DataFrame, clusters: DataFrame, resolution: float = 1.0) -> float:
    """Of undirected edges (src < dst counted once) under (cell, cluster)."""
    e = upper_edges(edges)
    c = clusters.select("cell", "cluster")
    labelled = e.join(c.select(F.col("cell").alias("src"), F.col("cluster").alias("a")), "src").join(c.select(F.col("cell").alias("dst"), F.col("cluster").alias("b")), "dst")
    ends = labelled.select(F.col("a").alias("c"), "weight").unionByName(labelled.select(F.col("b").alias("c"), "weight"))
    inside = labelled.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("i"), F.sum("weight").alias("t")).first()
    degrees = ends.groupBy("c").agg(F.sum("weight").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("dd")).first()
    total = inside["t"] or 1.0
    return inside["i"] / total - resolution * degrees["dd"] / (4 * total * total)


def communities(edges: DataFrame, cells: DataFrame, resolution: float = 0.5, seed: int = 0, algorithm: int = 1, max_edges: int = 20_000_000) -> DataFrame:
    """(cell, cluster) by modularity (1 and 2 Louvain, 4 Leiden) on the driver, for graphs of at most max_edges
    edges (a checked bound): beyond, it raises, as label_propagation is another method."""
    if algorithm not in ALGORITHMS:
        raise NotImplementedError(f"algorithm {algorithm}: choose from {sorted(ALGORITHMS)}")
    upper = upper_edges(edges)
    if upper.count() > max_edges:
        raise ValueError(f"more than {max_edges} edges: modularity is not built for larger graphs; label_propagation is another method")
    names = [r[0] for r in cells.orderBy("ord").select("cell").collect()]
    order = {c: k for k, c in enumerate(names)}
    rows = upper.select("src", "dst", "weight").toPandas()
    src, dst = rows["src"].map(order).to_numpy(), rows["dst"].map(order).to_numpy()
    sort = np.lexsort((dst, src))
    labels = ALGORITHMS[algorithm](len(names), src[sort], dst[sort], rows["weight"].to_numpy(float)[sort], resolution, seed).run()
    spark = edges.sparkSession
    return spark.createDataFrame(list(zip(names, map(int, labels), strict=True)), "cell string, cluster long")


def label_propagation(edges: DataFrame, cells: DataFrame, rounds: int = 20) -> DataFrame:
    """(cell, cluster): every node takes the label with most weight around it, its own
    counted; half of the nodes move each round, by hash, so that labels settle."""
    from ..plans.store import materialised

    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).filter("src <> dst")
    labels = cells.select("cell", F.col("ord").cast("long").alias("cluster"))
    for k in range(rounds):
        votes = both.join(labels.withColumnRenamed("cell", "dst"), "dst").groupBy("src", "cluster").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("src").agg(F.min_by("cluster", F.struct(-F.round("w", 9), F.col("cluster"))).alias("best"))
        turn = F.pmod(F.xxhash64("cell", F.lit(k)), F.lit(2)) == 0
        new = labels.join(best.withColumnRenamed("src", "cell"), "cell", "left").select("cell", F.when(turn, F.coalesce("best", "cluster")).otherwise(F.col("cluster")).alias("new"), "cluster")
        new = materialised(new, "labels")
        moved = new.filter("new <> cluster").limit(1).count()
        labels = new.select("cell", F.col("new").alias("cluster"))
        if not moved and k > 1:
            break
    return labels


def renumber_by_size(clusters: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell, cluster) with the largest cluster 0; ties by the first cell's order."""
    sized = clusters.join(cells.select("cell", "ord"), "cell").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    ranked = sized.withColumn("new", F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1)
    return clusters.join(ranked.select("cluster", "new"), "cluster").select("cell", F.col("new").cast("long").alias("cluster"))


def group_singletons(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """Clusters of one cell join the cluster of several to which their mean edge
    weight is largest, ties to the lowest label; without an edge they stay. Targets
    are the sizes from before."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    alone = clusters.join(sizes.filter("n = 1"), "cluster").select(F.col("cell").alias("src"))
    large = clusters.join(sizes.filter("n > 1"), "cluster").select(F.col("cell").alias("dst"), "cluster", "n")
    pull = edges.filter("src <> dst").join(alone, "src").join(large, "dst").groupBy("src", "cluster", "n").agg(F.sum("weight").alias("w"))
    best = pull.groupBy("src").agg(F.min_by("cluster", F.struct(-F.round(F.col("w") / F.col("n"), 12), F.col("cluster"))).alias("to"))
    return clusters.join(best.withColumnRenamed("src", "cell"), "cell", "left").select("cell", F.coalesce("to", "cluster").alias("cluster"))


def find_clusters(edges: DataFrame, cells: DataFrame, resolutions: list[float], seed: int = 0, singletons: bool = True, algorithm: int = 1) -> DataFrame:
    """(cell, res_<r> ..., clusters): labels per resolution, renumbered by size and
    then with singletons absorbed; clusters is the last. The graph is written once, as every
    resolution reads it several times."""
    from ..plans.store import materialised

    edges = materialised(edges.select("src", "dst", "weight"), "graph")
    out = cells.select("cell")
    for r in resolutions:
        labels = renumber_by_size(communities(edges, cells, r, seed, algorithm), cells)
        if singletons:
            labels = group_singletons(labels, edges)
        out = out.join(labels.withColumnRenamed("cluster", f"res_{resolution_label(r)}"), "cell", "left")
    return out.withColumn("clusters", F.col(f"`{out.columns[-1]}`"))
