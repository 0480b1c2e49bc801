"""Labelled sparse matrices as long tables: construction, selection, merging."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY_PATTERN = re.compile(r"^[a-zA-Z][a-zA-Z0-9]*_$")


def valid_key(key: str) -> bool:
    return bool(KEY_PATTERN.match(key))


@dataclass(frozen=True)
class Matrix:
    """One layer: expr(feature, cell, value) without zeros, and its two axes.

    features(feature, ord, ...) and cells(cell, ord, ...) name every row and
    column, also those without an entry; ord is the original order, the last
    word in every tie. Absent entries are zero, so means divide by n_cells.
    """

    expr: DataFrame
    features: DataFrame
    cells: DataFrame
    name: str = "counts"

    @cached_property
    def n_cells(self) -> int:
        return self.cells.count()

    @cached_property
    def n_features(self) -> int:
        return self.features.count()

    def of(self, expr: DataFrame, name: str | None = None) -> Matrix:
        """The same axes with other entries."""
        return replace(self, expr=expr, name=name or self.name)


def from_triplets(entries: DataFrame, features: DataFrame, cells: DataFrame, name: str = "counts") -> Matrix:
    """A matrix from (feature, cell, value) rows; repeated places are summed and
    zeros dropped."""
    summed = entries.groupBy("feature", "cell").agg(F.sum(F.col("value").cast("double")).alias("value"))
    return Matrix(summed.filter("value <> 0"), features, cells, name)


def make_unique(names: DataFrame, column: str = "name", order: str = "ord") -> DataFrame:
    """Adds unique: repeated names get .1, .2 ... in order of appearance."""
    nth = F.row_number().over(Window.partitionBy(column).orderBy(order)) - 1
    return names.withColumn("unique", F.when(nth == 0, F.col(column)).otherwise(F.concat_ws(".", column, nth.cast("string"))))


def calc_n(m: Matrix) -> DataFrame:
    """(cell, n_count, n_feature) for every cell, 0 where it has no entry."""
    sums = m.expr.groupBy("cell").agg(F.sum("value").alias("n_count"), F.count(F.when(F.col("value") != 0, 1)).alias("n_feature"))
    return m.cells.select("cell").join(sums, "cell", "left").fillna(0.0, ["n_count"]).fillna(0, ["n_feature"])


def create_assay(m: Matrix, min_cells: int = 0, min_features: int = 0) -> Matrix:
    """Features in at least min_cells cells first; then, over those features, cells
    with at least min_features of them."""
    if min_cells > 0:
        often = m.expr.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_cells).select("feature")
        m = subset(m, features=often)
    if min_features > 0:
        rich = m.expr.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_features).select("cell")
        m = subset(m, cells=rich)
    return m


def subset(m: Matrix, cells: DataFrame | None = None, features: DataFrame | None = None) -> Matrix:
    """Only the named cells (a frame with ``cell``) and features (with ``feature``)."""
    for names, key in ((cells, "cell"), (features, "feature")):
        if names is not None:
            chosen = names.select(key).distinct()
            m = replace(
                m,
                expr=m.expr.join(chosen, key, "left_semi"),
                cells=m.cells.join(chosen, key, "left_semi") if key == "cell" else m.cells,
                features=m.features.join(chosen, key, "left_semi") if key == "feature" else m.features,
            )
    return m


def percentage_feature_set(m: Matrix, pattern: str) -> DataFrame:
    """(cell, percent): 100 * matching / all of each cell's sum; a cell without
    counts has 0. The pattern is searched, not matched from the start."""
    hit = F.sum(F.when(F.col("feature").rlike(pattern), F.col("value")).otherwise(0.0))
    total = F.sum("value")
    sums = m.expr.groupBy("cell").agg((hit / F.when(total == 0, 1.0).otherwise(total) * 100).alias("percent"))
    return m.cells.select("cell").join(sums, "cell", "left").fillna(0.0, ["percent"])


def percentage_name(pattern: str) -> str:
    return "percent.mt" if re.search("mt|mito", pattern, re.I) else "percent_feature"


def which_cells(cells: DataFrame, idents: Sequence[str], column: str = "ident") -> DataFrame:
    return cells.filter(F.col(column).isin(list(idents))).select("cell")


def fetch_data(m: Matrix, features: Sequence[str], metadata: Sequence[str] = (), reduction: DataFrame | None = None, dims: dict[str, int] | None = None) -> DataFrame:
    """One row per cell: metadata columns, a column per feature (0 where absent),
    and dimensions of a reduction(cell, vec) by name -> 1-based place."""
    wide = m.expr.filter(F.col("feature").isin(list(features))).groupBy("cell").pivot("feature", list(features)).agg(F.first("value"))
    out = m.cells.select("cell", *metadata).join(wide, "cell", "left").fillna(0.0, list(features))
    if reduction is not None:
        out = out.join(reduction.select("cell", *[F.element_at("vec", k).alias(n) for n, k in (dims or {}).items()]), "cell", "left")
    return out


def add_metadata(cells: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join on cell; columns that both have are taken from metadata."""
    new = [c for c in metadata.columns if c != "cell"]
    return cells.drop(*new).join(metadata, "cell", "left")


def rename_cells(df: DataFrame, names: DataFrame) -> DataFrame:
    """df with its cell column renamed by names(cell, new); others keep theirs."""
    out = df.join(names.select("cell", F.col("new").alias("_new")), "cell", "left")
    return out.withColumn("cell", F.coalesce("_new", "cell")).drop("_new").select(*df.columns)


def rename_idents(cells: DataFrame, mapping: dict[str, str], column: str = "ident") -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return cells.withColumn(column, F.coalesce(F.element_at(pairs, F.col(column)), F.col(column)))


def levels(cells: DataFrame, column: str = "ident") -> DataFrame:
    """(level, ord): numeric labels by number before all others by letter."""
    number = F.expr(f"try_cast({column} AS INT)")
    distinct = cells.select(column).distinct().withColumn("_n", number)
    return distinct.select(F.col(column).alias("level"), (F.row_number().over(Window.orderBy(F.col("_n").asc_nulls_last(), column)) - 1).alias("ord"))


def match_positions(names: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each name with its position in table (ord), -1 where it is missing."""
    return names.join(table.select(key, F.col("ord").alias("position")), key, "left").fillna(-1, ["position"])


def merge(parts: Sequence[tuple[Matrix, str]]) -> Matrix:
    """Cells of all parts, their names prefixed by ``prefix_``; features that all
    parts have, in the first part's order. Metadata is united by column name."""
    first, _ = parts[0]
    shared = first.features
    for m, _ in parts[1:]:
        shared = shared.join(m.features.select("feature"), "feature", "left_semi")
    exprs, cells = [], []
    for k, (m, prefix) in enumerate(parts):
        named = F.concat_ws("_", F.lit(prefix), "cell")
        exprs.append(m.expr.join(shared.select("feature"), "feature", "left_semi").withColumn("cell", named).select("feature", "cell", "value"))
        cells.append(m.cells.withColumn("cell", named).withColumn("_part", F.lit(k)))
    expr, all_cells = exprs[0], cells[0]
    for e, c in zip(exprs[1:], cells[1:], strict=True):
        expr, all_cells = expr.unionByName(e), all_cells.unionByName(c, allowMissingColumns=True)
    return Matrix(expr, shared, all_cells, first.name)


def split_layers(m: Matrix, by: str) -> DataFrame:
    """(layer, stem, feature, cell, value): the layer's cells dealt out by a metadata column."""
    group = m.cells.select("cell", F.col(by).cast("string").alias("_g"))
    return m.expr.join(group, "cell").select(F.concat_ws(".", F.lit(m.name), "_g").alias("layer"), F.lit(m.name).alias("stem"), "feature", "cell", "value")


def join_layers(split: DataFrame) -> DataFrame:
    """The reverse of split_layers: every layer under its stem again."""
    return split.select(F.col("stem").alias("layer"), "feature", "cell", "value")


def columns_block(m: Matrix, cells: Sequence[str], features: Sequence[str]) -> DataFrame:
    """The entries of an outer selection by both axes."""
    return m.expr.filter(F.col("cell").isin(list(cells)) & F.col("feature").isin(list(features)))


def axis_sums(m: Matrix, by: str) -> DataFrame:
    """(name, total, mean over the full other axis, nnz) along one axis."""
    other = m.n_cells if by == "feature" else m.n_features
    sums = m.expr.groupBy(by).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("nnz"))
    names = m.features.select("feature") if by == "feature" else m.cells.select("cell")
    full = names.join(sums, by, "left").fillna(0.0, ["total"]).fillna(0, ["nnz"])
    return full.withColumn("mean", F.col("total") / F.lit(float(other)))


def col_blocks(m: Matrix, block_size: int = 10_000) -> Iterator[tuple[int, Matrix]]:
    """(number, matrix) of the cells of each range of block_size in their order; lazy, so
    that a block is read when it is used."""
    last = m.cells.agg(F.max("ord")).first()[0]
    for k in range(0 if last is None else last // block_size + 1):
        mine = F.col("ord").between(k * block_size, (k + 1) * block_size - 1)
        yield k, subset(m, cells=m.cells.filter(mine))


def block_sums(m: Matrix, block_size: int = 10_000) -> DataFrame:
    """(block, n_cells, nnz, total) of all blocks in one pass."""
    cells = m.cells.select("cell", F.floor(F.col("ord") / block_size).alias("block"))
    sums = m.expr.groupBy("cell").agg(F.count(F.lit(1)).alias("k"), F.sum("value").alias("s"))
    rows = cells.join(sums, "cell", "left").groupBy("block")
    return rows.agg(F.count(F.lit(1)).alias("n_cells"), F.coalesce(F.sum("k"), F.lit(0)).alias("nnz"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("total"))


def to_arrays(m: Matrix, max_entries: int = 10_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, indices, indptr) of the layer by cells in their order (compressed columns) on
    the driver, for at most max_entries entries (checked)."""
    n = m.expr.limit(max_entries + 1).count()
    if n > max_entries:
        raise ValueError(f"more than {max_entries} entries: select cells or features first")
    rows = m.expr.join(m.features.select("feature", F.col("ord").alias("i")), "feature").join(m.cells.select("cell", F.col("ord").alias("j")), "cell").select("i", "j", "value").toPandas()
    at = {key: np.array([r[0] for r in table.select("ord").orderBy("ord").collect()], dtype=np.int64) for key, table in (("i", m.features), ("j", m.cells))}
    i, j = (np.searchsorted(at[k], rows[k].to_numpy()) for k in ("i", "j"))
    order = np.lexsort((i, j))
    return rows["value"].to_numpy(float)[order], i[order], np.concatenate(([0], np.cumsum(np.bincount(j, minlength=len(at["j"])))))


def align_on_cells(a: Matrix, b: Matrix) -> tuple[Matrix, Matrix]:
    """Both matrices on the cells they share."""
    return subset(a, cells=b.cells), subset(b, cells=a.cells)


def strip_prefix(m: Matrix, prefix: str) -> Matrix:
    """Only the features with the prefix, without it."""
    bare = F.substring(F.col("feature"), len(prefix) + 1, 1 << 30)
    return replace(
        m,
        expr=m.expr.filter(F.col("feature").startswith(prefix)).withColumn("feature", bare),
        features=m.features.filter(F.col("feature").startswith(prefix)).withColumn("feature", bare),
    )


def dense_to_triplets(wide: DataFrame, id_column: str, names: Sequence[str], variable: str = "feature", value: str = "value") -> DataFrame:
    """Wide table to long without zeros."""
    return wide.unpivot([id_column], list(names), variable, value).filter(F.col(value) != 0)


def to_dense(m: Matrix) -> DataFrame:
    """(feature, vec): rows with zeros filled, in the cells' order. Rows are as long
    as there are cells."""
    order = m.cells.select("cell", "ord")
    grid = m.features.select("feature").join(order).join(m.expr, ["feature", "cell"], "left").fillna(0.0, ["value"])
    rows = grid.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("_v"))
    return rows.select("feature", F.col("_v.value").alias("vec"))


def from_dense(dense: DataFrame, cells: DataFrame) -> DataFrame:
    """(feature, cell, value): the reverse of to_dense, without zeros."""
    places = cells.select("cell", (F.row_number().over(Window.orderBy("ord")) - 1).alias("i"))
    return dense.select("feature", F.posexplode("vec").alias("i", "value")).filter("value <> 0").join(places, "i").select("feature", "cell", "value")


def set_variable_features(features: DataFrame, ranked: DataFrame) -> DataFrame:
    """features with hvg_rank and highly_variable from (feature, rank)."""
    rest = features.drop("hvg_rank", "highly_variable")
    return rest.join(ranked.select("feature", F.col("rank").alias("hvg_rank")), "feature", "left").withColumn("highly_variable", F.col("hvg_rank").isNotNull())


def variable_features(features: DataFrame) -> list[str]:
    """The variable features by rank; by their order where only the flag is there."""
    order = "hvg_rank" if "hvg_rank" in features.columns else "ord"
    return [r[0] for r in features.filter("highly_variable").orderBy(order).select("feature").collect()]
