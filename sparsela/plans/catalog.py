"""The object: named DataFrames and a few settings, never a matrix."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matrix as mx
from ..operators.matrix import Matrix


@dataclass
class Catalog:
    """cells(cell, ord, ident, ...); per assay features(feature, ord, ...); layers by
    (assay, layer): (feature, cell, value); reductions (cell, ord, vec); graphs
    (src, dst, weight); neighbors; images of centroids. Operators give back new
    frames; ``with_layer`` and the like return a changed copy."""

    cells: DataFrame
    features: dict[str, DataFrame] = field(default_factory=dict)
    layers: dict[tuple[str, str], DataFrame] = field(default_factory=dict)
    reductions: dict[str, DataFrame] = field(default_factory=dict)
    graphs: dict[str, DataFrame] = field(default_factory=dict)
    neighbors: dict[str, DataFrame] = field(default_factory=dict)
    images: dict[str, DataFrame] = field(default_factory=dict)
    active_assay: str = "RNA"
    misc: dict = field(default_factory=dict)
    tools: dict = field(default_factory=dict)
    commands: list[dict] = field(default_factory=list)
    keys: dict[str, str] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)

    @classmethod
    def create(cls, m: Matrix, assay: str = "RNA", min_cells: int = 0, min_features: int = 0, metadata: DataFrame | None = None, project: str = "project") -> Catalog:
        """Filters (features first), and adds n_count, n_feature and orig_ident."""
        m = mx.create_assay(m, min_cells, min_features)
        cells = m.cells.join(mx.calc_n(m), "cell", "left")
        cells = cells.withColumnsRenamed({"n_count": f"nCount_{assay}", "n_feature": f"nFeature_{assay}"}).withColumn("orig_ident", F.lit(project))
        if metadata is not None:
            cells = mx.add_metadata(cells, metadata)
        if "ident" not in cells.columns:
            cells = cells.withColumn("ident", F.col("orig_ident"))
        return cls(cells, {assay: m.features}, {(assay, "counts"): m.expr}, active_assay=assay)

    def copy(self, **changes) -> Catalog:
        own = {k: dict(v) if isinstance(v, dict) else list(v) if isinstance(v, list) else v for k, v in self.__dict__.items()}
        return Catalog(**(own | changes))

    def matrix(self, layer: str | None = None, assay: str | None = None) -> Matrix:
        """A layer with its axes: data where there is one, else counts."""
        assay = assay or self.active_assay
        name = layer or next((x for x in ("data", "counts") if (assay, x) in self.layers), None)
        if (assay, name) not in self.layers:
            raise KeyError(f"no layer {layer!r} in assay {assay!r}")
        return Matrix(self.layers[assay, name], self.features[assay], self.cells, name)

    def with_layer(self, name: str, expr: DataFrame, assay: str | None = None) -> Catalog:
        if not {"feature", "cell", "value"} <= set(expr.columns):
            raise ValueError("a layer has the columns feature, cell and value")
        return self.copy(layers=self.layers | {(assay or self.active_assay, name): expr})

    def without_layer(self, name: str, assay: str | None = None) -> Catalog:
        return self.copy(layers={k: v for k, v in self.layers.items() if k != (assay or self.active_assay, name)})

    def layers_list(self, pattern: str = "", assay: str | None = None) -> list[str]:
        return [n for a, n in self.layers if a == (assay or self.active_assay) and re.search(pattern, n)]

    def with_key(self, name: str, key: str) -> Catalog:
        if not mx.valid_key(key):
            raise ValueError(f"{key!r} is no key: letters and digits, then _")
        return self.copy(keys=self.keys | {name: key})

    def subset(self, cells: DataFrame | None = None, features: DataFrame | None = None, idents: list[str] | None = None) -> Catalog:
        """All tables on the chosen cells and features; neighbour tables are dropped,
        graphs keep edges with both ends."""
        from ..operators.neighbors import graph_subset

        if idents is not None:
            chosen = mx.which_cells(self.cells, idents)
            cells = chosen if cells is None else cells.join(chosen, "cell", "left_semi")
        out = self.copy(neighbors={})
        if features is not None:
            names = features.select("feature").distinct()
            out.features = {a: f.join(names, "feature", "left_semi") for a, f in out.features.items()}
            out.layers = {k: e.join(names, "feature", "left_semi") for k, e in out.layers.items()}
        if cells is not None:
            names = cells.select("cell").distinct()
            out.cells = out.cells.join(names, "cell", "left_semi")
            for part in ("layers", "reductions", "images"):
                setattr(out, part, {k: d.join(names, "cell", "left_semi") for k, d in getattr(out, part).items()})
            out.graphs = {k: graph_subset(g, names) for k, g in out.graphs.items()}
        return out

    def merge(self, others: list[Catalog], prefixes: list[str]) -> Catalog:
        """Cells of all, by prefix; assays that all have, of the same kind (layered, or
        fixed with its three layers). Reductions, graphs and images are not carried over."""
        every = [self, *others]
        shared = [a for a in self.features if all(a in o.features for o in others)]
        mixed = [a for a in shared if len({c.kinds.get(a, "layered") for c in every}) > 1]
        if mixed:
            raise ValueError(f"assays of different kinds can't be merged: {mixed}")
        out = None
        layers, features = {}, {}
        for a in shared:
            for layer in self.layers_list("", a):
                if all((a, layer) in o.layers for o in others):
                    m = mx.merge([(Matrix(c.layers[a, layer], c.features[a], c.cells, layer), p) for c, p in zip(every, prefixes, strict=True)])
                    layers[a, layer], features[a], out = m.expr, m.features, m.cells
        if out is None:
            raise ValueError("no assay and layer is in all objects")
        return Catalog(out.drop("_part"), features, layers, active_assay=shared[0])

    def rename_cells(self, names: DataFrame) -> Catalog:
        """All tables by names(cell, new)."""
        out = self.copy(cells=mx.rename_cells(self.cells, names))
        for part in ("layers", "reductions", "images"):
            setattr(out, part, {k: mx.rename_cells(d, names) for k, d in getattr(self, part).items()})
        for part, ends in (("graphs", ("src", "dst")), ("neighbors", ("cell", "nbr"))):
            setattr(out, part, {k: _renamed_ends(d, names, ends) for k, d in getattr(self, part).items()})
        return out

    def stash_ident(self, name: str) -> Catalog:
        return self.copy(cells=self.cells.withColumn(name, F.col("ident")))

    def set_ident(self, column: str) -> Catalog:
        return self.copy(cells=self.cells.withColumn("ident", F.col(column).cast("string")))

    def log(self, name: str, assay: str | None = None, reduction: str | None = None, **params) -> Catalog:
        """A copy with one more line in the command log; its key joins the parts by dots."""
        key = ".".join(x for x in (name, assay, reduction) if x)
        call = f"{name}({', '.join(f'{k}={v!r}' for k, v in params.items())})"
        entry = {"name": name, "ts": datetime.datetime.now(datetime.UTC), "assay": assay, "call_string": call, "params": {k: str(v) for k, v in params.items()}, "key": key}
        return self.copy(commands=[*self.commands, entry])

    def command_table(self) -> DataFrame:
        schema = "name string, ts timestamp, assay string, call_string string, params map<string,string>, key string"
        return self.cells.sparkSession.createDataFrame([tuple(c.values()) for c in self.commands], schema)

    def __getitem__(self, column: str) -> DataFrame:
        """A metadata column by cell."""
        return self.cells.select("cell", column)

    def __len__(self) -> int:
        return self.cells.count()

    def __repr__(self) -> str:
        return f"Catalog({', '.join(f'{a}: {[n for x, n in self.layers if x == a]}' for a in self.features)}; reductions {list(self.reductions)})"



def _renamed_ends(df: DataFrame, names: DataFrame, ends: tuple[str, str]) -> DataFrame:
    columns = df.columns
    for end in ends:
        new = names.select(F.col("cell").alias("_old"), F.col("new").alias("_new"))
        df = df.join(new, df[end] == F.col("_old"), "left").withColumn(end, F.coalesce("_new", end)).drop("_old", "_new")
    return df.select(*columns)
