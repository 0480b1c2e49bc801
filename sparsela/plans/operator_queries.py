"""Queries of readers, objects, tests with their tails, and transfers, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..functions.special import fisher_p
from ..operators import aggregate as ag
from ..operators import clustering as cl
from ..operators import demux as dm
from ..operators import linalg as la
from ..operators import mapping as mp
from ..operators import markers as mk
from ..operators import matrix as mx
from ..operators import neighbors as nb
from ..operators import normalize as nz
from ..operators import plots as pl
from ..operators import scores as sc
from ..operators import spatial as sp
from ..sources import bundle, tables
from ..streaming import running as st
from . import files
from . import fixture as fix
from . import store
from .catalog import Catalog
from .queries import _ANCHORS, _WEIGHTS, GROUP, _anchor_parts, _halves, query
from .sql_tails import chi2_sf, normal_two_sided

ALL = "SELECT feature, cell, value FROM expr"


# -- readers -------------------------------------------------------------------


@query(ALL, "expr")
def read_10x(s, d):
    path = files.folder(s, "tenx")
    files.write_10x(fix.counts(s, d), path)
    return tables.read_10x(s, path).expr.select("feature", "cell", "value")


@query("SELECT p_partkey AS ord, p_name AS name FROM part")
def tsv_column(s, d):
    path = files.folder(s, "names")
    files.write_lines(fix.table(s, d, "part"), "p_partkey", F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_name"), path)
    return tables.tsv_column(s, path, 1)


@query("SELECT f.ord AS i, c.ord AS j, value FROM expr JOIN features f USING (feature) JOIN cells c USING (cell)", "expr", "features", "cells")
def read_mtx(s, d):
    path = files.folder(s, "mtx")
    files.write_10x(fix.counts(s, d), path)
    return tables.read_mtx(s, f"{path}/matrix.mtx")


@query("SELECT 'RNA' AS assay, 'counts' AS layer, feature, cell, value FROM expr", "expr")
def matrix_store(s, d):
    path = files.folder(s, "store")
    rows = fix.counts(s, d).expr.select(F.lit("RNA").alias("assay"), F.lit("counts").alias("layer"), "feature", "cell", "value")
    store.write_matrix_store(rows, path)
    return store.open_matrix_store(s, path).select("assay", "layer", "feature", "cell", "value")


@query("SELECT c.ord // 256 AS block, count(DISTINCT c.cell) AS n_cells, count(value) AS nnz, coalesce(sum(value), 0.0) AS total FROM cells c LEFT JOIN expr USING (cell) GROUP BY 1", "cells", "expr")
def col_blocks(s, d):
    return mx.block_sums(fix.counts(s, d), 256)


_PLACES = "SELECT cell, x, y FROM centroids"


@query("SELECT feature, e.cell, value, x, y FROM expr e JOIN centroids USING (cell) WHERE feature NOT LIKE 'MT-%'", "expr", "centroids")
def load_xenium(s, d):
    path = files.folder(s, "xenium")
    files.write_10x(fix.counts(s, d), f"{path}/cell_feature_matrix", types=True)
    fix.centroids(s, d).select(F.col("cell").alias("cell_id"), F.col("x").alias("x_centroid"), F.col("y").alias("y_centroid")).write.parquet(f"{path}/cells.parquet")
    m, at = tables.load_xenium(s, path)
    return m.expr.join(at.select("cell", "x", "y"), "cell").select("feature", "cell", "value", "x", "y")


@query("SELECT feature, e.cell, value, x, y FROM expr e JOIN centroids c USING (cell) WHERE c.ord % 3 <> 0", "expr", "centroids")
def load_visium(s, d):
    path = files.folder(s, "visium")
    files.write_10x(fix.counts(s, d), f"{path}/filtered_feature_bc_matrix")
    c = fix.centroids(s, d)
    files.write_csv(c.select(F.col("cell").alias("barcode"), (F.col("ord") % 3 != 0).cast("int").alias("in_tissue"), "ord", "ord", F.col("y").alias("py"), F.col("x").alias("px")).toDF("barcode", "in_tissue", "array_row", "array_col", "pxl_row_in_fullres", "pxl_col_in_fullres"), f"{path}/spatial/tissue_positions.csv")
    m, at = tables.load_visium(s, path)
    return m.expr.join(at.select("cell", "x", "y"), "cell").select("feature", "cell", "value", "x", "y")


_WIDE = """, w AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, CAST(p_size % 2 AS DOUBLE) AS odd FROM part),
    l AS (SELECT id, 'size' AS feature, size AS value FROM w UNION ALL SELECT id, 'price', price FROM w UNION ALL SELECT id, 'odd', odd FROM w)"""


def _wide(s, d):
    p = fix.table(s, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_size") % 2).alias("odd"))


@query(_WIDE.replace(", w AS", "WITH w AS", 1) + " SELECT l.feature, id % 7 || '_' || id AS cell, value, id * 0.5 AS x, id * 0.25 AS y FROM l WHERE value <> 0 AND id <> 0")
def load_cosmx(s, d):
    path, w = files.folder(s, "cosmx"), _wide(s, d)
    keys = [(F.col("id") % 7).alias("fov"), F.col("id").alias("cell_ID")]
    files.write_csv(w.select(*keys, "size", "price", "odd"), f"{path}/expr.csv")
    files.write_csv(w.select(*keys, (F.col("id") * 0.5).alias("CenterX_global_px"), (F.col("id") * 0.25).alias("CenterY_global_px")), f"{path}/meta.csv")
    m, at = tables.load_cosmx(s, f"{path}/expr.csv", f"{path}/meta.csv")
    return m.expr.join(at.select("cell", "x", "y"), "cell").select("feature", "cell", "value", "x", "y")


@query(_WIDE.replace(", w AS", "WITH w AS", 1) + " SELECT l.feature, CAST(id AS VARCHAR) AS cell, value, id * 0.5 AS x, id * 0.25 AS y FROM l WHERE value <> 0")
def load_merscope(s, d):
    path, w = files.folder(s, "merscope"), _wide(s, d)
    files.write_csv(w.select(F.col("id").alias("cell"), "size", "price", "odd", F.lit(3).alias("Blank-1"), F.lit(4).alias("blank_2")), f"{path}/expr.csv")
    files.write_csv(w.select(F.col("id").alias("EntityID"), (F.col("id") * 0.5).alias("center_x"), (F.col("id") * 0.25).alias("center_y")), f"{path}/meta.csv")
    m, at = tables.load_merscope(s, f"{path}/expr.csv", f"{path}/meta.csv")
    return m.expr.join(at.select("cell", "x", "y"), "cell").select("feature", "cell", "value", "x", "y")


@query("SELECT * FROM (VALUES (89.5, 144.25, 0.17, CAST('nan' AS DOUBLE))) v(spot, fiducial, hires, lowres)")
def read_scale_factors(s, d):
    path = files.folder(s, "factors")
    s.createDataFrame([('{"spot_diameter_fullres": 89.5, "fiducial_diameter_fullres": 144.25, "tissue_hires_scalef": 0.17}',)], "value string").write.text(path)
    return tables.read_scale_factors(s, path)


@query("SELECT p_brand AS feature, p_type AS cell, CAST(sum(p_size) AS DOUBLE) AS value FROM part GROUP BY 1, 2 HAVING sum(p_size) <> 0")
def read_wide_table(s, d):
    path = files.folder(s, "wide")
    files.write_csv(fix.table(s, d, "part").groupBy("p_brand").pivot("p_type").agg(F.sum("p_size")).fillna(0), path)
    return tables.read_wide_table(s, path).expr.select("feature", "cell", "value")


# -- objects -------------------------------------------------------------------


@query("SELECT 'one' AS part, feature, cell, value FROM expr JOIN cells USING (cell) WHERE batch <> 'b0' AND ident <> 'BUILDING' UNION ALL SELECT 'two', feature, cell, value FROM expr JOIN cells USING (cell) WHERE batch <> 'b0' AND ident <> 'BUILDING' AND feature LIKE 'MT-%'", "expr", "cells")
def align_on_cells(s, d):
    m = fix.counts(s, d)
    one = mx.subset(m, cells=m.cells.filter("batch <> 'b0'"))
    two = mx.subset(m, cells=m.cells.filter("ident <> 'BUILDING'"), features=m.features.filter("feature like 'MT-%'"))
    a, b = mx.align_on_cells(one, two)
    return a.expr.select(F.lit("one").alias("part"), "feature", "cell", "value").unionByName(b.expr.select(F.lit("two").alias("part"), "feature", "cell", "value"))


_FILTERED = """, f AS (SELECT feature FROM expr GROUP BY 1 HAVING count(*) >= 400), e AS (SELECT * FROM expr SEMI JOIN f USING (feature)),
    k AS (SELECT cell, sum(value) AS n, count(*) AS k FROM e GROUP BY 1 HAVING count(*) >= 10)"""


def _object(s, d, **more):
    return Catalog.create(fix.counts(s, d), min_cells=400, min_features=10, **more)


@query(_FILTERED + " SELECT c.cell, ident, batch, n AS \"nCount_RNA\", k AS \"nFeature_RNA\", 'project' AS orig_ident FROM cells c JOIN k USING (cell)", "expr", "cells")
def create_object(s, d):
    return _object(s, d).cells.select("cell", "ident", "batch", "nCount_RNA", "nFeature_RNA", "orig_ident")


@query(_FILTERED + " SELECT feature, e.cell, value FROM e JOIN k USING (cell) JOIN cells c USING (cell) WHERE ident = 'BUILDING' AND feature LIKE 'g1%'", "expr", "cells")
def object_subset(s, d):
    o = _object(s, d)
    return o.subset(features=o.features["RNA"].filter("feature like 'g1%'"), idents=GROUP).layers["RNA", "counts"].select("feature", "cell", "value")


@query("SELECT 'x_' || cell AS cell, feature, value FROM expr JOIN cells USING (cell) WHERE batch = 'b0' UNION ALL SELECT 'y_' || cell, feature, value FROM expr JOIN cells USING (cell) WHERE batch <> 'b0'", "expr", "cells")
def object_merge(s, d):
    o = Catalog.create(fix.counts(s, d))
    return o.subset(o.cells.filter("batch = 'b0'")).merge([o.subset(o.cells.filter("batch <> 'b0'"))], ["x", "y"]).layers["RNA", "counts"].select("cell", "feature", "value")


@query("SELECT feature, cell, value FROM expr UNION ALL SELECT feature, cell, value FROM (SELECT feature, cell, value + 1000 AS value FROM expr)", "expr")
def object_bundle(s, d):
    path = files.folder(s, "bundle")
    o = Catalog.create(fix.counts(s, d))
    bundle.export_bundle(o.with_layer("more", o.layers["RNA", "counts"].withColumn("value", F.col("value") + 1000)), path)
    back = bundle.import_bundle(s, path)
    return back.layers["RNA", "counts"].select("feature", "cell", "value").unionByName(back.layers["RNA", "more"].select("feature", "cell", "value"))


@query("SELECT * FROM (VALUES ('counts.b0', CAST(0 AS BIGINT)), ('counts.b1', 1)) v(layer, place)")
def layers_list(s, d):
    o = Catalog.create(fix.counts(s, d))
    for b in ("b0", "b1"):
        o = o.with_layer(f"counts.{b}", o.layers["RNA", "counts"].join(o.cells.filter(F.col("batch") == b).select("cell"), "cell", "left_semi"))
    return s.createDataFrame(list(enumerate(o.layers_list(r"^counts\."))), "place long, layer string").select("layer", "place")


_RANKED_BY_NNZ = ", r AS (SELECT feature, row_number() OVER (ORDER BY n DESC, ord) AS rank FROM (SELECT f.feature, f.ord, count(value) AS n FROM features f LEFT JOIN expr USING (feature) GROUP BY 1, 2) QUALIFY rank <= 25)"


@query(_RANKED_BY_NNZ + " SELECT feature, rank AS place FROM r", "features", "expr")
def variable_features(s, d):
    m = fix.counts(s, d)
    ranked = mx.axis_sums(m, "feature").join(m.features, "feature").select("feature", F.row_number().over(Window.orderBy(F.desc("nnz"), "ord")).alias("rank")).filter("rank <= 25")
    names = mx.variable_features(mx.set_variable_features(m.features, ranked))
    return s.createDataFrame([(f, k + 1) for k, f in enumerate(names)], "feature string, place long")


@query("SELECT cell, batch AS ident, ident AS old FROM cells", "cells")
def stash_ident(s, d):
    return Catalog.create(fix.counts(s, d)).stash_ident("old").set_ident("batch").cells.select("cell", "ident", "old")


@query("SELECT * FROM (VALUES ('FindNeighbors', 'RNA', 'FindNeighbors(dims=[0, 1], k=20)', 'FindNeighbors.RNA.pca')) v(name, assay, call_string, key)")
def command_log(s, d):
    return Catalog.create(fix.counts(s, d)).log("FindNeighbors", "RNA", "pca", dims=[0, 1], k=20).command_table().select("name", "assay", "call_string", "key")


@query("SELECT image, count(DISTINCT cell) AS n_cells, count(*) AS n_vertices FROM rings WHERE cell IN (SELECT cell FROM rings WHERE x > 45) GROUP BY 1", "rings")
def geometry_dim(s, d):
    r = fix.rings(s, d)
    return sp.geometry_dim(sp.geometry_subset(r, r.filter("x > 45").select("cell")))


@query("SELECT cell, ident, n FROM (SELECT cell, ident, count(*) OVER (PARTITION BY ident) AS n FROM cells) WHERE n <= 100000 AND false UNION ALL SELECT NULL, ident, least(count(*), 40) FROM cells GROUP BY 2", "cells")
def downsampled_groups(s, d):
    m = fix.counts(s, d)
    chosen = mk.two_groups(m, GROUP, max_cells=40).join(m.cells.select("cell", "ident"), "cell")
    return chosen.groupBy("ident").agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast("string").alias("cell"), "ident", "n")


@query("SELECT * FROM (VALUES (0.5, '0.5'), (1.0, '1'), (0.1, '0.1'), (1e-05, '1e-05'), (100000.0, '1e+05'), (123456.0, '123456')) v(r, label)")
def resolution_labels(s, d):
    values = [0.5, 1.0, 0.1, 1e-05, 100000.0, 123456.0]
    return s.createDataFrame([(v, cl.resolution_label(v)) for v in values], "r double, label string")


@query("SELECT cell AS src, nbr AS dst, 1.0 AS weight FROM knn10 WHERE rank <= 6", "knn10")
def knn_graph(s, d):
    return nb.knn_graph(nb.knn(fix.embedding(s, d), 10), 6)


# -- tests and their tails -------------------------------------------------------

_FC = "log2((e1 + 1) / n1) - log2((e2 + 1) / n2)"
_MARKED = f"round(p, 6) AS p, round({_FC}, 6) + 0.0 AS \"avg_log2FC\", round(pos1 / n1, 6) AS pct_1, round(pos2 / n2, 6) AS pct_2, round(least(1, p * 120), 6) AS p_adj"
_LEVELS = ", w AS (SELECT cell, value / total AS value, feature FROM expr JOIN totals USING (cell))"


def _midranks(by: str, having: str = "true") -> str:
    return f"""{_LEVELS}, g AS (SELECT {by} AS part, f.feature, ident, coalesce(value, 0.0) AS value FROM features f CROSS JOIN cells c LEFT JOIN w e ON e.feature = f.feature AND e.cell = c.cell WHERE {having}),
    k AS (SELECT part, feature, ident, rank() OVER (PARTITION BY part, feature ORDER BY value) + (count(*) OVER (PARTITION BY part, feature, value) - 1) / 2 AS r, count(*) OVER (PARTITION BY part, feature, value) AS t FROM g),
    t AS (SELECT part, feature, sum(t::DOUBLE * t - 1) AS ties, count(*)::DOUBLE AS n FROM k GROUP BY 1, 2), u0 AS (SELECT part, feature, ident, count(*)::DOUBLE AS n1, sum(r) - count(*) * (count(*) + 1) / 2 AS u FROM k GROUP BY 1, 2, 3),
    u AS (SELECT part, feature, ident, n1, CASE WHEN n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1))) > 1e-12 THEN (abs(u - n1 * (n - n1) / 2) - 0.5) / sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))) END AS z FROM u0 JOIN t USING (part, feature)),
    q AS (SELECT *, coalesce(least(1.0, {normal_two_sided('greatest(z, 0)')}), 1.0) AS p FROM u)"""


def _sums_by(part: str, one: str) -> str:
    """Sums of each feature in group ``one`` and outside, by ``part``."""
    return f""", s0 AS (SELECT f.feature, {part} AS part, {one} AS one, count(value) AS pos, coalesce(sum(exp(value) - 1), 0) AS e, count(*)::DOUBLE AS n FROM features f CROSS JOIN cells c LEFT JOIN data d ON d.feature = f.feature AND d.cell = c.cell GROUP BY 1, 2, 3),
    s1 AS (SELECT feature, part, one, pos AS pos1, e AS e1, n AS n1, sum(pos) OVER v - pos AS pos2, sum(e) OVER v - e AS e2, sum(n) OVER v - n AS n2 FROM s0 WINDOW v AS (PARTITION BY feature, part))"""


_T = "(s1 / n1 - s2 / n2) / sqrt(v1 + v2)"
_DF = "((v1 + v2) * (v1 + v2) / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1)))"


@query(_midranks("0") + f" SELECT feature, {_MARKED} FROM (SELECT feature, p FROM q WHERE ident = 'BUILDING') JOIN sums USING (feature)", "features", "cells", "expr", "totals", "data", "sums")
def find_markers_wilcox(s, d):
    return mk.find_markers(fix.data(s, d), GROUP, test="wilcox", min_pct=0.0, threshold=0.0)


def _t_sql() -> str:
    from .sql_tails import t_two_sided

    return f", v AS (SELECT *, (q1 - s1 * s1 / n1) / (n1 - 1) / n1 AS v1, (q2 - s2 * s2 / n2) / (n2 - 1) / n2 AS v2 FROM sums), w AS (SELECT *, {_T} AS t, {_DF} AS df FROM v), r AS (SELECT *, {t_two_sided('t', 'df')} AS p FROM w) SELECT feature, {_MARKED} FROM r"


@query(_t_sql(), "sums")
def find_markers_t(s, d):
    return mk.find_markers(fix.data(s, d), GROUP, test="t", min_pct=0.0, threshold=0.0)


_LIK = "({n} - {p}) * ln(1 - greatest(1e-5, least(1 - 1e-5, {p} / {n}))) + {p} * ln(greatest(1e-5, least(1 - 1e-5, {p} / {n}))) - {p} / 2.0 * ln(2 * pi() * (({q} - {s} * {s} / {p}) / ({p} - 1))) - ({p} - 1) / 2.0"
_BIMOD = ", r0 AS (SELECT *, greatest(0, 2 * (" + _LIK.format(n="n1", p="pos1", q="q1", s="s1") + " + " + _LIK.format(n="n2", p="pos2", q="q2", s="s2") + " - (" + _LIK.format(n="(n1 + n2)", p="(pos1 + pos2)", q="(q1 + q2)", s="(s1 + s2)") + "))) AS lrt FROM sums)"


@query(_BIMOD + f", r AS (SELECT *, {chi2_sf('lrt', '3')} AS p FROM r0) SELECT feature, {_MARKED} FROM r", "sums")
def find_markers_bimod(s, d):
    return mk.find_markers(fix.data(s, d), GROUP, test="bimod", min_pct=0.0, threshold=0.0)


_HURDLE = """, r0 AS (SELECT *, pos1 * ln(pos1 / n1) + (n1 - pos1) * ln((n1 - pos1) / n1) + pos2 * ln(pos2 / n2) + (n2 - pos2) * ln((n2 - pos2) / n2) - (pos1 + pos2) * ln((pos1 + pos2) / (n1 + n2)) - (n1 + n2 - pos1 - pos2) * ln((n1 + n2 - pos1 - pos2) / (n1 + n2)) AS d,
    (pos1 + pos2) * ln((q1 + q2 - (s1 + s2) ** 2 / (pos1 + pos2)) / (q1 + q2 - s1 * s1 / pos1 - s2 * s2 / pos2)) AS l FROM sums), r1 AS (SELECT *, greatest(2 * d, 0) + greatest(l, 0) AS lrt, (d > 0)::INT + (l > 0)::INT AS df FROM r0)"""


# five places: a p-value of these tables lies on the edge of the sixth
@query(_HURDLE + f", r AS (SELECT *, {chi2_sf('lrt', 'df')} AS p FROM r1) SELECT feature, {_MARKED} FROM r".replace(", 6)", ", 5)"), "sums", digits=5)
def find_markers_mast(s, d):
    return mk.find_markers(fix.data(s, d), GROUP, test="mast", min_pct=0.0, threshold=0.0)


@query(_midranks("0") + _sums_by("0", "ident") + f" SELECT one AS cluster, feature, round(z, 6) + 0.0 AS z, {_MARKED} FROM (SELECT feature, ident AS one, z, p FROM q) JOIN s1 USING (feature, one) WHERE pos1 / n1 >= 0.1 OR pos2 / n2 >= 0.1", "features", "cells", "expr", "totals", "data")
def find_all_markers(s, d):
    return mk.find_all_markers(fix.data(s, d), threshold=0.0, return_thresh=1.1)


@query(
    _midranks("batch").replace("r, count(*)", "r, count(*)", 1).replace("ident, coalesce", "CASE WHEN ident = 'BUILDING' THEN 1 ELSE 2 END AS ident, coalesce", 1) + _sums_by("batch", "CASE WHEN ident = 'BUILDING' THEN 1 ELSE 2 END")
    + """, m AS (SELECT q.feature, q.part, p FROM q JOIN s1 ON s1.feature = q.feature AND s1.part = q.part AND one = 1 AND ident = 1 WHERE pos1 / s1.n1 >= 0.1 OR pos2 / n2 >= 0.1),
    x AS (SELECT feature, count(*) AS k, max(p) AS max_p, -sum(ln(greatest(p, 1e-300))) AS x FROM m GROUP BY 1 HAVING count(*) = 3)
    SELECT feature, round(max_p, 6) AS max_p, round(least(1, exp(-x) * (1 + x + x * x / 2)), 6) AS combined_p, k AS n_levels FROM x""",
    "features", "cells", "expr", "totals", "data",
)
def find_conserved_markers(s, d):
    return mk.find_conserved_markers(fix.data(s, d), GROUP, "batch", ["b0", "b1", "b2"], threshold=0.0)


_HYPER = "exp(lgamma(r1 + 1) - lgamma({x} + 1) - lgamma(r1 - {x} + 1) + lgamma(r2 + 1) - lgamma(c1 - {x} + 1) - lgamma(r2 - c1 + {x} + 1) - lgamma(r1 + r2 + 1) + lgamma(c1 + 1) + lgamma(r1 + r2 - c1 + 1))"


@query(
    """, t AS (SELECT ident AS "group", count(*) FILTER (batch = 'b0') AS n_1, count(*) FILTER (batch = 'b1') AS n_2 FROM cells WHERE batch IN ('b0', 'b1') GROUP BY 1),
    m AS (SELECT *, n_2 + n_1 AS r1, sum(n_2) OVER () + sum(n_1) OVER () - n_1 - n_2 AS r2, sum(n_2) OVER () AS c1, sum(n_1) OVER () AS c2 FROM t),
    o AS (SELECT *, """ + _HYPER.format(x="n_2") + """ AS seen, unnest(range(greatest(0, c1 - r2)::BIGINT, least(r1, c1)::BIGINT + 1)) AS x FROM m),
    p AS (SELECT "group", n_1, n_2, round(n_1 / c2, 6) AS prop_1, round(n_2 / c1, 6) AS prop_2, round(log2((n_2 / c1) / (n_1 / c2)), 6) + 0.0 AS log2_ratio, least(1.0, sum(pr) FILTER (pr <= seen * (1 + 1e-7))) AS p FROM (SELECT *, """ + _HYPER.format(x="x") + """ AS pr FROM o) GROUP BY ALL),
    a AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM p), b AS (SELECT *, least(1, min(raw) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS padj FROM a)
    SELECT "group", n_1, n_2, prop_1, prop_2, log2_ratio, round(p, 6) AS p, round(padj, 6) AS padj, CASE WHEN padj <= 0.001 THEN '***' WHEN padj <= 0.01 THEN '**' WHEN padj <= 0.05 THEN '*' ELSE 'ns' END AS sig FROM b""", "cells",
)
def composition_test(s, d):
    """Fisher's exact test of each group against the others, adjusted, with marks."""
    t = ag.composition(fix.cells(s, d), "ident", "batch", "b0", "b1")
    w = Window.partitionBy(F.lit(0))
    t = t.withColumn("_a", F.sum("n_2").over(w) - F.col("n_2")).withColumn("_b", F.sum("n_1").over(w) - F.col("n_1"))
    t = t.withColumn("p", fisher_p("n_2", "n_1", "_a", "_b")).drop("_a", "_b")
    return fx.benjamini_hochberg(t).withColumn("sig", fx.stars(F.col("padj")))


# -- transfers and signatures ------------------------------------------------------

_MOVED = _WEIGHTS + """, dims AS (SELECT unnest(range(1, len(any_value(vec)) + 1)) AS i FROM emb),
    sh AS (SELECT w.cell, i, sum(weight * (a.vec[i] - b.vec[i])) AS s FROM weights w JOIN emb a ON a.cell = w.c1 JOIN emb b ON b.cell = w.c2 CROSS JOIN dims GROUP BY 1, 2),
    mv AS (SELECT q.cell, dims.i, q.vec[dims.i] + CASE WHEN q.ord % 2 = 1 THEN coalesce(s, 0) ELSE 0 END AS x FROM emb q CROSS JOIN dims LEFT JOIN sh ON sh.cell = q.cell AND sh.i = dims.i)"""


@query(_MOVED + " SELECT cell, round(max(x) FILTER (i = 1), 6) + 0.0 AS first, round(sqrt(sum(x * x)), 6) AS norm FROM mv GROUP BY 1", "emb")
def integrate_embeddings(s, d):
    a, b = _halves(s, d)
    anchors = mp.find_anchors(a, b, 5, 15)
    return mp.integrate_embeddings(anchors, a, b, 20).select("cell", F.element_at("vec", 1).alias("first"), fx.norm(F.col("vec")).alias("norm"))


def _entries(e):
    return e.select(F.posexplode("vec").alias("i", "value"), "cell").select(F.concat(F.lit("d"), (F.col("i") + 1).cast("string")).alias("feature"), "cell", "value")


@query(_MOVED + " SELECT 'd' || i AS feature, cell, round(x, 6) + 0.0 AS value FROM mv", "emb")
def integrate_data(s, d):
    a, b, anchors, weights = _anchor_parts(s, d)
    return mp.integrate_data(anchors, _entries(a), _entries(b), weights)


@query(_ANCHORS + ", z AS (SELECT a.cell AS c1, b.cell AS c2 FROM emb a JOIN emb b ON a.ord % 2 = 0 AND b.ord % 2 = 1 QUALIFY row_number() OVER (PARTITION BY a.cell ORDER BY round(list_distance(a.vec[1:8], b.vec[1:8]), 12), b.ord) <= 60) SELECT c1 AS cell1, c2 AS cell2, round(score, 6) AS score FROM anchors SEMI JOIN z USING (c1, c2)", "emb")
def filter_anchors(s, d):
    a, b = _halves(s, d)
    space = [x.withColumn("vec", F.slice("vec", 1, 8)) for x in (a, b)]
    return mp.filter_anchors(mp.find_anchors(a, b, 5, 15), *space, k_filter=60)


@query(
    """, z AS (SELECT q.cell, t.cell AS nbr, t.vec AS vec, list_distance(q.vec, t.vec) AS dist FROM emb q JOIN emb t ON q.ord % 2 = 1 AND t.ord % 2 = 0 QUALIFY row_number() OVER (PARTITION BY q.cell ORDER BY round(list_distance(q.vec, t.vec), 12), t.ord) <= 30)
    SELECT cell, round(sum(vec[1] / (dist + 1e-6)) / sum(1 / (dist + 1e-6)), 6) + 0.0 AS x, round(sum(vec[2] / (dist + 1e-6)) / sum(1 / (dist + 1e-6)), 6) + 0.0 AS y FROM z GROUP BY 1""", "emb",
)
def place_by_neighbors(s, d):
    a, b = _halves(s, d)
    out = mp.place_by_neighbors(b, a, a.select("cell", F.slice("vec", 1, 2).alias("vec")))
    return out.select("cell", F.element_at("vec", 1).alias("x"), F.element_at("vec", 2).alias("y"))


@query(
    """, k AS (SELECT a.cell, b.cell AS nbr, row_number() OVER (PARTITION BY a.cell ORDER BY round(list_distance(a.vec[1:3], b.vec[1:3]), 12), b.ord) AS rank FROM emb a CROSS JOIN emb b QUALIFY rank <= 10)
    SELECT a.cell AS src, b.cell AS dst, round(count(*) / (20.0 - count(*)), 6) AS weight FROM k a JOIN k b USING (nbr) GROUP BY 1, 2 HAVING count(*) / (20.0 - count(*)) >= 1 / 15.0""", "emb",
)
def find_neighbors(s, d):
    return nb.find_neighbors(fix.embedding(s, d), [0, 1, 2], 10)[1]


_BINS = """, m AS (SELECT f.feature, f.ord, coalesce(sum(value), 0) / (SELECT n FROM n) AS mean FROM features f LEFT JOIN data USING (feature) GROUP BY 1, 2), eg AS (SELECT unnest(list_distinct([""" + ", ".join(f"quantile_cont(mean, {k / 8})" for k in range(1, 8)) + """])) AS e FROM m),
    bin AS (SELECT feature, (SELECT count(*) FROM eg WHERE eg.e < m.mean) AS bin FROM m), pr AS (SELECT 'S' AS program, 'g' || unnest(range(10, 20)) AS feature UNION ALL SELECT 'G2M', 'g' || unnest(range(30, 42))),
    ct AS (SELECT DISTINCT program, b.feature FROM pr JOIN bin a USING (feature) JOIN bin b USING (bin)), own AS (SELECT program, cell, sum(value) AS s FROM data JOIN pr USING (feature) GROUP BY 1, 2), oth AS (SELECT program, cell, sum(value) AS s FROM data JOIN ct USING (feature) GROUP BY 1, 2),
    sc AS (SELECT g.program, c.cell, coalesce(own.s, 0) / g.k - coalesce(oth.s, 0) / h.k AS score FROM cells c CROSS JOIN (SELECT program, count(*) AS k FROM pr GROUP BY 1) g JOIN (SELECT program, count(*) AS k FROM ct GROUP BY 1) h USING (program) LEFT JOIN own ON own.program = g.program AND own.cell = c.cell LEFT JOIN oth ON oth.program = g.program AND oth.cell = c.cell)"""
_PROGRAMS = {"S": [f"g{k}" for k in range(10, 20)], "G2M": [f"g{k}" for k in range(30, 42)]}


@query(_BINS + " SELECT program, cell, round(score, 6) + 0.0 AS score FROM sc", "features", "cells", "data", "n")
def module_scores(s, d):
    return sc.module_scores(fix.data(s, d), _PROGRAMS, n_bins=8)


@query(_BINS + " SELECT cell, round(max(score) FILTER (program = 'S'), 6) + 0.0 AS s_score, round(max(score) FILTER (program = 'G2M'), 6) + 0.0 AS g2m_score, CASE WHEN max(score) FILTER (program = 'S') <= 0 AND max(score) FILTER (program = 'G2M') <= 0 THEN 'G1' WHEN max(score) FILTER (program = 'S') > max(score) FILTER (program = 'G2M') THEN 'S' ELSE 'G2M' END AS phase FROM sc GROUP BY 1", "features", "cells", "data", "n")
def cell_cycle(s, d):
    return sc.cell_cycle(fix.data(s, d), _PROGRAMS["S"], _PROGRAMS["G2M"], n_bins=8)


@query(
    """, p AS (SELECT cell, ord, ident, depth, (ord % 97)::DOUBLE AS o FROM cells), z AS (SELECT q.cell, t.cell AS nbr FROM p q JOIN p t ON t.ident = 'BUILDING' QUALIFY row_number() OVER (PARTITION BY q.cell ORDER BY round(sqrt((q.depth - t.depth) ** 2 + (q.o - t.o) ** 2), 12), t.ord) <= 5),
    mn AS (SELECT z.cell, feature, sum(value) / 5.0 AS m FROM z JOIN data ON data.cell = nbr GROUP BY 1, 2)
    SELECT f.feature, c.cell, round(coalesce(value, 0) - coalesce(m, 0), 6) + 0.0 AS value FROM features f CROSS JOIN cells c LEFT JOIN data d ON d.feature = f.feature AND d.cell = c.cell LEFT JOIN mn ON mn.feature = f.feature AND mn.cell = c.cell""", "features", "cells", "data",
)
def perturbation_signature(s, d):
    m = fix.data(s, d)
    e = m.cells.select("cell", "ord", F.array(F.col("depth"), (F.col("ord") % 97).cast("double")).alias("vec"))
    return sc.perturbation_signature(m, e, m.cells.filter("ident = 'BUILDING'"), la.feature_list(m), 5)


@query(", u AS (SELECT cell, i, vec[i] AS x FROM emb, (SELECT unnest(range(1, len(any_value(vec)) + 1)) AS i FROM emb)), z AS (SELECT cell, i, (x - avg(x) OVER w) / stddev_samp(x) OVER w AS z FROM u WINDOW w AS (PARTITION BY i)) SELECT cell, round(max(z / n) FILTER (i = 1), 6) + 0.0 AS first, round(max(n), 6) AS norm FROM (SELECT *, sqrt(sum(z * z) OVER (PARTITION BY cell)) AS n FROM z) GROUP BY 1", "emb")
def standardized_rows(s, d):
    out = la.standardize(fix.embedding(s, d))
    return out.select("cell", F.element_at(fx.l2_normalise(F.col("vec")), 1).alias("first"), fx.norm(F.col("vec")).alias("norm"))


# -- tags, curves, space -------------------------------------------------------------


def _curve(rows: str, points: int, bandwidth: str) -> str:
    """Density of (grp, value) rows; needs a common table named by ``rows``."""
    bw = {"scott": "sd * n ** -0.2", "nrd0": "0.9 * least(sd, CASE WHEN q3 > q1 THEN (q3 - q1) / 1.34 ELSE sd END) * n ** -0.2"}[bandwidth]
    return f""", st AS (SELECT grp, count(*)::DOUBLE AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {rows} GROUP BY 1 HAVING max(value) > min(value)),
    gr AS (SELECT grp, n, {bw} AS bw, i, lo + (hi - lo) * i / {points - 1} AS x FROM st, (SELECT unnest(range({points})) AS i)),
    cu AS (SELECT gr.grp, i, any_value(x) AS x, sum(c * exp(-0.5 * ((x - value) / bw) ** 2)) / any_value(n * bw * sqrt(2 * pi())) AS density FROM gr JOIN (SELECT grp, value, count(*) AS c FROM {rows} GROUP BY 1, 2) v ON v.grp = gr.grp GROUP BY 1, 2)"""


_G15 = ", v0 AS (SELECT ident AS grp, coalesce(value, 0) AS value FROM cells c LEFT JOIN (SELECT * FROM data WHERE feature = 'g15') e USING (cell))"


@query(_G15 + _curve("v0", 64, "nrd0") + ' SELECT grp AS "group", i, round(x, 6) AS x, round(density, 6) + 0.0 AS density FROM cu', "cells", "data")
def violin(s, d):
    return pl.violin(fix.data(s, d), "g15", "ident", 64)[0]


@query(_G15 + _curve("v0", 30, "scott") + ' SELECT grp AS "group", i, round(x, 6) AS x, round(density, 6) + 0.0 AS density FROM cu', "cells", "data")
def ridge_plot(s, d):
    return pl.ridge(fix.data(s, d), "g15", "ident", 30)


def _calls(s, d):
    c = fix.cells(s, d)
    return c.select("cell", F.col("ident").alias("target"), F.col("batch").alias("call"), F.col("depth").alias("score"), F.col("depth").alias("posterior"))


@query(", v0 AS (SELECT batch AS grp, depth AS value FROM cells)" + _curve("v0", 40, "scott") + ' SELECT grp AS "call", i, round(x, 6) AS x, round(density, 9) + 0.0 AS density FROM cu', "cells", digits=9)
def perturbation_plot(s, d):
    return pl.perturbation_plot(_calls(s, d), 40).withColumn("x", F.round("x", 6))


@query("SELECT f.feature, c.cell, ident AS \"group\", row_number() OVER (PARTITION BY f.feature ORDER BY ident, depth DESC, c.cell) AS place, round(least(2.5, coalesce(value, 0)), 6) AS value FROM features f CROSS JOIN cells c LEFT JOIN data e ON e.feature = f.feature AND e.cell = c.cell", "features", "cells", "data")
def perturbation_heatmap(s, d):
    m = fix.data(s, d)
    return pl.perturbation_heatmap(m.expr, _calls(s, d), la.feature_list(m))


@query(
    """, w AS (SELECT feature, exp(sum(ln(1 + value)) / (SELECT n FROM n)) AS m FROM expr WHERE feature LIKE 'MT-%' GROUP BY 1), v0 AS (SELECT f.feature AS grp, f.ord, c.cell, coalesce(ln(1 + value / m), 0.0) AS value FROM (SELECT * FROM features WHERE feature LIKE 'MT-%') f CROSS JOIN (SELECT cell FROM cells) c LEFT JOIN expr e ON e.feature = f.feature AND e.cell = c.cell LEFT JOIN w ON w.feature = f.feature)"""
    + _curve("v0", 100, "scott")
    + """, pk AS (SELECT grp, i, x, density FROM (SELECT *, lag(density) OVER z AS a, lead(density) OVER z AS b FROM cu WINDOW z AS (PARTITION BY grp ORDER BY i)) WHERE (a IS NULL OR density > a) AND (b IS NULL OR b <= density)),
    md AS (SELECT grp, min(x) AS lo, max(x) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY density DESC, i) AS k FROM pk) WHERE k <= 2 GROUP BY 1 HAVING count(*) = 2),
    ht AS (SELECT cell, count(*) AS n, min_by(grp, ord) AS tag FROM v0 JOIN md USING (grp) WHERE value >= lo + 0.7 * (hi - lo) GROUP BY 1)
    SELECT c.cell, coalesce(n, 0) AS n_positive, CASE coalesce(n, 0) WHEN 0 THEN 'Negative' WHEN 1 THEN tag ELSE 'Doublet' END AS classification FROM cells c LEFT JOIN ht USING (cell)""", "features", "cells", "expr", "n",
)
def multiseq_demux(s, d):
    m = fix.counts(s, d)
    return dm.multiseq_demux(mx.subset(m, features=m.features.filter("feature like 'MT-%'")))[0]


@query("SELECT ident AS feature, s.cell, CAST(count(*) AS DOUBLE) AS value FROM space6 s JOIN cells l ON l.cell = s.nbr GROUP BY 1, 2", "space6", "cells")
def niche_assay(s, d):
    from ..operators import workflows as wf

    labels = fix.cells(s, d).select("cell", F.col("ident").alias("category"))
    return wf.build_niche_assay(fix.centroids(s, d), labels, 6)[0]


@query(
    """, sp AS (SELECT quantile_cont(d, 0.5) AS h FROM (SELECT a.cell, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM centroids a JOIN centroids b ON a.cell <> b.cell GROUP BY 1)),
    pr AS (SELECT a.cell AS src, b.cell AS dst, 1 - ((sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) - 5 * h) / h) ** 2 AS w FROM centroids a, centroids b, sp WHERE a.cell <> b.cell AND abs(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) - 5 * h) < h),
    v AS (SELECT f.feature, c.cell, coalesce(value, 0) AS value FROM features f CROSS JOIN cells c LEFT JOIN data e ON e.feature = f.feature AND e.cell = c.cell), va AS (SELECT feature, var_pop(value) AS va FROM v GROUP BY 1),
    g AS (SELECT a.feature, sum(w * (a.value - b.value) ** 2) / 2 / (SELECT sum(w) FROM pr) AS gamma FROM pr JOIN v a ON a.cell = src JOIN v b ON b.cell = dst AND b.feature = a.feature GROUP BY 1)
    SELECT feature, round(gamma / va, 6) AS markvariogram FROM g JOIN va USING (feature)""", "features", "cells", "data", "centroids",
)
def mark_variogram(s, d):
    return sp.mark_variogram(fix.data(s, d).expr, fix.centroids(s, d)).select("feature", "markvariogram")


@query(
    """, b AS (SELECT a.cell AS i, b.cell AS j, 1 / ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM centroids a JOIN centroids b ON a.cell <> b.cell), w AS (SELECT i, j, d / sum(d) OVER (PARTITION BY i) AS w FROM b),
    v AS (SELECT f.feature, c.cell, coalesce(value, 0) AS value FROM features f CROSS JOIN cells c LEFT JOIN data e ON e.feature = f.feature AND e.cell = c.cell WHERE f.feature LIKE 'MT-%'), z AS (SELECT feature, cell, value - avg(value) OVER (PARTITION BY feature) AS z FROM v),
    n AS (SELECT a.feature, sum(w * a.z * b.z) AS num FROM w JOIN z a ON a.cell = i JOIN z b ON b.cell = j AND b.feature = a.feature GROUP BY 1), q AS (SELECT feature, sum(z * z) AS den FROM z GROUP BY 1)
    SELECT feature, round(num / den, 6) + 0.0 AS moransi FROM n JOIN q USING (feature)""", "features", "cells", "data", "centroids",
)
def morans_i_all_pairs(s, d):
    """The six control features; all pairs of cells."""
    m = fix.data(s, d)
    return sp.morans_i_inverse_square(m.expr, fix.centroids(s, d), [f"MT-{k}" for k in range(6)]).select("feature", "moransi")


_FULL = ", g AS (SELECT f.feature, c.cell, c.ident, c.depth, coalesce(value, 0) AS value FROM features f CROSS JOIN cells c LEFT JOIN data e ON e.feature = f.feature AND e.cell = c.cell)"


@query(_FULL + " SELECT feature, cell, round(greatest(-10, least(10, (value - avg(value) OVER w) / stddev_samp(value) OVER w)), 6) + 0.0 AS value FROM g WINDOW w AS (PARTITION BY feature)", "features", "cells", "data")
def scale_data(s, d):
    return nz.scale_data(fix.data(s, d), fix.features(s))


@query(_FULL + ", r AS (SELECT feature, regr_slope(value, depth) AS b, regr_intercept(value, depth) AS a FROM g GROUP BY 1) SELECT feature, cell, round(value - a - b * depth, 6) + 0.0 AS value FROM g JOIN r USING (feature)", "features", "cells", "data")
def regress_out(s, d):
    m = fix.data(s, d)
    return nz.regress_out(m, "depth", la.feature_list(m))


@query(
    _FULL + """, h AS (SELECT feature, ident AS grp, sum(exp(value) - 1) / count(*) AS mean, count(*) FILTER (value > 0) / count(*) AS pct FROM g GROUP BY 1, 2)
    SELECT feature, grp AS "group", round(mean, 6) AS mean, round(pct, 6) AS pct, round(greatest(-2.5, least(2.5, (ln(1 + mean) - avg(ln(1 + mean)) OVER w) / stddev_samp(ln(1 + mean)) OVER w)), 6) + 0.0 AS scaled FROM h WINDOW w AS (PARTITION BY feature)""", "features", "cells", "data",
)
def dot_plot(s, d):
    m = fix.data(s, d)
    return ag.dot_plot(m, "ident", la.feature_list(m))


@query("SELECT f.feature, c.cell, ident AS \"group\", row_number() OVER (PARTITION BY f.feature ORDER BY ident, c.ord) AS place, round(least(2.5, coalesce(value, 0)), 6) AS value FROM features f CROSS JOIN cells c LEFT JOIN data e ON e.feature = f.feature AND e.cell = c.cell", "features", "cells", "data")
def heatmap(s, d):
    m = fix.data(s, d)
    return pl.heatmap(m.expr, m.cells, la.feature_list(m), "ident")


@query("SELECT feature, cell, value FROM expr", "expr")
def dense_round_trip(s, d):
    m = fix.counts(s, d)
    return mx.from_dense(mx.to_dense(m), m.cells)


@query(", g AS (SELECT f.feature, batch, coalesce(value, 0) AS value FROM features f CROSS JOIN cells c LEFT JOIN data e ON e.feature = f.feature AND e.cell = c.cell) SELECT feature FROM (SELECT feature, batch, stddev_samp(value) AS sd FROM g GROUP BY 1, 2) GROUP BY 1 HAVING min(sd) > 0", "features", "cells", "data")
def varying_everywhere(s, d):
    m = fix.data(s, d)
    return mp.varying_everywhere([nz.feature_moments(mx.subset(m, cells=m.cells.filter(F.col("batch") == b))) for b in ("b0", "b1", "b2")])


@query(_WEIGHTS + ", dims AS (SELECT unnest(range(1, len(any_value(vec)) + 1)) AS i FROM emb) SELECT 'd' || i AS feature, w.cell, round(sum(weight * vec[i]), 6) + 0.0 AS value FROM weights w JOIN emb ON emb.cell = c1 CROSS JOIN dims GROUP BY 1, 2", "emb")
def transfer_values(s, d):
    a, _, _, weights = _anchor_parts(s, d)
    return mp.transfer_values(weights, _entries(a))


@query(
    """, v AS (SELECT f.feature, c.cell, coalesce(value, 0) AS value FROM features f CROSS JOIN cells c LEFT JOIN data e ON e.feature = f.feature AND e.cell = c.cell),
    z AS (SELECT feature, cell, value - avg(value) OVER (PARTITION BY feature) AS z FROM v), q AS (SELECT feature, sum(z * z) AS den FROM z GROUP BY 1),
    k AS (SELECT a.feature, sum(a.z * b.z) / 6.0 AS num FROM space6 s JOIN z a ON a.cell = s.cell JOIN z b ON b.cell = s.nbr AND b.feature = a.feature GROUP BY 1)
    SELECT feature, round(num / den, 6) + 0.0 AS moransi FROM k JOIN q USING (feature)""", "space6", "features", "cells", "data",
)
def morans_i(s, d):
    m = fix.data(s, d)
    return sp.morans_i(m.expr, m.cells, sp.knn_weights(fix.centroids(s, d), 6)).select("feature", "moransi")


@query("SELECT image, cell, round(x * 0.17, 6) AS x, round(y * 0.17, 6) AS y, depth AS value, round(89.5 / 2 * 0.17 * 1.6, 6) AS radius FROM centroids JOIN cells USING (cell)", "centroids", "cells")
def spatial_plot(s, d):
    return sp.spatial_plot(fix.centroids(s, d), fix.cells(s, d).select("cell", F.col("depth").alias("value")), 0.17, 89.5)


@query("SELECT feature, rank() OVER (ORDER BY round(depth, 6) DESC) AS rank FROM (SELECT f.feature, round(sum(value), 6) AS depth FROM features f JOIN expr USING (feature) GROUP BY 1)", "features", "expr")
def competition_rank(s, d):
    sums = mx.axis_sums(fix.counts(s, d), "feature").select("feature", F.round("total", 6).alias("moransi"))
    return sp.ranked(sums, 0.0, 1.0).select("feature", "rank")


# -- streams ---------------------------------------------------------------------


@query("SELECT event_type AS feature, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(var_samp(value), 6) AS variance FROM events GROUP BY 1")
def stream_variance(s, d):
    from .queries import _events

    out = st.run(st.running_variance(_events(s, d).select("feature", "value")), "update", own_state=True)
    return out.groupBy("feature").agg(F.max_by(F.struct("n", "mean", "variance"), "n").alias("m")).select("feature", "m.n", "m.mean", "m.variance")


@query(
    """WITH e AS (SELECT ts, CASE WHEN epoch_us(ts) % 3 = 0 THEN 2 WHEN epoch_us(ts) % 3 = 1 THEN 0 ELSE 1 END AS batch FROM events), m AS (SELECT batch, max(ts) AS hi FROM e GROUP BY 1)
    SELECT e.batch, count(*) AS n, count(*) FILTER (ts < (SELECT max(hi) FROM m WHERE m.batch < e.batch) - INTERVAL '1 day') AS n_late FROM e GROUP BY 1"""
)
def stream_late_rows(s, d):
    path = files.folder(s, "late")
    e = fix.table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    part = F.unix_micros("ts") % 3
    for k, want in enumerate((1, 2, 0)):
        e.filter(part == want).repartition(1).write.mode("append").parquet(path)
    return st.late_rows(st.stream_table(s, path, files_per_batch=1), "1 day")
