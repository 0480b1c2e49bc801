"""Further queries: tables of the longer workflows, and SQL for their parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import clustering as cl
from ..operators import linalg as la
from ..operators import mapping as mp
from ..operators import markers as mk
from ..operators import matrix as mx
from ..operators import models as md
from ..operators import neighbors as nb
from ..operators import normalize as nz
from ..operators import plots as pl
from ..operators import scores as sc
from ..operators import spatial as sp
from ..operators import variable as vf
from ..operators import workflows as wf
from . import fixture as fix
from .queries import _WEIGHTS, GROUP, _anchor_parts, query

#: All features of the fixture.
SOME = [f"MT-{k}" for k in range(6)] + [f"g{k}" for k in range(6, 120)]


def _two(df, key="cell"):
    """The first two coordinates, in size: signs of components are free."""
    return df.select(key, *[F.round(F.abs(F.element_at("vec", k)), 4).alias(f"v{k}") for k in (1, 2)])


def _parts(s, d):
    """Two datasets: the first batch and the others."""
    m = fix.data(s, d)
    return [mx.subset(m, cells=m.cells.filter(x)) for x in ("batch = 'b0'", "batch <> 'b0'")]


@query("SELECT src, dst, round(weight, 6) AS weight FROM snn WHERE src IN (SELECT cell FROM emb WHERE ord % 3 = 0) AND dst IN (SELECT cell FROM emb WHERE ord % 3 = 0)", "snn")
def graph_subset(s, d):
    e = fix.embedding(s, d)
    return nb.graph_subset(nb.snn_graph(nb.knn(e, 10), 10), e.filter("ord % 3 = 0"))


@query("SELECT src, dst, round(weight, 6) AS weight FROM snn WHERE src < dst", "snn")
def upper_edges(s, d):
    return cl.upper_edges(nb.snn_graph(nb.knn(fix.embedding(s, d), 10), 10))


@query("SELECT cell, round(vec[1], 6) + 0.0 AS a, round(vec[4], 6) + 0.0 AS b FROM emb", "emb")
def take_dims(s, d):
    e = fix.embedding(s, d).withColumn("vec", fx.take_dims(F.col("vec"), [0, 3]))
    return e.select("cell", F.element_at("vec", 1).alias("a"), F.element_at("vec", 2).alias("b"))


@query("SELECT x, y, cell, image FROM centroids", "centroids")
def tissue_coordinates(s, d):
    c = fix.centroids(s, d)
    return sp.tissue_coordinates([c.filter("image = 'i0'"), c.filter("image = 'i1'")])


@query("SELECT 'the_' || l AS image, cell, x, y FROM (SELECT cell, x, y, image AS l FROM centroids)", "centroids")
def create_fovs(s, d):
    return sp.create_fovs(fix.centroids(s, d).withColumn("label", F.concat(F.lit("the "), "image")), "label")


@query("SELECT feature, ord FROM features SEMI JOIN (SELECT feature FROM expr JOIN cells USING (cell) WHERE ident = 'BUILDING' GROUP BY 1 HAVING count(*) > 70) USING (feature)", "features", "expr", "cells")
def shared_features(s, d):
    m = fix.counts(s, d)
    own = m.expr.join(mx.which_cells(m.cells, GROUP), "cell", "left_semi").groupBy("feature").count().filter("count > 70")
    return mp.shared_features(m.features, own)


@query("SELECT ident AS cluster, f.feature, count(value) AS pos1, round(coalesce(sum(exp(value) - 1), 0), 5) AS e1, count(*) AS n1 FROM features f CROSS JOIN cells c LEFT JOIN data e ON e.feature = f.feature AND e.cell = c.cell GROUP BY 1, 2", "features", "cells", "data")
def cluster_sums(s, d):
    out = mk.cluster_sums(fix.data(s, d))
    return out.select("cluster", "feature", "pos1", F.round("e1", 5).alias("e1"), F.col("n1").cast("long").alias("n1"))


_RANKED = """, g AS (SELECT f.feature, ident, coalesce(value, 0.0) AS value FROM features f CROSS JOIN cells c LEFT JOIN expr e ON e.feature = f.feature AND e.cell = c.cell),
    k AS (SELECT feature, ident, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS r, count(*) OVER (PARTITION BY feature, value) AS t FROM g),
    t AS (SELECT feature, sum(t::DOUBLE * t - 1) AS ties, count(*)::DOUBLE AS n FROM k GROUP BY 1), u AS (SELECT feature, ident, count(*)::DOUBLE AS n1, sum(r) - count(*) * (count(*) + 1) / 2 AS u FROM k GROUP BY 1, 2)"""


@query(_RANKED + " SELECT ident AS cluster, feature, round((abs(u - n1 * (n - n1) / 2) - 0.5) / sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))), 6) + 0.0 AS z FROM u JOIN t USING (feature)", "features", "cells", "expr")
def all_clusters_wilcoxon(s, d):
    return mk.find_all_markers(fix.counts(s, d), min_pct=0.0, threshold=0.0, return_thresh=2.0).select("cluster", "feature", "z")


@query(
    """, m AS (SELECT f.feature, f.ord, sum(coalesce(value, 0)) / count(*) AS mean FROM features f CROSS JOIN cells c LEFT JOIN expr e ON e.feature = f.feature AND e.cell = c.cell GROUP BY 1, 2)
    SELECT feature, round(sum(least((coalesce(value, 0) - mean) / sqrt(mean), sqrt((SELECT n FROM n))) ** 2) / ((SELECT n FROM n) - 1), 6) AS standardized FROM m CROSS JOIN cells c LEFT JOIN expr e USING (feature, cell) WHERE mean > 0 GROUP BY 1""",
    "features", "cells", "expr", "n",
)
def standardized_variance(s, d):
    m = fix.counts(s, d)
    moments = vf.vst_moments(m)
    return vf.standardized_variance(m, moments, moments.select("feature", F.col("mean").alias("expected"))).filter("mean > 0").select("feature", "standardized")


@query("SELECT feature, round(2 * (d1 + d2 - d) + CASE WHEN pos1 + pos2 >= 3 THEN (pos1 + pos2) * ln((q1 + q2 - (s1 + s2) ** 2 / (pos1 + pos2)) / (q1 + q2 - s1 * s1 / pos1 - s2 * s2 / pos2)) ELSE 0 END, 5) + 0.0 AS lrt FROM (SELECT *, pos1 * ln(pos1 / n1) + (n1 - pos1) * ln((n1 - pos1) / n1) AS d1, pos2 * ln(pos2 / n2) + (n2 - pos2) * ln((n2 - pos2) / n2) AS d2, (pos1 + pos2) * ln((pos1 + pos2) / (n1 + n2)) + (n1 + n2 - pos1 - pos2) * ln((n1 + n2 - pos1 - pos2) / (n1 + n2)) AS d FROM sums)", "sums")
def hurdle(s, d):
    m = fix.data(s, d)
    return mk.hurdle(mk.group_sums(m, mk.two_groups(m, GROUP))).select("feature", F.round("lrt", 5).alias("lrt"))


@query(
    """, r AS (SELECT src, dst, weight, rank() OVER (PARTITION BY src ORDER BY round(weight, 12)) AS r FROM snn WHERE src <> dst), f AS (SELECT src, list_distance(a.vec, b.vec) AS dist, row_number() OVER (PARTITION BY src ORDER BY list_distance(a.vec, b.vec) DESC, dst) AS k FROM r JOIN emb a ON a.cell = src JOIN emb b ON b.cell = dst WHERE r <= 8)
    SELECT src AS cell, round(avg(dist), 6) AS bandwidth FROM f WHERE k <= 8 GROUP BY 1""", "snn",
)
def snn_bandwidth(s, d):
    e = fix.embedding(s, d)
    return nb.snn_bandwidth(nb.snn_graph(nb.knn(e, 10), 10), e, 8)


@query(
    """, z AS (SELECT q.cell, t.label AS class, list_distance(q.vec, t.vec) AS dist, row_number() OVER (PARTITION BY q.cell ORDER BY round(list_distance(q.vec, t.vec), 12), t.ord) AS r FROM emb q CROSS JOIN emb t WHERE t.ord % 4 = 0 AND q.ord % 4 <> 0),
    y AS (SELECT cell, class, 1 - exp(-(1 - dist / max(dist) OVER (PARTITION BY cell)) / 4) AS w FROM z WHERE r <= 12), v AS (SELECT cell, class, sum(w) / any_value(t) AS score FROM (SELECT *, sum(w) OVER (PARTITION BY cell) AS t FROM y) GROUP BY 1, 2)
    SELECT cell, class, round(score, 6) AS score FROM v QUALIFY row_number() OVER (PARTITION BY cell ORDER BY score DESC, class) = 1""", "emb",
)
def project_labels(s, d):
    e = fix.embedding(s, d)
    return mp.project_labels(e.filter("ord % 4 <> 0"), e.filter("ord % 4 = 0"), e.select("cell", F.col("label").alias("class")), 12)


@query(
    """, p AS (SELECT l_linenumber % 3 AS dim, (l_partkey * 31 % 9973) / 9973.0 AS p FROM lineitem), h AS (SELECT dim, count(*) FILTER (p <= 0.01) AS n_hits, count(*)::DOUBLE AS n, floor(count(*) * 0.01) AS c FROM p GROUP BY 1)
    SELECT dim, n_hits, round(CASE WHEN n_hits > 0 THEN ((abs(n_hits / n - c / n) - least(0.5, abs(n_hits - c) / 2) * 2 / n) / sqrt((n_hits + c) / (2 * n) * (1 - (n_hits + c) / (2 * n)) * 2 / n)) ** 2 ELSE 0 END, 6) AS score FROM h""".replace(", p AS", "WITH p AS", 1)
)
def score_jack_straw(s, d):
    p = fix.table(s, d, "lineitem").select((F.col("l_linenumber") % 3).cast("int").alias("dim"), (F.col("l_partkey") * 31 % 9973 / 9973.0).alias("p"))
    return la.score_jack_straw(p, 0.01).select("dim", "n_hits", "score")


@query("SELECT feature, count(*) AS cells, round(sum(v), 6) AS total FROM (SELECT f.feature, coalesce(value, 0) AS v FROM features f CROSS JOIN cells c LEFT JOIN expr e ON e.feature = f.feature AND e.cell = c.cell) GROUP BY 1", "features", "cells", "expr")
def dense_rows(s, d):
    dense = mx.to_dense(fix.counts(s, d))
    return dense.select("feature", F.size("vec").alias("cells"), F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT name, min_by(feature, ord) AS feature FROM (SELECT 'G-' || id AS name, upper(regexp_replace(feature, '[^A-Za-z0-9]', '', 'g')) AS k, feature, ord FROM features, (SELECT unnest(range(7, 40)) AS id) WHERE upper(regexp_replace(feature, '[^A-Za-z0-9]', '', 'g')) = 'G' || id) GROUP BY 1", "features")
def resolve_symbols(s, d):
    return sc.resolve_symbols(fix.features(s), s.range(7, 40).select(F.concat(F.lit("G-"), F.col("id").cast("string")).alias("name")))


@query("SELECT cell, g80, g81, ident FROM (SELECT c.cell, ident, round(coalesce(sum(value) FILTER (feature = 'g80'), 0), 6) AS g80, round(coalesce(sum(value) FILTER (feature = 'g81'), 0), 6) AS g81 FROM cells c LEFT JOIN data USING (cell) GROUP BY 1, 2)", "cells", "data")
def feature_scatter(s, d):
    return pl.feature_scatter(fix.data(s, d), "g80", "g81", "ident")


@query()
def viz_dim_loadings(s, d):
    out = la.run_pca(fix.data(s, d), SOME, 3)["loadings"]
    return la.top_loadings(out, 5).select("dim", "feature", F.round("loading", 4).alias("loading"))


@query()
def variable_feature_plot(s, d):
    m = fix.counts(s, d)
    moments = vf.vst_moments(m)
    stats = vf.standardized_variance(m, moments, vf.expected_variance(moments))
    return pl.variable_feature_plot(stats, vf.top_features(stats, "standardized", 20))


@query()
def elbow(s, d):
    return pl.elbow(s, la.run_pca(fix.data(s, d), SOME, 10)["stdev"])


@query()
def dim_heatmap(s, d):
    m = fix.data(s, d)
    pca = la.run_pca(m, SOME, 3)
    return pl.dim_heatmap(nz.scale_data(m, SOME), pca["cells"], pca["loadings"], 0, 5, 50)


@query()
def integration_anchors_cca(s, d):
    return wf.find_integration_anchors(*_parts(s, d), SOME, "cca", 8, 5, 50, 10)


@query()
def integration_anchors_rpca(s, d):
    return wf.find_integration_anchors(*_parts(s, d), SOME, "rpca", 8, 5, None, 10)


@query()
def integrate_layers(s, d):
    m = fix.data(s, d)
    out = wf.integrate_layers(m, la.run_pca(m, SOME, 6)["cells"], "batch", SOME, "rpca", 6, 20)
    return _two(out)


@query()
def map_query(s, d):
    a, b = _parts(s, d)
    return wf.map_query(a, b, SOME, a.cells.select("cell", F.col("ident").alias("class")), dims=8, k_weight=20)


@query()
def project_data(s, d):
    m = fix.data(s, d)
    sketch = wf.sketch_data(m, SOME, 500, "uniform")
    return wf.project_data(m, sketch, SOME, m.cells.select("cell", F.col("ident").alias("class")), 6, 10)


@query()
def sctransform(s, d):
    return md.sctransform(fix.counts(s, d))["variances"].select("feature", F.round("residual_variance", 4).alias("residual_variance"))


@query()
def discriminants(s, d):
    m = fix.data(s, d)
    e = la.run_pca(m, SOME, 4)["cells"].select("cell", "vec")
    return _two(md.discriminants(e, m.cells.select("cell", F.col("ident").alias("label")), 4))


@query()
def mixscape(s, d):
    m = fix.data(s, d)
    cells = m.cells.select("cell", F.when(F.col("ident") == "BUILDING", "NT").otherwise(F.col("ident")).alias("target"))
    targets = [r[0] for r in cells.select("target").distinct().filter("target <> 'NT'").collect()]
    de = s.createDataFrame([(t, f) for t in sorted(targets) for f in SOME], "target string, feature string")
    return md.mixscape(m.expr, cells, "NT", de).select("cell", "target", "call")


@query()
def fuzzy_graph(s, d):
    return md.fuzzy_graph(nb.knn(fix.embedding(s, d), 10))


@query()
def jack_straw(s, d):
    return la.jack_straw(fix.data(s, d), SOME, 3)


@query()
def ica(s, d):
    e = la.run_pca(fix.data(s, d), SOME, 4)["cells"]
    return _two(la.run_ica(e, 3))


@query()
def spca(s, d):
    m = fix.data(s, d)
    graph = nb.knn_graph(nb.knn(la.run_pca(m, SOME, 4)["cells"], 5))
    return _two(la.run_spca(m, graph, SOME, 3)["loadings"], "feature")


@query()
def clara(s, d):
    from ..operators import demux as dm

    return dm.clara(fix.embedding(s, d).select("cell", "vec"), 4)


@query()
def find_clusters_leiden(s, d):
    e = fix.embedding(s, d)
    return cl.find_clusters(nb.snn_graph(nb.knn(e, 10), 10), e, [0.8], algorithm=4)


@query()
def run_tsne(s, d):
    return _two(md.run_tsne(fix.embedding(s, d)))


@query()
def run_umap(s, d):
    e = fix.embedding(s, d)
    return _two(md.run_umap(e, md.fuzzy_graph(nb.knn(e, 10)), rounds=100))


@query()
def glm_pca(s, d):
    return _two(md.glm_pca(fix.counts(s, d), SOME, 2, rounds=20)[0])


@query()
def top_dim_features(s, d):
    names = la.top_dim_features(la.run_pca(fix.data(s, d), SOME, 5)["loadings"], 20, 40)
    return s.createDataFrame([(f,) for f in names], "feature string")
