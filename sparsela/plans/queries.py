"""Every registered query of the engine, with SQL for the same rows where SQL can
express them. Queries run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
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
from ..operators import variable as vf
from ..streaming import running as st
from . import fixture as fix
from .fixture import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
GROUP = ["BUILDING"]


def query(statement: str | None = None, *needs: str, digits: int = 6):
    """Registers a function under its name; doubles are rounded to so many places."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            kinds = dict(df.dtypes)
            return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`").cast("long").alias(c) if kinds[c] == "int" else F.col(f"`{c}`") for c in df.columns])

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if statement:
            ORACLE_SQL[f.__name__] = sql(statement, *needs)
        return f

    return wrap


# -- construction and selection --------------------------------------------


@query("SELECT p_type AS name, p_partkey AS ord, CASE WHEN k = 0 THEN p_type ELSE p_type || '.' || k END AS \"unique\" FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS k FROM part)")
def make_unique(s, d):
    return mx.make_unique(fix.table(s, d, "part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("ord")))


@query("SELECT c.cell, coalesce(sum(value), 0.0) AS n_count, count(value) AS n_feature FROM cells c LEFT JOIN expr USING (cell) GROUP BY 1", "cells", "expr")
def calc_n(s, d):
    return mx.calc_n(fix.counts(s, d))


@query(
    """, f AS (SELECT feature FROM expr GROUP BY 1 HAVING count(*) >= 400), e AS (SELECT * FROM expr SEMI JOIN f USING (feature)),
    c AS (SELECT cell FROM e GROUP BY 1 HAVING count(*) >= 10) SELECT cell, feature, value FROM e SEMI JOIN c USING (cell)""", "expr",
)
def create_assay(s, d):
    return mx.create_assay(fix.counts(s, d), 400, 10).expr.select("cell", "feature", "value")


@query("SELECT c.cell, coalesce(round(100 * sum(CASE WHEN feature LIKE 'MT-%' THEN value ELSE 0 END) / sum(value), 6), 0) AS percent FROM cells c LEFT JOIN expr USING (cell) GROUP BY 1", "cells", "expr")
def percentage_feature_set(s, d):
    return mx.percentage_feature_set(fix.counts(s, d), "^MT-")


@query("SELECT feature, e.cell, value FROM expr e JOIN cells USING (cell) WHERE ident = 'BUILDING' AND feature IN ('g10', 'g11', 'MT-3')", "cells", "expr")
def subset(s, d):
    m = fix.counts(s, d)
    chosen = s.createDataFrame([("g10",), ("g11",), ("MT-3",)], "feature string")
    return mx.subset(m, mx.which_cells(m.cells, GROUP), chosen).expr.select("feature", "cell", "value")


@query("SELECT cell, ident, batch FROM cells WHERE depth > 1000 AND ident IN ('BUILDING', 'MACHINERY')", "cells")
def metadata_filter(s, d):
    return fix.cells(s, d).filter("depth > 1000").filter(F.col("ident").isin("BUILDING", "MACHINERY")).select("cell", "ident", "batch")


@query(
    "SELECT c.cell, ident, coalesce(sum(value) FILTER (feature = 'g10'), 0.0) AS g10, coalesce(sum(value) FILTER (feature = 'MT-1'), 0.0) AS \"MT-1\" FROM cells c LEFT JOIN expr USING (cell) GROUP BY 1, 2", "cells", "expr",
)
def fetch_data(s, d):
    return mx.fetch_data(fix.counts(s, d), ["g10", "MT-1"], ["ident"])


@query("SELECT cell, ident, batch, depth * 2 AS depth FROM cells WHERE false UNION ALL SELECT cell, ident, batch, round(depth * 2, 6) + 0.0 FROM cells", "cells")
def add_metadata(s, d):
    c = fix.cells(s, d)
    return mx.add_metadata(c, c.select("cell", (F.col("depth") * 2).alias("depth"))).select("cell", "ident", "batch", "depth")


@query("SELECT cell, CASE ident WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE ident END AS ident FROM cells", "cells")
def rename_idents(s, d):
    return mx.rename_idents(fix.cells(s, d), {"BUILDING": "B", "MACHINERY": "M"}).select("cell", "ident")


@query("SELECT ident AS level, row_number() OVER (ORDER BY try_cast(ident AS INTEGER) NULLS LAST, ident) - 1 AS ord FROM (SELECT DISTINCT c_nationkey::VARCHAR AS ident FROM customer)")
def ident_levels(s, d):
    return mx.levels(fix.table(s, d, "customer").select(F.col("c_nationkey").cast("string").alias("ident")))


@query("SELECT 'x' || c_custkey AS cell, c_mktsegment AS ident FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'c' || c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 1")
def rename_cells(s, d):
    c = fix.cells(s, d)
    names = c.filter("ord % 2 = 0").select("cell", F.concat(F.lit("x"), F.col("ord").cast("string")).alias("new"))
    return mx.rename_cells(c, names).select("cell", "ident")


@query("SELECT feature, coalesce(ord, -1) AS position FROM (SELECT 'g' || i AS feature FROM (SELECT unnest(range(100, 140)) AS i)) LEFT JOIN features USING (feature)", "features")
def match_positions(s, d):
    names = s.range(100, 140).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("feature"))
    return mx.match_positions(names, fix.features(s), "feature")


@query(
    """SELECT 'b_' || cell AS cell, feature, value FROM expr JOIN cells USING (cell) WHERE ident = 'BUILDING' AND feature NOT LIKE 'MT-%'
    UNION ALL SELECT 'm_' || cell, feature, value FROM expr JOIN cells USING (cell) WHERE ident = 'MACHINERY' AND feature NOT LIKE 'MT-%'""", "expr", "cells",
)
def merge(s, d):
    m = fix.counts(s, d)
    a = mx.subset(m, mx.which_cells(m.cells, GROUP))
    b = mx.subset(m, mx.which_cells(m.cells, ["MACHINERY"]), m.features.filter("feature not like 'MT-%'"))
    return mx.merge([(a, "b"), (b, "m")]).expr.select("cell", "feature", "value")


@query("SELECT 'counts.' || batch AS layer, 'counts' AS stem, feature, cell, value FROM expr JOIN cells USING (cell)", "expr", "cells")
def split_layers(s, d):
    return mx.split_layers(fix.counts(s, d), "batch")


@query("SELECT 'counts' AS layer, feature, cell, value FROM expr", "expr")
def join_layers(s, d):
    return mx.join_layers(mx.split_layers(fix.counts(s, d), "batch"))


@query("SELECT feature, cell, value FROM expr WHERE cell IN ('c1', 'c5', 'c9') AND feature IN ('g7', 'g8', 'MT-2')", "expr")
def columns_block(s, d):
    return mx.columns_block(fix.counts(s, d), ["c1", "c5", "c9"], ["g7", "g8", "MT-2"]).select("feature", "cell", "value")


@query("SELECT f.feature, coalesce(sum(value), 0.0) AS total, count(value) AS nnz, round(coalesce(sum(value), 0) / (SELECT n FROM n), 6) AS mean FROM features f LEFT JOIN expr USING (feature) GROUP BY 1", "features", "expr", "n")
def axis_sums(s, d):
    return mx.axis_sums(fix.counts(s, d), "feature")


@query("SELECT substr(feature, 4) AS feature, cell, value FROM expr WHERE feature LIKE 'MT-%'", "expr")
def strip_prefix(s, d):
    return mx.strip_prefix(fix.counts(s, d), "MT-").expr.select("feature", "cell", "value")


@query(
    "SELECT cell, variable AS feature, value FROM (SELECT 'p' || p_partkey AS cell, 'size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT 'p' || p_partkey, 'price', p_retailprice FROM part) WHERE value <> 0"
)
def wide_to_triplets(s, d):
    wide = fix.table(s, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("cell"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return mx.dense_to_triplets(wide, "cell", ["size", "price"])


# -- normalisation ----------------------------------------------------------


@query("SELECT feature, cell, round(value, 6) AS value FROM data", "data")
def log_normalize(s, d):
    return fix.data(s, d).expr


@query("SELECT feature, cell, round(value / total, 12) AS value FROM expr JOIN totals USING (cell)", "expr", "totals", digits=12)
def relative_counts(s, d):
    return nz.relative_counts(fix.counts(s, d)).expr


@query(", g AS (SELECT feature, exp(sum(ln(1 + value)) / (SELECT n FROM n)) AS m FROM expr GROUP BY 1) SELECT feature, cell, round(ln(1 + value / m), 6) AS value FROM expr JOIN g USING (feature)", "expr", "n")
def clr_by_feature(s, d):
    return nz.clr(fix.counts(s, d), 1).expr


@query(", g AS (SELECT cell, exp(sum(ln(1 + value)) / 120) AS m FROM expr GROUP BY 1) SELECT feature, cell, round(ln(1 + value / m), 6) AS value FROM expr JOIN g USING (cell)", "expr")
def clr_by_cell(s, d):
    return nz.clr(fix.counts(s, d), 2).expr


# -- aggregation -------------------------------------------------------------


@query("SELECT f.feature, ident || '_' || batch AS \"group\", coalesce(sum(value), 0.0) AS value FROM features f CROSS JOIN cells c LEFT JOIN expr e ON e.feature = f.feature AND e.cell = c.cell GROUP BY 1, 2", "features", "cells", "expr")
def aggregate_expression(s, d):
    return ag.aggregate_expression(fix.counts(s, d), ["ident", "batch"])


@query("SELECT f.feature, ident AS \"group\", round(sum(exp(coalesce(value, 0)) - 1) / count(*), 6) AS value FROM features f CROSS JOIN cells c LEFT JOIN data e ON e.feature = f.feature AND e.cell = c.cell GROUP BY 1, 2", "features", "cells", "data")
def average_expression(s, d):
    return ag.average_expression(fix.data(s, d), ["ident"])


@query(
    """, g AS (SELECT f.feature, ident || '_' || batch AS grp, coalesce(sum(value), 0.0) AS value FROM features f CROSS JOIN cells c LEFT JOIN expr e ON e.feature = f.feature AND e.cell = c.cell GROUP BY 1, 2)
    SELECT feature, grp AS "group", round(ln(1 + value / sum(value) OVER (PARTITION BY grp) * 10000), 6) AS value FROM g""", "features", "cells", "expr",
)
def aggregate_log_normalized(s, d):
    return ag.log_normalized_groups(ag.aggregate_expression(fix.counts(s, d), ["ident", "batch"]))


@query("SELECT ident AS \"group\", min_by(batch, ord) AS batch, min_by(depth, ord) AS depth FROM cells GROUP BY 1", "cells")
def group_metadata(s, d):
    return ag.group_metadata(fix.cells(s, d).withColumnRenamed("ident", "seg"), ["seg"]).select("group", "batch", "depth")


@query("SELECT f.feature, round(count(value) / (SELECT n FROM n), 6) AS pct FROM features f LEFT JOIN data USING (feature) GROUP BY 1", "features", "data", "n")
def percent_expressed(s, d):
    return ag.percent_expressed(fix.data(s, d))


@query("SELECT f.feature, round(exp(sum(ln(1 + coalesce(value, 0))) / (SELECT n FROM n)) - 1, 6) + 0.0 AS gmean FROM features f LEFT JOIN expr USING (feature) GROUP BY 1", "features", "expr", "n")
def geometric_means(s, d):
    return ag.geometric_means(fix.counts(s, d))


@query(
    """, t AS (SELECT ident AS "group", count(*) FILTER (batch = 'b0') AS n_1, count(*) FILTER (batch = 'b1') AS n_2 FROM cells WHERE batch IN ('b0', 'b1') GROUP BY 1)
    SELECT "group", n_1, n_2, round(n_1 / sum(n_1) OVER (), 6) AS prop_1, round(n_2 / sum(n_2) OVER (), 6) AS prop_2, round(log2((n_2 / sum(n_2) OVER ()) / (n_1 / sum(n_1) OVER ())), 6) + 0.0 AS log2_ratio FROM t""", "cells",
)
def composition(s, d):
    return ag.composition(fix.cells(s, d), "ident", "batch", "b0", "b1")


# -- variable features --------------------------------------------------------


@query("SELECT f.feature, round(coalesce(sum(value), 0) / (SELECT n FROM n), 6) AS mean, round((coalesce(sum(value * value), 0) / (SELECT n FROM n) - (coalesce(sum(value), 0) / (SELECT n FROM n)) ** 2) * (SELECT n / (n - 1) FROM n), 6) AS variance, count(value) AS nnz, ord FROM features f LEFT JOIN expr USING (feature) GROUP BY f.feature, ord", "features", "expr", "n")
def vst_moments(s, d):
    return vf.vst_moments(fix.counts(s, d)).select("feature", "mean", "variance", "nnz", "ord")


@query()
def find_variable_features(s, d):
    return vf.find_variable_features(fix.counts(s, d), 40)


_DISPERSION = """, m AS (SELECT f.feature, f.ord, sum(exp(coalesce(value, 0)) - 1) / count(*) AS mean, var_samp(exp(coalesce(value, 0)) - 1) AS variance FROM features f CROSS JOIN cells c LEFT JOIN data e ON e.feature = f.feature AND e.cell = c.cell GROUP BY 1, 2),
    r AS (SELECT feature, ord, ln(1 + mean) AS mean, ln(variance / mean) AS dispersion FROM m), b AS (SELECT *, least(19, greatest(0, CAST(ceil((mean - (SELECT min(mean) FROM r)) / ((SELECT max(mean) - min(mean) FROM r) / 20)) AS BIGINT) - 1)) AS bin FROM r)"""


@query(_DISPERSION + " SELECT feature, ord, round(mean, 6) AS mean, round(dispersion, 6) + 0.0 AS dispersion, bin, round(CASE WHEN count(*) OVER w > 1 THEN (dispersion - avg(dispersion) OVER w) / stddev_samp(dispersion) OVER w END, 6) + 0.0 AS scaled FROM b WINDOW w AS (PARTITION BY bin)", "features", "cells", "data")
def dispersions(s, d):
    return vf.dispersions(fix.data(s, d))


@query(_DISPERSION + " SELECT feature, row_number() OVER (ORDER BY round(dispersion, 9) DESC, ord) AS rank, round(dispersion, 6) + 0.0 AS dispersion FROM b QUALIFY rank <= 30", "features", "cells", "data")
def dispersion_features(s, d):
    return vf.dispersion_features(fix.data(s, d), "disp", 30)


# -- markers -------------------------------------------------------------------

_FC = "log2((e1 + 1) / n1) - log2((e2 + 1) / n2)"


@query(f"SELECT feature, round(pos1 / n1, 6) AS pct_1, round(pos2 / n2, 6) AS pct_2, round({_FC}, 6) + 0.0 AS \"avg_log2FC\" FROM sums WHERE (pos1 / n1 >= 0.1 OR pos2 / n2 >= 0.1) AND abs({_FC}) >= 0.05", "sums")
def fold_changes(s, d):
    m = fix.data(s, d)
    return mk.fold_changes(mk.group_sums(m, mk.two_groups(m, GROUP)), 0.1, 0.05).select("feature", "pct_1", "pct_2", "avg_log2FC")


_RANKS = """, g AS (SELECT f.feature, ident = 'BUILDING' AS one, coalesce(value, 0.0) AS value FROM features f CROSS JOIN cells c LEFT JOIN expr e ON e.feature = f.feature AND e.cell = c.cell),
    k AS (SELECT feature, one, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS r, count(*) OVER (PARTITION BY feature, value) AS t FROM g),
    u AS (SELECT feature, count(*) FILTER (one)::DOUBLE AS n1, count(*) FILTER (NOT one)::DOUBLE AS n2, sum(r) FILTER (one) AS r1, sum(t::DOUBLE * t - 1) AS ties FROM k GROUP BY 1),
    v AS (SELECT feature, n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))) AS var FROM u)"""


@query(_RANKS + " SELECT feature, round(u, 6) AS u, round((abs(u - n1 * n2 / 2) - 0.5) / sqrt(var), 6) + 0.0 AS z FROM v", "features", "cells", "expr")
def wilcoxon(s, d):
    m = fix.counts(s, d)
    groups = mk.two_groups(m, GROUP)
    return mk.wilcoxon(m, groups, mk.group_sums(m, groups))


@query(_RANKS + " SELECT feature, round(u / (n1 * n2), 6) AS auc, round(abs(2 * u / (n1 * n2) - 1), 6) AS power FROM v", "features", "cells", "expr")
def roc(s, d):
    m = fix.counts(s, d)
    return mk.find_markers(m, GROUP, test="roc", min_pct=0.0, threshold=0.0).select("feature", "auc", "power")


@query("SELECT feature, round((s1 / n1 - s2 / n2) / sqrt((q1 - s1 * s1 / n1) / (n1 - 1) / n1 + (q2 - s2 * s2 / n2) / (n2 - 1) / n2), 6) + 0.0 AS t FROM sums", "sums")
def welch(s, d):
    m = fix.data(s, d)
    return mk.welch(mk.group_sums(m, mk.two_groups(m, GROUP))).select("feature", "t")


_LIK = "({n} - {p}) * ln(1 - greatest(1e-5, least(1 - 1e-5, {p} / {n}))) + {p} * ln(greatest(1e-5, least(1 - 1e-5, {p} / {n}))) - {p} / 2.0 * ln(2 * pi() * (({q} - {s} * {s} / {p}) / ({p} - 1))) - ({p} - 1) / 2.0"


@query(
    "SELECT feature, round(greatest(0, 2 * (" + _LIK.format(n="n1", p="pos1", q="q1", s="s1") + " + " + _LIK.format(n="n2", p="pos2", q="q2", s="s2") + " - (" + _LIK.format(n="(n1 + n2)", p="(pos1 + pos2)", q="(q1 + q2)", s="(s1 + s2)") + "))), 5) + 0.0 AS lrt FROM sums", "sums",
)
def bimodal(s, d):
    m = fix.data(s, d)
    return mk.bimodal(mk.group_sums(m, mk.two_groups(m, GROUP))).select("feature", F.round("lrt", 5).alias("lrt"))


def _markers(test):
    def run(s, d):
        return mk.find_markers(fix.data(s, d), GROUP, test=test, min_pct=0.0, threshold=0.0, counts=fix.counts(s, d) if test == "negbinom" else None)

    run.__name__ = f"find_markers_{test}"
    return query()(run)


for _t in ("LR", "negbinom"):
    _markers(_t)


@query()
def pseudobulk_test(s, d):
    groups = ag.aggregate_expression(fix.counts(s, d), ["ident", "batch"])
    names = [r[0] for r in groups.select("group").distinct().collect()]
    return mk.pseudobulk_test(groups, {g: "x" if g.startswith(("BUILDING", "MACHINERY")) else "y" for g in names}, "x")


@query(
    """, g AS (SELECT f.feature, ident || '_' || batch AS grp, coalesce(sum(value), 0.0) AS value FROM features f CROSS JOIN cells c LEFT JOIN expr e ON e.feature = f.feature AND e.cell = c.cell GROUP BY 1, 2),
    l AS (SELECT grp, ln(value) - avg(ln(value)) OVER (PARTITION BY feature) AS r FROM g WHERE feature IN (SELECT feature FROM g GROUP BY 1 HAVING min(value) > 0))
    SELECT grp AS "group", round(exp(quantile_cont(r, 0.5)), 6) AS size_factor FROM l GROUP BY 1""", "features", "cells", "expr",
)
def size_factors(s, d):
    return mk.pseudobulk_size_factors(ag.aggregate_expression(fix.counts(s, d), ["ident", "batch"]))


@query(
    """, t AS (SELECT p_partkey AS k, (p_size * 37 % 101) / 1000.0 AS p FROM part), r AS (SELECT k, p, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM t)
    SELECT k, round(p, 6) AS p, round(least(1, min(raw) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS padj FROM r""".replace(", t AS", "WITH t AS", 1)
)
def benjamini_hochberg(s, d):
    rows = fix.table(s, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 37 % 101 / 1000.0).alias("p"))
    return fx.benjamini_hochberg(rows)


# -- neighbours, graphs, clusters -----------------------------------------------


@query("SELECT cell, rank, nbr, round(dist, 6) AS dist FROM knn10", "emb", "knn10")
def knn(s, d):
    return nb.knn(fix.embedding(s, d), 10)


@query("SELECT src, dst, round(weight, 6) AS weight FROM snn", "snn")
def snn_graph(s, d):
    return nb.snn_graph(nb.knn(fix.embedding(s, d), 10), 10)


def _halves(s, d):
    e = fix.embedding(s, d)
    return e.filter("ord % 2 = 0"), e.filter("ord % 2 = 1")


_AB = """, x AS (SELECT a.cell AS c1, b.cell AS c2, a.ord AS o1, b.ord AS o2, list_distance(a.vec, b.vec) AS dist FROM emb a CROSS JOIN emb b WHERE a.ord % 2 = 0 AND b.ord % 2 = 1),
    y AS (SELECT *, row_number() OVER (PARTITION BY c1 ORDER BY round(dist, 12), o2) AS r1, row_number() OVER (PARTITION BY c2 ORDER BY round(dist, 12), o1) AS r2 FROM x)"""


@query(_AB + " SELECT c1 AS cell1, c2 AS cell2 FROM y WHERE r1 <= 5 AND r2 <= 5", "emb")
def mutual_neighbors(s, d):
    a, b = _halves(s, d)
    return nb.mutual_neighbors(nb.knn(b, 5, query=a), nb.knn(a, 5, query=b))


_ANCHORS = _AB + """, p AS (SELECT c1, c2 FROM y WHERE r1 <= 5 AND r2 <= 5),
    w AS (SELECT a.cell AS cell, b.cell AS nbr, row_number() OVER (PARTITION BY a.cell ORDER BY round(list_distance(a.vec, b.vec), 12), b.ord) AS r FROM emb a JOIN emb b ON a.ord % 2 = b.ord % 2),
    h1 AS (SELECT cell AS c1, nbr FROM w WHERE r BETWEEN 2 AND 16 UNION ALL SELECT c1, c2 FROM y WHERE r1 <= 15), h2 AS (SELECT cell AS c2, nbr FROM w WHERE r BETWEEN 2 AND 16 UNION ALL SELECT c2, c1 FROM y WHERE r2 <= 15),
    raw AS (SELECT p.c1, p.c2, count(h2.nbr) AS raw FROM p JOIN h1 ON h1.c1 = p.c1 LEFT JOIN h2 ON h2.c2 = p.c2 AND h2.nbr = h1.nbr GROUP BY 1, 2),
    q AS (SELECT quantile_cont(raw::DOUBLE, 0.01) AS lo, quantile_cont(raw::DOUBLE, 0.9) AS hi FROM raw),
    anchors AS (SELECT c1, c2, CASE WHEN hi <= lo THEN 1.0 ELSE greatest(0, least(1, (raw - lo) / (hi - lo))) END AS score FROM raw, q)"""


@query(_ANCHORS + " SELECT c1 AS cell1, c2 AS cell2, round(score, 6) AS score FROM anchors", "emb")
def find_anchors(s, d):
    a, b = _halves(s, d)
    return mp.find_anchors(a, b, 5, 15)


_WEIGHTS = _ANCHORS + """, u AS (SELECT DISTINCT c2 FROM anchors),
    z AS (SELECT q.cell, t.cell AS nbr, list_distance(q.vec, t.vec) AS dist, row_number() OVER (PARTITION BY q.cell ORDER BY round(list_distance(q.vec, t.vec), 12), t.ord) AS r FROM emb q CROSS JOIN emb t WHERE q.ord % 2 = 1 AND t.cell IN (SELECT c2 FROM u)),
    z1 AS (SELECT *, max(dist) OVER (PARTITION BY cell) AS far FROM z WHERE r <= 20),
    z2 AS (SELECT cell, c1, nbr AS c2, 1 - exp(-(1 - dist / far) * score / 4) AS w FROM (SELECT z1.*, a.c1, a.score, row_number() OVER (PARTITION BY cell ORDER BY r, c1) AS k FROM z1 JOIN anchors a ON a.c2 = z1.nbr) WHERE k <= 20),
    weights AS (SELECT cell, c1, c2, w / CASE WHEN sum(w) OVER (PARTITION BY cell) = 0 THEN 1 ELSE sum(w) OVER (PARTITION BY cell) END AS weight FROM z2)"""


def _anchor_parts(s, d):
    a, b = _halves(s, d)
    anchors = mp.find_anchors(a, b, 5, 15)
    return a, b, anchors, mp.anchor_weights(anchors, b, 20)


@query(_WEIGHTS + " SELECT cell, c1 AS cell1, c2 AS cell2, round(weight, 6) AS weight FROM weights", "emb")
def anchor_weights(s, d):
    return _anchor_parts(s, d)[3]


@query(_WEIGHTS + ", v AS (SELECT weights.cell, emb.label AS class, sum(weight) AS score FROM weights JOIN emb ON emb.cell = c1 GROUP BY 1, 2) SELECT cell, class, round(score, 6) AS score FROM v QUALIFY row_number() OVER (PARTITION BY cell ORDER BY score DESC, class) = 1", "emb")
def transfer_labels(s, d):
    a, _, _, weights = _anchor_parts(s, d)
    return mp.transfer_labels(weights, a.select("cell", F.col("label").alias("class")))


@query()
def find_clusters(s, d):
    e = fix.embedding(s, d)
    snn = nb.snn_graph(nb.knn(e, 10), 10)
    return cl.find_clusters(snn, e, [0.5, 1.0])


@query(
    """, l AS (SELECT cell, ord, CASE WHEN ord % 7 = 0 THEN 100 + ord ELSE ord % 5 END AS cluster FROM emb), z AS (SELECT cluster, count(*) AS n FROM l GROUP BY 1),
    p AS (SELECT a.cell, b.cluster, round(sum(weight) / max(z.n), 12) AS w FROM snn JOIN l a ON a.cell = src JOIN z za ON za.cluster = a.cluster AND za.n = 1 JOIN l b ON b.cell = dst JOIN z ON z.cluster = b.cluster AND z.n > 1 WHERE src <> dst GROUP BY 1, 2),
    t AS (SELECT cell, cluster AS "to" FROM p QUALIFY row_number() OVER (PARTITION BY cell ORDER BY w DESC, cluster) = 1) SELECT l.cell, coalesce("to", cluster) AS cluster FROM l LEFT JOIN t USING (cell)""", "snn",
)
def group_singletons(s, d):
    e = fix.embedding(s, d)
    labels = e.select("cell", F.when(F.col("ord") % 7 == 0, 100 + F.col("ord")).otherwise(F.col("ord") % 5).alias("cluster"))
    return cl.group_singletons(labels, nb.snn_graph(nb.knn(e, 10), 10))


@query(", l AS (SELECT cell, ord, label FROM emb), z AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, min(ord)) - 1 AS cluster FROM l GROUP BY 1) SELECT cell, cluster FROM l JOIN z USING (label)", "emb")
def renumber_by_size(s, d):
    e = fix.embedding(s, d)
    return cl.renumber_by_size(e.select("cell", F.col("label").alias("cluster")), e)


@query(" SELECT DISTINCT * FROM (SELECT cell AS src, nbr AS dst FROM knn10 UNION ALL SELECT nbr, cell FROM knn10 UNION ALL SELECT cell, cell FROM knn10 UNION ALL SELECT nbr, nbr FROM knn10)", "knn10")
def symmetric_union(s, d):
    return nb.symmetric_union(nb.knn_graph(nb.knn(fix.embedding(s, d), 10)))


@query()
def multimodal_neighbors(s, d):
    e = fix.embedding(s, d)
    one, two = (e.withColumn("vec", F.slice("vec", a, 32)) for a in (1, 33))
    return nb.multimodal_neighbors(one, two, 10, 30)["weights"]


@query("SELECT cell, round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) AS norm, round(vec[1] / sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) + 0.0 AS first FROM emb", "emb")
def l2_normalise(s, d):
    return fix.embedding(s, d).select("cell", fx.norm(F.col("vec")).alias("norm"), F.element_at(fx.l2_normalise(F.col("vec")), 1).alias("first"))


# -- reductions ------------------------------------------------------------------


@query()
def pca(s, d):
    out = la.run_pca(fix.data(s, d), n_pcs=5)["cells"]
    return out.select("cell", *[F.round(F.element_at("vec", k + 1), 4).alias(f"pc_{k + 1}") for k in range(2)])


@query()
def leverage_scores(s, d):
    return la.leverage_scores(fix.data(s, d))


@query()
def sketch_data(s, d):
    scores = la.leverage_scores(fix.data(s, d))
    return la.weighted_sample(scores, 100)


@query()
def cca(s, d):
    m = fix.data(s, d)
    parts = [mx.subset(m, m.cells.filter(x)) for x in ("batch = 'b0'", "batch <> 'b0'")]
    out = la.cca(*parts, la.feature_list(m), 5)
    return out.select("dataset", "cell", *[F.round(F.abs(F.element_at("vec", k)), 4).alias(f"v{k}") for k in (1, 2)])


@query()
def harmony(s, d):
    e = fix.embedding(s, d)
    out = la.run_harmony(e, e.select("cell", F.concat(F.lit("b"), (F.col("ord") % 2).cast("string")).alias("batch")))
    return out.select("cell", *[F.round(F.element_at("vec", k), 4).alias(f"v{k}") for k in (1, 2)])


# -- spatial -----------------------------------------------------------------------


@query("SELECT image, round(0.01 * ((max(x) - min(x)) + (max(y) - min(y))) / 2, 6) AS radius FROM centroids GROUP BY 1", "centroids")
def auto_radius(s, d):
    return sp.auto_radius(fix.centroids(s, d))


@query("SELECT * FROM rings WHERE cell IN (SELECT cell FROM rings WHERE x BETWEEN 10 AND 12 AND y BETWEEN 5 AND 9)", "rings")
def crop(s, d):
    return sp.crop(fix.rings(s, d), (10, 12), (5, 9))


@query("SELECT r.image, r.cell, vertex, x, y FROM rings r WHERE cell IN (SELECT cell FROM rings, (SELECT min(x) a, max(x) b, min(y) c, max(y) d FROM rings WHERE cell IN ('o1', 'o2')) WHERE x BETWEEN a AND b AND y BETWEEN c AND d)", "rings")
def overlay(s, d):
    r = fix.rings(s, d)
    return sp.overlay(r, r.filter(F.col("cell").isin("o1", "o2")))


_ONE = "SELECT image, cell, vertex, min(x) AS x, min(y) AS y FROM rings GROUP BY ALL"


@query(f", o AS ({_ONE}), e AS (SELECT image, cell, min_by(x, vertex) AS ax, min_by(y, vertex) AS ay, max_by(x, vertex) AS zx, max_by(y, vertex) AS zy, max(vertex) AS last, count(*) AS n FROM o GROUP BY ALL) SELECT * FROM o UNION ALL SELECT image, cell, last + 1, ax, ay FROM e WHERE n > 2 AND (ax <> zx OR ay <> zy)", "rings")
def close_rings(s, d):
    r = fix.rings(s, d).groupBy("image", "cell", "vertex").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return sp.close_rings(r)


@query(f", o AS ({_ONE}), w AS (SELECT *, sqrt((x - lag(x) OVER v) ** 2 + (y - lag(y) OVER v) ** 2) AS s, count(*) OVER (PARTITION BY cell) AS n, lead(x) OVER v IS NULL AS z FROM o WINDOW v AS (PARTITION BY cell ORDER BY vertex)) SELECT image, cell, vertex, x, y FROM w WHERE n <= 3 OR s IS NULL OR z OR s > 12", "rings")
def simplify(s, d):
    r = fix.rings(s, d).groupBy("image", "cell", "vertex").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return sp.simplify(r, 12)


@query("SELECT image, cell, round(x * 0.17, 6) AS x, round(y * 0.17, 6) AS y, ord FROM centroids", "centroids")
def scale_coordinates(s, d):
    return sp.scale_coordinates(fix.centroids(s, d), 0.17).select("image", "cell", "x", "y", "ord")


@query("SELECT cell, rank, nbr, round(dist, 6) AS dist FROM space6", "space6")
def spatial_knn(s, d):
    return sp.spatial_knn(fix.centroids(s, d), 6)


@query(", c AS (SELECT s.cell, l.ident AS category, count(*) AS n FROM space6 s JOIN cells l ON l.cell = s.nbr GROUP BY 1, 2) SELECT g.cell, g.category, coalesce(n, 0) AS n, round(coalesce(n, 0) / 6.0, 6) AS proportion FROM (SELECT a.cell, b.category FROM cells a, (SELECT DISTINCT ident AS category FROM cells) b) g LEFT JOIN c USING (cell, category)", "space6", "cells")
def local_neighborhood(s, d):
    return sp.local_neighborhood(fix.centroids(s, d), fix.cells(s, d).select("cell", F.col("ident").alias("category")), 6)


@query("SELECT a.cell, round(min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS dist FROM centroids a JOIN cells ca USING (cell), centroids b JOIN cells cb USING (cell) WHERE ca.ident = 'BUILDING' AND cb.ident = 'MACHINERY' GROUP BY 1".replace("a JOIN cells ca USING (cell), centroids b JOIN cells cb USING (cell)", "a JOIN cells ca ON ca.cell = a.cell CROSS JOIN (SELECT c2.*, k.ident FROM centroids c2 JOIN cells k USING (cell)) b").replace("cb.ident", "b.ident"), "centroids", "cells")
def nearest_distance(s, d):
    return sp.nearest_distance(fix.centroids(s, d), fix.cells(s, d).select("cell", F.col("ident").alias("category")), "BUILDING", "MACHINERY")


_MORAN = """, v AS (SELECT f.feature, c.cell, coalesce(value, 0) AS value FROM (SELECT * FROM features WHERE ord BETWEEN 50 AND 59) f CROSS JOIN cells c LEFT JOIN data e ON e.feature = f.feature AND e.cell = c.cell),
    z AS (SELECT feature, cell, value - avg(value) OVER (PARTITION BY feature) AS z FROM v), d AS (SELECT feature, sum(z * z) AS den FROM z GROUP BY 1),
    k AS (SELECT a.feature, sum(a.z * b.z) / 6.0 AS num FROM space6 s JOIN z a ON a.cell = s.cell JOIN z b ON b.cell = s.nbr AND b.feature = a.feature GROUP BY 1)"""


@query("SELECT a.cell AS src, b.cell AS dst, round(1 - ((sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) - 4.0) / 1.0) ** 2, 6) AS weight FROM centroids a, centroids b WHERE a.cell <> b.cell AND abs(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) - 4.0) < 1.0", "centroids")
def band_pairs(s, d):
    return sp.band_pairs(fix.centroids(s, d), 4.0, 1.0)


@query()
def niches(s, d):
    near = sp.local_neighborhood(fix.centroids(s, d), fix.cells(s, d).select("cell", F.col("ident").alias("category")), 6)
    return sp.niches(near, 4)


# -- scores, tags, perturbations ------------------------------------------------------

_PROGRAMS = {"S": [f"g{k}" for k in range(10, 20)], "G2M": [f"g{k}" for k in range(30, 42)]}


@query("SELECT program, c.cell, round(coalesce(sum(value), 0) / max(k), 6) AS mean FROM cells c CROSS JOIN (SELECT 'A' AS program, 3 AS k UNION ALL SELECT 'B', 2) p LEFT JOIN (SELECT 'A' AS pr, * FROM data WHERE feature = 'g12' UNION ALL SELECT 'A', * FROM data WHERE feature = 'g12' UNION ALL SELECT 'A', * FROM data WHERE feature = 'g13' UNION ALL SELECT 'B', * FROM data WHERE feature IN ('g40', 'g41')) e ON e.pr = program AND e.cell = c.cell GROUP BY 1, 2", "cells", "data")
def program_means(s, d):
    rows = [("A", "g12"), ("A", "g12"), ("A", "g13"), ("B", "g40"), ("B", "g41")]
    return sc.program_means(fix.data(s, d), s.createDataFrame(rows, "program string, feature string"))


@query(
    """, m AS (SELECT f.feature, ord, coalesce(sum(value), 0) / (SELECT n FROM n) AS mean FROM features f LEFT JOIN expr USING (feature) GROUP BY 1, 2), e AS (SELECT unnest(list_distinct([""" + ", ".join(f"quantile_cont(mean, {k / 8})" for k in range(1, 8)) + """])) AS e FROM m)
    SELECT feature, ord, round(mean, 6) AS mean, (SELECT count(*) FROM e WHERE e.e < m.mean) AS bin FROM m""", "features", "expr", "n",
)
def expression_bins(s, d):
    return sc.expression_bins(fix.counts(s, d), 8)


def _tags(s, d):
    """Six tags per customer: the counts of the MT features."""
    m = fix.counts(s, d)
    return mx.subset(m, features=m.features.filter("feature like 'MT-%'"))


@query(
    """, t AS (SELECT f.feature, ord, c.cell, coalesce(value, 0.0) AS value FROM (SELECT * FROM features WHERE feature LIKE 'MT-%') f CROSS JOIN (SELECT cell FROM cells) c LEFT JOIN expr e ON e.feature = f.feature AND e.cell = c.cell),
    r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value DESC, ord) AS k FROM t), p AS (SELECT cell, count(*) AS n FROM t WHERE value > 60 GROUP BY 1)
    SELECT a.cell, coalesce(n, 0) AS n_positive, CASE coalesce(n, 0) WHEN 0 THEN 'Negative' WHEN 1 THEN 'Singlet' ELSE 'Doublet' END AS call, a.feature AS max_tag, b.feature AS second_tag, a.value - b.value AS margin,
    CASE coalesce(n, 0) WHEN 0 THEN 'Negative' WHEN 1 THEN a.feature ELSE least(a.feature, b.feature) || '_' || greatest(a.feature, b.feature) END AS classification, CASE coalesce(n, 0) WHEN 0 THEN 'Negative' WHEN 1 THEN a.feature ELSE 'Doublet' END AS hash_id
    FROM r a JOIN r b ON a.cell = b.cell AND a.k = 1 AND b.k = 2 LEFT JOIN p ON p.cell = a.cell""", "features", "cells", "expr",
)
def call_cells(s, d):
    m = _tags(s, d)
    values = dm.dense_values(m)
    return dm.call_cells(values, values.filter("value > 60").select("cell", "feature"), m.features)


@query()
def hto_demux(s, d):
    return dm.hto_demux(_tags(s, d))[0]


@query(
    """, v AS (SELECT ident AS "group", depth AS value FROM cells), st AS (SELECT "group", count(*) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) * count(*) ** -0.2 AS bw FROM v GROUP BY 1),
    g AS (SELECT st.*, i, lo + (hi - lo) * i / 19 AS x FROM st, (SELECT unnest(range(20)) AS i)) SELECT g."group", i, round(any_value(x), 6) AS x, round(sum(exp(-0.5 * ((x - value) / bw) ** 2)) / any_value(n * bw * sqrt(2 * pi())), 6) + 0.0 AS density FROM g JOIN v ON v."group" = g."group" GROUP BY 1, 2""", "cells",
)
def density(s, d):
    return dm.density(fix.cells(s, d).select(F.col("ident").alias("group"), F.col("depth").alias("value")), "group", "value", 20)


# -- plots ---------------------------------------------------------------------------


@query("SELECT ident AS \"group\", round(quantile_cont(coalesce(value, 0), 0.5), 6) AS median FROM cells c LEFT JOIN (SELECT * FROM data WHERE feature = 'g15') e USING (cell) GROUP BY 1", "cells", "data")
def violin_medians(s, d):
    return pl.violin(fix.data(s, d), "g15", "ident")[1]


@query(", l AS (SELECT cell, label AS \"group\", vec[1] AS x, vec[2] AS y FROM emb) SELECT \"group\", round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y FROM l GROUP BY 1", "emb")
def dim_plot_centres(s, d):
    e = fix.embedding(s, d)
    return pl.dim_plot(e.select("cell", "label"), e.select("cell", "vec"), "label")[1]


@query(
    """, v AS (SELECT c.cell, coalesce(value, 0) AS value, depth FROM cells c LEFT JOIN (SELECT * FROM data WHERE feature = 'g15') e USING (cell)), q AS (SELECT quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM v)
    SELECT cell, round(value, 6) AS value, round(depth, 6) AS x, round(greatest(a, least(b, value)), 6) AS shown FROM v, q""", "cells", "data",
)
def feature_plot(s, d):
    m = fix.data(s, d)
    return pl.feature_plot(m, "g15", m.cells.select("cell", F.array("depth", "depth").alias("vec"))).select("cell", "value", "x", "shown")


@query("SELECT image, cell, round(x * 0.5, 6) AS x, round(y * 0.5, 6) AS y, depth AS value, round(3.0 * 0.5 * 1.6, 6) AS radius FROM centroids JOIN cells USING (cell)", "centroids", "cells")
def image_plot(s, d):
    return pl.image_plot(fix.centroids(s, d), fix.cells(s, d).select("cell", F.col("depth").alias("value")), 0.5, 3.0)


# -- streams ---------------------------------------------------------------------------


def _events(s, d):
    e = st.stream_table(s, f"{d}/events.parquet")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("cell"), F.col("event_type").alias("feature"), "value")


@query("SELECT 'u' || user_id AS cell, round(sum(value), 6) AS n_count, count(*) FILTER (value <> 0) AS n_records FROM events GROUP BY 1")
def stream_running_counts(s, d):
    return st.run(st.running_counts(_events(s, d)))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type AS feature, count(*) AS n, round(sum(value), 6) AS s, round(sum(value * value), 4) AS ss FROM events GROUP BY 1, 2")
def stream_windowed_moments(s, d):
    return st.run(st.windowed_moments(_events(s, d))).withColumn("ss", F.round("ss", 4))


@query("SELECT start, round(100 * sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) / sum(value), 6) AS percent FROM (SELECT unnest([time_bucket(INTERVAL '6 hours', ts) - k * INTERVAL '6 hours' FOR k IN range(4)]) AS start, event_type, value FROM events) GROUP BY 1")
def stream_sliding_percent(s, d):
    return st.run(st.sliding_percent(_events(s, d), "^click$"))


@query(
    """WITH a AS (SELECT 'u' || user_id AS cell, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    b AS (SELECT *, sum(new) OVER (PARTITION BY cell ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT cell, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n, round(sum(value), 6) AS total FROM b GROUP BY cell, k"""
)
def stream_sessions(s, d):
    return st.run(st.sessions(_events(s, d)))


@query("SELECT 'u' || user_id AS cell, CASE WHEN event_type < 'm' THEN 'low' ELSE 'high' END AS class, round(sum(value), 6) AS score FROM events GROUP BY 1, 2")
def stream_votes(s, d):
    names = fix.table(s, d, "events").select(F.col("event_type").alias("cell")).distinct()
    reference = names.select("cell", F.when(F.col("cell") < "m", "low").otherwise("high").alias("class"))
    return st.run(st.online_votes(_events(s, d).select("cell", F.col("feature").alias("nbr"), F.col("value").alias("weight")), reference))


# -- functions ------------------------------------------------------------------------


@query(
    """SELECT p_partkey AS k, round(CASE WHEN abs(u) < 1 THEN (1 - abs(u) ** 3) ** 3 ELSE 0 END, 6) AS tricube, round(CASE WHEN abs(u) < 1 THEN 0.75 * (1 - u * u) ELSE 0 END, 6) AS epanechnikov, round(exp(-u * u / 2), 6) AS gaussian,
    CASE WHEN p <= 0.001 THEN '***' WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' ELSE 'ns' END AS stars, CASE WHEN u <= 0 AND p - 0.05 <= 0 THEN 'G1' WHEN u > p - 0.05 THEN 'S' ELSE 'G2M' END AS phase, upper(regexp_replace(p_name, '[^\\p{L}\\p{N}]', '', 'g')) AS symbol
    FROM (SELECT *, (p_size - 25) / 20.0 AS u, (p_partkey % 100) / 1000.0 AS p FROM part)"""
)
def scalar_functions(s, d):
    rows = fix.table(s, d, "part").withColumn("u", (F.col("p_size") - 25) / 20.0).withColumn("p", F.col("p_partkey") % 100 / 1000.0)
    u, p = F.col("u"), F.col("p")
    return rows.select(
        F.col("p_partkey").alias("k"), fx.tricube(u).alias("tricube"), fx.epanechnikov(u).alias("epanechnikov"), fx.gaussian(u).alias("gaussian"),
        fx.stars(p).alias("stars"), fx.cell_cycle_phase(u, p - 0.05).alias("phase"), fx.bare_symbol(F.col("p_name")).alias("symbol"),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts to markers of every cluster."""
    return QUERIES["find_all_markers"](spark, sf_dir)

