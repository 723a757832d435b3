"""Queries of panels as tables of pairs: spanning trees, clusters and eigenpairs without a matrix in one task."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewater.functions.scalar import piecewise
from tidewater.operators import graphs, joins
from tidewater.operators.estimators import TW_POINTS
from tidewater.operators.spectrum import top_eigenpairs
from tidewater.plans.portfolio import log_returns
from tidewater.plans.views import sql

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def r(c, n: int = 6):
    return F.round(c, n) + F.lit(0.0)


def covariance_cells(spark, d):
    """a, b, cov of all pairs, both orders and the diagonal, over the times that all series have."""
    p = joins.aligned_long(log_returns(spark, d), "symbol", "ts_nanos", "r")
    left = p.select("ts_nanos", F.col("symbol").alias("a"), F.col("r").alias("x"))
    right = p.select("ts_nanos", F.col("symbol").alias("b"), F.col("r").alias("y"))
    return left.join(right, "ts_nanos").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("cov"))


CELLS = (
    sql("", "filled").rstrip().replace("WITH", "WITH RECURSIVE", 1)
    + """, rt AS (SELECT * FROM (SELECT symbol, ts_nanos, round(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts_nanos)), 9) AS r FROM filled) WHERE r IS NOT NULL),
al AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ts_nanos) AS have FROM rt) WHERE have = (SELECT count(DISTINCT symbol) FROM rt)),
cells AS MATERIALIZED (SELECT p.symbol AS a, q.symbol AS b, covar_samp(p.r, q.r) AS cov FROM al p JOIN al q USING (ts_nanos) GROUP BY 1, 2),
sd AS (SELECT a AS name, sqrt(cov) AS sd FROM cells WHERE a = b),
cr AS (SELECT c.a, c.b, cov / (x.sd * y.sd) AS rho FROM cells c JOIN sd x ON x.name = c.a JOIN sd y ON y.name = c.b),
e AS (SELECT a, b, sqrt(greatest(0, 2 * (1 - rho))) AS w, row_number() OVER (ORDER BY sqrt(greatest(0, 2 * (1 - rho))), a, b) AS k FROM cr WHERE a < b)"""
)
# an edge is in the tree if shorter ones don't join its ends already
TREE = """, reach(k, node) AS (SELECT k, a FROM e UNION SELECT r.k, CASE WHEN e.a = r.node THEN e.b ELSE e.a END FROM reach r JOIN e ON e.k < r.k AND (e.a = r.node OR e.b = r.node)),
tree AS (SELECT a, b, w FROM e WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.k = e.k AND reach.node = e.b))"""


def distances(spark, d):
    return graphs.correlation_distance(covariance_cells(spark, d))


@query(CELLS + TREE + " SELECT a, b, round(w, 6) AS weight FROM tree")
def minimum_spanning_tree(spark, d):
    return graphs.spanning_forest(distances(spark, d)).withColumn("weight", F.round("weight", 6))


@query(
    CELLS
    + TREE
    + """, cut AS (SELECT median(w) + 1e-9 AS c FROM tree), s AS (SELECT a, b FROM tree, cut WHERE w < c UNION ALL SELECT b, a FROM tree, cut WHERE w < c),
co(name, node) AS (SELECT DISTINCT a, a FROM s UNION SELECT co.name, s.b FROM co JOIN s ON s.a = co.node)
SELECT name, min(node) AS cluster FROM co GROUP BY 1"""
)
def spanning_clusters(spark, d):
    """Clusters that the tree's edges up to its median length tie."""
    tree = graphs.spanning_forest(distances(spark, d))
    cutoff = tree.agg(F.median("weight")).first()[0]  # one number
    return graphs.clusters(tree, (cutoff or 0.0) + 1e-9)


@query(
    CELLS
    + """, f AS (SELECT a, b, w FROM e WHERE k <= greatest(3 * (SELECT count(*) FROM sd) - 6, 1)), dg AS (SELECT name, count(*)::INT AS n FROM (SELECT a AS name FROM f UNION ALL SELECT b FROM f) GROUP BY 1)
SELECT a, b, round(w, 6) AS weight, x.n AS degree_a, y.n AS degree_b FROM f JOIN dg x ON x.name = a JOIN dg y ON y.name = b"""
)
def filtered_graph(spark, d):
    return graphs.filtered_edges(distances(spark, d)).withColumn("weight", F.round("weight", 6))


def _eigen_sql(cells: str, value: str, count: int) -> str:
    """Eigenpairs by squaring: a matrix over its trace, squared 40 times, is the projector of its largest one, which is then taken away."""
    n = "(SELECT count(*) FROM sd)"
    out = f", nm AS (SELECT list(name ORDER BY name) AS names FROM sd), m0 AS MATERIALIZED (SELECT list({value} ORDER BY a, b) AS m FROM {cells})"
    cell = "list_sum(list_transform(range(n), lambda k: m[(i // n) * n + k + 1] * m[k * n + i % n + 1]))"
    for k in range(count):
        out += f""", q{k}(j, n, m) AS (SELECT 0, {n}, m FROM m{k} UNION ALL SELECT j + 1, n, list_transform(s, lambda x: x / list_sum(list_transform(range(n), lambda i: s[i * n + i + 1]))) FROM (SELECT j, n, list_transform(range(n * n), lambda i: {cell}) AS s FROM q{k} WHERE j < 40)),
p{k} AS MATERIALIZED (SELECT q.n, q.m AS p, m{k}.m AS c, list_sum(list_transform(range(q.n * q.n), lambda i: q.m[i + 1] * m{k}.m[i + 1])) AS v, list_transform(range(q.n), lambda i: q.m[i * q.n + i + 1]) AS dg FROM q{k} q, m{k} WHERE j = 40),
m{k + 1} AS MATERIALIZED (SELECT list_transform(range(n * n), lambda i: c[i + 1] - v * p[i + 1]) AS m FROM p{k})"""
    parts = " UNION ALL ".join(f"SELECT {k}::INT AS k, v, dg, n, p FROM p{k}" for k in range(count))
    return (
        out
        + f", al2 AS ({parts}), tr AS (SELECT sum({value}) AS t FROM {cells} WHERE a = b)"
        + ", ld AS (SELECT k, v, v / t AS share, names[i + 1] AS name, p[i * n + list_position(dg, list_max(dg))] / sqrt(list_max(dg)) AS loading FROM al2, tr, nm, unnest(range(n)) AS u(i))"
    )


@query(CELLS + _eigen_sql("cells", "cov", 3) + " SELECT k, name, round(v, 6) + 0.0 AS eigenvalue, round(share, 6) + 0.0 AS share, round(loading, 5) + 0.0 AS loading FROM ld")
def principal_components(spark, d):
    """The three largest components of the covariances."""
    p = top_eigenpairs(covariance_cells(spark, d).withColumnRenamed("cov", "x"), 3)
    return p.select("k", "name", r("eigenvalue").alias("eigenvalue"), r("share").alias("share"), r("loading", 5).alias("loading"))


def correlation_cells(spark, d):
    """a, b, x: correlations of all pairs, both orders and the diagonal; a flat series has none."""
    c = covariance_cells(spark, d)
    sd = c.filter("a = b").select("a", F.sqrt("cov").alias("sd"))
    rho = c.join(sd.withColumnRenamed("sd", "sa"), "a").join(sd.select(F.col("a").alias("b"), F.col("sd").alias("sb")), "b")
    return rho.select("a", "b", F.coalesce(F.try_divide("cov", F.col("sa") * F.col("sb")), F.lit(0.0)).alias("x"))


@query(CELLS + _eigen_sql("cr", "rho", 1) + " SELECT name, round(loading, 5) + 0.0 AS loading, round(share, 6) + 0.0 AS share FROM ld")
def market_mode(spark, d):
    """The largest component of the correlations."""
    p = top_eigenpairs(correlation_cells(spark, d), 1)
    return p.select("name", r("loading", 5).alias("loading"), r("share").alias("share"))


def _tail_sql(s: str) -> str:
    out = f"CASE WHEN {s} <= {TW_POINTS[0][0]} THEN {TW_POINTS[0][1]}"
    for (x0, y0), (x1, y1) in zip(TW_POINTS, TW_POINTS[1:], strict=False):
        out += f" WHEN {s} <= {x1} THEN {y0} + ({y1} - {y0}) * ({s} - {x0}) / ({x1} - {x0})"
    return out + f" ELSE {TW_POINTS[-1][1]} END::DOUBLE"


@query(
    CELLS
    + _eigen_sql("cr", "rho", 5)
    + """, ev AS (SELECT DISTINCT k, v, share FROM ld), sz AS (SELECT (SELECT count(*) FROM sd)::DOUBLE AS n, (SELECT count(DISTINCT ts_nanos) FROM al)::DOUBLE AS t),
z AS (SELECT n, t, pow(1 + sqrt(n / t), 2) AS edge, (SELECT max(v) FROM ev) AS top, (SELECT max(share) FROM ev) AS share, pow(sqrt(t - 1) + sqrt(n), 2) AS mu, (sqrt(t - 1) + sqrt(n)) * pow(1 / sqrt(t - 1) + 1 / sqrt(n), 1 / 3::DOUBLE) AS sigma FROM sz),
s AS (SELECT *, (top * t - mu) / sigma AS s FROM z)"""
    + f" SELECT (SELECT count(*) FROM ev WHERE v > edge)::INT AS n_above, round(top, 6) AS top, round(edge, 6) AS edge, round(share, 6) AS top_share, round({_tail_sql('s')}, 6) AS p FROM s"
)
def random_matrix_summary(spark, d):
    """Eigenvalues of the correlations above the Marchenko-Pastur edge, the largest one, its share and its tail."""
    cells = correlation_cells(spark, d)
    n, t = cells.select("a").distinct().count(), joins.aligned_long(log_returns(spark, d), "symbol", "ts_nanos", "r").select("ts_nanos").distinct().count()
    edge, wanted = (1 + math.sqrt(n / t)) ** 2 if t else 0.0, 4
    while True:
        pairs = top_eigenpairs(cells, wanted).select("k", "eigenvalue", "share").distinct()
        above = pairs.filter(F.col("eigenvalue") > edge).count()
        if above < wanted or wanted >= n:  # all that lie above are there
            break
        wanted *= 2
    mu = (math.sqrt(max(t - 1, 0)) + math.sqrt(n)) ** 2
    sigma = (math.sqrt(t - 1) + math.sqrt(n)) * (1 / math.sqrt(t - 1) + 1 / math.sqrt(n)) ** (1 / 3) if t > 1 and n else 1.0
    s = (F.col("eigenvalue") * t - mu) / sigma
    p = piecewise(s, [(F.lit(x), y) for x, y in TW_POINTS])
    return pairs.filter("k = 0").select(F.lit(above).alias("n_above"), r("eigenvalue").alias("top"), r(F.lit(edge)).alias("edge"), r("share").alias("top_share"), r(p).alias("p"))
