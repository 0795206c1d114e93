"""Distances between clusters and proxy families, and grouped statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import stats as S
from ..operators.features import fourier_parameters, unit_projections
from ..sources.pairs import PAIRS_SQL, pairs, table
from .base import Registry
from .cluster_plans import mean_sql
from .vector_plans import PROJ_SQL, PROJECTIONS, RFF_DIM, RFF_SQL, SIGMA, rff_sql

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

DIFF = "list_transform(range(1, len({a}) + 1), lambda i: {a}[i] - {b}[i])"

MMD_SQL = f"""{PAIRS_SQL}, {RFF_SQL},
feat AS MATERIALIZED (SELECT pair_id, coarse, fine, family, {rff_sql('z_t')} AS psi FROM pairs),
mu AS ({mean_sql('feat', 'coarse', 'psi', RFF_DIM)}), nu AS ({mean_sql('feat', 'family', 'psi', RFF_DIM)}),
sizes AS (SELECT coarse AS cluster, count(*) AS n FROM pairs GROUP BY coarse),
diffs AS (SELECT mu.grp AS cluster, nu.grp AS family, {DIFF.format(a='mu.m', b='nu.m')} AS v FROM mu, nu),
dist AS MATERIALIZED (SELECT cluster, family, n, list_dot_product(v, v) AS d FROM diffs JOIN sizes USING (cluster))"""

SCALED_SQL = f"""{MMD_SQL},
q AS (SELECT family, quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.5) AS q2, quantile_cont(d, 0.75) AS q3 FROM dist GROUP BY family),
scaled AS MATERIALIZED (SELECT cluster, family, n, d, (d - q2) / (q3 - q1 + 1e-6) AS d_tilde FROM dist JOIN q USING (family))"""

SPREAD_SQL = f"""{SCALED_SQL},
rel AS (SELECT cluster, n, exp(-CASE WHEN d_tilde > 20 THEN d_tilde ELSE ln(1 + exp(greatest(-50, least(20, d_tilde)))) END) AS a FROM scaled),
spread AS MATERIALIZED (SELECT cluster, max(n) AS n, avg(a) AS abar, var_pop(a) AS u FROM rel GROUP BY cluster)"""


def features(spark: SparkSession, d: str) -> DataFrame:
    """The pool with psi, the random Fourier features of its text vectors."""
    psi = V.fourier(*fourier_parameters("rff", RFF_DIM, 32, SIGMA))
    return pairs(spark, d).withColumn("psi", psi("z_t"))


def distances(spark: SparkSession, d: str) -> DataFrame:
    p = features(spark, d).persist()  # read for the clusters and for the families
    return S.mmd2(p, p, "coarse", "family", "psi")


def scaled(spark: SparkSession, d: str) -> DataFrame:
    return S.robust_scale(distances(spark, d))


def spread(spark: SparkSession, d: str) -> DataFrame:
    s = scaled(spark, d).persist()
    return S.relevance_spread(s, "d_tilde").join(s.groupBy("cluster").agg(F.max("n").alias("n")), "cluster")


@R.add(f"""WITH {PAIRS_SQL}, p AS (SELECT list_dot_product(a.z_t, a.z_t) + list_dot_product(b.z_t, b.z_t) - 2 * list_dot_product(a.z_t, b.z_t) AS d2 FROM pairs a JOIN pairs b ON a.pair_id < b.pair_id)
SELECT round(sqrt(quantile_cont(d2, 0.5) / 2), 6) AS sigma FROM p""")
def median_bandwidth(spark: SparkSession, d: str) -> DataFrame:
    sigma = S.median_bandwidth(pairs(spark, d), "pair_id", "z_t")
    return spark.createDataFrame([(round(sigma, 6),)], "sigma double")


@R.add(f"WITH {MMD_SQL} SELECT grp AS cluster, CAST(unnest(range({RFF_DIM})) AS INT) AS f, round(unnest(m), 6) AS x FROM mu")
def mean_embedding(spark: SparkSession, d: str) -> DataFrame:
    m = features(spark, d).groupBy(F.col("coarse").alias("cluster")).agg(V.mean_vector(F.col("psi")).alias("m"))
    return m.select("cluster", F.posexplode("m").alias("f", "x")).withColumn("x", F.round("x", 6))


@R.add(f"WITH {MMD_SQL} SELECT cluster, family, n, round(d, 6) AS d FROM dist")
def mmd2_cluster_proxy(spark: SparkSession, d: str) -> DataFrame:
    return distances(spark, d).withColumn("d", F.round("d", 6))


@R.add(f"WITH {SCALED_SQL} SELECT cluster, family, round(d_tilde, 6) AS d_tilde FROM scaled")
def normalize_per_proxy(spark: SparkSession, d: str) -> DataFrame:
    return scaled(spark, d).select("cluster", "family", F.round("d_tilde", 6).alias("d_tilde"))


@R.add(f"WITH {SPREAD_SQL} SELECT cluster, round(abar, 6) AS abar, round(u, 6) AS u FROM spread")
def relevance_abar_u(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark, d).select("cluster", F.round("abar", 6).alias("abar"), F.round("u", 6).alias("u"))


@R.add(f"""WITH {MMD_SQL}, pairs_of AS (SELECT a.grp AS family, b.grp AS other, {DIFF.format(a='a.m', b='b.m')} AS v FROM nu a, nu b)
SELECT family, other, round(list_dot_product(v, v), 6) AS d FROM pairs_of""")
def family_mmd_matrix(spark: SparkSession, d: str) -> DataFrame:
    nu = features(spark, d).groupBy("family").agg(V.mean_vector(F.col("psi")).alias("nu"))
    other = nu.select(F.col("family").alias("other"), F.col("nu").alias("mu"))
    return nu.crossJoin(F.broadcast(other)).select("family", "other", F.round(V.squared_distance(F.col("nu"), F.col("mu")), 6).alias("d"))


# ---- Wasserstein gaps ------------------------------------------------------------------------------------

W2_SQL = f"""{PAIRS_SQL}, long AS (SELECT coarse, unnest(z_t) AS x, unnest(range(32)) AS k FROM pairs),
own AS (SELECT coarse, k, count(*) AS n, avg(x) AS mu, stddev_samp(x) AS sd FROM long GROUP BY coarse, k),
pooled AS (SELECT k, count(*) AS m, avg(x) AS mu, stddev_samp(x) AS sd FROM long GROUP BY k),
gw AS MATERIALIZED (SELECT coarse AS cluster, max(n) AS n, sqrt(sum(pow(own.mu - pooled.mu, 2)) + CASE WHEN max(n) > 1 AND max(m) > 1 THEN sum(pow(own.sd - pooled.sd, 2)) ELSE 0 END) AS w FROM own JOIN pooled USING (k) GROUP BY coarse)"""
GAPS_SQL = f"{W2_SQL}, gaps AS MATERIALIZED (SELECT cluster, n, CASE WHEN n >= 2 THEN w ELSE coalesce(avg(w) FILTER (n >= 2) OVER (), 0) END AS gap FROM gw)"


def gaussian_gaps(spark: SparkSession, d: str) -> DataFrame:
    """(cluster, n, w): each coarse cluster against the pooled proxy."""
    p = pairs(spark, d).select("coarse", "z_t")
    return S.gaussian_w2(p, p, "coarse", "z_t", 32)


@R.add(f"WITH {W2_SQL} SELECT cluster, n, round(w, 6) AS w FROM gw")
def w2_gaussian_diag(spark: SparkSession, d: str) -> DataFrame:
    return gaussian_gaps(spark, d).withColumn("w", F.round("w", 6))


@R.add(f"WITH {GAPS_SQL} SELECT cluster, n, round(gap, 6) AS gap FROM gaps")
def cluster_w2_gaps(spark: SparkSession, d: str) -> DataFrame:
    return S.filled_gaps(gaussian_gaps(spark, d)).withColumn("gap", F.round("gap", 6))


LINES_SQL = f"""{PAIRS_SQL}, {PROJ_SQL}, pts AS MATERIALIZED (SELECT coarse AS cluster, CAST(l AS INT) AS l, list_dot_product(z_t, w) AS y FROM pairs, proj),
x AS (SELECT cluster, l, y, row_number() OVER (PARTITION BY cluster, l ORDER BY y) AS i, count(*) OVER (PARTITION BY cluster, l) AS n FROM pts),
y AS (SELECT l, y, row_number() OVER (PARTITION BY l ORDER BY y) AS j, count(*) OVER (PARTITION BY l) AS m FROM pts),
w2 AS MATERIALIZED (SELECT cluster, x.l, max(n) AS n, sum(CAST(least(i * m, j * n) - greatest((i - 1) * m, (j - 1) * n) AS DOUBLE) / (n * m) * pow(x.y - y.y, 2)) AS w2
  FROM x JOIN y ON x.l = y.l AND (i - 1) * m < j * n AND (j - 1) * n < i * m GROUP BY cluster, x.l),
sw AS (SELECT cluster, max(n) AS n, sqrt(avg(w2)) AS w FROM w2 GROUP BY cluster)"""


def lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Projections (cluster, l, y, pair_id) of the pool, and (l, y, pair_id) of all proxies pooled."""
    p = pairs(spark, d).select("pair_id", "coarse", F.posexplode(V.project(unit_projections("proj", PROJECTIONS, 32))("z_t")).alias("l", "y")).persist()  # read for either order
    return p.withColumnRenamed("coarse", "cluster"), p.drop("coarse")


def line_distances(spark: SparkSession, d: str) -> DataFrame:
    """(cluster, l, w2) of every cluster and projection."""
    return S.w2_1d(*lines(spark, d), ["cluster", "l"], "y", shared=["l"], tie="pair_id")


def sliced(spark: SparkSession, d: str) -> DataFrame:
    w = line_distances(spark, d).groupBy("cluster").agg(F.sqrt(F.avg("w2")).alias("w"))
    n = pairs(spark, d).groupBy(F.col("coarse").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return w.join(n, "cluster").select("cluster", "n", "w")


@R.add(f"WITH {LINES_SQL} SELECT cluster, l, round(w2, 6) AS w2 FROM w2")
def w2_exact_1d(spark: SparkSession, d: str) -> DataFrame:
    return line_distances(spark, d).withColumn("w2", F.round("w2", 6))


@R.add(f"WITH {LINES_SQL} SELECT cluster, n, round(w, 6) AS w FROM sw")
def sliced_w2(spark: SparkSession, d: str) -> DataFrame:
    return sliced(spark, d).withColumn("w", F.round("w", 6))


@R.add(f"""WITH {LINES_SQL}, every AS (SELECT CAST(c AS INT) AS cluster FROM range(12) t(c))
SELECT every.cluster, coalesce(n, 0) AS n, round(coalesce(w, avg(w) OVER ()), 6) AS gap FROM every LEFT JOIN sw USING (cluster)""")
def coarse_sw2_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Twelve clusters, of which two are empty and take the mean of the others."""
    every = spark.range(12).select(F.col("id").cast("int").alias("cluster"))
    g = every.join(sliced(spark, d), "cluster", "left").select("cluster", F.coalesce("n", F.lit(0)).alias("n"), "w")
    return S.filled_gaps(g, least=1).withColumn("gap", F.round("gap", 6))


GRID_SQL = f"""{LINES_SQL}, sized AS (SELECT cluster, x.l, max(n) AS n, max(m) AS m, least(max(n), max(m), 256) AS g FROM x JOIN (SELECT l, max(m) AS m FROM y GROUP BY l) s ON s.l = x.l GROUP BY cluster, x.l),
pos AS (SELECT cluster, l, unnest(range(g)) AS k, g, n, m FROM sized),
grid AS (SELECT p.cluster, p.l, avg(pow(x.y - y.y, 2)) AS w2 FROM pos p JOIN x ON x.cluster = p.cluster AND x.l = p.l AND x.i - 1 = CASE WHEN g > 1 THEN k * (p.n - 1) // (g - 1) ELSE 0 END
  JOIN y ON y.l = p.l AND y.j - 1 = CASE WHEN g > 1 THEN k * (p.m - 1) // (g - 1) ELSE 0 END GROUP BY p.cluster, p.l),
gridded AS MATERIALIZED (SELECT cluster, avg(w2) AS w2 FROM grid GROUP BY cluster)"""


def gridded(spark: SparkSession, d: str) -> DataFrame:
    return S.grid_w2(*lines(spark, d), ["cluster", "l"], "y", shared=["l"], tie="pair_id").groupBy("cluster").agg(F.avg("w2").alias("w2"))


@R.add(f"WITH {GRID_SQL} SELECT cluster, round(w2, 6) AS w2 FROM gridded")
def sliced_w2_grid(spark: SparkSession, d: str) -> DataFrame:
    return gridded(spark, d).withColumn("w2", F.round("w2", 6))


# ---- other statistics ------------------------------------------------------------------------------------


@R.add("""SELECT source, round(min(v), 6) AS least, round(quantile_cont(v, 0.5), 6) AS median, round(max(v), 6) AS most, round(avg(v), 6) AS mean,
  round(coalesce(stddev_samp(v), 0), 6) AS std, round(coalesce(stddev_samp(v) / avg(v), 0), 6) AS cv FROM (SELECT source, CAST(n_chars AS DOUBLE) AS v FROM documents) GROUP BY source""")
def dist_summary(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").groupBy("source").agg(*S.summary(F.col("n_chars").cast("double")))
    return s.select("source", *(F.round(c, 6).alias(c) for c in s.columns[1:]))


@R.add("""SELECT l_returnflag, l_linestatus, round(coalesce(CASE WHEN stddev_pop(l_quantity) * stddev_pop(l_extendedprice) > 0 THEN covar_pop(l_quantity, l_extendedprice) / (stddev_pop(l_quantity) * stddev_pop(l_extendedprice)) END, 0), 4) AS r,
  CAST(0 AS DOUBLE) AS flat FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def safe_corr(spark: SparkSession, d: str) -> DataFrame:
    """Correlation by group, and with a column without spread, where it is 0."""
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(S.guarded_correlation(q, p), 4).alias("r"), S.guarded_correlation(q, F.lit(1.0)).alias("flat"))


@R.add(f"""WITH {SCALED_SQL}, ra AS (SELECT family, cluster, rank() OVER (PARTITION BY family ORDER BY round(d, 12)) + (count(*) OVER (PARTITION BY family, round(d, 12)) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY family ORDER BY round(d_tilde, 9)) + (count(*) OVER (PARTITION BY family, round(d_tilde, 9)) - 1) / 2.0 AS b FROM scaled)
SELECT family, count(*) AS clusters, round(corr(a, b), 4) AS rho FROM ra GROUP BY family HAVING count(*) >= 3""")
def spearman_rank_shift(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation, per family, of raw and scaled scores over clusters; families of fewer than 3 are left out."""
    s = scaled(spark, d).select("family", "cluster", F.round("d", 12).alias("raw"), F.round("d_tilde", 9).alias("scaled"))
    ranked = S.average_rank(S.average_rank(s, ["family"], "raw", "a"), ["family"], "scaled", "b")
    r = ranked.groupBy("family").agg(F.count(F.lit(1)).alias("clusters"), F.round(S.guarded_correlation(F.col("a"), F.col("b")), 4).alias("rho"))
    return r.where("clusters >= 3")


@R.add()
def pca_components_for(spark: SparkSession, d: str) -> DataFrame:
    """How many principal components explain 80, 90 and 95 percent of the image vectors' variance."""
    shares = S.principal(pairs(spark, d), "z_v", 32)[1].cumsum()
    rows = [(level, int((shares < level - 1e-12).sum()) + 1) for level in (0.8, 0.9, 0.95)]
    return spark.createDataFrame(rows, "level double, components int")


@R.add()
def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates of all image vectors on the first two principal components."""
    x = S.principal_coordinates(pairs(spark, d), "z_v", 2)
    return x.select("pair_id", F.round(F.col("coordinates")[0], 6).alias("x"), F.round(F.col("coordinates")[1], 6).alias("y"))
