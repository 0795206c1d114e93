"""Clustering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.clustering import assign, centroids, cluster_sizes as sizes_of, knn_within, lloyd, minibatch
from ..sources.pairs import PAIRS_SQL, pairs
from .base import UNIFORM, Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def mean_sql(source: str, group: str, vector: str, dims: int = 32) -> str:
    return f"""SELECT grp, list(x ORDER BY k) AS m FROM (SELECT grp, k, avg(x) AS x FROM (SELECT {group} AS grp, unnest({vector}) AS x, unnest(range({dims})) AS k FROM {source}) GROUP BY grp, k) GROUP BY grp"""


def unit_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x / (sqrt(list_dot_product({v}, {v})) + 1e-12))"


CENTROIDS_SQL = f"""cents AS (SELECT grp AS cluster, {unit_sql('m')} AS centroid FROM ({mean_sql('pairs', 'coarse', 'z_v')}))"""


def lloyd_sql(tag: str, source: str, key: str, vector: str, group: str, k: int, rounds: int, seed: str) -> str:
    """Common table expressions of operators.clustering.lloyd, unrolled; the last is {tag}_out (columns of source, cluster)."""
    out = f"""{tag}_s AS (SELECT *, CAST({group} AS INT) AS g_ FROM {source}),
{tag}_c0 AS (SELECT g_, CAST(r - 1 AS INT) AS c, {vector} AS v FROM (SELECT *, row_number() OVER (PARTITION BY g_ ORDER BY md5('{seed}:' || {key}), {key}) AS r FROM {tag}_s) WHERE r <= {k})"""
    for n in range(rounds + 1):
        out += f""",
{tag}_a{n} AS MATERIALIZED (SELECT s.{key} AS k_, arg_max(c.c, {{'s': round(list_dot_product(s.{vector}, c.v), 9), 'n': -c.c}}) AS cluster FROM {tag}_s s JOIN {tag}_c{n} c USING (g_) GROUP BY s.{key})"""
        if n < rounds:
            out += f""",
{tag}_m{n} AS (SELECT g_, cluster, list(x ORDER BY d) AS m FROM (SELECT g_, cluster, d, avg(x) AS x FROM (SELECT s.g_, a.cluster, unnest(s.{vector}) AS x, unnest(range(len(s.{vector}))) AS d FROM {tag}_s s JOIN {tag}_a{n} a ON a.k_ = s.{key}) GROUP BY g_, cluster, d) GROUP BY g_, cluster),
{tag}_c{n + 1} AS MATERIALIZED (SELECT c.g_, c.c, CASE WHEN m.m IS NULL THEN c.v ELSE {unit_sql('m.m')} END AS v FROM {tag}_c{n} c LEFT JOIN {tag}_m{n} m ON m.g_ = c.g_ AND m.cluster = c.c)"""
    return out + f""",
{tag}_out AS MATERIALIZED (SELECT s.* EXCLUDE (g_), a.cluster FROM {tag}_s s JOIN {tag}_a{rounds} a ON a.k_ = s.{key})"""


WITH = f"WITH {PAIRS_SQL}"


@R.add(f"{WITH}, n AS (SELECT coarse, count(*) AS n FROM pairs GROUP BY coarse) SELECT CAST(c AS INT) AS cluster, coalesce(n, 0) AS n FROM range(12) t(c) LEFT JOIN n ON n.coarse = c")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return sizes_of(pairs(spark, d), "coarse", 12)


@R.add(f"{WITH}, {CENTROIDS_SQL} SELECT cluster, CAST(unnest(range(32)) AS INT) AS k, round(unnest(centroid), 6) AS x FROM cents")
def cluster_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = centroids(pairs(spark, d), "coarse", "z_v").select("cluster", F.posexplode("centroid").alias("k", "x"))
    return c.withColumn("x", F.round("x", 6))


@R.add(f"{WITH}, {CENTROIDS_SQL} SELECT pair_id, arg_max(cluster, {{'s': round(list_dot_product(z_v, centroid), 9), 'n': -cluster}}) AS cluster FROM pairs, cents GROUP BY pair_id")
def assign_nearest(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return assign(p.select("pair_id", "z_v"), "z_v", centroids(p, "coarse", "z_v")).select("pair_id", "cluster")


@R.add(f"{WITH}, {lloyd_sql('l', 'pairs', 'pair_id', 'z_v', '0', 6, 3, 'lloyd')} SELECT pair_id, cluster FROM l_out")
def kmeans_lloyd_fixed(spark: SparkSession, d: str) -> DataFrame:
    return lloyd(pairs(spark, d).select("pair_id", "z_v"), "pair_id", "z_v", 6, 3, "lloyd").select("pair_id", "cluster")


def minibatch_sql(k: int, rounds: int, seed: str, batch: int) -> str:
    """operators.clustering.minibatch with one start and no reassignment, unrolled; the last expression is mb_a{rounds}."""
    near = "arg_min(c, {'d': round(list_dot_product(z_v, z_v) + list_dot_product(v, v) - 2 * list_dot_product(z_v, v), 9), 'c': c})"
    out = f"mb_c0 AS (SELECT CAST(r - 1 AS INT) AS c, z_v AS v, 0 AS n FROM (SELECT *, row_number() OVER (ORDER BY md5('{seed}-0:' || pair_id), pair_id) AS r FROM pairs) WHERE r <= {k})"
    for t in range(rounds):
        drawn = UNIFORM.format(key=f"'{seed}:{t}:' || pair_id")
        out += f""", mb_a{t} AS MATERIALIZED (SELECT pair_id, any_value(z_v) AS z_v, {near} AS c FROM pairs, mb_c{t} WHERE {drawn} < least(1.0, {batch}.0 / (SELECT count(*) FROM pairs)) GROUP BY pair_id),
mb_m{t} AS ({mean_sql(f'mb_a{t}', 'c', 'z_v')}), mb_n{t} AS (SELECT c, count(*) AS k FROM mb_a{t} GROUP BY c),
mb_c{t + 1} AS MATERIALIZED (SELECT o.c, CASE WHEN k IS NULL THEN o.v ELSE list_transform(range(1, len(o.v) + 1), lambda i: (o.v[i] * o.n + m[i] * k) / (o.n + k)) END AS v, o.n + coalesce(k, 0) AS n
  FROM mb_c{t} o LEFT JOIN mb_m{t} m_ ON m_.grp = o.c LEFT JOIN mb_n{t} n_ ON n_.c = o.c)"""
    return out + f", mb_out AS (SELECT pair_id, {near} AS cluster FROM pairs, mb_c{rounds} GROUP BY pair_id)"


@R.add(f"{WITH}, {minibatch_sql(6, 4, 'mini', 512)} SELECT pair_id, cluster FROM mb_out")
def kmeans_minibatch(spark: SparkSession, d: str) -> DataFrame:
    """Four rounds, one start, no reassignment, so that SQL can spell it out."""
    return minibatch(pairs(spark, d).select("pair_id", "z_v"), "pair_id", "z_v", 6, 4, "mini", 512, starts=1, reassign=0.0).select("pair_id", "cluster")


TWO_LEVEL_SQL = f"""{lloyd_sql('a', '(SELECT pair_id, z_v, z_t FROM pairs)', 'pair_id', 'z_v', '0', 4, 2, 'coarse')},
a_named AS (SELECT pair_id, z_v, z_t, cluster AS lvl FROM a_out),
{lloyd_sql('b', 'a_named', 'pair_id', 'z_v', 'lvl', 3, 2, 'fine')}"""


def two_level(p: DataFrame) -> DataFrame:
    """pair_id, z_v, coarse (0..3), local (0..2): Lloyd iterations, then again inside each coarse cluster."""
    coarse = lloyd(p.select("pair_id", "z_v"), "pair_id", "z_v", 4, 2, "coarse").withColumnRenamed("cluster", "coarse")
    return lloyd(coarse, "pair_id", "z_v", 3, 2, "fine", group="coarse").withColumnRenamed("cluster", "local")


@R.add(f"{WITH}, {TWO_LEVEL_SQL} SELECT pair_id, lvl AS coarse, CAST(lvl * 3 + cluster AS INT) AS fine FROM b_out")
def cluster_two_level(spark: SparkSession, d: str) -> DataFrame:
    t = two_level(pairs(spark, d))
    return t.select("pair_id", "coarse", (F.col("coarse") * 3 + F.col("local")).cast("int").alias("fine"))


@R.add(f"""{WITH}, {TWO_LEVEL_SQL}, m AS ({mean_sql('b_out', 'lvl * 3 + cluster', 'z_v')}), n AS (SELECT lvl * 3 + cluster AS grp, count(*) AS n FROM b_out GROUP BY 1)
SELECT CAST(grp // 3 AS INT) AS coarse, CAST(grp % 3 AS INT) AS local, n, round(list_sum({unit_sql('m')}), 6) AS total FROM m JOIN n USING (grp)""")
def cluster_hierarchical(spark: SparkSession, d: str) -> DataFrame:
    """Local ids and centroids of the two levels; every pair is assigned, and a cluster of one pair has it as centroid."""
    t = two_level(pairs(spark, d))
    c = t.groupBy("coarse", "local").agg(F.count(F.lit(1)).alias("n"), V.mean_vector(F.col("z_v")).alias("m"))
    return c.select("coarse", "local", "n", F.round(F.aggregate(V.l2(F.col("m")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@R.add(f"""{WITH}, {lloyd_sql('t', 'pairs', 'pair_id', 'z_t', '0', 5, 3, 'theme')}, m AS ({mean_sql('t_out', 'cluster', 'z_t')}),
r AS (SELECT cluster, pair_id, count(*) OVER (PARTITION BY cluster) AS n, row_number() OVER (PARTITION BY cluster ORDER BY round(list_dot_product(z_t, {unit_sql('m')}), 9) DESC, pair_id) AS rank FROM t_out JOIN m ON grp = cluster)
SELECT cluster, n, CAST(rank AS INT) AS rank, pair_id FROM r WHERE rank <= 3""")
def theme_top3(spark: SparkSession, d: str) -> DataFrame:
    t = lloyd(pairs(spark, d).select("pair_id", "z_t"), "pair_id", "z_t", 5, 3, "theme").persist()
    c = centroids(t, "cluster", "z_t")
    s = t.join(c, "cluster").select("cluster", "n", "pair_id", F.round(V.dot(F.col("z_t"), F.col("centroid")), 9).alias("s"))
    w = Window.partitionBy("cluster").orderBy(F.desc("s"), "pair_id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("cluster", "n", "rank", "pair_id")


KNN_SQL = """knn AS (SELECT a.pair_id, b.pair_id AS neighbour, row_number() OVER (PARTITION BY a.pair_id ORDER BY round(list_dot_product(a.z_t, b.z_t), 9) DESC, b.pair_id) AS rank
FROM pairs a JOIN pairs b ON a.coarse = b.coarse AND a.pair_id <> b.pair_id)"""


@R.add(f"{WITH}, {KNN_SQL} SELECT pair_id, neighbour, CAST(rank AS INT) AS rank FROM knn WHERE rank <= 8")
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return knn_within(pairs(spark, d), "coarse", "z_t", 8)


@R.add(f"{WITH}, {KNN_SQL} SELECT DISTINCT neighbour AS pair_id FROM knn WHERE rank <= 8")
def knn_candidates(spark: SparkSession, d: str) -> DataFrame:
    return knn_within(pairs(spark, d), "coarse", "z_t", 8).select(F.col("neighbour").alias("pair_id")).distinct()
