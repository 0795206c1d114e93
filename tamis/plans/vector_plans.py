"""Vector projections, samples and joins on the pair pool."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng, vectors as V
from ..operators.features import fourier_parameters, unit_projections
from ..operators.sampling import exact_sample, split_exact
from ..operators.scores import cosine_rate, relevance
from ..sources.pairs import PAIRS_SQL, pairs, table
from .base import GAUSS, UNIFORM, Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

WITH = f"WITH {PAIRS_SQL}"
RFF_DIM, SIGMA, PROJECTIONS = 16, 1.0, 8

#: Random Fourier features of an array column, as a scalar DuckDB expression over the tables rw and rb.
RFF_SQL = f"""
rw AS (SELECT f, list({GAUSS.format(key="'rff:' || f || ':' || k")} / {SIGMA} ORDER BY k) AS w FROM range({RFF_DIM}) a(f), range(32) b(k) GROUP BY f),
rff AS (SELECT list({{'f': f, 'w': w, 'b': 2 * pi() * {UNIFORM.format(key="'rffb:' || f")}}} ORDER BY f) AS rows FROM rw)"""


def rff_sql(column: str) -> str:
    return f"list_transform((SELECT rows FROM rff), lambda r: sqrt(2.0 / {RFF_DIM}) * cos(list_dot_product({column}, r.w) + r.b))"


PROJ_SQL = f"""
pg AS (SELECT l, list({GAUSS.format(key="'proj:' || l || ':' || k")} ORDER BY k) AS g FROM range({PROJECTIONS}) a(l), range(32) b(k) GROUP BY l),
proj AS (SELECT l, list_transform(g, lambda x: x / greatest(sqrt(list_dot_product(g, g)), 1e-12)) AS w FROM pg)"""


def _rounded(c):
    return F.transform(c, lambda x: F.round(x, 6))


@R.add(f"{WITH}, u AS (SELECT pair_id, unnest(z_v) AS x, unnest(range(1, 33)) AS k FROM pairs) SELECT pair_id, CAST(k AS INT) AS k, round(x, 6) AS x FROM u")
def vec_l2norm(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).select("pair_id", F.posexplode("z_v").alias("k", "x"))
    return p.select("pair_id", (F.col("k") + 1).alias("k"), F.round("x", 6).alias("x"))


@R.add("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12))), 6) AS total, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM e""")
def vec_l2norm_floor(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, d, "embeddings").select("vec_id", v.alias("v"))
    return e.select("vec_id", F.round(F.aggregate(V.l2_floor(F.col("v")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(V.norm(F.col("v")), 6).alias("norm"))


@R.add(f"{WITH} SELECT pair_id, round(list_dot_product(z_v, z_t), 6) AS dot FROM pairs")
def vec_dot(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("pair_id", F.round(V.dot(F.col("z_v"), F.col("z_t")), 6).alias("dot"))


@R.add(f"{WITH} SELECT coarse, count(*) AS n, round(avg(list_dot_product(z_v, z_t)), 6) AS mean_alignment, round(max(list_dot_product(z_v, z_t)), 6) AS max_alignment FROM pairs GROUP BY coarse")
def pair_alignment(spark: SparkSession, d: str) -> DataFrame:
    a = V.dot(F.col("z_v"), F.col("z_t"))
    return pairs(spark, d).groupBy("coarse").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(a), 6).alias("mean_alignment"), F.round(F.max(a), 6).alias("max_alignment"))


@R.add(f"{WITH}, {RFF_SQL}, u AS (SELECT pair_id, {rff_sql('z_t')} AS psi FROM pairs) SELECT pair_id, CAST(unnest(range({RFF_DIM})) AS INT) AS f, round(unnest(psi), 6) AS x FROM u")
def rff_transform(spark: SparkSession, d: str) -> DataFrame:
    psi = V.fourier(*fourier_parameters("rff", RFF_DIM, 32, SIGMA))
    p = pairs(spark, d).select("pair_id", F.posexplode(psi("z_t")).alias("f", "x"))
    return p.select("pair_id", "f", F.round("x", 6).alias("x"))


@R.add(f"""{WITH}, {RFF_SQL}, u AS (SELECT pair_id, list_transform({rff_sql('z_v')}, lambda x: sqrt(0.5) * x) || list_transform({rff_sql('z_t')}, lambda x: sqrt(0.5) * x) AS m FROM pairs)
SELECT pair_id, round(list_sum(m), 6) AS total, round(list_dot_product(m, m), 6) AS square FROM u""")
def pair_feature_map(spark: SparkSession, d: str) -> DataFrame:
    psi = V.fourier(*fourier_parameters("rff", RFF_DIM, 32, SIGMA))
    half = math.sqrt(0.5)
    p = pairs(spark, d).select("pair_id", psi("z_v").alias("a"), psi("z_t").alias("b"))
    m = p.select("pair_id", F.concat(F.transform("a", lambda x: x * half), F.transform("b", lambda x: x * half)).alias("m"))
    return m.select("pair_id", F.round(F.aggregate("m", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(V.dot(F.col("m"), F.col("m")), 6).alias("square"))


@R.add(f"""{WITH}, j AS (SELECT pair_id, list_transform(z_v, lambda x: x * sqrt(0.7)) || list_transform(z_t, lambda x: x * sqrt(1 - 0.7)) AS v FROM pairs)
SELECT pair_id, round(list_sum(list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12))), 6) AS total FROM j""")
def joint_embedding(spark: SparkSession, d: str) -> DataFrame:
    j = pairs(spark, d).select("pair_id", V.joint(F.col("z_v"), F.col("z_t"), 0.7).alias("v"))
    return j.select("pair_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@R.add(f"WITH {PROJ_SQL} SELECT CAST(l AS INT) AS l, CAST(unnest(range(32)) AS INT) AS k, round(unnest(w), 6) AS w FROM proj")
def random_projections(spark: SparkSession, d: str) -> DataFrame:
    p = unit_projections("proj", PROJECTIONS, 32)
    return spark.createDataFrame([(l, k, round(float(p[l, k]), 6)) for l in range(PROJECTIONS) for k in range(32)], "l int, k int, w double")


@R.add(f"{WITH}, {PROJ_SQL} SELECT pair_id, CAST(l AS INT) AS l, round(list_dot_product(z_t, w), 6) AS y FROM pairs, proj")
def project_points(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).select("pair_id", F.posexplode(V.project(unit_projections("proj", PROJECTIONS, 32))("z_t")).alias("l", "y"))
    return p.select("pair_id", "l", F.round("y", 6).alias("y"))


@R.add("SELECT event_id, round(exp(-1.5 * CASE WHEN value > 20 THEN value ELSE ln(1 + exp(greatest(-50, least(20, value)))) END), 6) AS a FROM events")
def relevance_transform(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(relevance(F.col("value"), 1.5), 6).alias("a"))


@R.add("""WITH s AS (SELECT event_id, CAST(row_number() OVER (ORDER BY event_id) - 1 AS DOUBLE) AS step, CAST(count(*) OVER () AS DOUBLE) AS n FROM events)
SELECT event_id, round(CASE WHEN step < 100 THEN 0.001 * step / 100 ELSE 0.5 * 0.001 * (1 + cos(pi() * (step - 100) / greatest(1, n - 100))) END, 9) AS rate FROM s""")
def cosine_lr(spark: SparkSession, d: str) -> DataFrame:
    """The schedule over as many steps as there are events; step numbers are dealt by a two-level count, not one global window."""
    from ..operators.sampling import global_row_number

    e = global_row_number(table(spark, d, "events").select("event_id"), "event_id", "step")
    n = e.count()
    return e.select("event_id", F.round(cosine_rate(F.col("step").cast("double"), 0.001, 100, n), 9).alias("rate"))


# ---- samples -----------------------------------------------------------------------------------------------


@R.add(f"SELECT vec_id AS pair_id FROM embeddings ORDER BY md5('random:' || vec_id), vec_id LIMIT 100")
def select_random(spark: SparkSession, d: str) -> DataFrame:
    return exact_sample(table(spark, d, "embeddings").select(F.col("vec_id").alias("pair_id")), "pair_id", 100, "random")


@R.add("""WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY md5('split:' || vec_id), vec_id) AS r FROM embeddings)
SELECT vec_id AS pair_id, CASE WHEN r <= 100 THEN 'validation' ELSE 'train' END AS part FROM r""")
def split_train_val(spark: SparkSession, d: str) -> DataFrame:
    return split_exact(table(spark, d, "embeddings").select(F.col("vec_id").alias("pair_id")), "pair_id", 100, "split")


@R.add("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('batch:' || doc_id), doc_id) AS r FROM documents)
SELECT lang, doc_id FROM r WHERE r <= 24""")
def sample_per_group(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("lang").orderBy(F.md5(rng.keyed("batch", "doc_id")), "doc_id")
    return table(spark, d, "documents").select("lang", "doc_id").withColumn("r", F.row_number().over(w)).where("r <= 24").drop("r")


@R.add(f"""WITH g AS (SELECT i, CAST(floor(10 * pow({UNIFORM.format(key="'group:' || i")}, 2)) AS INT) AS grp FROM range(2000) t(i)),
x AS (SELECT i, grp, k, {GAUSS.format(key="'centre:' || grp || ':' || k")} + CASE WHEN grp IN (7, 8, 9) THEN 0.6 ELSE 0.15 END * {GAUSS.format(key="'noise:' || i || ':' || k")} AS x FROM g, range(8) t(k)),
n AS (SELECT i, sqrt(sum(x * x)) AS n FROM x GROUP BY i)
SELECT i AS pair_id, grp, CAST(k AS INT) AS k, round(x / n, 6) AS x FROM x JOIN n USING (i)""")
def synth_pool(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.synthetic import synthetic_pool

    p = synthetic_pool(spark, 2000, 8, groups=10, noisy=(7, 8, 9))
    return p.select("pair_id", "grp", F.posexplode("z").alias("k", "x")).withColumn("x", F.round("x", 6))


# ---- joins ---------------------------------------------------------------------------------------------------


@R.add(f"""WITH a AS (SELECT vec_id AS pair_id, embedding[1] AS first_v FROM embeddings), b AS (SELECT vec_id AS pair_id, embedding[33] AS first_t, label FROM embeddings)
SELECT pair_id, label, round(CAST(first_v AS DOUBLE), 6) AS first_v, round(CAST(first_t AS DOUBLE), 6) AS first_t FROM a JOIN b USING (pair_id)""")
def join_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    a = e.select(F.col("vec_id").alias("pair_id"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first_v"))
    b = e.select(F.col("vec_id").alias("pair_id"), "label", F.round(F.col("embedding")[32].cast("double"), 6).alias("first_t"))
    return a.join(b, "pair_id")


@R.add("""WITH l AS (SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS local FROM embeddings) SELECT label, local, vec_id AS pair_id FROM l""")
def gather_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every local position inside a cluster is mapped back to its pool id by a join on (cluster, position)."""
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("vec_id")
    local = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("pair_id"), (F.row_number().over(w) - 1).cast("long").alias("local"))
    return local.select("label", "local").join(local, ["label", "local"])


DRAWN_SQL = f"""n AS (SELECT count(*) AS n FROM pairs), ids AS (SELECT pair_id, z_t, row_number() OVER (ORDER BY pair_id) - 1 AS pos FROM pairs),
draw AS (SELECT i, CAST(floor(n * {UNIFORM.format(key="'pa:' || i")}) AS BIGINT) AS a, CAST(floor(n * {UNIFORM.format(key="'pb:' || i")}) AS BIGINT) AS b FROM range(2000) t(i), n),
drawn AS (SELECT list_dot_product(x.z_t, y.z_t) AS s FROM draw JOIN ids x ON x.pos = a JOIN ids y ON y.pos = b WHERE a <> b)"""


def drawn_cosines(spark: SparkSession, d: str) -> DataFrame:
    """(s) of 2000 drawn pairs of proxies."""
    from ..operators.sampling import global_row_number

    ids = global_row_number(pairs(spark, d).select("pair_id", "z_t"), "pair_id", "pos")
    n = ids.count()
    draw = spark.range(2000).select(*(F.floor(n * rng.uniform(rng.keyed(s, "id"))).alias(c) for s, c in (("pa", "a"), ("pb", "b")))).where("a <> b")
    x, y = ids.select(F.col("pos").alias("a"), F.col("z_t").alias("x")), ids.select(F.col("pos").alias("b"), F.col("z_t").alias("y"))
    return draw.join(x, "a").join(y, "b").select(V.dot(F.col("x"), F.col("y")).alias("s"))


@R.add(f"{WITH}, {DRAWN_SQL} SELECT CAST(count(*) AS BIGINT) AS n, round(avg(s), 6) AS mean_cosine FROM drawn")
def pairwise_cosine_sample(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine of the drawn pairs."""
    return drawn_cosines(spark, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("mean_cosine"))


@R.add(f"""{WITH}, {DRAWN_SQL} SELECT (SELECT n FROM n) AS n, count(*) AS n_pairs, round(min(s), 6) AS least, round(quantile_cont(s, 0.5), 6) AS median, round(max(s), 6) AS most, round(avg(s), 6) AS mean,
  round(coalesce(stddev_samp(s), 0), 6) AS std, round(coalesce(stddev_samp(s) / avg(s), 0), 6) AS cv FROM drawn""")
def proxy_quality(spark: SparkSession, d: str) -> DataFrame:
    """How many proxies there are, and a summary of the cosines of drawn pairs."""
    from ..operators.stats import summary

    s = drawn_cosines(spark, d).agg(F.count(F.lit(1)).alias("n_pairs"), *summary(F.col("s")))
    n = pairs(spark, d).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(s).select("n", "n_pairs", *(F.round(c, 6).alias(c) for c in ("least", "median", "most", "mean", "std", "cv")))
