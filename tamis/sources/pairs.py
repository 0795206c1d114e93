"""The pair pool and the proxy families, read from an embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import keyed, uniform
from ..functions.vectors import l2

#: Coarse clusters, fine clusters per coarse one, and number of proxy families.
COARSE, FINE, FAMILIES = 10, 5, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, category (the label), coarse and fine (global id) clusters, family, z_v and z_t (normalised halves).

    Coarse clusters are uneven on purpose, by a squared hashed uniform, so that caps of budgets bind.
    """
    half = F.transform("embedding", lambda x: x.cast("double"))
    coarse = F.floor(COARSE * F.pow(uniform(keyed("skew", "vec_id")), F.lit(2))).cast("int")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("pair_id"),
        F.col("label").cast("int").alias("category"),
        coarse.alias("coarse"),
        (coarse * FINE + F.pmod("vec_id", F.lit(FINE))).cast("int").alias("fine"),
        F.pmod("vec_id", F.lit(FAMILIES)).cast("int").alias("family"),
        l2(F.slice(half, 1, 32)).alias("z_v"),
        l2(F.slice(half, 33, 32)).alias("z_t"),
    )


#: The same rows as a DuckDB common table expression.
PAIRS_SQL = f"""
halves AS (SELECT vec_id, label, CAST(floor({COARSE} * pow(CAST(concat('0x', substr(md5('skew:' || vec_id), 1, 8)) AS BIGINT) / 4294967296.0, 2)) AS INT) AS c,
  CAST(embedding[1:32] AS DOUBLE[]) AS a, CAST(embedding[33:64] AS DOUBLE[]) AS b FROM embeddings),
pairs AS (SELECT vec_id AS pair_id, CAST(label AS INT) AS category, c AS coarse, CAST(c * {FINE} + vec_id % {FINE} AS INT) AS fine, CAST(vec_id % {FAMILIES} AS INT) AS family,
  list_transform(a, lambda x: x / (sqrt(list_dot_product(a, a)) + 1e-12)) AS z_v,
  list_transform(b, lambda x: x / (sqrt(list_dot_product(b, b)) + 1e-12)) AS z_t FROM halves)"""
