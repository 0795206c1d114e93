"""A synthetic pool of unit vectors around hashed group centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng, vectors as V


def _gauss(*key: Column) -> Column:
    """Box-Muller on two hashed uniforms, as in rng.gaussian_of."""
    whole = F.concat_ws(":", *key)
    bits = lambda tail: F.conv(F.substring(F.md5(F.concat(whole, F.lit(tail)).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.sqrt(-2 * F.log((bits(":a") + 0.5) / 4294967296.0)) * F.cos(2 * F.pi() * bits(":b") / 4294967296.0)


def synthetic_pool(spark: SparkSession, n: int, dim: int, groups: int, noisy: tuple[int, ...]) -> DataFrame:
    """pair_id, grp, z: groups of uneven sizes (squared uniforms); noisy groups scatter four times as far."""
    p = spark.range(n).select(F.col("id").alias("pair_id"))
    p = p.withColumn("grp", F.floor(groups * F.pow(rng.uniform(rng.keyed("group", "pair_id")), F.lit(2))).cast("int"))
    spread = F.when(F.col("grp").isin(list(noisy)), 0.6).otherwise(0.15)
    part = lambda k: _gauss(F.lit("centre"), F.col("grp").cast("string"), k.cast("string")) + spread * _gauss(F.lit("noise"), F.col("pair_id").cast("string"), k.cast("string"))
    return p.select("pair_id", "grp", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), part).alias("z")).withColumn("z", V.l2(F.col("z"), 0.0))
