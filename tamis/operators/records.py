"""Experiment records: names, grids, summaries, tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng

# Parts of a run's file name that say nothing about the run.
NOISE = ("metrics", "stage", "c", "stagec", "eval", "norm")
SEED, BUDGET = r"(?i)^(?:s|seed)(\d+)$", r"(?i)^(?:b|budget)?(\d+(?:\.\d+)?)$"


def run_name(stem: Column) -> list[Column]:
    """Columns method, budget, seed of a run's file name; the last token of a kind counts, and the rest is the method."""
    tokens = F.filter(F.split(stem, "__|_"), lambda t: (t != "") & ~F.lower(t).isin(list(NOISE)))
    seeds = F.filter(tokens, lambda t: t.rlike(SEED))
    budgets = F.filter(tokens, lambda t: t.rlike(BUDGET))
    rest = F.filter(tokens, lambda t: ~t.rlike(SEED) & ~t.rlike(BUDGET))
    last = lambda found, pattern: F.regexp_extract(F.try_element_at(found, F.lit(-1)), pattern, 1)
    return [
        F.when(F.size(rest) > 0, F.array_join(rest, "_")).otherwise(stem).alias("method"),
        F.when(F.size(budgets) > 0, last(budgets, BUDGET)).alias("budget"),
        F.when(F.size(seeds) > 0, last(seeds, SEED)).cast("int").alias("seed"),
    ]


def label(name: Column) -> Column:
    """A name fit for a file: everything but letters, digits, _ and - becomes _."""
    return F.regexp_replace(name, "[^A-Za-z0-9_-]", "_")


def percent_tag(alpha: Column, share: Column) -> Column:
    return F.format_string("a%03d_lv%03d", F.round(alpha * 100).cast("int"), F.round(share * 100).cast("int"))


def missing(grid: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of a grid without a run."""
    return grid.join(runs.select(*keys).distinct(), keys, "left_anti")


def unfinished(planned: DataFrame, records: DataFrame, keys: list[str], category: str, needed: int) -> DataFrame:
    """Planned combinations that don't have records of all needed categories; a half-written one counts as not done."""
    done = records.groupBy(*keys).agg(F.countDistinct(category).alias("_n")).where(F.col("_n") >= needed)
    return planned.join(done.select(*keys), keys, "left_anti")


def across_seeds(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean, std, n): std is 0 for a single run."""
    return runs.groupBy(*keys).agg(F.round(F.avg(value), 3).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 3).alias("std"), F.count(value).alias("n"))


def sign_flip_test(diffs: DataFrame, by: str, key: str, value: str, resamples: int, seed: str) -> DataFrame:
    """(by, p): share of sign flips of paired differences whose mean is at least as far from 0 as the real one."""
    spark = diffs.sparkSession
    flips = diffs.crossJoin(F.broadcast(spark.range(resamples).select(F.col("id").alias("b"))))
    sign = F.when(rng.uniform(rng.keyed(seed, "b", key)) < 0.5, 1.0).otherwise(-1.0)
    stats = flips.groupBy(by, "b").agg(F.round(F.abs(F.avg(F.col(value) * sign)), 9).alias("s"))
    real = diffs.groupBy(by).agg(F.round(F.abs(F.avg(value)), 9).alias("obs"))
    return stats.join(real, by).groupBy(by).agg(((F.count_if(F.col("s") >= F.col("obs")) + 1) / F.lit(resamples + 1.0)).alias("p"))


def holm(df: DataFrame, p: str, key: str) -> DataFrame:
    """Adds the step-down adjusted p. One row per hypothesis: a small table, ranked as a whole."""
    w = Window.orderBy(p, key)
    m = F.count(F.lit(1)).over(Window.partitionBy())
    scaled = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(w) + 1))
    return df.withColumn("_s", scaled).withColumn("adjusted", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def average_place(scores: DataFrame, block: str, method: str, score: str) -> DataFrame:
    """(method, avg_rank): the mean over blocks of a method's rank by score, the best being 1."""
    w = Window.partitionBy(block).orderBy(F.desc(score))
    return scores.withColumn("_r", F.rank().over(w)).groupBy(method).agg(F.avg("_r").alias("avg_rank"))
