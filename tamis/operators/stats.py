"""Distances between distributions and other grouped statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng, vectors as V
from .sampling import exact_sample
from .scores import relevance


#: Bins of one pass over the distances of all pairs, and distances that are worked out at a time.
BINS, TILE = 1 << 14, 1 << 19


def median_bandwidth(df: DataFrame, key: str, vector: str, most: int | None = None, seed: str = "bandwidth") -> float:
    """sqrt(median squared distance / 2) over all pairs of rows; with most, over those of so many rows drawn by a hash."""
    rows = df.select(key, vector)
    d2 = median_pair_distance(rows if most is None else exact_sample(rows, key, most, seed), key, vector)
    return float(np.sqrt(max(d2 or 0.0, 1e-12) / 2))


def median_pair_distance(df: DataFrame, key: str, vector: str, block_rows: int = 16384) -> float | None:
    """Median of the squared distances of all pairs of different rows; None without a pair.

    Rows are dealt into blocks by a hash, and each pair of blocks is a task of its own. A pass counts distances in BINS
    bins and the next one looks only into the bin with the median: nothing is kept per pair, and the driver sees one
    row per bin. Two middle values in different bins are the largest and the smallest value on the two sides of an edge.
    """
    n, longest = df.agg(F.count(F.lit(1)), F.max(V.dot(F.col(vector), F.col(vector)))).first()
    if n < 2:
        return None
    blocks = max(8, -(-n // block_rows))
    own = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    cell = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("_b", o).alias("x"), F.greatest("_b", o).alias("y"), (o < F.col("_b")).alias("right")))
    dealt = df.select(own.alias("_b"), F.col(key).alias("_k"), F.col(vector).alias("_v")).select(F.explode(cell).alias("_o"), "_k", "_v")
    cells = dealt.select("_o.*", "_k", "_v").repartition("x", "y").persist()  # read in every pass
    first, second = (n * (n - 1) // 2 - 1) // 2, n * (n - 1) // 4
    low, width = 0.0, 4 * longest * (1 + 1e-9) or 1.0  # of unit vectors: 4
    least = width * 1e-12
    try:
        while width > least:
            tally = sorted(cells.groupBy("x", "y").applyInPandas(_tally(low, BINS / width), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect())
            ends = np.cumsum([r.n for r in tally])
            a, b = (tally[int(np.searchsorted(ends, rank, side="right"))].bin for rank in (first, second))
            if a != b:
                edge = cells.groupBy("x", "y").applyInPandas(_sides(low, BINS / width, a, b), "below double, above double")
                return float(sum(edge.agg(F.max("below"), F.min("above")).first()) / 2)
            width /= BINS
            low += (min(max(a, 1), BINS) - 1) * width  # beyond an end: by rounding only
        return low + width / 2
    finally:
        cells.unpersist()


def _cell_bins(pdf: pd.DataFrame, low: float, scale: float) -> Iterator[np.ndarray]:
    """(d2 - low) * scale + 1 of the pairs of two blocks, or of one with itself, some rows at a time, within 0 and BINS + 1.

    The whole parts are bins: 1 to BINS from low on, 0 below, BINS + 1 above. Norms, shift and scale are columns of the
    factors, so all of it is one matrix product.
    """
    pdf = pdf.sort_values("_k", kind="stable")
    x = V.to_matrix(pdf["_v"][~pdf["right"]])
    own = pdf["x"].iloc[0] == pdf["y"].iloc[0]
    y = x if own else V.to_matrix(pdf["_v"][pdf["right"]])
    if not len(x) or not len(y):
        return
    left = np.column_stack([-2 * scale * x, ((x * x).sum(axis=1) - low) * scale + 1, np.ones(len(x))])
    right = np.column_stack([y, np.ones(len(y)), (y * y).sum(axis=1) * scale]).T
    step = max(1, TILE // len(y))
    for lo in range(0, len(x), step):
        t = left[lo : lo + step] @ right[:, lo if own else 0 :]
        np.clip(t, 0, BINS + 1, out=t)
        yield t[np.triu(np.ones(t.shape, bool), 1)] if own else t.ravel()


def _tally(low: float, scale: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(BINS + 2, np.int64)
        for t in _cell_bins(pdf, low, scale):
            counts += np.bincount(t.astype(np.int64), minlength=BINS + 2)
        held = np.flatnonzero(counts)
        return pd.DataFrame({"bin": held, "n": counts[held]})

    return run


def _sides(low: float, scale: float, last: int, next_: int):
    """The largest distance in bin `last` and the smallest one in bin `next_`, with none between them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        below, above = -np.inf, np.inf
        for t in _cell_bins(pdf, low, scale):
            near = t[(t >= last) & (t < next_ + 1)]
            below, above = max(below, near[near < last + 1].max(initial=-np.inf)), min(above, near[near >= next_].min(initial=np.inf))
        return pd.DataFrame({"below": [(below - 1) / scale + low], "above": [(above - 1) / scale + low]})

    return run


def mmd2(left: DataFrame, right: DataFrame, group: str, family: str, features: str) -> DataFrame:
    """(cluster, family, n, d): squared distance of mean features of every cluster and family.

    Means are small (one row per cluster or family), so all their pairs are too.
    """
    a = left.groupBy(F.col(group).alias("cluster")).agg(F.count(F.lit(1)).alias("n"), V.mean_vector(F.col(features)).alias("mu"))
    b = right.groupBy(F.col(family).alias("family")).agg(V.mean_vector(F.col(features)).alias("nu"))
    return a.crossJoin(F.broadcast(b)).select("cluster", "family", "n", V.squared_distance(F.col("mu"), F.col("nu")).alias("d"))


def robust_scale(scores: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Adds d_tilde: d less its family's median, over its interquartile range + eps. Null scores stay null."""
    q = scores.groupBy("family").agg(F.percentile("d", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return scores.join(q, "family").withColumn("d_tilde", (F.col("d") - F.col("q")[1]) / (F.col("q")[2] - F.col("q")[0] + eps)).drop("q")


def relevance_spread(scores: DataFrame, distance: str, tau: float = 1.0, weights: dict | None = None) -> DataFrame:
    """(cluster, abar, u): weighted mean and variance over families of the relevance of a distance.

    Families without a score for a cluster don't count there, and the other weights are scaled up.
    """
    if weights:
        weight = F.coalesce(*(F.when(F.col("family") == f, F.lit(float(w))) for f, w in weights.items()))
    else:
        weight = F.lit(1.0)
    a = scores.where(F.col(distance).isNotNull()).select("cluster", relevance(F.col(distance), tau).alias("a"), weight.alias("w"))
    # Var = E[a^2] - E[a]^2 would cancel; the two-pass form needs one more look at these few rows.
    mean = a.groupBy("cluster").agg((F.sum(F.col("w") * F.col("a")) / F.sum("w")).alias("abar"))
    return a.join(mean, "cluster").groupBy("cluster").agg(F.max("abar").alias("abar"), (F.sum(F.col("w") * F.pow(F.col("a") - F.col("abar"), F.lit(2))) / F.sum("w")).alias("u"))


def gaussian_w2(left: DataFrame, right: DataFrame, group: str, vector: str, dims: int) -> DataFrame:
    """(cluster, n, w): distance of diagonal Gaussians, sqrt(|dmu|^2 + |dsigma|^2); of means alone if either has one row."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    moments = Summarizer.metrics("count", "mean", "std").summary(array_to_vector(F.col(vector)))

    def summed(df: DataFrame, *by) -> DataFrame:
        s = df.groupBy(*by).agg(moments.alias("s"))
        return s.select(*by, F.col("s.count").alias("n"), vector_to_array("s.mean").alias("mu"), vector_to_array("s.std").alias("sd"))

    a = summed(left.withColumn("cluster", F.col(group)), "cluster")
    b = summed(right).select(F.col("n").alias("m"), F.col("mu").alias("mu_b"), F.col("sd").alias("sd_b"))
    both = a.crossJoin(F.broadcast(b))
    spread = F.when((F.col("n") > 1) & (F.col("m") > 1), V.squared_distance(F.col("sd"), F.col("sd_b"))).otherwise(0.0)
    return both.select("cluster", "n", F.sqrt(V.squared_distance(F.col("mu"), F.col("mu_b")) + spread).alias("w"))


def filled_gaps(gaps: DataFrame, least: int = 2) -> DataFrame:
    """(cluster, n, gap): w, or the mean of the valid ones for clusters of fewer rows."""
    valid = gaps.where(F.col("n") >= least).agg(F.avg("w").alias("_m"))
    return gaps.crossJoin(F.broadcast(valid)).select("cluster", "n", F.when(F.col("n") >= least, F.col("w")).otherwise(F.coalesce("_m", F.lit(0.0))).alias("gap"))


def ordered(df: DataFrame, keys: list[str], value: str, tie: str | None = None) -> DataFrame:
    """Adds _i, the rank of value under its keys from 1 on, _n, how many there are, and _before, the sum of those before.

    Rows are range-partitioned by (keys, value, tie) and numbered inside a partition; counts and sums of partitions, one
    row per partition and key it holds, give the offsets. So no key has to fit one task, nor does a value if tie tells
    its rows apart. Rows are kept: both uses must see the same partitions.
    """
    inside = [value, *([tie] if tie else [])]
    ranged = df.repartitionByRange(*keys, *inside).withColumn("_part", F.spark_partition_id()).persist()
    held = ranged.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_c"), F.sum(value).alias("_t"))
    group = Window.partitionBy(*keys)
    so_far = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c, none, over: F.coalesce(F.sum(c).over(over), F.lit(none))
    offsets = held.select("_part", *keys, start("_c", 0, so_far).alias("_c0"), start("_t", 0.0, so_far).alias("_t0"), F.sum("_c").over(group).alias("_n"))
    place = Window.partitionBy("_part", *keys).orderBy(*inside)
    earlier = place.rowsBetween(Window.unboundedPreceding, -1)
    numbered = ranged.join(offsets, ["_part", *keys])
    return numbered.select(*df.columns, (F.col("_c0") + F.row_number().over(place)).alias("_i"), "_n", (F.col("_t0") + start(value, 0.0, earlier)).alias("_before"))


def w2_1d(left: DataFrame, right: DataFrame, keys: list[str], value: str, shared: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """(keys, w2): exact squared 2-Wasserstein distance of two sets of numbers per key, of any sizes. Rows without a value
    don't count; keys that one side lacks are left out.

    shared names the keys that the right side has, if it hasn't all of them: it is then ordered once, whatever the number
    of other keys. With quantile functions f and g, the distance is mean(f^2) + mean(g^2) - 2 int f g, and f is a step of
    width 1/n for each number x of the left side: the last integral is the sum of x (G(i/n) - G((i-1)/n)), where G, the
    running integral of g, is known at every number of the right side. So each number looks up two places there: a join
    on the place, never a product of the two sides. n times m must be below 2^63.
    """
    shared = keys if shared is None else shared
    left, right = left.where(F.col(value).isNotNull()), right.where(F.col(value).isNotNull())
    whole = right.groupBy(*shared).agg(F.count(F.lit(1)).alias("_m"), F.avg(value).alias("_mean"), F.var_pop(value).alias("_var"))
    steps = ordered(right, shared, value, tie).select(*shared, (F.col("_i") - 1).alias("_j"), F.col(value).alias("_y"), F.col("_before").alias("_sum"))
    side = lambda at, sign: F.struct(at.alias("at"), F.lit(sign).alias("sign"))
    ends = ordered(left, keys, value, tie).select(*keys, F.col(value).alias("_x"), "_n", F.explode(F.array(side(F.col("_i"), 1.0), side(F.col("_i") - 1, -1.0))).alias("_e"))
    at = ends.join(whole, shared).withColumn("_j", F.expr("(_e.at * _m) DIV _n"))
    found = at.join(steps, [*shared, "_j"], "left")  # none at the end, where G is the mean
    # All numbers less the right side's mean: so little as possible cancels out.
    part = (F.expr("(_e.at * _m) % _n") / F.col("_n")) * (F.col("_y") - F.col("_mean"))
    g = F.coalesce((F.col("_sum") - F.col("_j") * F.col("_mean") + part) / F.col("_m"), F.lit(0.0))
    x = F.col("_x") - F.col("_mean")
    square = F.when(F.col("_e.sign") > 0, x * x / F.col("_n")).otherwise(0.0)
    sums = found.groupBy(*keys).agg(F.sum(square - 2 * F.col("_e.sign") * x * g).alias("_w"), F.max("_var").alias("_var"))
    return sums.select(*keys, F.greatest(F.lit(0.0), F.col("_w") + F.col("_var")).alias("w2"))


def grid_w2(left: DataFrame, right: DataFrame, keys: list[str], value: str, most: int = 256, shared: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """(keys, w2): mean squared difference of quantiles on a grid of min(n, m, most) points, positions rounded down. shared
    names the keys of the right side, if it hasn't all of them."""
    shared = keys if shared is None else shared
    sizes = lambda df, by, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    grid = sizes(left, keys, "_n").join(sizes(right, shared, "_m"), shared).withColumn("_g", F.least("_n", "_m", F.lit(most)))
    grid = grid.select(*keys, "_n", "_m", "_g", F.explode(F.sequence(F.lit(0), F.col("_g").cast("int") - 1)).alias("_k"))
    # floor(k (n - 1) / (g - 1)) in whole numbers
    at = lambda size: F.when(F.col("_g") > 1, F.expr(f"(_k * ({size} - 1)) DIV (_g - 1)")).otherwise(F.lit(0)).cast("long")
    grid = grid.select(*keys, "_k", at("_n").alias("_i"), at("_m").alias("_j"))
    ranked = lambda df, by, name, r: ordered(df, by, value, tie).select(*by, F.col(value).alias(name), (F.col("_i") - 1).alias(r))
    both = grid.join(ranked(left, keys, "_x", "_i"), [*keys, "_i"]).join(ranked(right, shared, "_y", "_j"), [*shared, "_j"])
    return both.groupBy(*keys).agg(F.avg(F.pow(F.col("_x") - F.col("_y"), F.lit(2))).alias("w2"))


def guarded_correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation, 0 where a side has no spread."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def summary(value: Column) -> list[Column]:
    """Aggregates least, median, most, mean, std, cv; 0 for an empty set, std and cv 0 for a single value."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        zero(F.min(value)).alias("least"), zero(F.percentile(value, 0.5)).alias("median"), zero(F.max(value)).alias("most"),
        zero(F.avg(value)).alias("mean"), zero(F.stddev_samp(value)).alias("std"), zero(F.try_divide(F.stddev_samp(value), F.avg(value))).alias("cv"),
    ]


def average_rank(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds the rank of value in its group, ties sharing the mean of their places."""
    w = Window.partitionBy(*keys)
    return df.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2.0)


def principal(df: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components as rows, shares of variance, mean) of the first k principal components; of a component the entry that is
    largest in size is positive. What is collected depends on the dimensions alone."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    x = df.select(array_to_vector(F.col(vector)).alias("x"))
    model = PCA(k=k, inputCol="x", outputCol="y").fit(x)
    parts = model.pc.toArray().T
    signs = np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])
    mean = np.array(df.agg(V.mean_vector(F.col(vector))).first()[0])
    return parts * signs[:, None], model.explainedVariance.toArray(), mean


def principal_coordinates(df: DataFrame, vector: str, k: int) -> DataFrame:
    """Adds coordinates, of the vectors less their mean on the first k principal components."""
    parts, _, mean = principal(df, vector, k)
    shift = F.array(*(F.lit(float(v)) for v in parts @ mean))
    return df.withColumn("coordinates", F.zip_with(V.project(parts)(F.col(vector)), shift, lambda a, b: a - b))


def wilson(share: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """(low, high) of the Wilson interval, in percent, of a share in percent over n trials; null if n <= 0."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share / 100.0))
    whole = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / whole
    half = z / whole * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    ok = n > 0
    return F.when(ok, F.round(100 * (mid - half), 2)), F.when(ok, F.round(100 * (mid + half), 2))


def bootstrap_interval(df: DataFrame, value: str, position: str, n: int, resamples: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """(low, high): percentile interval of the mean of a value over hashed resamples; nulls without a row. Rows position
    must run from 0 to n - 1.

    A draw is never a row: some resamples at a time are a task, which has all values in the order of positions and
    works out draws as arrays. Values are sent to each executor compressed (hits, 0 or 1, in less than a bit each,
    as a rule); a task holds eight bytes of each.
    """
    spark = df.sparkSession
    block, step = 1 << 16, -(-resamples // 48)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_p")
        return pd.DataFrame({"at": [int(pdf["_p"].iloc[0])], "data": [zlib.compress(pdf["_v"].to_numpy(float).tobytes())]})

    def means(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (r for pdf in batches for r in pdf.itertuples()):
            held = np.concatenate([np.frombuffer(zlib.decompress(x["data"])) for x in row.held])
            for b in range(row.id, min(row.id + step, resamples)):
                total = sum(held[np.floor(n * u).astype(np.int64)].sum() for u in rng.uniforms_of(f"{seed}:{b}:", n))
                yield pd.DataFrame({"m": [total / n]})

    dealt = df.select(F.col(position).alias("_p"), F.col(value).cast("double").alias("_v")).groupBy(F.floor(F.col("_p") / block).alias("_b"))
    packed = dealt.applyInPandas(pack, "at long, data binary").agg(F.sort_array(F.collect_list(F.struct("at", "data"))).alias("held"))
    chunks = spark.range(0, resamples if n else 0, step, -(-resamples // step))
    m = chunks.crossJoin(F.broadcast(packed)).mapInPandas(means, "m double")
    q = m.agg(F.percentile("m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    return q.select(F.round(F.col("q")[0], 4).alias("low"), F.round(F.col("q")[1], 4).alias("high"))
