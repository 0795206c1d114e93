"""Clusters: sizes, centroids, nearest-centroid assignment, Lloyd iterations, neighbours inside clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rng, vectors as V

#: Scores are compared after rounding to so many places, so that ties are ties in any order of summation.
PLACES = 9


def cluster_sizes(df: DataFrame, cluster: str, k: int) -> DataFrame:
    """(cluster, n) for clusters 0..k-1, empty ones included; negative and null cluster ids are left out."""
    counts = df.where(F.col(cluster) >= 0).groupBy(F.col(cluster).cast("long").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(k).select(F.col("id").alias("cluster")).join(counts, "cluster", "left").select(F.col("cluster").cast("int"), F.coalesce("n", F.lit(0)).alias("n"))


def centroids(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, n, centroid): the normalised mean of each cluster's vectors."""
    means = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("n"), V.mean_vector(F.col(vector)).alias("centroid"))
    return means.withColumn("centroid", V.l2(F.col("centroid")))


def nearest(choices: dict[int, tuple[list[int], np.ndarray]]):
    """Scalar pandas function of (vector, group): the id of the group's row with the largest dot product, by one matrix
    product per batch and group; ties: the smallest id. choices: ids in rising order and their vectors, per group."""

    @F.pandas_udf("int")
    def pick(vector: pd.Series, group: pd.Series) -> pd.Series:
        out = np.zeros(len(vector), np.int32)
        for g, rows in group.groupby(group).indices.items():
            ids, m = choices[int(g)]
            out[rows] = np.array(ids)[np.argmax(np.round(V.to_matrix(vector.iloc[rows]) @ m.T, PLACES), axis=1)]
        return pd.Series(out)

    return pick


def assign(df: DataFrame, vector: str, cents: DataFrame, name: str = "cluster") -> DataFrame:
    """Adds the nearest centroid's id. cents (cluster, centroid) has one row per cluster: a bounded table."""
    rows = sorted((int(r.cluster), list(r.centroid)) for r in cents.select("cluster", "centroid").collect())
    choices = {0: ([i for i, _ in rows], np.array([v for _, v in rows]))}
    return df.withColumn(name, nearest(choices)(F.col(vector), F.lit(0)))


def lloyd(df: DataFrame, key: str, vector: str, k: int, rounds: int, seed: str, group: str | None = None) -> DataFrame:
    """Spherical k-means from a fixed start, inside each group if one is named: df with a column cluster (0..k-1).

    The start of a group is its first k vectors by a hash of seed and key. A cluster that gets no vector keeps its
    centroid. Rows never move: each round maps rows against the centroids of their group (k per group, sent out
    with the function) and adds up vectors per cluster (partial sums first), whatever the sizes of groups are.
    """
    base = df.withColumn("_g", F.col(group).cast("int") if group else F.lit(0)).persist()
    w = Window.partitionBy("_g").orderBy(F.md5(rng.keyed(seed, key)), key)
    start = base.select("_g", key, vector, F.row_number().over(w).alias("_r")).where(F.col("_r") <= k).collect()
    cents = {(r["_g"], r["_r"] - 1): np.array(r[vector]) for r in start}

    def assigned() -> DataFrame:
        groups = sorted({g for g, _ in cents})
        ids = {g: sorted(c for h, c in cents if h == g) for g in groups}
        choices = {g: (ids[g], np.stack([cents[(g, c)] for c in ids[g]])) for g in groups}
        return base.withColumn("cluster", nearest(choices)(F.col(vector), F.col("_g")))

    for _ in range(rounds):
        means = assigned().groupBy("_g", "cluster").agg(V.mean_vector(F.col(vector)).alias("m"))
        for r in means.collect():  # k rows per group
            m = np.array(r.m)
            cents[(r["_g"], r.cluster)] = m / (np.linalg.norm(m) + 1e-12)
    return assigned().drop("_g")


def closest(cents: np.ndarray):
    """Scalar pandas function of a vector: the row of cents at the least squared distance, ties: the first."""

    @F.pandas_udf("int")
    def pick(vector: pd.Series) -> pd.Series:
        if not len(vector):
            return pd.Series([], dtype=np.int32)
        x = V.to_matrix(vector)
        d = (x * x).sum(axis=1)[:, None] + (cents * cents).sum(axis=1) - 2 * x @ cents.T
        return pd.Series(np.argmin(np.round(d, PLACES), axis=1).astype(np.int32))

    return pick


def minibatch(df: DataFrame, key: str, vector: str, k: int, rounds: int, seed: str, batch: int = 4096, starts: int = 3, reassign: float = 0.01) -> DataFrame:
    """Euclidean k-means by mini-batches: df with a column cluster (0..k-1). No row with a null vector may be among them.

    A round draws each row with probability batch / n, by a hash of seed, round and key, and moves each centroid to the
    mean of all vectors it has been given so far. Before, the best of some starts, each the first k vectors by a hash, is
    chosen by its squared distances in the first batch. A centroid with less than the share reassign of the largest
    count goes to a drawn vector, the first ones by key, with the least count of the others. Rows don't move; the driver
    holds k centroids. Fewer rows than k give as many clusters.
    """
    base = df.persist()
    n = base.count()
    if not n:
        base.unpersist()
        return df.withColumn("cluster", F.lit(0))
    share = min(1.0, batch / n)
    drawn = lambda t: base.where(rng.uniform(rng.keyed(seed, F.lit(t), key)) < share)

    def start(s: int) -> np.ndarray:
        first = base.orderBy(F.md5(rng.keyed(f"{seed}-{s}", key)), key).limit(k).select(vector).collect()
        return np.array([r[0] for r in first], float)

    def inertia(cents: np.ndarray) -> float:
        own = F.element_at(F.lit(cents.tolist()), closest(cents)(F.col(vector)) + 1)
        return drawn(0).agg(F.sum(V.squared_distance(F.col(vector), own))).first()[0] or 0.0

    options = [start(s) for s in range(starts)]
    cents = options[0] if starts == 1 else min(options, key=inertia)
    counts = np.zeros(len(cents))
    for t in range(rounds):
        means = drawn(t).groupBy(closest(cents)(F.col(vector)).alias("c")).agg(F.count(F.lit(1)).alias("n"), V.mean_vector(F.col(vector)).alias("m")).collect()
        for r in means:
            cents[r.c] = (cents[r.c] * counts[r.c] + np.array(r.m) * r.n) / (counts[r.c] + r.n)
            counts[r.c] += r.n
        low = np.flatnonzero(counts < reassign * counts.max())
        if len(low) and len(low) < len(counts):
            fresh = drawn(t).orderBy(key).limit(len(low)).select(vector).collect()
            for c, r in zip(low, fresh):
                cents[c] = np.array(r[0])
            counts[low] = np.delete(counts, low).min()
    return base.withColumn("cluster", closest(cents)(F.col(vector)))


#: Scores that are worked out at a time, and how many of them share one maximum in the search for the k-th largest.
TILE, RUN = 1 << 19, 32


def _top_of_blocks(k: int, vector: str):
    """The k best rows of the right side for each of the left. The k-th largest maximum of runs of scores has k scores not
    below it, so only scores from there on, less what rounding may change, are rounded and put in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.half == 0], pdf[pdf.half == 1].sort_values("pair_id")
        found = []
        if len(left) and len(right):
            a, b = left.pair_id.to_numpy(), right.pair_id.to_numpy()
            x, y = V.to_matrix(left[vector]), V.to_matrix(right[vector])
            (x, a), (y, b) = ((m[fit], ids[fit]) for m, ids in ((x, a), (y, b)) for fit in [np.isfinite(m).all(axis=1)])
            runs, step = len(b) // RUN, max(1, TILE // max(1, len(b)))
            enough, y = k + 1, y.T.copy()  # one more: the row itself may be among them
            for lo in range(0, len(a) if len(b) else 0, step):
                s = x[lo : lo + step] @ y
                if runs > k:
                    most = s[:, : RUN * runs].reshape(len(s), RUN, runs).max(axis=1)
                    least = np.partition(most, runs - enough, axis=1)[:, runs - enough] - 2 * 10.0**-PLACES
                    i, j = np.divmod(np.flatnonzero(s >= least[:, None]), len(b))
                else:
                    i, j = (c.ravel() for c in np.indices(s.shape))
                other = a[lo + i] != b[j]
                i, j = i[other], j[other]
                score = np.round(s[i, j], PLACES)
                order = np.lexsort((j, -score, i))
                i, j, score = i[order], j[order], score[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < k
                found.append(pd.DataFrame({"pair_id": a[lo + i[best]], "neighbour": b[j[best]], "score": score[best]}))
        return pd.concat(found) if found else pd.DataFrame({"pair_id": [], "neighbour": [], "score": []})

    return run


def knn_within(df: DataFrame, cluster: str, vector: str, k: int, block_rows: int = 8192) -> DataFrame:
    """(pair_id, neighbour, rank): the k nearest rows of the same cluster by dot product, itself left out.

    A cluster is dealt into blocks of about block_rows rows by a hash; each pair of blocks is a task of its own
    that keeps k neighbours per row, and a window picks k of these. So no cluster has to fit one task.
    """
    nb = df.groupBy(F.col(cluster).alias("_c")).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_nb"))
    rows = df.select(F.col(cluster).alias("_c"), "pair_id", vector).join(nb, "_c")
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("pair_id"), F.col("_nb")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))
    left = rows.select("_c", F.col("_b").alias("_x"), every.alias("_y"), F.lit(0).alias("half"), "pair_id", vector)
    right = rows.select("_c", every.alias("_x"), F.col("_b").alias("_y"), F.lit(1).alias("half"), "pair_id", vector)
    tops = left.unionByName(right).groupBy("_c", "_x", "_y").applyInPandas(_top_of_blocks(k, vector), "pair_id long, neighbour long, score double")
    w = Window.partitionBy("pair_id").orderBy(F.desc("score"), "neighbour")
    return tops.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("pair_id", "neighbour", "rank")
