"""Whole-number budgets: capped largest remainders and what builds on them.

Budgets are per cluster, so these tables have one row per cluster. Each function works on one set of bins or, with
`group`, on one set per group (the coarse clusters, say, whose fine clusters share its budget).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(weights: list[float], total: int) -> list[float]:
    s = sum(weights)
    return [_whole_safe(total * w / s) if s > 0 else 0.0 for w in weights]


def _whole_safe(x: float) -> float:
    """Rounded to nine places, so that a share which is a whole number but for rounding is one."""
    return round(float(x), 9)


def largest_remainder(targets: list[float], caps: list[int], total: int, guard: bool = False) -> list[int]:
    """Floors of targets within caps, then single units by remainder, then by what a cap leaves free.

    guard: stop after as many looks at bins as 10 per bin, the units left and 10 together, though units be left.
    Without it units go on to free bins until none is left or all bins are full. If the floors alone reach the
    total, they stand.
    """
    target, cap = np.array(targets, float), np.array(caps, np.int64)
    base = np.minimum(np.floor(target).astype(np.int64), cap)
    left = int(total) - int(base.sum())
    if left <= 0:
        return base.tolist()
    order = np.argsort(-(target - np.floor(target)), kind="stable")
    looks = 10 * len(base) + left + 11 if guard else None
    while left > 0 and len(order) and (looks is None or looks > 0) and (base < cap).any():
        seen = order if looks is None else order[:looks]
        free = seen[base[seen] < cap[seen]]
        # As many whole passes as every free bin can take part in, or the beginning of one.
        passes = 1 if looks is not None or left < len(free) else min(left // len(free), int((cap - base)[free].min()))
        given = free[:left] if passes == 1 else free
        base[given] += passes
        left -= passes * len(given)
        looks = None if looks is None else looks - len(order)
        order = np.argsort(base - cap, kind="stable")
    return base.tolist()


def water_fill(weights: list[float], caps: list[int], total: int) -> list[int]:
    """Exactly total units, in rounds: what is left is shared by the weights of the bins that aren't full (by their
    free room, where these weights are all zero), rounded down and capped; then each of these bins that still has
    room gets one more, the largest remainders first, as long as units last. Negative input or too small caps raise
    ValueError."""
    w, cap = np.array(weights, float), np.array(caps, np.int64)
    if total < 0 or (cap < 0).any() or (w < 0).any():
        raise ValueError("weights, caps and total must not be negative")
    if total > cap.sum():
        raise ValueError(f"total {total} is more than the caps hold ({cap.sum()})")
    out = np.zeros(len(cap), np.int64)
    while (left := int(total) - int(out.sum())) > 0:
        live = np.flatnonzero(out < cap)
        part = w[live] if w[live].sum() > 0 else (cap - out)[live].astype(float)
        want = np.round(left * part / part.sum(), 9)
        whole = np.floor(want)
        out[live] += np.minimum(whole.astype(np.int64), (cap - out)[live])
        by_rest = live[np.argsort(whole - want, kind="stable")]
        out[by_rest[out[by_rest] < cap[by_rest]][: int(total) - int(out.sum())]] += 1
    return out.tolist()


def allocation_scores(n: Column, abar: Column, u: Column, alpha: float = 0.5, beta: float = 1.0, eta: float = 1.0) -> Column:
    """n^alpha (1 + beta abar + eta u); null parts count 0; empty clusters get 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.when(n > 0, F.pow(n.cast("double"), F.lit(alpha)) * (1 + beta * zero(abar) + eta * zero(u))).otherwise(0.0)


def per_group(df: DataFrame, group: str | None, key: str, out: str, rule) -> DataFrame:
    """Adds the integer column out: rule(rows of one group, ordered by key) -> list of budgets. Rows are clusters."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable")
        return pdf.assign(**{out: pd.Series(rule(pdf), index=pdf.index, dtype="int64")})

    return df.groupBy(*([group] if group else [])).applyInPandas(run, schema)


def proportional(df: DataFrame, n: str, key: str, total: int | str, out: str = "budget", group: str | None = None) -> DataFrame:
    """Budgets in proportion to sizes n, in whole numbers: floors, then one more by remainder, ties by key.

    total is a number, or a column with the group's own. Caps are the sizes; they hold because a total above the
    group's size counts as that size.
    """
    w = Window.partitionBy(*([group] if group else [F.lit(0)]))
    budget = F.least(F.lit(total).cast("long") if isinstance(total, int) else F.col(total).cast("long"), F.sum(n).over(w))
    s = df.withColumn("_all", F.sum(n).over(w)).withColumn("_t", budget)
    s = s.withColumn("_f", F.when(F.col("_all") > 0, F.expr(f"(`{n}` * _t) DIV _all")).otherwise(F.lit(0)).cast("long"))
    s = s.withColumn("_r", F.when(F.col("_all") > 0, F.expr(f"(`{n}` * _t) % _all")).otherwise(F.lit(0)))
    place = F.row_number().over(w.orderBy(F.desc("_r"), key))
    more = place <= F.col("_t") - F.sum("_f").over(w)
    return s.withColumn(out, F.col("_f") + more.cast("long")).drop("_all", "_t", "_f", "_r")


def gap_weights(n: str, gap: str, alpha: float):
    """Weights n^alpha (1 + gap / mean gap) of a pandas frame; without any gap, n^alpha."""

    def weigh(pdf: pd.DataFrame) -> list[float]:
        mean = float(pdf[gap].mean()) if len(pdf) else 0.0
        scale = pdf[gap] / mean if mean > 0 else pdf[gap] * 0
        return [float(a) ** alpha * (1 + float(g)) if a > 0 else 0.0 for a, g in zip(pdf[n], scale)]

    return weigh


def by_gap(df: DataFrame, n: str, gap: str, key: str, total: int, alpha: float = 0.5, out: str = "budget") -> DataFrame:
    """Budgets that grow with a cluster's distance: water-filling by n^alpha (1 + gap / mean gap), capped by n."""
    weigh = gap_weights(n, gap, alpha)
    return per_group(df, None, key, out, lambda pdf: water_fill(weigh(pdf), pdf[n].tolist(), total))


def by_score(df: DataFrame, score: str, cap: str, key: str, total: int, out: str = "budget") -> DataFrame:
    """Capped largest remainders of total shared by score."""
    return per_group(df, None, key, out, lambda pdf: largest_remainder(shares(pdf[score].tolist(), total), pdf[cap].tolist(), total))


def split_fine(df: DataFrame, group: str, n: str, total: str, key: str, out: str = "fine_budget", exact: bool = False) -> DataFrame:
    """A coarse budget (column total, the same on all rows of a group) shared by its fine clusters in proportion to size.

    exact: by water-filling, which gives out the whole budget or raises; else by capped largest remainders.
    """

    def rule(pdf: pd.DataFrame) -> list[int]:
        sizes, budget = pdf[n].tolist(), int(pdf[total].iloc[0])
        return water_fill([float(x) for x in sizes], sizes, budget) if exact else largest_remainder(shares(sizes, budget), sizes, budget)

    return per_group(df, group, key, out, rule)
