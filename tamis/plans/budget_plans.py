"""Budgets: scores turned into whole numbers of rows per cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import apportion as A
from ..operators.stats import filled_gaps, guarded_correlation
from ..sources.pairs import pairs, table
from .base import Registry
from .stat_plans import GAPS_SQL, LINES_SQL, SPREAD_SQL, gaussian_gaps, sliced, spread

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: Rows to select by score (caps bind) and by gap; weight of disagreement.
TOTAL, GAP_TOTAL, ETA = 300, 100, 0.5


def clr_sql(tag: str, targets: str, total: str) -> str:
    """Capped largest remainders, pass by pass: targets has (grp, bin, t, cap), total is an expression on grp's row."""
    return f"""{tag}_p(grp, bin, base, cap, rem, tot, pass) AS (
  SELECT grp, bin, least(CAST(floor(t) AS BIGINT), cap), cap, t - floor(t), CAST({total} AS BIGINT), 0 FROM {targets}
  UNION ALL
  SELECT grp, bin, base + CASE WHEN base < cap AND place <= tot - taken THEN 1 ELSE 0 END, cap, rem, tot, pass + 1 FROM (
    SELECT *, sum(base) OVER (PARTITION BY grp) AS taken, max(cap - base) OVER (PARTITION BY grp) AS free,
      row_number() OVER (PARTITION BY grp ORDER BY base < cap DESC, CASE WHEN pass = 0 THEN rem ELSE cap - base END DESC, bin) AS place FROM {tag}_p) s
  WHERE taken < tot AND free > 0),
{tag} AS MATERIALIZED (SELECT grp, bin, max_by(base, pass) AS budget FROM {tag}_p GROUP BY grp, bin)"""


def fill_sql(tag: str, weights: str, total: str) -> str:
    """Water-filling, round by round: weights has (grp, bin, w, cap)."""
    return f"""{tag}_p(grp, bin, w, cap, base, tot, pass) AS (
  SELECT grp, bin, CAST(w AS DOUBLE), cap, CAST(0 AS BIGINT), CAST({total} AS BIGINT), 0 FROM {weights}
  UNION ALL
  SELECT grp, bin, w, cap, base + give + CASE WHEN base + give < cap AND place <= tot - taken - gives THEN 1 ELSE 0 END, tot, pass + 1 FROM (
    SELECT *, sum(give) OVER (PARTITION BY grp) AS gives, row_number() OVER (PARTITION BY grp ORDER BY base + give < cap DESC, want - floor(want) DESC, bin) AS place FROM (
      SELECT *, least(CAST(floor(want) AS BIGINT), cap - base) AS give FROM (
        SELECT *, round((tot - taken) * part / sum(part) OVER (PARTITION BY grp), 9) AS want FROM (
          SELECT *, CASE WHEN base >= cap THEN 0 WHEN mass > 0 THEN w ELSE CAST(cap - base AS DOUBLE) END AS part FROM (
            SELECT *, sum(base) OVER (PARTITION BY grp) AS taken, sum(CASE WHEN base < cap THEN w END) OVER (PARTITION BY grp) AS mass FROM {tag}_p))))) s
  WHERE taken < tot),
{tag} AS MATERIALIZED (SELECT grp, bin, max_by(base, pass) AS budget FROM {tag}_p GROUP BY grp, bin)"""


def scores_sql(alpha: float = 0.5, beta: float = 1.0, eta: float = ETA) -> str:
    return f"scored AS MATERIALIZED (SELECT cluster, n, abar, u, pow(n, {alpha}) * (1 + {beta} * abar + {eta} * u) AS s FROM spread)"


def scored(spark: SparkSession, d: str, alpha: float = 0.5, beta: float = 1.0, eta: float = ETA) -> DataFrame:
    s = spread(spark, d)
    return s.withColumn("s", A.allocation_scores(F.col("n"), F.col("abar"), F.col("u"), alpha, beta, eta))


TARGETS_SQL = f"{SPREAD_SQL}, {scores_sql()}, tgt AS (SELECT 0 AS grp, cluster AS bin, round({TOTAL} * s / sum(s) OVER (), 9) AS t, n AS cap FROM scored), {clr_sql('clr', 'tgt', str(TOTAL))}"
FINE_SQL = """fine_n AS (SELECT coarse, fine, count(*) AS n FROM pairs GROUP BY coarse, fine)"""


@R.add(f"WITH {SPREAD_SQL}, {scores_sql()} SELECT cluster, n, round(s, 6) AS s FROM scored")
def allocation_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("cluster", "n", F.round("s", 6).alias("s"))


@R.add(f"WITH RECURSIVE {TARGETS_SQL} SELECT cluster, n, round(abar, 6) AS abar, round(u, 6) AS u, round(s, 6) AS s, budget FROM scored JOIN clr ON bin = cluster")
def allocate_v3(spark: SparkSession, d: str) -> DataFrame:
    """From pairs and proxies to budgets: features, MMD, scaling, relevance, scores, capped largest remainders."""
    b = A.by_score(scored(spark, d).select("cluster", "n", "abar", "u", "s"), "s", "n", "cluster", TOTAL)
    return b.select("cluster", "n", *(F.round(c, 6).alias(c) for c in ("abar", "u", "s")), "budget")


@R.add(f"""WITH RECURSIVE g AS (SELECT l_suppkey AS bin, count(*) AS cap, sum(l_quantity) AS w FROM lineitem GROUP BY 1),
tgt AS (SELECT 0 AS grp, bin, round((SELECT count(*) // 2 FROM lineitem) * w / sum(w) OVER (), 9) AS t, cap FROM g), {clr_sql('clr', 'tgt', '(SELECT count(*) // 2 FROM lineitem)')}
SELECT bin AS l_suppkey, budget FROM clr""")
def clr_v3(spark: SparkSession, d: str) -> DataFrame:
    """Half of all line items, shared by suppliers in proportion to their quantities."""
    li = table(spark, d, "lineitem")
    g = li.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("cap"), F.sum("l_quantity").alias("w"))
    return A.by_score(g, "w", "cap", "l_suppkey", li.count() // 2).select("l_suppkey", "budget")


@R.add(f"""WITH RECURSIVE g AS (SELECT 0 AS grp, l_suppkey AS bin, CAST(ceil(count(*) * 0.7) AS BIGINT) AS cap, pow(sum(l_quantity), 2) AS w FROM lineitem GROUP BY 2),
{fill_sql('wf', 'g', '(SELECT count(*) // 2 FROM lineitem)')} SELECT bin AS l_suppkey, budget FROM wf""")
def clr_waterfill(spark: SparkSession, d: str) -> DataFrame:
    """The same total by water-filling, with steeper weights and tighter caps."""
    li = table(spark, d, "lineitem")
    g = li.groupBy("l_suppkey").agg(F.ceil(F.count(F.lit(1)) * F.lit(0.7)).cast("long").alias("cap"), F.pow(F.sum("l_quantity"), F.lit(2)).alias("w"))
    total = li.count() // 2
    return A.per_group(g, None, "l_suppkey", "budget", lambda pdf: A.water_fill(pdf.w.tolist(), pdf.cap.tolist(), total)).select("l_suppkey", "budget")


PROP_SQL = """{tag} AS MATERIALIZED (SELECT grp, bin, f + CASE WHEN row_number() OVER (PARTITION BY grp ORDER BY r DESC, bin) <= t - sum(f) OVER (PARTITION BY grp) THEN 1 ELSE 0 END AS budget
  FROM (SELECT grp, bin, t, n * t // s AS f, n * t % s AS r FROM (SELECT grp, bin, n, CAST(sum(n) OVER (PARTITION BY grp) AS BIGINT) AS s, CAST(least({total}, sum(n) OVER (PARTITION BY grp)) AS BIGINT) AS t FROM {source})))"""


def prop_sql(tag: str, source: str, total: str) -> str:
    return PROP_SQL.format(tag=tag, source=source, total=total)


@R.add(f"WITH g AS (SELECT 0 AS grp, l_returnflag || l_linestatus || l_linenumber AS bin, count(*) AS n FROM lineitem GROUP BY 2), {prop_sql('pr', 'g', '1000')} SELECT bin AS stratum, CAST(budget AS BIGINT) AS budget FROM pr")
def budgets_proportional(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    return A.proportional(g, "n", "stratum", 1000).select("stratum", "budget")


AWARE_SQL = f"""{GAPS_SQL}, ww AS (SELECT 0 AS grp, cluster AS bin, sqrt(n) * (1 + gap / avg(gap) OVER ()) AS w, n AS cap FROM gaps), {fill_sql('aware', 'ww', str(GAP_TOTAL))}"""


def gap_budgets(spark: SparkSession, d: str, total: int = GAP_TOTAL) -> DataFrame:
    return A.by_gap(filled_gaps(gaussian_gaps(spark, d)), "n", "gap", "cluster", total)


@R.add(f"WITH RECURSIVE {AWARE_SQL} SELECT bin AS cluster, budget FROM aware")
def budgets_w_aware(spark: SparkSession, d: str) -> DataFrame:
    return gap_budgets(spark, d).select("cluster", "budget")


def fine_sizes(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).groupBy(F.col("coarse").alias("cluster"), "fine").agg(F.count(F.lit(1)).alias("n"))


SPLIT_SQL = f"""{TARGETS_SQL}, {FINE_SQL}, ft AS (SELECT coarse AS grp, fine AS bin, round(budget * f.n / sum(f.n) OVER (PARTITION BY coarse), 9) AS t, f.n AS cap, budget FROM fine_n f JOIN clr ON clr.bin = coarse), {clr_sql('fclr', 'ft', 'budget')}"""


def v3_fine(spark: SparkSession, d: str) -> DataFrame:
    b = A.by_score(scored(spark, d).select("cluster", "n", "s"), "s", "n", "cluster", TOTAL).select("cluster", "budget")
    return A.split_fine(fine_sizes(spark, d).join(b, "cluster"), "cluster", "n", "budget", "fine")


@R.add(f"WITH RECURSIVE {SPLIT_SQL} SELECT grp AS cluster, bin AS fine, budget AS fine_budget FROM fclr")
def split_fine_v3(spark: SparkSession, d: str) -> DataFrame:
    return v3_fine(spark, d).select("cluster", "fine", "fine_budget")


SW_AWARE_SQL = f"""{LINES_SQL}, sww AS (SELECT 0 AS grp, cluster AS bin, sqrt(n) * (1 + w / avg(w) OVER ()) AS w, n AS cap FROM sw), {fill_sql('sbud', 'sww', str(GAP_TOTAL))}, {FINE_SQL},
fw AS (SELECT coarse AS grp, fine AS bin, f.n AS w, f.n AS cap, budget FROM fine_n f JOIN sbud ON sbud.bin = coarse WHERE budget > 0), {fill_sql('fbud', 'fw', 'budget')}"""


def v21_fine(spark: SparkSession, d: str) -> DataFrame:
    gaps = filled_gaps(sliced(spark, d), least=1)
    b = A.by_gap(gaps, "n", "gap", "cluster", GAP_TOTAL).where("budget > 0").select("cluster", "budget")
    return A.split_fine(fine_sizes(spark, d).join(b, "cluster"), "cluster", "n", "budget", "fine", exact=True)


@R.add(f"WITH RECURSIVE {SW_AWARE_SQL} SELECT grp AS cluster, bin AS fine, budget AS fine_budget FROM fbud")
def split_fine_v21(spark: SparkSession, d: str) -> DataFrame:
    return v21_fine(spark, d).select("cluster", "fine", "fine_budget")


def shift(aware: DataFrame) -> DataFrame:
    """One row: how far budgets by gaps (cluster, n, budget) lie from proportional ones."""
    aware = aware.persist()
    plain = A.proportional(aware.select("cluster", "n"), "n", "cluster", GAP_TOTAL, "plain")
    both = aware.join(plain.select("cluster", "plain"), "cluster")
    diff = F.abs(F.col("budget") - F.col("plain"))
    return both.agg(F.sum("plain").alias("proportional"), F.sum("budget").alias("shifted"), F.sum(diff).alias("l1"), F.max(diff).alias("most"), F.count_if(diff > 0).alias("bins"))


@R.add(f"""WITH RECURSIVE {AWARE_SQL}, sz AS (SELECT 0 AS grp, cluster AS bin, n FROM gaps), {prop_sql('pr', 'sz', str(GAP_TOTAL))}
SELECT CAST(sum(p.budget) AS BIGINT) AS proportional, CAST(sum(a.budget) AS BIGINT) AS shifted, CAST(sum(abs(a.budget - p.budget)) AS BIGINT) AS l1, CAST(max(abs(a.budget - p.budget)) AS BIGINT) AS most, count(*) FILTER (a.budget <> p.budget) AS bins FROM aware a JOIN pr p USING (bin)""")
def budget_shift(spark: SparkSession, d: str) -> DataFrame:
    return shift(gap_budgets(spark, d))


@R.add(f"""WITH RECURSIVE {SW_AWARE_SQL}, sz AS (SELECT 0 AS grp, cluster AS bin, n FROM sw), {prop_sql('pr', 'sz', str(GAP_TOTAL))}
SELECT CAST(sum(p.budget) AS BIGINT) AS proportional, CAST(sum(a.budget) AS BIGINT) AS shifted, CAST(sum(abs(a.budget - p.budget)) AS BIGINT) AS l1, CAST(max(abs(a.budget - p.budget)) AS BIGINT) AS most, count(*) FILTER (a.budget <> p.budget) AS bins FROM sbud a JOIN pr p USING (bin)""")
def sliced_budget_shift(spark: SparkSession, d: str) -> DataFrame:
    """The same for budgets by sliced gaps."""
    return shift(A.by_gap(filled_gaps(sliced(spark, d), least=1), "n", "gap", "cluster", GAP_TOTAL))


@R.add(f"WITH RECURSIVE {TARGETS_SQL} SELECT cluster, budget, n FROM scored JOIN clr ON bin = cluster ORDER BY budget DESC, cluster LIMIT 3")
def alloc_top_clusters(spark: SparkSession, d: str) -> DataFrame:
    return allocate_v3(spark, d).orderBy(F.desc("budget"), "cluster").limit(3).select("cluster", "budget", "n")


def _corr_sql(a: str, b: str) -> str:
    return f"round(coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 0), 4)"


@R.add(f"""WITH RECURSIVE {TARGETS_SQL} SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS rows_in, CAST(sum(budget) AS BIGINT) AS rows_out, {_corr_sql('CAST(budget AS DOUBLE)', 'CAST(n AS DOUBLE)')} AS budget_vs_size,
  {_corr_sql('CAST(budget AS DOUBLE)', 'abar')} AS budget_vs_relevance, {_corr_sql('CAST(budget AS DOUBLE)', 'u')} AS budget_vs_disagreement FROM scored JOIN clr ON bin = cluster""")
def allocation_report(spark: SparkSession, d: str) -> DataFrame:
    b = A.by_score(scored(spark, d).select("cluster", "n", "abar", "u", "s"), "s", "n", "cluster", TOTAL)
    budget = F.col("budget").cast("double")
    corr = lambda x: F.round(guarded_correlation(budget, x), 4)
    return b.agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("rows_in"), F.sum("budget").alias("rows_out"), corr(F.col("n").cast("double")).alias("budget_vs_size"), corr(F.col("abar")).alias("budget_vs_relevance"), corr(F.col("u")).alias("budget_vs_disagreement"))


GRID = [("relevance only", 0.5, 1.0, 0.0), ("with disagreement", 0.5, 1.0, 1.0), ("size only", 0.5, 0.0, 0.0), ("linear size", 1.0, 1.0, 0.0)]


@R.add("WITH RECURSIVE " + SPREAD_SQL + ", cfg(config, al, be, et) AS (VALUES " + ", ".join(f"('{c}', {a}, {b}, {e})" for c, a, b, e in GRID) + f"""),
sc AS (SELECT config AS grp, cluster AS bin, n AS cap, pow(n, al) * (1 + be * abar + et * u) AS s FROM spread, cfg),
tgt AS (SELECT grp, bin, cap, round({TOTAL} * s / sum(s) OVER (PARTITION BY grp), 9) AS t FROM sc), {clr_sql('clr', 'tgt', str(TOTAL))} SELECT grp AS config, bin AS cluster, budget FROM clr""")
def ablation_grid(spark: SparkSession, d: str) -> DataFrame:
    """Four settings of the score on one set of features: these are computed once."""
    s = spread(spark, d).persist()
    cfg = spark.createDataFrame(GRID, "config string, al double, be double, et double")
    each = s.crossJoin(F.broadcast(cfg)).withColumn("s", F.expr("pow(n, al) * (1 + be * abar + et * u)"))
    out = A.per_group(each.select("config", "cluster", "n", "s"), "config", "cluster", "budget", lambda p: A.largest_remainder(A.shares(p.s.tolist(), TOTAL), p.n.tolist(), TOTAL))
    return out.select("config", "cluster", "budget")
