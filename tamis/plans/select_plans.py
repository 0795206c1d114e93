"""Selectors: rows picked under budgets. Oracles of greedy ones are recursive: one step is one pick per cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import apportion as A, select as X
from ..operators.clustering import centroids
from ..sources.pairs import PAIRS_SQL, pairs
from .base import Registry
from .budget_plans import AWARE_SQL, SPLIT_SQL, SW_AWARE_SQL, clr_sql, gap_budgets, prop_sql, v21_fine, v3_fine
from .cluster_plans import CENTROIDS_SQL, mean_sql, unit_sql
from .stat_plans import GRID_SQL, features, gridded
from .vector_plans import ORACLES as VECTOR_ORACLES, select_random

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

TOTAL, SHARE, ALPHA, LIMIT = 60, 0.7, 0.75, 0.3

SIZES_SQL = f"csize AS (SELECT 0 AS grp, coarse AS bin, count(*) AS n FROM pairs GROUP BY coarse), {prop_sql('pbud', 'csize', str(TOTAL))}"


def greedy_sql(items: str, budgets: str, init: str, score: str, update: str) -> str:
    """picks(grp, t, sel): items has (grp, id, pos, col, proto, mu), budgets (grp, b); state st is a list like col.

    score and update see t, st and i.* (the candidate); ids come by the smallest first among equal scores.
    """
    return f"""picks(grp, t, sel, st) AS (
  SELECT b.grp, 0, CAST([] AS BIGINT[]), any_value({init}) FROM {budgets} b JOIN {items} i ON i.grp = b.grp GROUP BY b.grp
  UNION ALL
  SELECT grp, t + 1, list_append(sel, best.id), list_transform(range(1, len(st) + 1), lambda k: {update}) FROM (
    SELECT p.grp, any_value(p.t) AS t, any_value(p.sel) AS sel, any_value(p.st) AS st, arg_max({{'id': i.id, 'col': i.col}}, {{'s': round({score}, 9), 'n': -i.id}}) AS best
    FROM picks p JOIN {budgets} b ON b.grp = p.grp AND p.t < b.b JOIN {items} i ON i.grp = p.grp WHERE NOT list_contains(p.sel, i.id) GROUP BY p.grp) s),
chosen AS (SELECT grp, unnest(sel) AS id, unnest(range(len(sel))) AS place FROM picks p JOIN {budgets} b USING (grp) WHERE p.t = b.b)"""


def matrix_sql(tag: str, cluster: str, sim: str, diagonal: str = "") -> str:
    """Items whose col is a row's similarities to all rows of its cluster, ordered by id."""
    return f"""{tag}_n AS (SELECT *, {cluster} AS grp, row_number() OVER (PARTITION BY {cluster} ORDER BY pair_id) AS pos FROM pairs),
{tag} AS MATERIALIZED (SELECT a.grp, b.pair_id AS id, b.pos, list({f"CASE WHEN a.pair_id = b.pair_id THEN 1.0 ELSE {sim} END" if diagonal else sim} ORDER BY a.pos) AS col FROM {tag}_n a JOIN {tag}_n b ON a.grp = b.grp GROUP BY a.grp, b.pair_id, b.pos)"""


COVER = "list_sum(list_transform(range(1, len(i.col) + 1), lambda k: greatest(i.col[k] - p.st[k], 0.0)))"
ZERO = "list_transform(i.col, lambda x: CAST(0 AS DOUBLE))"
GROW = "greatest(st[k], best.col[k])"

CROSS_SQL = """cm_n AS (SELECT pair_id, {cluster} AS grp, z_v, z_t, list_dot_product(z_v, z_t) AS al, row_number() OVER (PARTITION BY {cluster} ORDER BY pair_id) AS pos FROM pairs),
cm_d AS (SELECT a.grp, a.pair_id AS i, b.pair_id AS j, b.pos, a.pos AS apos, round(1 - list_dot_product(a.z_v, b.z_v), 9) AS dv, round(1 - list_dot_product(a.z_t, b.z_t), 9) AS dt, round(abs(a.al - b.al), 9) AS da, count(*) OVER (PARTITION BY a.grp) AS cells FROM cm_n a JOIN cm_n b USING (grp)),
cm AS MATERIALIZED (SELECT grp, i, j, pos, apos, CASE WHEN i = j THEN 1.0 ELSE 1 - ((row_number() OVER (PARTITION BY grp ORDER BY dv, i, j) - 1) / greatest(1.0, cells - 1) + (row_number() OVER (PARTITION BY grp ORDER BY dt, i, j) - 1) / greatest(1.0, cells - 1)
  + (row_number() OVER (PARTITION BY grp ORDER BY da, i, j) - 1) / greatest(1.0, cells - 1)) / 3 END AS s FROM cm_d),
cm_items AS MATERIALIZED (SELECT grp, j AS id, pos, list(s ORDER BY apos) AS col FROM cm GROUP BY grp, j, pos)"""


def coarse_sizes(p: DataFrame) -> DataFrame:
    return p.groupBy(F.col("coarse").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


def proportional(p: DataFrame, total: int = TOTAL) -> DataFrame:
    return A.proportional(coarse_sizes(p), "n", "cluster", total).select("cluster", "budget")


# ---- top-k ------------------------------------------------------------------------------------------------


@R.add(f"WITH {PAIRS_SQL} SELECT pair_id FROM pairs ORDER BY round(list_dot_product(z_v, z_t), 9) DESC, pair_id LIMIT {TOTAL}")
def select_clipscore_pair(spark: SparkSession, d: str) -> DataFrame:
    return X.top(pairs(spark, d), V.dot(F.col("z_v"), F.col("z_t")), "pair_id", TOTAL).select("pair_id")


@R.add(f"""WITH {PAIRS_SQL}, fm AS ({mean_sql('pairs', 'family', 'z_t')}), fc AS (SELECT {unit_sql('m')} AS c FROM fm), sc AS (SELECT pair_id, avg(list_dot_product(z_t, c)) AS s FROM pairs, fc GROUP BY pair_id)
SELECT pair_id FROM sc ORDER BY round(s, 9) DESC, pair_id LIMIT {TOTAL}""")
def select_clipscore_proxy(spark: SparkSession, d: str) -> DataFrame:
    """By the mean cosine to the family centroids, which is a product with their mean: one small array for all rows."""
    p = pairs(spark, d)
    mean = centroids(p, "family", "z_t").agg(V.mean_vector(F.col("centroid")).alias("m"))
    return X.top(p.crossJoin(F.broadcast(mean)), V.dot(F.col("z_t"), F.col("m")), "pair_id", TOTAL).select("pair_id")


def _by_centroid(direction: str) -> str:
    return f"""WITH {PAIRS_SQL}, {CENTROIDS_SQL}, {SIZES_SQL}, r AS (SELECT pair_id, coarse, row_number() OVER (PARTITION BY coarse ORDER BY round(list_dot_product(z_v, centroid), 9) {direction}, pair_id) AS r FROM pairs JOIN cents ON cluster = coarse)
SELECT pair_id FROM r JOIN pbud ON bin = coarse WHERE r <= budget"""


def _centroid_order(spark: SparkSession, d: str, far: bool) -> DataFrame:
    p = pairs(spark, d)
    c = centroids(p, "coarse", "z_v").select(F.col("cluster").alias("coarse"), "centroid")
    s = F.round(V.dot(F.col("z_v"), F.col("centroid")), 9)
    return X.top_per_cluster(p.join(c, "coarse"), "coarse", proportional(p), [s.asc() if far else s.desc(), F.col("pair_id")], most=TOTAL).select("pair_id")


@R.add(_by_centroid("ASC"))
def select_v0(spark: SparkSession, d: str) -> DataFrame:
    """In each cluster, the rows farthest from its centroid."""
    return _centroid_order(spark, d, True)


@R.add(_by_centroid("DESC"))
def select_v0_proto(spark: SparkSession, d: str) -> DataFrame:
    """In each cluster, the rows nearest to its centroid."""
    return _centroid_order(spark, d, False)


@R.add(f"""WITH RECURSIVE {GRID_SQL}, gs AS (SELECT bin, n, g2.w2 AS gap FROM (SELECT coarse AS bin, count(*) AS n FROM pairs GROUP BY coarse) s JOIN gridded g2 ON g2.cluster = bin),
tgt AS (SELECT 0 AS grp, bin, round({TOTAL} * s / sum(s) OVER (), 9) AS t, n AS cap FROM (SELECT bin, n, sqrt(n) * (1 + gap / max(gap) OVER ()) AS s FROM gs)), {clr_sql('gb', 'tgt', str(TOTAL))},
r AS (SELECT pair_id, coarse, row_number() OVER (PARTITION BY coarse ORDER BY md5('sw:' || pair_id), pair_id) AS r FROM pairs) SELECT pair_id FROM r JOIN gb ON bin = coarse WHERE r <= budget""")
def select_sw_random(spark: SparkSession, d: str) -> DataFrame:
    """Budgets by sliced distance to the proxies, then random rows of each cluster."""
    p = pairs(spark, d)
    g = gridded(spark, d).join(coarse_sizes(p), "cluster")
    most = g.agg(F.max("w2").alias("_top"))
    s = g.crossJoin(F.broadcast(most)).select("cluster", "n", (F.sqrt("n") * (1 + F.coalesce(F.try_divide(F.col("w2"), F.col("_top")), F.lit(0.0)))).alias("s"))
    return X.random_per_cluster(p, "coarse", A.by_score(s, "s", "n", "cluster", TOTAL).select("cluster", "budget"), "pair_id", "sw").select("pair_id")


# ---- similarity matrices -----------------------------------------------------------------------------------

SMALL = 2  # rows per fine cluster in the queries of single rules
PER_FINE_SQL = f"fb AS (SELECT DISTINCT fine AS grp, {SMALL} AS b FROM pairs), nb AS (SELECT fine AS grp, count(*) AS n FROM pairs GROUP BY fine), fbud2 AS (SELECT grp, b FROM fb JOIN nb USING (grp) WHERE n > b)"


def per_fine(p: DataFrame, b: int = SMALL) -> DataFrame:
    """b rows of each fine cluster that has more."""
    return p.groupBy("fine").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > b).select("fine", F.lit(b).cast("long").alias("budget"))


def _matrix_rows(p: DataFrame, columns: list[str], rule) -> DataFrame:
    """(cluster, i, j, s): entries of a matrix per fine cluster, one task each; more than MATRIX_ROWS rows are an error."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pair_id", kind="stable")
        if len(pdf) > X.MATRIX_ROWS:
            raise ValueError("split clusters first")
        s, ids = rule({c: V.to_matrix(pdf[c]) for c in columns}), pdf.pair_id.to_numpy()
        return pd.DataFrame({"cluster": pdf.fine.iloc[0], "i": np.repeat(ids, len(ids)), "j": np.tile(ids, len(ids)), "s": s.ravel()})

    return p.select("fine", "pair_id", *columns).groupBy("fine").applyInPandas(run, "cluster int, i long, j long, s double")


@R.add(f"WITH {PAIRS_SQL} SELECT a.fine AS cluster, a.pair_id AS i, b.pair_id AS j, round(greatest(0, least(1, (1 + 0.7 * list_dot_product(a.z_v, b.z_v) + 0.3 * list_dot_product(a.z_t, b.z_t)) / 2)), 6) AS s FROM pairs a JOIN pairs b USING (fine)")
def pairwise_sim_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _matrix_rows(pairs(spark, d), ["z_v", "z_t"], lambda c: X.weighted(c["z_v"], c["z_t"], 0.7)).withColumn("s", F.round("s", 6))


@R.add(f"""WITH {PAIRS_SQL}, m AS (SELECT a.fine AS cluster, a.pair_id AS i, b.pair_id AS j, round(1 - list_dot_product(a.z_v, b.z_v), 9) AS dd, count(*) OVER (PARTITION BY a.fine) AS cells FROM pairs a JOIN pairs b USING (fine))
SELECT cluster, i, j, round((row_number() OVER (PARTITION BY cluster ORDER BY dd, i, j) - 1) / greatest(1.0, cells - 1), 6) AS s FROM m""")
def rank_norm(spark: SparkSession, d: str) -> DataFrame:
    return _matrix_rows(pairs(spark, d), ["z_v"], lambda c: X.rank_norm(1 - c["z_v"] @ c["z_v"].T)).withColumn("s", F.round("s", 6))


@R.add(f"WITH {PAIRS_SQL}, {CROSS_SQL.format(cluster='fine')} SELECT grp AS cluster, i, j, round(s, 6) AS s FROM cm")
def cross_modal_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _matrix_rows(pairs(spark, d), ["z_v", "z_t"], lambda c: X.cross_modal(c["z_v"], c["z_t"])).withColumn("s", F.round("s", 6))


WEIGHTED_SIM = f"greatest(0, least(1, (1 + {SHARE} * list_dot_product(a.z_v, b.z_v) + {1 - SHARE} * list_dot_product(a.z_t, b.z_t)) / 2))"


@R.add(f"WITH {PAIRS_SQL}, {matrix_sql('it', 'fine', WEIGHTED_SIM)} SELECT grp AS cluster, id AS pair_id, round(list_sum(list_transform(col, lambda x: greatest(x - 0.5, 0))) / len(col), 6) AS gain FROM it")
def facility_gain(spark: SparkSession, d: str) -> DataFrame:
    """What each row would add, per row of its cluster, to a cover of one half everywhere."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = X.weighted(V.to_matrix(pdf.z_v), V.to_matrix(pdf.z_t), SHARE)
        return pd.DataFrame({"cluster": pdf.fine.iloc[0], "pair_id": pdf.pair_id, "gain": np.round(np.maximum(s - 0.5, 0).sum(axis=0) / len(s), 6)})

    return pairs(spark, d).select("fine", "pair_id", "z_v", "z_t").groupBy("fine").applyInPandas(run, "cluster int, pair_id long, gain double")


PROTO_SQL = f"""pv AS ({mean_sql('pairs', 'fine', 'z_v')}), pt AS ({mean_sql('pairs', 'fine', 'z_t')}), pc AS (SELECT grp, list_transform(pv.m, lambda x: x / greatest(sqrt(list_dot_product(pv.m, pv.m)), 1e-12)) AS cv, list_transform(pt.m, lambda x: x / greatest(sqrt(list_dot_product(pt.m, pt.m)), 1e-12)) AS ct FROM pv JOIN pt USING (grp)),
protos AS MATERIALIZED (SELECT pair_id, fine, greatest(0, least(1, (1 + {SHARE} * list_dot_product(z_v, cv) + {1 - SHARE} * list_dot_product(z_t, ct)) / 2)) AS proto FROM pairs JOIN pc ON grp = fine)"""


@R.add(f"WITH {PAIRS_SQL}, {PROTO_SQL} SELECT pair_id, round(proto, 6) AS proto FROM protos")
def prototype_scores(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    c = p.groupBy("fine").agg(V.mean_vector(F.col("z_v")).alias("cv"), V.mean_vector(F.col("z_t")).alias("ct"))
    c = c.select("fine", V.l2_floor(F.col("cv")).alias("cv"), V.l2_floor(F.col("ct")).alias("ct"))
    score = (1 + SHARE * V.dot(F.col("z_v"), F.col("cv")) + (1 - SHARE) * V.dot(F.col("z_t"), F.col("ct"))) / 2
    return p.join(c, "fine").select("pair_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("proto"))


# ---- greedy rules in fine clusters -------------------------------------------------------------------------------

OUT = "SELECT grp AS cluster, id AS pair_id, CAST(place AS INT) AS place FROM chosen"


@R.add(f"WITH RECURSIVE {PAIRS_SQL}, {CROSS_SQL.format(cluster='fine')}, {PER_FINE_SQL}, {greedy_sql('cm_items', 'fbud2', ZERO, COVER, GROW)} {OUT}")
def facility_location(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return X.greedy_per_cluster(p, "fine", per_fine(p), ["z_v", "z_t"], lambda c, k: X.facility(X.cross_modal(c["z_v"], c["z_t"]), k))


PROTO_ITEMS_SQL = f"{matrix_sql('it', 'fine', WEIGHTED_SIM)}, {PROTO_SQL}, pit AS MATERIALIZED (SELECT it.*, proto FROM it JOIN protos ON id = pair_id)"
PROTO_SCORE = f"{ALPHA} * i.proto + {1 - ALPHA} * {COVER} / len(i.col)"


def _proto_rule(c: dict[str, np.ndarray], k: int) -> list[int]:
    zv, zt = c["z_v"], c["z_t"]
    return X.lazy_facility(X.weighted_columns(zv, zt, SHARE), len(zv), k, X.prototype(zv, zt, zv.mean(axis=0), SHARE), ALPHA)


@R.add(f"WITH RECURSIVE {PAIRS_SQL}, {PROTO_ITEMS_SQL}, {PER_FINE_SQL}, {greedy_sql('pit', 'fbud2', ZERO, PROTO_SCORE, GROW)} {OUT}")
def proto_greedy(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d)
    return X.greedy_per_cluster(p, "fine", per_fine(p), ["z_v", "z_t"], _proto_rule, X.COVER_ROWS)


KC_ITEMS_SQL = f"""{matrix_sql('kd', 'coarse', '1 - list_dot_product(a.z_v, b.z_v)')}, {CENTROIDS_SQL}, kit AS MATERIALIZED (SELECT kd.*, list_dot_product(z_v, centroid) AS proto FROM kd JOIN pairs ON pair_id = id JOIN cents ON cluster = grp)"""
PBUD_SQL = f"{SIZES_SQL}, pb AS (SELECT bin AS grp, CAST(budget AS BIGINT) AS b FROM pbud WHERE budget > 0)"


@R.add(f"WITH RECURSIVE {PAIRS_SQL}, {KC_ITEMS_SQL}, {PBUD_SQL}, {greedy_sql('kit', 'pb', 'list_transform(i.col, lambda x: CAST(1e9 AS DOUBLE))', 'CASE WHEN p.t = 0 THEN i.proto ELSE p.st[i.pos] END', 'least(st[k], best.col[k])')} {OUT}")
def select_kcenter_clustered(spark: SparkSession, d: str) -> DataFrame:
    """From the row nearest the centroid of a cluster, farthest rows first."""
    p = pairs(spark, d)

    def rule(c: dict[str, np.ndarray], k: int) -> list[int]:
        m = c["z_v"].mean(axis=0)
        return X.farthest_first(c["z_v"], m / (np.linalg.norm(m) + 1e-12), k)

    return X.greedy_per_cluster(p, "coarse", proportional(p), ["z_v"], rule, X.VECTOR_ROWS)


@R.add(f"""WITH RECURSIVE {PAIRS_SQL}, kg(t, sel, near) AS (
  SELECT 1, [min(pair_id)], [CAST([] AS DOUBLE[])] FROM pairs
  UNION ALL
  SELECT t + 1, list_append(sel, best), near FROM (SELECT any_value(t) AS t, any_value(sel) AS sel, any_value(near) AS near, arg_max(id, {{'s': round(dist, 9), 'n': -id}}) AS best FROM (
    SELECT any_value(k.t) AS t, any_value(k.sel) AS sel, any_value(k.near) AS near, p.pair_id AS id, min(list_sum(list_transform(range(1, 33), lambda q: pow(p.z_v[q] - s.z_v[q], 2)))) AS dist
    FROM kg k JOIN pairs p ON NOT list_contains(k.sel, p.pair_id) JOIN pairs s ON list_contains(k.sel, s.pair_id) WHERE k.t < 6 GROUP BY p.pair_id)) WHERE t IS NOT NULL)
SELECT unnest(sel) AS pair_id, CAST(unnest(range(6)) AS INT) AS place FROM kg WHERE t = 6""")
def select_kcenter_global(spark: SparkSession, d: str) -> DataFrame:
    """Six farthest-first picks over the whole pool, from the smallest id."""
    p = pairs(spark, d).select("pair_id", "z_v")
    return X.farthest_rounds(p, "pair_id", "z_v", 6, p.agg(F.min("pair_id")).first()[0])


JOINT_SQL = """je0 AS (SELECT pair_id, {cluster} AS grp, list_transform(z_v, lambda x: x * sqrt(0.5)) || list_transform(z_t, lambda x: x * sqrt(0.5)) AS v FROM pairs),
je AS (SELECT pair_id, grp, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v, row_number() OVER (PARTITION BY grp ORDER BY pair_id) AS pos FROM je0),
jm AS ({mean})"""


def prune_sql(cluster: str, budgets: str) -> str:
    """chosen(grp, id): one step looks at the next row of each cluster's order."""
    return JOINT_SQL.format(cluster=cluster, mean=mean_sql("je", "grp", "v", 64)) + f""",
jo AS MATERIALIZED (SELECT je.*, row_number() OVER (PARTITION BY je.grp ORDER BY round(list_dot_product(v, list_transform(m, lambda x: x / greatest(sqrt(list_dot_product(m, m)), 1e-12))), 9), pair_id) AS r FROM je JOIN jm ON jm.grp = je.grp),
scan(grp, r, sel, vecs) AS (
  SELECT grp, 0, CAST([] AS BIGINT[]), CAST([] AS DOUBLE[][]) FROM {budgets}
  UNION ALL
  SELECT s.grp, s.r + 1, CASE WHEN ok THEN list_append(sel, pair_id) ELSE sel END, CASE WHEN ok THEN list_append(vecs, v) ELSE vecs END FROM (
    SELECT c.grp, c.r, c.sel, c.vecs, j.pair_id, j.v, len(c.sel) < b.b AND coalesce(round(list_max(list_transform(c.vecs, lambda x: list_dot_product(x, j.v))), 9), -2) <= {LIMIT} AS ok
    FROM scan c JOIN {budgets} b ON b.grp = c.grp JOIN jo j ON j.grp = c.grp AND j.r = c.r + 1) s),
ends AS (SELECT grp, max_by(sel, r) AS sel FROM scan GROUP BY grp),
chosen AS (SELECT grp, id, place FROM (SELECT jo.grp, jo.pair_id AS id, row_number() OVER (PARTITION BY jo.grp ORDER BY CASE WHEN list_contains(sel, jo.pair_id) THEN 0 ELSE 1 END, r) AS q, b.b, q - 1 AS place
  FROM jo JOIN ends ON ends.grp = jo.grp JOIN {budgets} b ON b.grp = jo.grp) WHERE q <= b)"""


def joint(p: DataFrame) -> DataFrame:
    return p.withColumn("joint", V.joint(F.col("z_v"), F.col("z_t"), 0.5))


@R.add(f"WITH RECURSIVE {PAIRS_SQL}, {PER_FINE_SQL}, sb AS (SELECT grp, 4 AS b FROM nb WHERE n > 4), {prune_sql('fine', 'sb')} SELECT grp AS cluster, id AS pair_id FROM chosen")
def semdedup_local(spark: SparkSession, d: str) -> DataFrame:
    """Four rows of each fine cluster, hard ones first, none too similar to another while others are left."""
    p = joint(pairs(spark, d))
    return X.greedy_per_cluster(p, "fine", per_fine(p, 4), ["joint"], lambda c, k: X.prune(c["joint"], k, LIMIT), X.VECTOR_ROWS).select("cluster", "pair_id")


@R.add(f"WITH RECURSIVE {PAIRS_SQL}, {PBUD_SQL}, {prune_sql('coarse', 'pb')} SELECT id AS pair_id FROM chosen")
def select_semdedup(spark: SparkSession, d: str) -> DataFrame:
    p = joint(pairs(spark, d))
    return X.greedy_per_cluster(p, "coarse", proportional(p), ["joint"], lambda c, k: X.prune(c["joint"], k, LIMIT), X.VECTOR_ROWS).select("pair_id")


HERD_ITEMS_SQL = "hm AS ({mean}), hit AS MATERIALIZED (SELECT {cluster} AS grp, pair_id AS id, psi AS col, m AS mu FROM feat JOIN hm ON hm.grp = {cluster})"
HERD_SCORE = "list_dot_product(i.col, list_transform(range(1, len(i.col) + 1), lambda k: i.mu[k] - CASE WHEN p.t = 0 THEN 0 ELSE p.st[k] / p.t END))"


def herd_sql(cluster: str, budgets: str) -> str:
    items = HERD_ITEMS_SQL.format(mean=mean_sql("feat", cluster, "psi", 16), cluster=cluster)
    return f"{items}, {greedy_sql('hit', budgets, ZERO, HERD_SCORE, 'st[k] + best.col[k]')}"


def _feat_sql() -> str:
    from .stat_plans import MMD_SQL

    return MMD_SQL


@R.add(f"WITH RECURSIVE {_feat_sql()}, {PER_FINE_SQL}, hb AS (SELECT grp, least(3, n) AS b FROM nb WHERE n > 3), {herd_sql('fine', 'hb')} {OUT}")
def kernel_herding(spark: SparkSession, d: str) -> DataFrame:
    """Three herded rows of each fine cluster with more than three."""
    p = features(spark, d)
    return X.herd_per_cluster(p, "fine", per_fine(p, 3), "psi")


@R.add(f"WITH RECURSIVE {_feat_sql()}, {PBUD_SQL}, {herd_sql('coarse', 'pb')} SELECT id AS pair_id FROM chosen")
def select_herding(spark: SparkSession, d: str) -> DataFrame:
    p = features(spark, d)
    return X.herd_per_cluster(p, "coarse", proportional(p), "psi").select("pair_id")


@R.add(f"WITH RECURSIVE {SPLIT_SQL}, vb AS (SELECT bin AS grp, budget AS b FROM fclr WHERE budget > 0), {herd_sql('fine', 'vb')} SELECT id AS pair_id FROM chosen")
def select_proposed(spark: SparkSession, d: str) -> DataFrame:
    """End to end: features, allocation by relevance, fine budgets, herding."""
    return X.herd_per_cluster(features(spark, d), "fine", v3_fine(spark, d).select("fine", "fine_budget"), "psi").select("pair_id")


@R.add(f"WITH RECURSIVE {PAIRS_SQL}, {CROSS_SQL.format(cluster='coarse')}, {PBUD_SQL}, {greedy_sql('cm_items', 'pb', ZERO, COVER, GROW)} SELECT id AS pair_id FROM chosen")
def select_v1(spark: SparkSession, d: str) -> DataFrame:
    """Proportional budgets, facility location on the cross-modal similarity."""
    p = pairs(spark, d)
    return X.greedy_per_cluster(p, "coarse", proportional(p), ["z_v", "z_t"], lambda c, k: X.facility(X.cross_modal(c["z_v"], c["z_t"]), k)).select("pair_id")


@R.add(f"WITH RECURSIVE {AWARE_SQL}, {CROSS_SQL.format(cluster='coarse')}, ab AS (SELECT bin AS grp, budget AS b FROM aware WHERE budget > 0), {greedy_sql('cm_items', 'ab', ZERO, COVER, GROW)} SELECT id AS pair_id FROM chosen")
def select_v2(spark: SparkSession, d: str) -> DataFrame:
    """Budgets by the Gaussian gap, facility location on the cross-modal similarity."""
    b = gap_budgets(spark, d).select("cluster", "budget")
    return X.greedy_per_cluster(pairs(spark, d), "coarse", b, ["z_v", "z_t"], lambda c, k: X.facility(X.cross_modal(c["z_v"], c["z_t"]), k)).select("pair_id")


@R.add(f"WITH RECURSIVE {SW_AWARE_SQL}, {PROTO_ITEMS_SQL}, v21 AS (SELECT bin AS grp, budget AS b FROM fbud WHERE budget > 0), {greedy_sql('pit', 'v21', ZERO, PROTO_SCORE, GROW)} SELECT id AS pair_id FROM chosen")
def select_v2_1(spark: SparkSession, d: str) -> DataFrame:
    """Budgets by the sliced gap, split over fine clusters, prototype-conditioned cover in each."""
    b = v21_fine(spark, d).select("fine", "fine_budget")
    return X.greedy_per_cluster(pairs(spark, d), "fine", b, ["z_v", "z_t"], _proto_rule, X.COVER_ROWS).select("pair_id")


SELECTORS = {f.__name__: f for f in (select_random, select_clipscore_pair, select_clipscore_proxy, select_v0, select_v0_proto, select_sw_random, select_kcenter_clustered, select_kcenter_global, select_semdedup, select_herding, select_proposed, select_v1, select_v2, select_v2_1)}


def select(name: str, spark: SparkSession, d: str) -> DataFrame:
    """A selector by name."""
    if name not in SELECTORS:
        raise ValueError(f"no selector {name}; there are {', '.join(sorted(SELECTORS))}")
    return SELECTORS[name](spark, d)


def overlap_sql(methods: tuple[str, ...]) -> str:
    sets = " UNION ALL ".join(f"SELECT '{m}' AS method, pair_id FROM ({(ORACLES | VECTOR_ORACLES)[m]})" for m in methods)
    return f"""WITH runs AS ({sets}), n AS (SELECT method, count(*) AS n FROM runs GROUP BY method)
SELECT a.method AS method, b.method AS other, round(c.k / (a.n + b.n - c.k), 4) AS jaccard FROM n a, n b, LATERAL (SELECT CAST(count(*) AS DOUBLE) AS k FROM runs x JOIN runs y USING (pair_id) WHERE x.method = a.method AND y.method = b.method) c WHERE a.method < b.method"""


def overlaps(spark: SparkSession, d: str, methods: tuple[str, ...]) -> DataFrame:
    """Jaccard index of every two selections; ids meet in one shuffle, not per pair of methods."""
    runs = None
    for m in methods:
        r = SELECTORS[m](spark, d).select(F.lit(m).alias("method"), "pair_id")
        runs = r if runs is None else runs.unionByName(r)
    held = runs.groupBy("pair_id").agg(F.collect_set("method").alias("ms"))  # at most one entry per method
    pairs_of = held.select(F.explode("ms").alias("method"), "ms").select("method", F.explode("ms").alias("other")).groupBy("method", "other").agg(F.count(F.lit(1)).alias("k"))
    n = pairs_of.where("method = other").select("method", F.col("k").alias("n"))
    names = spark.createDataFrame([(a, b) for a in methods for b in methods if a < b], "method string, other string")
    both = names.join(pairs_of, ["method", "other"], "left").join(n, "method").join(n.select(F.col("method").alias("other"), F.col("n").alias("m")), "other")
    k = F.coalesce("k", F.lit(0))
    return both.select("method", "other", F.round(k / (F.col("n") + F.col("m") - k), 4).alias("jaccard"))


OVERLAP = ("select_clipscore_pair", "select_clipscore_proxy", "select_v0", "select_v0_proto")
FIVE = ("select_proposed", "select_random", "select_clipscore_proxy", "select_kcenter_global", "select_sw_random")
DIAGNOSED = ("select_random", "select_v0", "select_v0_proto", "select_v1", "select_v2")


@R.add(overlap_sql(OVERLAP))
def selector_overlap(spark: SparkSession, d: str) -> DataFrame:
    return overlaps(spark, d, OVERLAP)


@R.add(overlap_sql(FIVE))
def selector_overlap_five(spark: SparkSession, d: str) -> DataFrame:
    """The whole method next to its four rivals."""
    return overlaps(spark, d, FIVE)


@R.add(overlap_sql(DIAGNOSED))
def selector_overlap_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """The selectors of the older generation and a random one."""
    return overlaps(spark, d, DIAGNOSED)
