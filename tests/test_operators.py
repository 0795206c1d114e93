"""Hand-made cases and properties of the operators."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tamis.operators import apportion as A, families as Y, records as E, select as X, stats as S
from tamis.operators.clustering import assign, centroids, cluster_sizes, knn_within, lloyd
from tamis.operators.retrieval import true_ranks
from tamis.operators.sampling import exact_sample, global_row_number, split_exact

# ---- Wasserstein distances ----------------------------------------------------------------------------------


def numbers(spark, xs):
    return spark.createDataFrame([(0, float(x)) for x in xs], "k int, v double")


@pytest.mark.parametrize("n, m", [(4, 6), (1, 5), (9, 3)])
def test_w2_of_unequal_sizes(spark, n, m):
    r = np.random.default_rng(n * m)
    a, b = r.normal(size=n), r.exponential(size=m)
    whole = math.lcm(n, m)  # both as step functions on the same grid
    steps = np.sort(np.repeat(a, whole // n)) - np.sort(np.repeat(b, whole // m))
    assert S.w2_1d(numbers(spark, a), numbers(spark, b), ["k"], "v").first().w2 == pytest.approx(float((steps**2).mean()))


def test_w2_of_a_shift(spark):
    a = np.random.default_rng(2).normal(size=11)
    for by in (-3.25, 0.5):
        assert S.w2_1d(numbers(spark, a), numbers(spark, a + by), ["k"], "v").first().w2 == pytest.approx(by**2)


@pytest.mark.parametrize("seed", range(3))
def test_w2_is_symmetric_and_zero_on_itself(spark, seed):
    r = np.random.default_rng(seed)
    a, b = numbers(spark, r.normal(size=7)), numbers(spark, r.normal(size=5))
    assert S.w2_1d(a, b, ["k"], "v").first().w2 == pytest.approx(S.w2_1d(b, a, ["k"], "v").first().w2)
    assert S.w2_1d(a, a, ["k"], "v").first().w2 == pytest.approx(0.0)


@pytest.mark.parametrize("seed", range(2))
def test_w2_of_many_groups_against_one_set(spark, seed):
    r = np.random.default_rng(seed)
    sizes, b = (1, 4, 30), r.normal(size=12) + 1000.0  # far from zero, with ties
    b[3] = b[4]
    sets = {k: np.round(r.normal(size=n), 1) + 1000.0 for k, n in enumerate(sizes)}
    left = spark.createDataFrame([(k, 7, float(v), i) for k, a in sets.items() for i, v in enumerate(a)] + [(9, 8, 1.0, 0), (0, 7, None, 99)], "c int, k int, v double, id int").repartition(5)
    right = spark.createDataFrame([(7, float(v), i) for i, v in enumerate(b)], "k int, v double, id int").repartition(3)
    for kind in ("exact", "grid"):
        if kind == "exact":
            got = S.w2_1d(left, right, ["c", "k"], "v", shared=["k"], tie="id")
        else:
            got = S.grid_w2(left.where("v IS NOT NULL"), right, ["c", "k"], "v", most=5, shared=["k"], tie="id")
        got = {row.c: row.w2 for row in got.collect()}
        assert sorted(got) == [0, 1, 2]  # group 9 has no partner
        for k, a in sets.items():
            if kind == "exact":
                whole = math.lcm(len(a), len(b))
                d = np.sort(np.repeat(a, whole // len(a))) - np.sort(np.repeat(b, whole // len(b)))
            else:
                g = min(len(a), len(b), 5)
                pick = lambda x: np.sort(x)[[t * (len(x) - 1) // (g - 1) if g > 1 else 0 for t in range(g)]]  # noqa: B023, E731
                d = pick(a) - pick(b)
            assert got[k] == pytest.approx(float((d**2).mean()), abs=1e-9)


# ---- median distance --------------------------------------------------------------------------------------------


def brute_median(x):
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    return float(np.median(d2[np.triu_indices(len(x), 1)]))


def points(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "pair_id long, v array<double>")


def test_bandwidth_of_all_pairs_above_2000_rows(spark):
    x = np.random.default_rng(5).normal(size=(2600, 3))
    assert S.median_bandwidth(points(spark, x), "pair_id", "v") == pytest.approx(math.sqrt(brute_median(x) / 2), abs=1e-9)


@pytest.mark.parametrize("n, copies", [(2, 1), (3, 1), (4, 1), (41, 1), (7, 6)])
def test_median_distance_in_blocks(spark, n, copies):
    x = np.repeat(np.random.default_rng(n).normal(size=(n, 3)), copies, axis=0)
    assert S.median_pair_distance(points(spark, x), "pair_id", "v", block_rows=4) == pytest.approx(brute_median(x), abs=1e-9)


# ---- budgets ------------------------------------------------------------------------------------------------


def test_rounds_of_water_filling():
    assert A.water_fill([1000, 37, 3], [1, 100, 100], 50) == [1, 45, 4]  # single units after each round, not only the last
    assert A.water_fill([0, 0], [10, 2], 6) == [5, 1]  # by free room
    assert A.water_fill([], [], 0) == []


def unit_by_unit(targets, caps, total, guard):
    out = [min(math.floor(t), c) for t, c in zip(targets, caps)]
    ids = list(range(len(out)))
    order = sorted(ids, key=lambda k: (math.floor(targets[k]) - targets[k], k))
    left, looks = total - sum(out), 0
    limit = 10 * len(out) + left + 10
    while left > 0 and any(out[k] < caps[k] for k in ids):
        for k in order:
            if left <= 0 or (guard and looks > limit):
                break
            looks += 1
            if out[k] < caps[k]:
                out[k], left = out[k] + 1, left - 1
        if guard and looks > limit:
            break
        order = sorted(ids, key=lambda k: (out[k] - caps[k], k))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 40)), min_size=1, max_size=8), st.integers(0, 200), st.booleans())
def test_whole_passes_equal_single_units(b, total, guard):
    targets, caps = [t / 8 for t, _ in b], [c for _, c in b]
    assert A.largest_remainder(targets, caps, total, guard) == unit_by_unit(targets, caps, total, guard)


def test_guard_stops_early():
    assert A.largest_remainder([90, 5, 5], [5, 100, 5], 100) == [5, 90, 5]
    assert A.largest_remainder([90, 5, 5], [5, 100, 5], 100, guard=True) == [5, 47, 5]


def test_floors_that_reach_the_total_stand():
    assert A.largest_remainder([3.0, 3.0], [5, 5], 4) == [3, 3]


def test_impossible_totals_raise():
    with pytest.raises(ValueError):
        A.water_fill([1.0, 1.0], [1, 1], 3)
    with pytest.raises(ValueError):
        A.water_fill([-1.0, 1.0], [1, 1], 1)


bins = st.lists(st.tuples(st.floats(0, 100), st.integers(0, 50)), min_size=1, max_size=12)


@settings(max_examples=200, deadline=None)
@given(bins, st.floats(0, 1))
def test_budgets_add_up(b, part):
    weights, caps = [w for w, _ in b], [c for _, c in b]
    total = int(part * sum(caps))
    out = A.water_fill(weights, caps, total)
    assert sum(out) == total and all(0 <= x <= c for x, c in zip(out, caps))
    out = A.largest_remainder(A.shares(weights, total), caps, total)
    assert all(0 <= x <= c for x, c in zip(out, caps)) and sum(out) == total


def test_proportional_on_empty_and_full(spark):
    df = spark.createDataFrame([(0, 3), (1, 0), (2, 7)], "c int, n long")
    assert {r.c: r.budget for r in A.proportional(df, "n", "c", 10).collect()} == {0: 3, 1: 0, 2: 7}
    assert {r.c: r.budget for r in A.proportional(df, "n", "c", 0).collect()} == {0: 0, 1: 0, 2: 0}
    assert {r.c: r.budget for r in A.proportional(df, "n", "c", 99).collect()} == {0: 3, 1: 0, 2: 7}


# ---- greedy rules -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("k", [1, 3, 8])
def test_alpha_one_takes_the_best_prototypes(k):
    r = np.random.default_rng(k)
    sim, proto = r.uniform(size=(13, 13)), r.uniform(size=13)
    assert X.facility(sim, k, proto, 1.0) == np.argsort(-proto).tolist()[:k]


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 700), st.integers(0, 9), st.sampled_from([None, 0.0, 0.4, 1.0]), st.integers(0, 99))
def test_lazy_cover_equals_the_matrix(n, k, alpha, seed):
    r = np.random.default_rng(seed)
    zv, zt = (r.normal(size=(n, 3)) for _ in range(2))
    zv, zt = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (zv, zt))
    zv[n // 2], zt[n // 2] = zv[0], zt[0]  # a tie
    proto = None if alpha is None else r.uniform(size=n)
    whole = X.facility(X.weighted(zv, zt, 0.7), k, proto, alpha or 0.0)
    assert X.lazy_facility(X.weighted_columns(zv, zt, 0.7), n, k, proto, alpha or 0.0) == whole


def test_large_clusters_are_dealt_into_parts(spark):
    x = np.random.default_rng(4).normal(size=(400, 3))
    df = spark.createDataFrame([(i, int(i >= 300), v) for i, v in enumerate(x.tolist())], "pair_id long, c int, v array<double>")
    b = spark.createDataFrame([(0, 31), (1, 7)], "c int, budget long")
    out = X.herd_per_cluster(df, "c", b, "v", part_rows=128).collect()
    assert {c: len({r.pair_id for r in out if r.cluster == c}) for c in (0, 1)} == {0: 31, 1: 7}
    assert len({(r.cluster, r.place) for r in out}) == 38
    alone = X.herd_per_cluster(df.where("c = 1"), "c", b, "v").collect()
    assert sorted(r.pair_id for r in alone) == sorted(r.pair_id for r in out if r.cluster == 1)  # a cluster that fits is left alone


def test_a_budget_that_is_not_given_out_is_an_error(spark):
    df = spark.createDataFrame([(i, 0, [float(i)]) for i in range(4)], "pair_id long, c int, v array<double>")
    b = spark.createDataFrame([(0, 2)], "c int, budget long")
    with pytest.raises(Exception, match="of a budget of 2"):
        X.greedy_per_cluster(df, "c", b, ["v"], lambda c, k: [1, 1]).collect()


@pytest.mark.parametrize("fold", [2, 16])
def test_global_farthest_by_brute_force(spark, monkeypatch, fold):
    monkeypatch.setattr(X, "FOLD", fold)
    x = np.random.default_rng(1).normal(size=(40, 3))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "pair_id long, v array<double>")
    out = [r.pair_id for r in X.farthest_rounds(df, "pair_id", "v", 8, 5).orderBy("place").collect()]
    want = [5]
    while len(want) < 8:
        near = ((x[:, None] - x[want]) ** 2).sum(axis=2).min(axis=1)
        near[want] = -1
        want.append(int(np.argmax(np.round(near, 9))))
    assert out == want


def test_alpha_zero_is_the_plain_cover():
    s = np.random.default_rng(0).uniform(size=(9, 9))
    assert X.facility(s, 4, np.random.default_rng(1).uniform(size=9), 0.0) == X.facility(s, 4)


def test_pruning_takes_one_of_each_bundle():
    r = np.random.default_rng(6)
    axes = np.repeat(np.eye(5), 4, axis=0)  # five bundles of four close directions
    x = axes + 0.01 * r.normal(size=axes.shape)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert sorted(j // 4 for j in X.prune(x, 5, 0.5)) == [0, 1, 2, 3, 4]
    more = X.prune(x, 9, 0.5)  # filled up by skipped rows
    assert len(set(more)) == 9 and {j // 4 for j in more[:5]} == {0, 1, 2, 3, 4}


@pytest.mark.parametrize("seed", range(3))
def test_farthest_first_by_brute_force(seed):
    x = np.random.default_rng(seed).normal(size=(15, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = X.farthest_first(x, x.mean(axis=0), 7)
    assert out[0] == int(np.argmax(x @ x.mean(axis=0)))
    for t in range(1, 7):
        far = [min(1 - float(x[j] @ x[i]) for i in out[:t]) if j not in out[:t] else -1 for j in range(15)]
        assert out[t] == int(np.argmax(np.round(far, 9)))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(0, 14), st.integers(0, 1000))
def test_rules_never_pick_twice(n, k, seed):
    x = np.random.default_rng(seed).normal(size=(n, 3))
    x = np.concatenate([x, x[:1]])  # a copy
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for out in (X.herding(x, k), X.farthest_first(x, x[0], k), X.prune(x, k, 0.5), X.facility((1 + x @ x.T) / 2, k)):
        assert len(out) == len(set(out)) == min(k, n + 1)
    assert len(X.herding(x, k, np.array([0, 1]))) == min(k, 2)


def test_bad_parameters_raise():
    with pytest.raises(ValueError):
        X.facility(np.eye(2), 1, np.ones(2), 1.5)
    with pytest.raises(ValueError):
        X.prune(np.eye(2), 1, 2.0)


def test_whole_clusters_and_empty_budgets(spark):
    df = spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(6)], "pair_id long, c int, v array<double>")
    b = spark.createDataFrame([(0, 9), (1, 0)], "c int, budget long")
    assert {r.pair_id for r in X.herd_per_cluster(df, "c", b, "v").collect()} == {0, 2, 4}


def test_large_clusters_herd_among_all_rows(spark):
    x = np.linspace(0.5, 1.0, 5100)
    x[7] = -1.0  # in nobody's list of nearest rows, and the best second pick
    df = spark.createDataFrame([(i, 0, [float(v)]) for i, v in enumerate(x)], "pair_id long, c int, v array<double>")
    b = spark.createDataFrame([(0, 4)], "c int, budget long")
    out = [r.pair_id for r in X.herd_per_cluster(df, "c", b, "v").orderBy("place").collect()]
    assert out[:2] == [5099, 7] and out == X.herding(x[:, None], 4)


def test_global_farthest_with_copies(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3)], "pair_id long, v array<double>")
    out = [r.pair_id for r in X.farthest_rounds(df, "pair_id", "v", 5, 0).orderBy("place").collect()]
    assert out == [0, 1, 2]


# ---- clusters -----------------------------------------------------------------------------------------------


def vectors(spark, n=60, parts=3):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "pair_id long, g int, v array<double>").repartition(parts)


def test_lloyd_does_not_depend_on_partitions(spark):
    a, b = (lloyd(vectors(spark, parts=p), "pair_id", "v", 4, 3, "s", group="g").orderBy("pair_id").collect() for p in (1, 7))
    assert a == b and {r.cluster for r in a} <= set(range(4))


def test_sizes_count_empty_clusters(spark):
    df = spark.createDataFrame([(0,), (0,), (2,), (-1,), (None,)], "c int")
    assert [(r.cluster, r.n) for r in cluster_sizes(df, "c", 4).orderBy("cluster").collect()] == [(0, 2), (1, 0), (2, 1), (3, 0)]


def test_blocks_do_not_change_neighbours(spark):
    df = vectors(spark)
    a, b = (knn_within(df, "g", "v", 3, block_rows=n).orderBy("pair_id", "rank").collect() for n in (5, 1000))
    assert a == b and len(a) == 180


def test_assignment_ties(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "pair_id long, v array<double>")
    c = spark.createDataFrame([(3, [1.0, 0.0]), (2, [1.0, 0.0])], "cluster int, centroid array<double>")
    assert assign(df, "v", c).first().cluster == 2


def test_centroid_of_one_row(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0])], "g int, v array<double>")
    assert centroids(df, "g", "v").first().centroid == pytest.approx([0.6, 0.8])


# ---- samples, ranks, records, texts ----------------------------------------------------------------------------------


def test_exact_samples(spark):
    df = spark.range(50).withColumnRenamed("id", "pair_id")
    a, b = (exact_sample(df.repartition(p), "pair_id", 13, "x").collect() for p in (1, 6))
    assert sorted(a) == sorted(b) and len(a) == 13
    assert exact_sample(df, "pair_id", 0, "x").count() == 0
    assert split_exact(df, "pair_id", 7, "x").where("part = 'validation'").count() == 7
    assert [r.n for r in global_row_number(df.repartition(5), "pair_id", "n").orderBy("pair_id").collect()] == list(range(50))


def test_ranks_with_ties(spark):
    q = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(4)], "id long, v array<double>")
    out = {r.id: (r.above, r.before) for r in true_ranks(q, q, block_rows=2).collect()}
    assert out == {i: (0, i) for i in range(4)}


def test_correlation_without_spread(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(S.guarded_correlation(F.col("x"), F.col("y"))).first()[0] == 0.0


def test_summary_of_nothing(spark):
    out = spark.createDataFrame([], "v double").agg(*S.summary(F.col("v"))).first()
    assert set(out) == {0.0}


def test_wilson_without_trials(spark):
    low, high = S.wilson(F.col("p"), F.col("n"))
    out = spark.createDataFrame([(50.0, 0), (50.0, 100)], "p double, n long").select(low, high).collect()
    assert tuple(out[0]) == (None, None) and tuple(out[1]) == (40.38, 59.62)


def test_run_names(spark):
    names = ["metrics_random_b5_s42", "kcenter__0.1__seed3", "sw_v2_eval", "stage_c"]
    out = spark.createDataFrame([(n,) for n in names], "stem string").select(*E.run_name(F.col("stem"))).collect()
    assert [tuple(r) for r in out] == [("random", "5", 42), ("kcenter", "0.1", 3), ("sw_v2", None, None), ("stage_c", None, None)]


def test_reasons(spark):
    long = "one two three four five six seven eight"
    rows = [("a", 0, 0, long), ("a", 0, 1, f" {long.upper()} "), ("b", 1, 0, long), ("b", 1, 1, "too short"), ("b", 1, 2, None), ("b", 1, 3, long + " spam")]
    df = spark.createDataFrame(rows, "f string, o int, pos int, q string")
    out = Y.judge(df, "q", "f", "o", "pos", r"\bspam\b").orderBy("o", "pos")
    assert [r.reason for r in out.collect()] == ["kept", "within", "cross", "short", "malformed", "artifact"]


@pytest.mark.parametrize("total", [0, 3, 6, 9, 20])
def test_trim_equals_the_loop(spark, total):
    sizes = {"p": 4, "a": 3, "b": 5}
    rows = [(f, k, i) for k, (f, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "f string, o int, pos int")
    left = {f: list(range(n)) for f, n in sizes.items()}
    while sum(map(len, left.values())) > total:
        names = [f for f in left if f != "p" and left[f]] or [f for f in left if left[f]]
        left[max(names, key=lambda f: len(left[f]))].pop()
    out = {(r.f, r.pos) for r in Y.trim(df, "f", "o", "pos", ["f", "pos"], total, ["p"]).collect()}
    assert out == {(f, i) for f, v in left.items() for i in v}


def test_answers_of_all_kinds(spark):
    raw = ['```json\n{"families": {"Q1": ["a b c", "x"]}}\n```', '{"Q1": ["d e f"]}', 'Sure: {"Q1": ["g h i"]} ok', "no object", None, "{broken"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")
    assert [(r.i, r.query) for r in Y.family_rows(df, "raw", ["i"]).orderBy("i").collect()] == [(0, "a b c"), (1, "d e f"), (2, "g h i")]


def test_stream_appends_once(spark, tmp_path):
    from tamis.streaming.records import append_once, read_records

    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in range(2):
        spark.range(5).write.mode("append").parquet(src)
        append_once(read_records(spark, src, "id long"), sink, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(sink).count() == 10


# ---- principal components, mini-batches, families ----------------------------------------------------------------


def test_principal_components_by_numpy(spark):
    x = np.random.default_rng(5).normal(size=(40, 4)) * [5, 3, 1, 0.2] + 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(3)
    values, axes = np.linalg.eigh(np.cov(x.T))
    axes = axes.T[::-1]
    axes *= np.sign(axes[np.arange(4), np.abs(axes).argmax(axis=1)])[:, None]
    _, shares, _ = S.principal(df, "v", 4)
    assert shares == pytest.approx(values[::-1] / values.sum())
    got = {r.id: r.coordinates for r in S.principal_coordinates(df, "v", 2).collect()}
    want = (x - x.mean(axis=0)) @ axes[:2].T
    assert np.array([got[i] for i in range(40)]) == pytest.approx(want)


@pytest.mark.parametrize("starts, reassign", [(1, 0.0), (3, 0.2)])
def test_mini_batches_by_brute_force(spark, starts, reassign):
    from tamis.functions import rng as hashed
    from tamis.operators.clustering import minibatch

    r, k, rounds, batch = np.random.default_rng(11), 4, 3, 25
    x = np.repeat(r.normal(size=(4, 3)) * 6, 15, axis=0) + r.normal(size=(60, 3))
    md5 = lambda seed, i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest()
    first = [x[sorted(range(60), key=lambda i: md5(f"s-{s}", i))[:k]] for s in range(starts)]  # noqa: B023
    drawn = lambda t: [i for i in range(60) if hashed.uniform_of(f"s:{t}:{i}") < batch / 60]
    d2 = lambda rows, c: ((x[rows][:, None] - c) ** 2).sum(axis=2)
    cents = min(first, key=lambda c: d2(drawn(0), c).min(axis=1).sum()).copy()
    given = [[] for _ in range(k)]
    counts = np.zeros(k)
    for t in range(rounds):
        own = d2(drawn(t), cents).argmin(axis=1)
        for c in range(k):
            mine = x[drawn(t)][own == c]
            if len(mine):
                cents[c] = (cents[c] * counts[c] + mine.sum(axis=0)) / (counts[c] + len(mine))
                counts[c] += len(mine)
        low = np.flatnonzero(counts < reassign * counts.max())
        if len(low):
            cents[low] = x[drawn(t)][: len(low)]
            counts[low] = np.delete(counts, low).min()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(5)
    got = {row.id: row.cluster for row in minibatch(df, "id", "v", k, rounds, "s", batch, starts, reassign).collect()}
    assert [got[i] for i in range(60)] == d2(list(range(60)), cents).argmin(axis=1).tolist()
    assert minibatch(df.where("id < 0"), "id", "v", k, rounds, "s").count() == 0


def test_leaks(spark):
    from tamis.operators.families import leak_filter

    caption = "one two three four five six seven eight nine"  # five runs of five words
    texts = [caption.upper(), "One  two", "one two three four five six seven eight x", "one two three four five six seven y z", "", None, "other words are here and they stay", "a b one two three four five"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    captions = spark.createDataFrame([(caption,), (caption,), ("one two",), (None,)], "c string")
    # Of the third text's five runs, four are known, and it goes; of the fourth's, three.
    assert sorted(r.id for r in leak_filter(df, "id", "t", captions, "c").collect()) == [3, 4, 5, 6, 7]
    assert leak_filter(df, "id", "t", captions.limit(0), "c").count() == len(texts)


def test_presets_and_ablation_families(spark):
    assert [r.family for r in Y.preset(spark, "default").orderBy("family_order").collect()] == list(Y.PRESETS["default"])
    with pytest.raises(ValueError):
        Y.preset(spark, "other")
    df = spark.createDataFrame([(1, "validation", True), (2, "test", True), (3, "validation", None), (4, None, True)], "id int, part string, bad boolean")
    failed = Y.failure_family(df, F.col("bad"), "part")
    assert [r.id for r in failed.collect()] == [1]
    assert Y.main_run(failed, "family").count() == 0


# ---- resamples, ranks and neighbours as arrays -----------------------------------------------------------------------


@pytest.mark.parametrize("prefix", ["boot:7:", "", "x" * 51, "x" * 53, "\u00e9:"])
def test_hashed_numbers_as_arrays(prefix):
    from tamis.functions import rng

    got = np.concatenate(list(rng.uniforms_of(prefix, 20_003)))
    assert got.tolist() == [rng.uniform_of(f"{prefix}{t}") for t in range(20_003)]
    assert list(rng.uniforms_of(prefix, 0)) == []


def test_bootstrap_makes_no_row_per_draw(spark):
    from tamis.functions import rng

    v = np.random.default_rng(3).normal(size=70_000)  # positions of more than one block
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "p long, v double").repartition(7)
    out = S.bootstrap_interval(df, "v", "p", len(v), 5, "s", alpha=0.5)
    means = [np.mean(v[np.floor(len(v) * np.concatenate(list(rng.uniforms_of(f"s:{b}:", len(v))))).astype(int)]) for b in range(5)]
    assert tuple(out.first()) == tuple(round(float(q), 4) for q in np.percentile(means, [25, 75]))
    assert "Generate" not in out._jdf.queryExecution().toString()
    assert tuple(S.bootstrap_interval(df.limit(0), "v", "p", 0, 5, "s").first()) == (None, None)


def test_bootstrap_has_as_many_resamples_as_the_model(spark, monkeypatch):
    from tamis.plans import retrieval_plans as P

    monkeypatch.setattr(P, "bootstrap_interval", lambda df, value, position, n, resamples, seed: resamples)
    assert P.bootstrap_ci(spark, "/root/testdata/sf0.001") == 1000 and "range(1000)" in P.ORACLES["bootstrap_ci"]


def test_ranks_are_those_of_rounded_scores(spark):
    r = np.random.default_rng(8)
    a, b = r.normal(size=(60, 5)), r.normal(size=(60, 5))
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    b[30:50] = b[:20] + 1e-12  # ties after rounding
    q, g = (spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, v array<double>") for m in (a, b))
    s = np.round(a @ b.T, 9)
    want = {i: (int((s[i] > s[i, i]).sum()), int((s[i, :i] == s[i, i]).sum())) for i in range(60)}
    for rows in (7, 1000):
        assert {x.id: (x.above, x.before) for x in true_ranks(q, g, block_rows=rows).collect()} == want


def test_neighbours_of_large_blocks(spark, monkeypatch):
    from tamis.plans import cluster_plans as P

    r = np.random.default_rng(4)
    x = r.normal(size=(700, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[300:340], x[500] = x[:40], np.nan  # ties; a row without scores
    s = np.round(x @ x.T, 9)
    ids = [i for i in range(700) if i != 500]
    want = sorted((i, j, n + 1) for i in ids for n, j in enumerate(sorted((j for j in ids if j != i), key=lambda j: (-s[i, j], j))[:5]))
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "pair_id long, g int, v array<double>").repartition(3)
    for rows in (300, 8192):  # several runs of scores, in several blocks and in one
        assert sorted(tuple(row) for row in knn_within(df, "g", "v", 5, block_rows=rows).collect()) == want
    # The query leaves the size of blocks to the operator: each row is copied once per block of its cluster.
    asked = []
    monkeypatch.setattr(P, "knn_within", lambda *a, **k: asked.append(k.get("block_rows", 8192)))
    P.knn_graph(spark, "/root/testdata/sf0.001")
    assert asked[0] >= 8192


@pytest.mark.parametrize("kind", ["int", "string"])
def test_average_precision(spark, kind, monkeypatch):
    from tamis.operators import retrieval as T

    r = np.random.default_rng(6)
    a, b = r.normal(size=(80, 4)), r.normal(size=(80, 4))
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    b[40:60] = b[:20] + 1e-12  # ties after rounding
    groups = [None if i in (3, 4) else 9 if i == 5 else i % 3 for i in range(80)]  # one group of a single row
    s, want = np.round(a @ b.T, 9), {}
    for i in range(80):
        ranked = sorted((j for j in range(80) if j != i), key=lambda j: (-s[i, j], j))
        at = [n for n, j in enumerate(ranked, 1) if groups[i] is not None and groups[j] == groups[i]]
        want[i] = (round(float(np.mean([k / n for k, n in enumerate(at, 1)])), 12) if at else None, *(float(bool(at) and at[0] <= k) for k in (1, 5)))
    q, g = (spark.createDataFrame([(i, x.tolist(), c) for i, (x, c) in enumerate(zip(m, groups))], "id long, v array<double>, c int").withColumn("c", F.col("c").cast(kind)).repartition(3) for m in (a, b))
    for rows, packed, held in ((9, 13, 0), (1000, 4096, 1 << 29)):  # with a scratch file and without
        monkeypatch.setattr(T, "PACKED", packed)
        monkeypatch.setattr(T, "HELD", held)
        out = T.average_precision(q, g, "c", (1, 5), block_rows=rows)
        assert {x.id: (None if x.ap is None else round(x.ap, 12), x.r1, x.r5) for x in out.collect()} == want
    assert "collect_list" not in out._jdf.queryExecution().toString()  # no list of a query's positives
    assert {(x.ap, x.r1) for x in T.average_precision(q, g.limit(0), "c", (1,)).collect()} == {(None, 0.0)}
