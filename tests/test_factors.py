"""Components, factorisation, maps, residuals, trends and the nulls of this kind against numpy; missing values and odd names."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import factors, nulls, ranks, regression, scoring, spatial, statistics

NAN, INF = float("nan"), float("inf")


def long_of(spark, x, more=()):
    rows = [(i, f"f{j:02d}", float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if x[i, j]]
    return spark.createDataFrame([*rows, *more], "node long, feature string, x double").repartition(3)


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.poisson(2, (80, 12)).astype(float) * (1 + np.arange(12) % 3)
    x[:, 5] = 4.0
    x[3, 2] = 900.0  # cut off
    at, loads = factors.principal_components(long_of(spark, x, [(1, "f00", None), (2, None, 1.0), (None, "f01", 1.0), (5, "f01", NAN)]), "node", "feature", "x", 4)
    sd = x.std(0, ddof=1)
    z = np.clip(np.divide(x - x.mean(0), sd, out=np.zeros_like(x), where=sd > 0), -10, 10)
    z = z - z.mean(0)
    e, u = np.linalg.eigh(z.T @ z / 79)
    e, u = e[::-1], u[:, ::-1]
    got = {(r.node, r.component): r.value for r in at.collect()}
    for j in range(4):
        mine = np.array([got[i, j + 1] for i in range(80)])
        assert np.allclose(np.abs(mine), np.abs(z @ u[:, j]), atol=1e-6)
    shares = {r.component: r.share for r in loads.collect()}
    assert [shares[j + 1] for j in range(4)] == pytest.approx((e[:4] / e.sum()).tolist())
    assert max(abs(r.loading) for r in loads.where("component = 1").collect()) == max(r.loading for r in loads.where("component = 1").collect())
    assert factors.principal_components(long_of(spark, x).limit(0), "node", "feature", "x", 3)[0].count() == 0


def test_factorisation_finds_planted_programs(spark):
    rng = np.random.default_rng(4)
    h = np.zeros((3, 15))
    for j in range(3):
        h[j, 5 * j : 5 * j + 5] = rng.random(5) + 0.5
    w = rng.dirichlet([0.3] * 3, 120) * 30
    x = w @ h + rng.random((120, 15)) * 0.01
    rows = factors.SparseRows(long_of(spark, x), "node", "feature", "x")
    assert rows.names == [f"f{j:02d}" for j in range(15)] and rows.count == 120
    spectra, losses = factors.factorise(rows, 3, 5, 60)
    for r in range(5):
        own = losses[r][~np.isnan(losses[r])]
        assert len(own) > 2 and (np.diff(own) <= 1e-9 * own[:-1]).all()
    table, loads, used = factors.programs(long_of(spark, x, [(1, "f00", -5.0), (2, "f01", None)]), "node", "feature", "x", (3, 40), 6, 60)
    assert [(r.k, r.silhouette > 0.9) for r in table.collect()] == [(3, True)]
    found = np.zeros((3, 15))
    for r in loads.collect():
        found[r.program - 1, int(r.feature[1:])] = r.loading
    assert np.allclose(found.sum(1), 1)
    want = h / h.sum(1, keepdims=True)
    match = [int(np.argmax(found @ want[j])) for j in range(3)]
    assert sorted(match) == [0, 1, 2] and all(np.abs(found[match[j]] - want[j]).max() < 0.02 for j in range(3))
    share = np.zeros((120, 3))
    for r in used.collect():
        share[r.node, r.program - 1] = r.usage
    true = w * h.sum(1)
    assert np.abs(share[:, match] - true / true.sum(1, keepdims=True)).max() < 0.03


def test_usages_are_the_least_squares(spark):
    rng = np.random.default_rng(2)
    h, x = rng.random((3, 8)), rng.random((10, 8))
    w = factors.usages(x, h)
    gradient = (w @ h - x) @ h.T
    assert (w >= 0).all() and (gradient > -1e-8).all() and np.abs(gradient * w).max() < 1e-8
    with pytest.raises(ValueError, match="near neighbours"):
        factors.consensus_spectra(np.eye(6).reshape(3, 2, 6), 0.5, 0.1)


def test_planted_points_return_from_their_distances(spark):
    rng = np.random.default_rng(6)
    p = rng.normal(size=(25, 2)) * [3, 1]
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    pairs = spark.createDataFrame([(a, b, float(d[a, b])) for a in range(25) for b in range(a)] + [(1, None, 2.0), (3, 3, 1.0), (77, 1, 1.0)], "a long, b long, d double")
    nodes = spark.createDataFrame([(i,) for i in range(25)] + [(None,)], "n long")
    got = factors.distance_scaling(pairs, nodes, "n", "d", 2).collect()
    at = np.zeros((25, 2))
    for r in got:
        at[r.node, r.axis - 1] = r.value
    assert np.abs(np.sqrt(((at[:, None] - at[None]) ** 2).sum(-1)) - d).max() < 1e-4
    assert sum({r.axis: r.share for r in got}.values()) == pytest.approx(1)
    # absent pairs are far apart; the same as the whole table by numpy
    sim = {(a, b): float(rng.random()) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.3}
    whole = np.ones((14, 14)) - np.eye(14)
    for (a, b), s in sim.items():
        whole[a, b] = whole[b, a] = 1 - s
    j = np.eye(14) - 1 / 14
    e, u = np.linalg.eigh(-j @ (whole**2) @ j / 2)
    sparse = spark.createDataFrame([(a, b, 1 - s) for (a, b), s in sim.items()], "a long, b long, d double")
    got = {(r.node, r.axis): (r.value, r.share) for r in factors.distance_scaling(sparse, spark.range(14).toDF("n"), "n", "d", 2).collect()}
    for axis in (1, 2):
        mine = np.array([got[i, axis][0] for i in range(14)])
        assert np.allclose(np.abs(mine), np.abs(u[:, -axis]) * np.sqrt(e[-axis]), atol=1e-3) and got[0, axis][1] == pytest.approx(e[-axis] / e.sum(), abs=1e-6)
    assert factors.distance_scaling(sparse, nodes.limit(0), "n", "d").count() == 0


def test_residuals_and_trend_with_missing_values(spark):
    rng = np.random.default_rng(3)
    x = rng.poisson(np.linspace(0.2, 9, 14), (40, 14)).astype(float)
    more = [(1, "f03", None), (1, "f03", NAN), (None, "f03", 2.0)]
    x[0] = np.maximum(x[0], 1)
    x[:, 0] = np.maximum(x[:, 0], 1)
    got = {r.feature: r for r in factors.residual_variance(long_of(spark, x, [*more, (2, "f03", -3.0)]), "node", "feature", "x").collect()}
    m = np.outer(x.sum(1), x.sum(0)) / x.sum()
    z = np.clip((x - m) / np.sqrt(m + m * m / 100), -math.sqrt(40), math.sqrt(40))
    assert [got[f"f{j:02d}"].squares for j in range(14)] == pytest.approx((z * z).sum(0).tolist())
    assert [got[f"f{j:02d}"].variance for j in range(14)] == pytest.approx(z.var(0).tolist())
    got = {r.feature: r for r in factors.variable_features(long_of(spark, x, more), "node", "feature", "x").collect()}
    assert [got[f"f{j:02d}"].variance for j in range(14)] == pytest.approx(x.var(0, ddof=1).tolist()) and sorted(r.rank for r in got.values()) == list(range(1, 15))
    assert all(got[f"f{j:02d}"].trend is None and got[f"f{j:02d}"].variability == 0 for j in range(14) if x[:, j].std() == 0)
    own = x[:, x.std(0) > 0]
    lx, ly, j = np.log10(own.mean(0)), np.log10(own.var(0, ddof=1)), own.shape[1] - 5
    bins = np.floor(lx / 0.1)
    weight = np.maximum(1 - (np.abs(bins - bins[j]) / 11) ** 3, 0) ** 3
    a = np.stack([lx**0, lx, lx**2], axis=1)
    fit = np.linalg.solve(a.T @ (a * weight[:, None]), a.T @ (weight * ly)) @ [1, lx[j], lx[j] ** 2]
    assert got["f09"].trend == pytest.approx(fit) and (own[:, j] == x[:, 9]).all()
    c = np.minimum(own[:, j], own[:, j].mean() + 10 ** (fit / 2) * math.sqrt(40))
    assert got["f09"].variability == pytest.approx(((c - own[:, j].mean()) ** 2).sum() / 39 / 10**fit)


def test_pseudo_f_with_and_without_covariate(spark):
    rng = np.random.default_rng(7)
    n, times = 40, 30
    g, m, y = rng.random(n) < 0.4, rng.normal(size=n), rng.normal(size=(n, 2))
    y[:, 0] += g * 1.2 + m
    rows = [("a", i, bool(g[i]), float(m[i]), *map(float, y[i])) for i in range(n)] + [("flat", i, i % 2 == 0, 1.0, float(i), float(i * i % 7)) for i in range(9)] + [(None, 1, True, 1.0, 2.0, 3.0), ("a", 99, None, 1.0, 1.0, 1.0), ("a", 98, True, NAN, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "n string, k long, _g boolean, m double, u double, v double")
    got = {r[0]: r for r in regression.pseudo_f(df, ["n"], "k", "_g", ["u", "v"], "m", times).collect()}

    def f_of(y, x0, x1):
        sse = lambda x: float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())
        small, full = sse(x0), sse(x1)
        return (small - full) / (full / (len(y) - x1.shape[1])), (small - full) / small

    x0 = np.column_stack([np.ones(n), m])
    x1 = np.column_stack([x0, g])
    f, r2 = f_of(y, x0, x1)
    rest = y - x0 @ np.linalg.lstsq(x0, y, rcond=None)[0]
    more = 0
    for perm in range(1, times + 1):
        order = sorted(range(n), key=lambda i: (hashlib.md5(f"pseudo|{perm}|{i}".encode()).hexdigest(), i))  # noqa: B023
        more += f_of(y - rest + rest[order], x0, x1)[0] >= f - 1e-9
    a = got["a"]
    assert (a[1], a.mode, a.f, a.r2, a.p) == (n, "group_plus_covariate", pytest.approx(f), pytest.approx(r2), pytest.approx((more + 1) / (times + 1)))
    assert got["flat"].mode == "group_only" and got["flat"].f is not None and got[None].f is None and got[None].p is None
    plain = {r[0]: r for r in regression.pseudo_f(df.where("_g is not null and not isnan(m)"), ["n"], "k", "_g", ["u", "v"], None, 5).collect()}
    assert plain["a"].f == pytest.approx(f_of(y, x0[:, :1], x1[:, [0, 2]])[0]) and plain["a"].mode == "group_only"


def test_matched_sets_smoothness_by_hand(spark):
    rng = np.random.default_rng(8)
    side, genes, times = 5, 18, 12
    nodes = [(r * side + c, r, c) for r in range(side) for c in range(side)]
    x = rng.random((side * side, genes)).round(3)
    x[:, :5] += np.array([[r] for _, r, _ in nodes])
    edges = [(a, b) for a, r, c in nodes for b, s, d in nodes if abs(r - s) + abs(c - d) == 1]
    e = spark.createDataFrame([("s", n, j, float(x[n, j])) for n in range(side * side) for j in range(genes) if not (n == 0 and j == 3)] + [("s", 1, 2, None), ("s", 1, 2, NAN)], "n string, node long, gene long, x double")
    got = nulls.matched_set_smoothness(e, spark.createDataFrame([("s", a, b) for a, b in edges], "n string, src long, dst long"), spark.createDataFrame([("rows", j) for j in range(5)] + [("few", 1), ("many", 2)] + [("most", j) for j in range(12)], "name string, gene long"), ["n"], "node", "gene", "x", "name", times, 5, "matched").collect()
    assert [r.name for r in got] == ["rows"]
    x[0, 3] = 0

    def both(own):
        v = x[:, own].mean(1)
        z = v - v.mean()
        around = np.array([np.mean([v[b] for a, b in edges if a == n]) for n in range(len(v))])
        return len(v) / len(edges) * sum(z[a] * z[b] for a, b in edges) / (z @ z), np.corrcoef(v, around)[0, 1]

    seen = both(list(range(5)))
    drawn = [both(sorted(range(5, genes), key=lambda j: (hashlib.md5(f"matched|{perm}|{j}".encode()).hexdigest(), j))[:5]) for perm in range(1, times + 1)]  # noqa: B023
    r = got[0]
    assert (r.moran_i, r.neighbour_r, r.null_moran, r.null_r) == tuple(map(pytest.approx, (*seen, np.mean([d[0] for d in drawn]), np.mean([d[1] for d in drawn]))))
    assert (r.p_moran, r.p_r) == tuple(pytest.approx((1 + sum(d[i] >= seen[i] for d in drawn)) / (times + 1)) for i in (0, 1)) and r.pool == 13


# ---------------------------------------------------------------- missing values, ties and names

WITH_GAPS = [("g", 1, 2.0), ("g", 2, 4.0), ("g", 3, 9.0), ("g", 4, NAN), ("g", 5, INF), ("g", 6, None), (None, 1, 1.0), (None, 2, 3.0), ("void", 1, None)]


@pytest.mark.parametrize("name", ["n", "_m", "_p", "_range"])
def test_scalings_ranks_and_adjustment_ignore_what_is_missing(spark, name):
    df = spark.createDataFrame(WITH_GAPS, f"{name} string, k int, x double").repartition(2)
    x = np.array([2.0, 4.0, 9.0])
    got = {(r[0], r.k): r for r in ranks.scaled(df, [name], ranks.z_of("x", "z"), ranks.min_max_of("x", "scaled", zero="zero"), ranks.share_of("x", "share"), ranks.sd_level_of("x", "level"), ranks.quartile_of("x", "side"), ranks.quantile_of("x", 2, "code"), ranks.log_of("x", "logged")).collect()}
    assert len(got) == len(WITH_GAPS)
    for i, v in enumerate(x):
        r = got["g", i + 1]
        assert (r.z, r.scaled, r.share, r.zero) == tuple(map(pytest.approx, ((v - x.mean()) / x.std(), (v - 2) / 7, v / 15, -2 / 7)))
    assert [got["g", i].level for i in (1, 2, 3)] == ["LOW", "MID", "HIGH"] and [got["g", i].side for i in (1, 2, 3)] == ["LOW", None, "HIGH"] and [got["g", i].code for i in (1, 2, 3)] == [0, 0, 1]
    assert all(got["g", i][c] is None for i in (4, 5, 6) for c in ("z", "scaled", "share", "level", "side", "code")) and got[None, 2].scaled == 1.0
    ranked = {(r[0], r.k): r.r for r in ranks.rank_average(df.where("k < 4 or k = 6"), [name], "x", "r").collect()}
    assert ranked == {("g", 1): 1.0, ("g", 2): 2.0, ("g", 3): 3.0, ("g", 6): None, (None, 1): 1.0, (None, 2): 2.0, ("void", 1): None}
    assert {(r[0], r.k, r.tail) for r in ranks.both_tails(df, [name], "x", "k", 9).collect()} == {("g", 1, "positive"), ("g", 2, "positive"), ("g", 3, "positive"), (None, 1, "positive"), (None, 2, "positive")}
    p = df.withColumn("x", F.when(F.isnan("x"), F.col("x")).otherwise(F.col("x") / 100))
    adjusted = {(r[0], r.k): r for r in statistics.adjust(p, [name], "x", "k").collect()}
    assert set(adjusted) == {("g", 1), ("g", 2), ("g", 3), (None, 1), (None, 2)} and adjusted["g", 1].bh == pytest.approx(0.06) and adjusted["g", 1].holm == pytest.approx(0.06) and adjusted["g", 3].bonferroni == pytest.approx(0.27)
    d = {r[0]: r for r in statistics.describe(df, [name], "x").collect()}
    assert (d["g"][1], d["g"].median, d["g"].max) == (3, 4.0, 9.0) and d["void"].mean is None


def test_adjustment_and_ranks_over_many_ranges(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(300) ** 3, 3)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "k int, p double").repartition(5)
    got = {r.k: r for r in statistics.adjust(df, [], "p", "k").collect()}
    order = np.argsort(p, kind="stable")
    bh, holm, low, high = np.zeros(300), np.zeros(300), 1.0, 0.0
    for place in range(299, -1, -1):
        low = bh[order[place]] = min(low, p[order[place]] * 300 / (place + 1))
    for place in range(300):
        high = holm[order[place]] = max(high, min(1, p[order[place]] * (300 - place)))
    assert [got[i].bh for i in range(300)] == pytest.approx(bh.tolist()) and [got[i].holm for i in range(300)] == pytest.approx(holm.tolist())
    ranked = {r.k: r.r for r in ranks.rank_average(df, [], "p", "r").collect()}
    assert all(ranked[i] == (p < p[i]).sum() + ((p == p[i]).sum() + 1) / 2 for i in range(300))
    total = {r.k: r.s for r in ranks.running_sum(df, [], ["k"], F.col("k"), "s").collect()}
    assert all(total[i] == i * (i - 1) // 2 for i in range(300))


def test_spatial_measures_ignore_what_is_missing(spark):
    rows = [("a", i, float(v)) for i, v in enumerate([1, 5, 2, 8, 3, 9])]
    edges = spark.createDataFrame([("a", i, j) for i in range(6) for j in range(6) if abs(i - j) == 1] + [("a", 2, 6), ("a", 6, 2)], "n string, src long, dst long")
    clean = spark.createDataFrame(rows, "n string, node long, x double")
    for gap in (NAN, INF, None):
        gaps = spark.createDataFrame([*rows, ("a", 6, gap)], "n string, node long, x double")
        for run in (spatial.moran, spatial.local_moran, spatial.getis_ord):
            known = lambda df: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
            e = edges.where("src < 6 and dst < 6")
            mine = run(gaps, edges, ["n"], "node", "x")
            mine = mine.where("node < 6") if "node" in mine.columns else mine
            assert known(mine) == known(run(clean, e, ["n"], "node", "x")), run
        assert {r.node: r.mean_x for r in spatial.neighbour_mean(gaps, edges, ["n"], "node", ["x"]).collect()}[2] == 6.5
        assert {r.p for r in spatial.lisa(gaps, edges, ["n"], "node", "x", 9).collect()} - {1.0}


def test_labels_that_are_missing_count_for_nothing(spark):
    df = spark.createDataFrame([("g", "a", "x"), ("g", "a", "y"), ("g", None, "x"), ("g", None, None), ("g", "b", None)], "n string, a string, b string")
    r = statistics.label_entropy(df, ["n"], "a").collect()[0]
    assert (r.labels, r.mode) == (2, "a") and r.entropy == pytest.approx(-(2 / 3) * math.log(2 / 3) - math.log(1 / 3) / 3)
    assert sorted((q.a, q.b, q[3]) for q in statistics.contingency(df, ["n"], "a", "b").collect()) == [("a", "x", 1), ("a", "y", 1)]
    weights = spark.createDataFrame([("p", 2.0), ("q", -3.0), ("r", NAN), ("s", None), ("t", 0.5)], "gene string, w double")
    found = {(v.variant, v.gene) for v in scoring.signature_variants(weights, "gene", "w", 1).collect()}
    assert ("strongest", "q") in found and not any(g in ("r", "s") for _, g in found) and ("positive", "p") in found


def test_scalings_read_their_table_twice_at_most(spark, tmp_path):
    spark.createDataFrame([("g", 1.0), ("h", 2.0)], "n string, x double").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    wide = ranks.scaled(df, ["n"], ranks.z_of("x", "z"), ranks.min_max_of("x", "m"), ranks.share_of("x", "s"), ranks.sd_level_of("x", "l"), ranks.quantile_of("x", 4, "c"), ranks.quartile_of("x", "q"))
    assert wide._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 2
