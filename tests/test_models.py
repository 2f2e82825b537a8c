"""Regressions, clustering, assignment, searches and readers against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import joins, matching, meta, nulls, regression, reports, scoring, similarity, spatial
from quillon.sources import readers, sinks


def line_rows(n=120, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [10, -3, 100]
    y = 2 * x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n) + 7
    return x, y


def table(spark, x, y):
    return spark.createDataFrame([("g", int(i), *map(float, r), float(v), int(i) // 10) for i, (r, v) in enumerate(zip(x, y))], "g string, k long, a double, b double, c double, y double, block int")


def standard_fit(x, y, alpha, l1=0.0):
    m, s = x.mean(0), x.std(0)
    z, v = (x - m) / s, y - y.mean()
    if l1 == 0:
        w = np.linalg.solve(z.T @ z / len(z) + alpha * np.eye(x.shape[1]), z.T @ v / len(z))
    else:
        w = np.zeros(x.shape[1])
        for _ in range(5000):
            for j in range(len(w)):
                r = v - z @ w + z[:, j] * w[j]
                rho = z[:, j] @ r / len(z)
                w[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (z[:, j] @ z[:, j] / len(z) + alpha * (1 - l1))
    return w / s, y.mean() - m @ (w / s)


def test_least_squares_and_ridge_equal_numpy(spark):
    x, y = line_rows()
    df = table(spark, x, y).union(spark.createDataFrame([("g", 999, float("nan"), 1.0, 1.0, 1.0, 0), ("g", 998, 1.0, None, 1.0, 1.0, 0)], "g string, k long, a double, b double, c double, y double, block int"))
    for alpha in (0.0, 0.3):
        got = regression.ols(df, ["g"], ["a", "b", "c"], "y", alpha).first()
        b, a = standard_fit(x, y, alpha)
        assert got.n == 120 and got.coefficients == pytest.approx(b.tolist(), rel=1e-6) and got.intercept == pytest.approx(a, rel=1e-5)
        rss = ((y - a - x @ b) ** 2).sum()
        assert got.rss == pytest.approx(rss, rel=1e-6) and got.r2 == pytest.approx(1 - rss / ((y - y.mean()) ** 2).sum(), rel=1e-6)
    constant = table(spark, x, y).withColumn("a", F.lit(1.0)).withColumn("y", F.lit(2.0))
    assert regression.ols(constant, ["g"], ["a", "b"], "y").first().r2 is None
    assert regression.ols(df.limit(0), ["g"], ["a"], "y").count() == 0


def test_nested_elastic_net_equals_rows(spark):
    """The same nested folds over rows instead of moments; folds kept whole by block."""
    x, y = line_rows(90)
    df = table(spark, x, y)
    alphas, l1s = [0.01, 0.3, 2.0], [0.2, 0.8]
    got = regression.cross_validated(df, ["g"], "k", ["a", "b", "c"], "y", alphas, l1s, folds=4, group="block").first()
    fold = np.array([r.f for r in df.select("k", regression.fold_of(F.col("block"), 4).alias("f")).orderBy("k").collect()])
    sse = 0.0
    for f in sorted(set(fold)):
        rest, best = [g for g in sorted(set(fold)) if g != f], None
        for alpha, l1 in itertools.product(alphas, l1s):
            e = 0.0
            for g in rest:
                inside = (fold != f) & (fold != g)
                b, a = standard_fit(x[inside], y[inside], alpha, l1)
                e += ((y[fold == g] - a - x[fold == g] @ b) ** 2).sum()
            if best is None or e < best[0] - 1e-9:
                best = (e, alpha, l1)
        b, a = standard_fit(x[fold != f], y[fold != f], *best[1:])
        sse += ((y[fold == f] - a - x[fold == f] @ b) ** 2).sum()
    assert got.cv_r2 == pytest.approx(1 - sse / ((y - y.mean()) ** 2).sum(), rel=1e-5)
    held = {r.held_out: r for r in regression.held_out_groups(df, "block", ["a", "b", "c"], "y", [0.01], [0.5]).collect()}
    out = (np.arange(90) // 10) == 4
    b, a = standard_fit(x[~out], y[~out], 0.01, 0.5)
    assert held["4"].r2 == pytest.approx(1 - ((y[out] - a - x[out] @ b) ** 2).sum() / ((y[out] - y[out].mean()) ** 2).sum(), rel=1e-5)
    steps = regression.ladder(df, ["g"], "k", {"one": ["a"], "two": ["a", "b"]}, "y").orderBy("place").collect()
    assert steps[0].gain is None and steps[1].gain == pytest.approx(steps[1].cv_r2 - steps[0].cv_r2)


def test_components_and_residuals_equal_numpy(spark):
    x, y = line_rows(80)
    df = regression.residuals(table(spark, x, y), ["g"], ["a"], "y", "rest")
    b, a = standard_fit(x[:, :1], y, 0.0)
    rest = [r.rest for r in df.orderBy("k").collect()]
    assert rest == pytest.approx((y - a - x[:, 0] * b[0]).tolist(), abs=1e-8)
    got = {r.component: r for r in regression.principal_parts(df, ["g"], ["a", "b", "c"], "b").collect()}
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert got[1].share == pytest.approx(values[-1] / values.sum(), rel=1e-6)
    assert np.abs(got[1].loadings) == pytest.approx(np.abs(vectors[:, -1]), abs=1e-6) and got[1].loadings[1] > 0


def test_assignment_has_the_least_total(spark):
    rng = random.Random(4)
    for n, m in ((1, 1), (2, 5), (4, 4), (5, 2), (3, 6)):
        a, b = [rng.randint(0, 30) / 3 for _ in range(n)], [rng.randint(0, 30) / 3 for _ in range(m)]
        rows = [("g", True, i, v) for i, v in enumerate(a)] + [("g", False, 100 + i, v) for i, v in enumerate(b)] + [("g", True, 900, None)]
        pairs = matching.optimal_pairs(spark.createDataFrame(rows, "g string, c boolean, k int, x double"), ["g"], "c", "k", "x").collect()
        few, many = (a, b) if n <= m else (b, a)
        want = min(sum(abs(x - many[j]) for x, j in zip(few, p)) for p in itertools.permutations(range(len(many)), len(few)))
        assert len(pairs) == min(n, m) == len({r.case for r in pairs}) == len({r.control for r in pairs})
        assert sum(abs(r.x_case - r.x_control) for r in pairs) == pytest.approx(want)


def test_neighbours_of_sparse_nodes_are_found(spark):
    rng = random.Random(5)
    points = [("g", i, rng.random(), rng.random()) for i in range(40)] + [("g", 100, 900.0, 5.0), ("g", 101, -300.0, 2.0), ("h", 1, 0.0, 0.0), ("h", 2, 50.0, 0.0), ("i", 1, 1.0, 1.0), ("g", 300, None, 1.0)]
    nodes = spark.createDataFrame(points, "s string, n int, x double, y double")
    got = {}
    for r in spatial.knn_edges(nodes, ["s"], "n", "x", "y", 3, 0.1).collect():
        got.setdefault((r.s, r.src), []).append((r.rank, r.dst))
    for s, n, x, y in points:
        others = sorted(((math.dist((x, y), (u, v)), m) for t, m, u, v in points if t == s and m != n and u is not None), key=lambda e: (e[0], e[1])) if x is not None else []
        assert [d for _, d in sorted(got.get((s, n), []))] == [m for _, m in others[:3]]
    near = {(r.s, r.n): r.distance for r in spatial.nearest_target(nodes.where("n < 100"), nodes.where("n >= 100"), ["s"], "n", "x", "y", 0.5).collect()}
    assert set(near) == {("g", i) for i in range(40)} and near[("g", 0)] == pytest.approx(min(math.dist(points[0][2:], p[2:]) for p in points[40:42]))


def test_checked_join_and_band(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    many = spark.createDataFrame([(1, "c"), (1, "d")], "k int, y string")
    assert joins.checked_join(many, one, ["k"], "many_to_one").count() == 2
    with pytest.raises(Exception, match="repeated key"):
        joins.checked_join(one, many, ["k"], "one_to_one").collect()
    rng = random.Random(1)
    xs, ys = [rng.uniform(-5, 5) for _ in range(60)], [rng.uniform(-5, 5) for _ in range(60)]
    a, b = spark.createDataFrame([(0, v) for v in xs] + [(0, None)], "g int, x double"), spark.createDataFrame([(0, v) for v in ys], "g int, y double")
    assert joins.band_join(a, b, ["g"], "x", "y", 0.7).count() == sum(abs(x - y) <= 0.7 for x in xs for y in ys)


def test_pooled_reml_finds_the_least_likelihood(spark):
    r, n = [0.1, 0.5, -0.2, 0.4, 0.3], [20, 40, 30, 25, 50]
    got = meta.pooled_reml(spark.createDataFrame([("g", x, k) for x, k in zip(r, n)] + [("g", None, 9), ("g", 0.2, 3)], "g string, r double, n int"), ["g"], "r", F.col("n")).first()
    z, v = np.arctanh(r), 1 / (np.array(n) - 3.0)

    def loss(t):
        w = 1 / (v + t)
        m = (w * z).sum() / w.sum()
        return 0.5 * (np.log(v + t).sum() + np.log(w.sum()) + (w * (z - m) ** 2).sum())

    best = min(np.linspace(0, 0.5, 200_001), key=loss)
    w = 1 / (v + best)
    m, se = (w * z).sum() / w.sum(), w.sum() ** -0.5
    assert got.k == 5 and got.tau2 == pytest.approx(best, abs=1e-4) and got.estimate == pytest.approx(math.tanh(m), abs=1e-4)
    assert got.ci_low == pytest.approx(math.tanh(m - 1.96 * se), abs=1e-3) and got.p == pytest.approx(math.erfc(abs(m / se) / 2**0.5), abs=1e-3)


def test_nulls_stay_in_their_bounds(spark):
    nodes = spark.createDataFrame([("s", i, float(i % 7)) for i in range(60)], "s string, n int, x double")
    edges = spark.createDataFrame([("s", i, (i + d) % 60) for i in range(60) for d in (-1, 1)], "s string, src int, dst int")
    p = nulls.subset_neighbourhood(nodes, edges, ["s"], "n", F.col("x") >= 5, "x", 19).first()
    assert 1 / 20 <= p.p <= 1 and p.draws == 19
    flips = nulls.sign_flip(spark.createDataFrame([(s, g, 1) for s in range(6) for g in range(10)], "s int, g int, sign int"), spark.createDataFrame([("all", g) for g in range(10)], "name string, g int"), "s", "g", "sign", "name", 6, 99).first()
    assert flips.genes == 10 and flips.p <= 0.1
    assert nulls.matched_sets(nodes, nodes.where("n < 50"), "n", 5, 3).where("n < 50").count() == 0


def test_scores_and_reports_at_the_edges(spark):
    expr = spark.createDataFrame([("s", i, g, 1.0 if g == "c" else float(i)) for i in range(3) for g in "abc"], "s string, spot int, gene string, x double")
    sets = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "c"), ("small", "a")], "name string, gene string")
    got = {r.spot: r.score for r in scoring.mean_z_scores(expr, sets, ["s"], "spot", "gene", "x", "name").collect()}
    z = (2 - 1) / math.sqrt(2 / 3)
    assert got == pytest.approx({0: -2 * z / 3, 1: 0.0, 2: 2 * z / 3})
    assert scoring.mean_z_scores(expr.limit(0), sets, ["s"], "spot", "gene", "x", "name").count() == 0
    gaps = spark.createDataFrame([("g", "0_a"), ("g", "3_b"), ("g", "3_c"), ("g", "x")], "g string, l string")
    assert sorted((r.l, r.number) for r in reports.dense_labels(gaps, ["g"], "l").collect()) == [("0_a", "0_a"), ("3_b", "1_b"), ("3_c", "1_c"), ("x", None)]
    owners = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "o int, i string")
    pairs = similarity.all_pairs(similarity.set_overlaps(owners, [], "o", "i"), owners, [], "o", ["jaccard"])
    assert sorted(map(tuple, pairs.collect())) == [(1, 2, 1.0), (1, 3, 0.0), (2, 3, 0.0)]


def test_readers_take_files_as_they_come(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\tnan\n2\t3.5\n")
    assert sorted(map(tuple, readers.delimited(spark, f"file://{tmp_path}/a.tsv", "x long, y double").collect())) == [(1, None), (2, 3.5)]
    (tmp_path / "plain.csv").write_text("AA-1,1,0,2,10.5,20\nBB-1,0,1,1,11,21\n")
    (tmp_path / "head.csv").write_text("barcode,in_tissue,array_row,array_col,pxl_row,pxl_col\nCC-1,1,5,5,1,2\n")
    for name, n in (("plain", 2), ("head", 1)):
        assert readers.positions(spark, f"file://{tmp_path}/{name}.csv").count() == n
    (tmp_path / "sets.gmt").write_text("T1\tdesc\tA\tB\tA\t\nT2\tdesc\nT3\t\tC\n")
    assert sorted(map(tuple, readers.gmt(spark, f"file://{tmp_path}/sets.gmt").collect())) == [("sets", "T1", "A"), ("sets", "T1", "B"), ("sets", "T3", "C")]
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n% c\n3 2 2\n1 2 5\n3 1 7\n")
    assert sorted(map(tuple, readers.matrix_market(spark, f"file://{tmp_path}/m.mtx").collect())) == [(1, 2, 5.0), (3, 1, 7.0)]
    (tmp_path / "sets.json").write_text('{"T": ["A", "B", "A"], "U": []}')
    assert sorted(map(tuple, readers.json_sets(spark, f"file://{tmp_path}/sets.json").collect())) == [("T", "A"), ("T", "B")]
    with pytest.raises(ValueError, match="missing columns: z"):
        readers.require_columns(spark.range(1), ["id", "z"])
    out = sinks.write_table(spark.range(3), f"file://{tmp_path}/out", "csv")
    audit = [r for r in sinks.file_audit(spark, out).collect() if r.file.startswith("part")]
    assert sum(r.lines for r in audit) == 3 and all(len(r.sha256) == 64 for r in audit)
    a, b = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string"), spark.createDataFrame([(1, None), (2, "x"), (1, None)], "k int, v string").repartition(3)
    assert sinks.content_audit(a).collect() == sinks.content_audit(b).collect() != sinks.content_audit(a.distinct()).collect()
