"""Small pinned cases: the decisions where several meanings are possible, and degenerate input."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import distributions as D
from quillon.functions import scalars as S
from quillon.operators import meta, ranks, similarity, spatial, statistics


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_null_policy_and_labels(spark):
    df = spark.createDataFrame([("1",), ("nan",), ("inf",), ("x",), (None,)], "a string")
    assert [r[0] for r in df.select(S.numeric("a")).collect()] == [1.0, None, None, None, None]
    df = spark.createDataFrame([("Yes",), ("hot",), ("0",), (None,)], "a string")
    assert [r[0] for r in df.select(S.truthy("a")).collect()] == [True, True, False, False]
    df = spark.createDataFrame([(" b; a;b;;",), (None,)], "a string")
    assert [r[0] for r in df.select(S.list_items("a")).collect()] == [["a", "b"], []]


def test_average_ranks_leave_nulls_out(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 1.0), ("g", 3.0), ("g", None)], "g string, x double")
    assert sorted((r.x or -1, r.r) for r in ranks.rank_average(df, ["g"], "x", "r").collect() if r.r) == [(1.0, 1.5), (1.0, 1.5), (3.0, 3.0)]


def test_constant_input_gives_null_not_an_error(spark):
    df = spark.createDataFrame([("g", 1.0, float(i)) for i in range(5)], "g string, x double, y double")
    assert statistics.pearson(df, ["g"], "x", "y").first().r is None
    assert statistics.spearman(df, ["g"], "x", "y").first().rho is None
    assert ranks.z_score(df, ["g"], "x", "z").first().z is None
    assert ranks.min_max(df, ["g"], "x", "z").first().z == 0.5
    assert statistics.two_groups(df, ["g"], F.col("y") > 2, "x").first().cohens_d is None


def test_adjusted_p_values_skip_missing(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", None)], "f string, k string, p double")
    got = {r.k: (r.bh, r.holm, r.bonferroni) for r in statistics.adjust(df, ["f"], "p", "k").collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"] == pytest.approx((0.03, 0.03, 0.03))
    assert got["c"] == pytest.approx((0.04, 0.06, 0.09))
    assert got["b"] == pytest.approx((0.04, 0.06, 0.12))


def test_tails_against_known_values(spark):
    """Values of printed tables and closed forms."""
    df = spark.createDataFrame([(3.0, 5.0, 1.96, 8.0, 2.0, 10.0)], "k double, n double, z double, a double, d double, m double")
    one = df.select(
        D.normal_p(F.lit(1.959963984540054)).alias("z"), D.student_p(F.lit(2.228138852), F.lit(10.0)).alias("t"), D.student_p(F.lit(1.0), F.lit(1.0)).alias("t1"), D.chi_square_p(F.lit(3.841458821), F.lit(1.0)).alias("c1"),
        D.chi_square_p(F.lit(18.307038053), F.lit(10.0)).alias("c10"), D.chi_square_p(F.lit(4.0), F.lit(2.0)).alias("c2"), D.f_p(F.lit(4.964602744), F.lit(1.0), F.lit(10.0)).alias("f"), D.binomial_p(F.lit(1.0), F.lit(6.0), F.lit(0.5)).alias("b"),
        D.signed_rank_p(F.lit(0.0), F.lit(5.0)).alias("w"), D.fisher_p(F.lit(2), F.lit(2), F.lit(1), F.lit(5)).alias("e"), D.student_p(F.lit(None).cast("double"), F.lit(3.0)).alias("none"), D.student_p(F.lit(1.0), F.lit(0.0)).alias("no_df"),
    ).first()
    assert (one.z, one.t, one.c1, one.c10, one.f) == pytest.approx((0.05,) * 5, abs=1e-8)
    assert one.t1 == pytest.approx(0.5) and one.c2 == pytest.approx(math.exp(-2))
    assert one.b == pytest.approx(2 * 7 / 64) and one.w == pytest.approx(2 / 32)
    assert one.e.p_greater == pytest.approx((6 * 6 + 4) / 120) and one.e.p_two_sided == pytest.approx((6 * 6 + 4) / 120 + 20 / 120)
    assert one.none is None and one.no_df is None


def test_missing_flags_and_values_belong_to_no_group(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("g", True, 1.0), ("g", True, 4.0), ("g", False, 2.0), ("g", False, 3.0), ("g", None, 9.0), ("g", True, nan), ("g", False, inf), (None, True, 1.0), (None, False, 2.0)]
    got = {r.g: r for r in statistics.mann_whitney(spark.createDataFrame(rows, "g string, f boolean, x double"), ["g"], F.col("f"), "x").collect()}
    assert (got["g"].n1, got["g"].n2, got["g"].u, got["g"].rank_biserial) == (2, 2, 2.0, 0.0)
    assert set(got) == {"g", None} and got[None].u == 0.0
    df = spark.createDataFrame([(None, float(i), float(i * i % 7), "a") for i in range(8)] + [(None, nan, 1.0, "a"), (None, 2.0, inf, "a")], "g string, x double, y double, l string")
    assert statistics.pearson(df, ["g"], "x", "y").first().n == statistics.spearman(df, ["g"], "x", "y").first().n == 8
    d = statistics.describe(df, ["g"], "y").first()
    assert d.n == 9 and d.max == 4.0 and d.mean is not None and not math.isnan(d.mean)
    assert statistics.signed_rank(df, ["g"], "x").count() == 1 and meta.consistency(df, ["g"], "x").count() == 1
    assert ranks.quantile_code(df, ["g"], "x", 2, "c").count() == 10 and ranks.relabel_by_median(df, ["g"], "l", "x", "c").count() == 10
    assert meta.inverse_variance(df.withColumn("se", F.lit(1.0)), ["g"], "y", "se").first().k == 9


def test_labels_are_the_survey_s(spark):
    df = spark.createDataFrame([(0.05, 1), (0.15, 2), (-0.3, 3), (0.9, 4), (None, None)], "r double, n int")
    assert [tuple(r) for r in df.select(S.strength("r"), S.tier("n"), S.sign_pattern("r", F.lit(0.1))).collect()] == [
        ("negligible", "sample_specific", "both_positive"), ("weak", "subset_specific", "both_positive"), ("moderate", "subset_specific", "second_only_positive"),
        ("strong", "cohort_recurrent", "both_positive"), ("not_available", None, "undefined"),
    ]
    df = spark.createDataFrame([("2",), ("0.5",), ("-1",), ("nan",), ("cold",)], "a string")
    assert [r[0] for r in df.select(S.truthy("a")).collect()] == [True, True, False, False, True]


def test_upsert_is_deterministic(spark):
    old = spark.createDataFrame([("k", 1, "old"), ("l", 1, "only")], "k string, v int, x string")
    new = spark.createDataFrame([("k", 2, "b"), ("k", 3, "a"), ("k", 3, "c")], "k string, v int, x string")
    assert rows(ranks.upsert(old, new, ["k"])) == [("k", 3, "c"), ("l", 1, "only")]
    assert rows(ranks.upsert(old, new, ["k"], [F.col("v")])) == [("k", 2, "b"), ("l", 1, "only")]


def test_neighbours_are_the_six_at_equal_distance(spark):
    cells = [(r, c, r * 100 + c) for r in range(5) for c in range(10) if (r + c) % 2 == 0]
    nodes = spark.createDataFrame(cells, "row long, col long, node long").withColumn("s", F.lit(1))
    edges = spatial.lattice_edges(nodes, ["s"], "node", "row", "col")
    assert sorted(r.dst for r in edges.where("src = 204").collect()) == [103, 105, 202, 206, 303, 305]
    assert rows(spatial.rings(edges, nodes.where("node = 204"), ["s"], "node", 1).groupBy("ring").count()) == [(0, 1), (1, 6)]


def test_lisa_counts_every_permutation_of_the_kernel(spark):
    cells = [("a" if i < 30 else "b", i, i // 6, 2 * (i % 6) + i // 6 % 2, None if i == 8 else float(i * i % 11)) for i in range(55)]
    nodes = spark.createDataFrame(cells, "s string, node long, row long, col long, x double")
    edges = spatial.lattice_edges(nodes, ["s"], "node", "row", "col")
    near = {}
    for r in edges.where("src <> 8 and dst <> 8").collect():
        near.setdefault(r.src, []).append(r.dst)
    given = {}
    for r in spatial.permuted(nodes.where("x is not null"), ["s"], "node", "x", 40, "lisa").collect():
        given.setdefault((r.s, r.perm), {})[r.node] = r.x
    for s in "ab":
        given[s, 0] = {c[1]: c[4] for c in cells if c[0] == s and c[4] is not None}

    def extreme(x):
        m = sum(x.values()) / len(x)
        sd = math.sqrt(sum((v - m) ** 2 for v in x.values()) / len(x))
        z = {k: (v - m) / sd for k, v in x.items()}
        return {k: round(abs(z[k] * sum(z[d] for d in near[k]) / len(near[k])), 9) for k in z}

    found = {k: extreme(x) for k, x in given.items()}
    got = {r.node: r.p for r in spatial.lisa(nodes, edges, ["s"], "node", "x", 40).collect()}
    assert got == {n: pytest.approx((1 + sum(found[s, p][n] >= found[s, 0][n] for p in range(1, 41))) / 41) for s in "ab" for n in found[s, 0]}


def test_nearest_neighbours_break_ties_by_id(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 1.0), (4, -1.0, 0.0)], "n long, x double, y double").withColumn("s", F.lit(1))
    got = spatial.knn_edges(nodes, ["s"], "n", "x", "y", 2, 1.5)
    assert [r.dst for r in got.where("src = 1").orderBy("rank").collect()] == [2, 3]


def test_sets_and_components(spark):
    items = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 9), ("a", 1)], "o string, i long")
    assert rows(similarity.set_overlaps(items, [], "o", "i").select("a", "b", "shared", "jaccard")) == [("a", "b", 1, 1 / 3)]
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31)], "a long, b long")
    assert rows(similarity.components(edges)) == [(i, 0) for i in range(21)] + [(30, 30), (31, 30)]


def test_meta_analysis_of_equal_studies(spark):
    df = spark.createDataFrame([("v", 0.5, 0.1), ("v", 0.5, 0.2), ("w", 0.1, 0.1), ("w", 0.9, 0.1)], "v string, y double, se double")
    got = {r.v: r for r in meta.inverse_variance(df, ["v"], "y", "se").collect()}
    assert got["v"].tau2 == 0 and got["v"].random == pytest.approx(0.5)
    assert got["w"].tau2 == pytest.approx(0.31) and got["w"].random_se == pytest.approx(0.4)
    assert {r.v: r.tau2 for r in meta.reml(df, ["v"], "y", "se").collect()}["w"] == pytest.approx(0.31)


def test_balances(spark):
    df = spark.createDataFrame([(0.0, 0.25, 0.75)], "a double, b double, c double")
    parts = S.zero_replaced(["a", "b", "c"], 0.1)
    p = df.select(*[x.alias(n) for x, n in zip(parts, "abc")]).first()
    assert tuple(p) == pytest.approx((0.1, 0.225, 0.675))
    b = df.select(S.balance([F.lit(2.0)], [F.lit(0.5), F.lit(0.5)]).alias("x")).first().x
    assert b == pytest.approx(math.sqrt(2 / 3) * math.log(4))


def test_upsert_keeps_the_new_row(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "c")], "k long, v string")
    assert rows(ranks.upsert(old, new, ["k"])) == [(1, "a"), (2, "c")]


def test_profiles_and_sweeps_of_constants_and_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 4.0), (None, 0.0, 1.0), (None, 10.0, 3.0), ("b", None, 1.0)], "g string, x double, y double")
    got = {(r.g, r.bin): (r.n, r.fraction, r["mean"], r["median"]) for r in statistics.binned_profile(df, ["g"], "x", "y", 5).collect()}
    assert got == {("a", 0): (2, 1.0, 3.0, 3.0), (None, 0): (1, 0.5, 1.0, 1.0), (None, 4): (1, 0.5, 3.0, 3.0)}
    assert statistics.binned_profile(df, [], "x", "y", 2).agg(F.sum("n")).first()[0] == 4
    swept = {(r.g, r.threshold): (r.n, r.n_above, r.fraction_above) for r in statistics.threshold_sweep(df, ["g"], "x", [1, 5]).collect()}
    assert swept == {("a", 1.0): (2, 2, 1.0), ("a", 5.0): (2, 0, 0.0), (None, 1.0): (2, 1, 0.5), (None, 5.0): (2, 1, 0.5), ("b", 1.0): (0, 0, None), ("b", 5.0): (0, 0, None)}
