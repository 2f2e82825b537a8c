"""Work that must not grow faster than the input: plans, counted pairs, draws that are not sorted whole."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.functions import hashes
from quillon.operators import communities, factors, joins, linkage, matching, nulls, ranks, regression, reports, similarity, spatial, statistics
from quillon.sources import readers

from tests.test_graphs import linked


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gmt_lines_are_split_before_their_genes_become_rows(spark, tmp_path):
    (tmp_path / "lib.gmt").write_text("a\t-\tx\ty\t x\t \n\t-\tz\nb\t-\nc\n")
    got = readers.gmt(spark, str(tmp_path / "lib.gmt"))
    assert sorted(tuple(r) for r in got.collect()) == [("lib", "a", "x"), ("lib", "a", "y")]
    above = optimized(got).split("Generate")[0]
    assert "split(" not in above


def test_relations_and_classes_count_pairs_that_share_nothing(spark):
    rng = random.Random(5)
    labels = {i: i % 3 for i in range(20)} | {20: 9}
    sims = {(a, b): rng.random() for a in range(21) for b in range(a + 1, 21) if rng.random() < 0.2}
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in sims.items()], "a int, b int, s double")
    every = spark.createDataFrame([(a, b, sims.get((a, b), 0.0)) for a in range(21) for b in range(a + 1, 21)], "a int, b int, s double")
    members = spark.createDataFrame(list(labels.items()), "item int, label int")
    close = lambda df, *keys: {tuple(r[k] for k in keys): [v if not isinstance(v, float) else round(v, 9) for v in r] for r in df.collect()}
    assert close(similarity.separation(pairs, members, "s", sparse=True), "label") == close(similarity.separation(every, members, "s"), "label")
    assert close(similarity.medoid(pairs, members, "s", sparse=True), "label") == close(similarity.medoid(every, members, "s"), "label")
    at = members.select("item", (F.col("item") % 4).alias("sample"), F.col("label").alias("group"))
    want = {}
    for a in range(21):
        for b in range(a + 1, 21):
            kind = "same_sample" if a % 4 == b % 4 else "same_group" if labels[a] == labels[b] else "different"
            want.setdefault(kind, []).append(sims.get((a, b), 0.0))
    assert {r.relation: (r.pairs, round(r["mean"], 9)) for r in similarity.relation_summary(pairs, at, "s").collect()} == {k: (len(v), round(sum(v) / len(v), 9)) for k, v in want.items()}


def test_nearest_in_band_equals_the_pairs(spark):
    rng = random.Random(6)
    rows = [(g, i, rng.choice([rng.randrange(12) / 2.0, rng.randrange(400) / 4.0])) for g in ("u", "v", None) for i in range(60)] + [("w", 1, 0.0), ("w", 2, 90.0), ("u", 99, None)]
    df = spark.createDataFrame(rows, "g string, a int, x double")
    filled = df.withColumn("g", F.coalesce("g", F.lit("-")))
    pairs = joins.band_join(filled, filled.select("g", F.col("a").alias("b"), F.col("x").alias("y")), ["g"], "x", "y", 3.0).where("a <> b").select("g", "a", "b", F.abs(F.col("x") - F.col("y")).alias("gap"), F.col("y").alias("score"))
    want = joins.nearest_partner(pairs, ["g"], "a", "b", "gap", "score").select("g", "a", "b", "gap")
    got = joins.nearest_in_band(df, ["g"], "a", "x", 3.0).select(F.coalesce("g", F.lit("-")), "a", "b", "gap")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def _first_by_md5(rows, times, seed, size):
    """{(group, perm): keys} by sorting every draw whole."""
    out = {}
    for g in {r[0] for r in rows}:
        keys = [r[1] for r in rows if r[0] == g]
        for p in range(1, times + 1):
            out[g, p] = sorted(keys, key=lambda k: (hashlib.md5(f"{seed}|{p}|{k}".encode()).hexdigest(), k))[: size[g]]
    return out


def test_draws_are_not_sorted_whole_and_equal_those_that_are(spark):
    rows = [(g, k) for g, n in (("a", 3000), ("b", 40), (None, 7)) for k in range(n)]
    size = {"a": 700, "b": 40, None: 0}
    df, n = spark.createDataFrame(rows, "g string, k long"), spark.createDataFrame(list(size.items()), "g string, n long")
    want = _first_by_md5(rows, 4, "s", size)
    got = {}
    for r in nulls.random_subsets(df, ["g"], "k", n, 4, "s").collect():
        got.setdefault((r.g, r.perm), []).append(r.k)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
    dealt = nulls._dealt(df, ["g"], "k", n, 4, "s", {"_s": F.col("k")})
    assert dealt.where("g = 'a' and perm = 1").count() < 1500
    sums = {(r.g, r.perm): r["t"] for r in dealt.where("_in").groupBy("g", "perm").agg(F.sum("_s").alias("t")).collect()}
    assert sums == {k: sum(v) for k, v in want.items() if v}
    # a key that half of the rows share makes hashes uneven: the place is missed, and the draw is put in order whole
    uneven = spark.createDataFrame([("a", max(0, k - 1500)) for k in range(3000)], "g string, k long")
    dealt = nulls._dealt(uneven, ["g"], "k", spark.createDataFrame([("a", 700)], "g string, n long"), 4, "s", {})
    assert {r.t for r in dealt.where("_in").groupBy("perm").agg(F.sum("_c").alias("t")).collect()} == {700}


def test_ring_null_passes_all_draws_along_an_edge(spark):
    nodes = spark.createDataFrame([("g", i, float(i * i % 31), i < 9) for i in range(60)], "g string, k long, x double, hot boolean")
    links = [(a, b) for a in range(60) for b in ((a + 1) % 60, (a * 7 + 3) % 60) if a != b]
    edges = spark.createDataFrame([("g", a, b) for a, b in {*links, *[(b, a) for a, b in links]}], "g string, src long, dst long")
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def rings_of(start):
        seen, last, out = set(start), set(start), []
        for _ in range(2):
            last = {b for a in last for b in near[a]} - seen
            seen |= last
            out.append(sum(k * k % 31 for k in last) / len(last) if last else None)
        return out

    got = {r.ring: r for r in nulls.ring_null(nodes, edges, ["g"], "k", F.col("hot"), "x", 2, 70).collect()}
    draws = [rings_of(v) for v in _first_by_md5([("g", k) for k in range(60)], 70, "ring", {"g": 9}).values()]
    for i, seen in enumerate(rings_of(range(9))):
        values = [d[i] for d in draws if d[i] is not None]
        assert (got[i + 1].x, got[i + 1].null_mean, got[i + 1].draws) == (pytest.approx(seen), pytest.approx(sum(values) / len(values)), len(values))


def test_ranks_of_equal_rows_are_weights(spark):
    rng = random.Random(8)
    rows = [("g", float(rng.randrange(6)), float(rng.randrange(5)), float(rng.randrange(4))) for _ in range(300)] + [("g", float("nan"), 1.0, 1.0), (None, 1.0, 2.0, 3.0), (None, 2.0, 4.0, 1.0), (None, 3.0, 3.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double")
    ranked = statistics.finite_rows(df, "x", "y")
    for c in ("x", "y"):
        ranked = ranks.rank_average(ranked, ["g"], c, f"r{c}")
    want = {r.g: (r.n, r.r) for r in statistics.pearson(ranked, ["g"], "rx", "ry").collect()}
    assert {r.g: (r.n, pytest.approx(r.rho)) for r in statistics.spearman(df, ["g"], "x", "y").collect()} == want
    assert statistics._ranked(statistics.finite_rows(df, "x", "y"), ["g"], {"x": "rx", "y": "ry"}).count() <= 33


def test_neighbours_of_dense_tables_meet_few_targets(spark, monkeypatch):
    rng = random.Random(9)
    points = [("g", i, float(rng.randrange(40)), float(rng.randrange(20)) / 2) for i in range(1500)] + [("g", 5000, 900.0, 900.0)]
    df, met, top_n = spark.createDataFrame(points, "g string, n int, x double, y double"), [], spatial.top_n

    def counted(rows, by, order, n, out="rank"):
        met.append(rows.count() if "d2" in rows.columns else 0)
        return top_n(rows, by, order, n, out)

    monkeypatch.setattr(spatial, "top_n", counted)
    got = {(r.src, r["rank"]): r.dst for r in spatial.knn_edges(df, ["g"], "n", "x", "y", 3, 50.0).collect()}
    want = {}
    for _, a, x, y in points:
        for i, (_, b) in enumerate(sorted(((x - u) ** 2 + (y - v) ** 2, b) for _, b, u, v in points if a != b)[:3]):
            want[a, i + 1] = b
    assert got == want
    assert sum(met) < 1500 * 1500 / 4


def test_components_and_rings_send_no_table_through_the_driver(spark, monkeypatch):
    plans, settled = [], ranks.settled

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settled(df)

    monkeypatch.setattr(similarity, "settled", seen)
    edges = spark.createDataFrame([("g", i, i + 1) for i in range(12)], "g string, src long, dst long")
    got = similarity.components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    assert {r.component for r in got.collect()} == {0}
    monkeypatch.setattr(spatial, "settled", seen)
    r = spatial.rings(edges, edges.where("src = 3").select("g", "src"), ["g"], "src", 2)
    assert sorted((x.node, x.ring) for x in r.collect()) == [(3, 0), (4, 1), (5, 2)]
    plans.append(r._jdf.queryExecution().executedPlan().toString())
    assert not any("BroadcastHashJoin" in p for p in plans)


def test_adjusted_p_values_take_no_frames_to_the_end(spark):
    rng = random.Random(9)
    rows = [(f, i, rng.choice([rng.random(), 0.25])) for f in ("u", None) for i in range(300)]
    got = statistics.adjust(spark.createDataFrame(rows, "f string, k int, p double"), ["f"], "p", "k")
    # what passes on between ranges (a row each) may reach to the end, rows may not
    assert not [line for line in optimized(got).splitlines() if "specifiedwindowframe(RowFrame, currentrow$(), unboundedfollowing$())" in line]
    want = {}
    for f in ("u", None):
        own = sorted((p, k) for g, k, p in rows if g == f)
        least = 1.0
        for i in range(len(own), 0, -1):
            least = min(least, own[i - 1][0] * len(own) / i)
            want[f, own[i - 1][1]] = round(least, 12)
    assert {(r.f, r.k): round(r.bh, 12) for r in got.collect()} == want


def test_pieces_take_no_frames_to_the_end_of_their_rows(spark, monkeypatch):
    plans, written = [], matching.settled
    monkeypatch.setattr(matching, "settled", lambda df: plans.append(optimized(df)) or written(df))
    rows = [("u", i % 3 == 0, i, (i * 7 % 50) / 4.0) for i in range(200)]
    got = matching.optimal_pairs(spark.createDataFrame(rows, "g string, c boolean, k int, x double"), ["g"], "c", "k", "x")
    assert got.count() == 67 and plans
    assert not [line for plan in plans for line in plan.splitlines() if "max(_p#" in line and "1, unboundedfollowing$()" in line and "_hi#" not in line]


def test_lattice_joins_send_nothing_through_the_driver(spark):
    nodes = spark.createDataFrame([(0, 40 * r + c, r, 2 * c + r % 2, float(r * c)) for r in range(6) for c in range(6)], "s int, n long, r long, c long, v double")
    edges = spatial.lattice_edges(nodes, ["s"], "n", "r", "c")
    for got in (spatial.neighbour_mean(nodes, edges, ["s"], "n", ["v"]), spatial.getis_ord(nodes, edges, ["s"], "n", "v")):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and plan.count("BroadcastHashJoin") <= 1  # the one: totals, a row a group


def test_a_matrix_is_written_in_a_file_for_each_thousand_spots(spark, tmp_path):
    from quillon.plans import catalog_sources  # noqa: F401
    from quillon.plans.registry import QUERIES

    spark.range(3000).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(9000).select((F.col("id") % 3000).alias("l_suppkey"), (F.col("id") % 7).alias("l_partkey"), F.lit(2.0).alias("l_quantity")).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = QUERIES["matrix_round_trip"](spark, str(tmp_path))
    assert len([f for f in got.inputFiles() if f.endswith(".txt")]) == 3
    want = {}
    for i in range(9000):
        if i % 3000 % 3 == 1:
            want[i % 3000, str(i % 7)] = want.get((i % 3000, str(i % 7)), 0.0) + 2.0
    assert {(r.barcode, r.gene): r["count"] for r in got.collect()} == want


def test_unique_genes_are_not_gathered_once_more(spark):
    rows = spark.createDataFrame([("a", "MT-1", 1.0), ("a", "G2", 3.0), ("b", "G2", 0.0), ("b", "G3", 2.0), ("b", None, 1.0)], "s string, g string, c double")
    want, got = reports.quality_covariates(rows, [], "s", "g", "c"), reports.quality_covariates(rows, [], "s", "g", "c", unique=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "distinct" in optimized(want) and "distinct" not in optimized(got)


def test_resampled_separation_equals_that_of_written_pairs(spark):
    rng = random.Random(12)
    items = spark.createDataFrame([(o, i) for o in range(14) for i in rng.sample(range(25), 9)] + [(99, 1), (None, 1), (3, None)], "o long, i long")
    families = spark.createDataFrame([(o, f"f{o % 3}") for o in range(12)] + [(13, "alone"), (5, "f0"), (4, None)], "n long, f string")
    draws = linkage.resampled(items, "o", "i", 20, 6)
    pairs = similarity.set_overlaps(draws, ["perm"], "owner", "item").select("perm", "a", "b", "jaccard")
    want = linkage.family_separation(pairs, families, draws.select("perm", F.col("owner").alias("node")).distinct(), "n", "f")
    got = linkage.resampled_separation(items, "o", "i", families, "n", "f", 20, 6)
    rows = lambda df: sorted([r.family, *[None if v is None else round(v, 9) for v in r[1:]]] for r in df.collect())
    assert rows(got) == rows(want)
    bits = linkage.drawn_bits(items, "o", "i", 20, 6)
    assert bits.count() <= items.dropna().count() < draws.count()


def test_permanova_draws_meet_rows_and_not_themselves(spark):
    from quillon.operators import regression

    rng = random.Random(3)
    rows = [(g, k, rng.choice("ab"), rng.random()) for g in ("u", "v") for k in range(30)]
    got = regression.permanova(spark.createDataFrame(rows, "g string, k long, l string, x double"), ["g"], "k", "l", ["x"], 19)

    def pseudo_f(pairs):
        ss = lambda xs: sum(x * x for x in xs) - sum(xs) ** 2 / len(xs)
        within = sum(ss([x for m, x in pairs if m == l]) for l in {m for m, _ in pairs})  # noqa: E741
        return (ss([x for _, x in pairs]) - within) / (within / (len(pairs) - 2))

    for r in got.collect():
        own = [(k, l, x) for g, k, l, x in rows if g == r.g]  # noqa: E741
        seen, hits = pseudo_f([(l, x) for _, l, x in own]), 0  # noqa: E741
        for p in range(1, 20):
            dealt = sorted(own, key=lambda t: (hashlib.md5(f"permanova|{p}|{t[0]}".encode()).hexdigest(), t[0]))  # noqa: B023
            hits += pseudo_f([(d[1], o[2]) for d, o in zip(dealt, own, strict=True)]) >= seen - 1e-9
        assert round(r.f, 9) == round(seen, 9) and round(r.p, 9) == round((hits + 1) / 20, 9)
    assert "strategy=merge" in optimized(got)


@pytest.mark.parametrize("gathered", [0, 30, 4_000_000])
def test_permanova_deals_small_groups_in_tasks(spark, monkeypatch, gathered):
    rng = random.Random(14)
    rows = [(g, i, rng.choice("abc"), rng.random(), rng.random()) for g, n in (("a", 40), ("b", 25), (None, 20)) for i in range(n)]
    monkeypatch.setattr(regression, "GATHERED", gathered)
    seen, numbered = [], nulls.numbered
    monkeypatch.setattr(nulls, "numbered", lambda df, times: seen.append(df.select(df.columns[0]).distinct().count()) or numbered(df, times))
    got = {r.g: (r.n, r.labels, round(r.f, 9), r.p) for r in regression.permanova(spark.createDataFrame(rows, "g string, k long, l string, x double, y double"), ["g"], "k", "l", ["x", "y"], 25).collect()}
    # groups that a task holds are not written out once a draw
    assert seen == {0: [3], 30: [1], 4_000_000: []}[gathered] and len(got) == 3
    assert _PERMANOVA.setdefault("all", got) == got


_PERMANOVA = {}


@pytest.mark.parametrize("whole", [0, 6, 1_000_000])
def test_merges_are_the_same_in_tasks_and_in_rounds(spark, monkeypatch, whole):
    rng = random.Random(11)
    sims = [(g, at + a, at + b, rng.randint(1, 6) / 8) for g in ("u", None) for at in (0, 20, 40) for a in range(9) for b in range(a + 1, 9) if rng.random() < 0.5]
    pairs = spark.createDataFrame(sims, "g string, a long, b long, s double")
    nodes = spark.createDataFrame([(g, at + a) for g in ("u", None) for at in (0, 20, 40) for a in range(9)], "g string, node long")
    rounds = []
    seen = linkage.reciprocal
    monkeypatch.setattr(linkage, "reciprocal", lambda *a: rounds.append(1) or seen(*a))
    monkeypatch.setattr(linkage, "WHOLE", whole)
    got = sorted(((r.g or "-", r.place, r.parent, r.child, round(r.height, 9), r.na, r.nb) for r in linkage.average_linkage(pairs, nodes, ["g"], "node", "s").collect()))
    for g in ("u", None):
        members, mine = {n: [n] for at in (0, 20, 40) for n in range(at, at + 9)}, []
        for _, _, parent, child, height, na, nb in [r for r in got if r[0] == (g or "-")]:
            assert (na, nb) == (len(members[parent]), len(members[child]))
            members[parent] = members[parent] + members.pop(child)
            mine.append((frozenset(members[parent]), height))
        assert set(mine) == set(linked(sorted(n for at in (0, 20, 40) for n in range(at, at + 9)), {(a, b): s for h, a, b, s in sims if h == g}))
    # one round of jobs for what fits a task, as many as the tree is deep without
    assert not rounds if whole > 6 else len(rounds) > 2


def test_programs_are_ranked_once(spark, monkeypatch):
    from quillon.plans import catalog_graphs
    from quillon.plans.cohort import Tables

    calls, programs = [], Tables.programs
    monkeypatch.setattr(Tables, "programs", lambda *a: calls.append(a) or programs(*a))
    seen = []
    monkeypatch.setattr(linkage, "linkage_clusters", lambda pairs, nodes, *a: seen.append(optimized(nodes)) or nodes.select(F.col("program").alias("owner"), F.lit(0).alias("place")))
    catalog_graphs.program_order(Tables(spark, "/root/testdata/sf0.001"))
    assert len(calls) == 1 and "Window" not in seen[0] and "lineitem" not in seen[0]


def test_a_task_merges_what_a_gigabyte_holds(monkeypatch):
    # 360 times sf0.1 has some 12 million pairs of programs, whose first ten rounds of jobs would leave more than half
    assert linkage.WHOLE >= 12_000_000
    rng = np.random.default_rng(16)
    code = np.unique(rng.integers(0, 300 * 300, 4000))
    code = code[code // 300 < code % 300]
    pairs = (code // 300).astype(np.int32), (code % 300).astype(np.int32), rng.integers(1, 9, len(code)) / 8
    want = [[x.tolist() for x in r] for r in linkage._rounds(*pairs, np.ones(300, np.int64))]
    monkeypatch.setattr(linkage, "STRIPE", 100)
    assert [[x.tolist() for x in r] for r in linkage._rounds(*pairs, np.ones(300, np.int64))] == want and sum(len(r[0]) for r in want) > 200


@pytest.mark.parametrize("met", [0, 8_000_000])
def test_resamples_are_whole_in_a_task_and_equal_those_in_rounds(spark, monkeypatch, met):
    rng = random.Random(15)
    sets = {f"o{o}": rng.sample(range(30), rng.randint(2, 8)) for o in range(25)} | {"lone": [90], "apart": [91, 92]}
    items = spark.createDataFrame([(o, i) for o, s in sets.items() for i in s] + [("o1", None), (None, 4)], "o string, i long")
    rows = lambda df: sorted(map(tuple, df.select("perm", "node", "root").collect()))
    want = rows(linkage.resampled_clusters(items, "o", "i", 11, 4, 6)[0])
    calls, rounds = [], linkage.resampled_clusters
    monkeypatch.setattr(linkage, "resampled_clusters", lambda *a: calls.append(a) or rounds(*a))
    monkeypatch.setattr(linkage, "MET", met)
    monkeypatch.setattr(linkage, "SOME", 6)
    assert rows(linkage.resampled_labels(items, "o", "i", 11, 4, 6)) == want and len(want) == 11 * 27
    # no jobs for what a task holds, and no more than SOME resamples on disk where it can't
    assert [c[3] for c in calls] == ([] if met else [6, 5])


def test_clusters_numbers_are_bytes(spark):
    labels = spark.createDataFrame([(p, n, n % 3 + p) for p in range(40) for n in range(12)], "perm int, node long, root long")
    got = linkage.co_clustering(labels, 40)
    assert {(r.a, r.b): r.together for r in got.collect()} == {(a, b): 1.0 for a in range(12) for b in range(a + 1, 12) if a % 3 == b % 3}
    assert "array<" not in optimized(got) and all(kind != "array" for _, kind in got.dtypes)
    many = spark.createDataFrame([(p, n, n // 2) for p in range(2) for n in range(700)], "perm int, node long, root long")
    assert {(r.a, r.b, r.together) for r in linkage.co_clustering(many, 2).collect()} == {(2 * n, 2 * n + 1, 1.0) for n in range(350)}


@pytest.mark.parametrize("block", [7, 1_000])
def test_nodes_that_share_clusters_are_counted_in_blocks(spark, monkeypatch, block):
    rng = random.Random(13)
    label = {(p, n): rng.randrange(4) for p in range(1, 11) for n in range(30) if rng.random() < 0.9}
    labels = spark.createDataFrame([(p, f"n{n}", f"n{r}") for (p, n), r in label.items()], "perm int, node string, root string")
    monkeypatch.setattr(linkage, "BLOCK", block)
    want = {}
    for p in range(1, 11):
        for a in range(30):
            for b in range(30):
                if f"n{a}" < f"n{b}" and (p, a) in label and label[p, a] == label.get((p, b)):
                    want[f"n{a}", f"n{b}"] = want.get((f"n{a}", f"n{b}"), 0) + 1
    got = linkage.co_clustering(labels, 10)
    assert {(r.a, r.b): r.together for r in got.collect()} == {e: n / 10 for e, n in want.items()}
    # no pair is a row of a shuffle once for each resample
    assert "root#" not in optimized(got).split("FlatMapGroupsInArrow")[0]
    assert got.count() == len(want)


def test_draws_of_sets_are_no_rows_of_nodes_or_edges(spark, monkeypatch):
    e = spark.createDataFrame([("s", n, g, float((n * 7 + g * 5) % 11)) for n in range(60) for g in range(24) if (n + g) % 3], "sample string, node long, gene long, x double")
    edges = spark.createDataFrame([("s", n, m) for n in range(60) for m in (n - 1, n + 1) if 0 <= m < 60], "sample string, src long, dst long")
    sets = spark.createDataFrame([("low", g) for g in range(6)] + [("high", g + 12) for g in range(6)], "name string, gene long")
    most, write = [], nulls.settled
    monkeypatch.setattr(nulls, "settled", lambda df: most.append((out := write(df)).count()) or out)
    nulls.matched_set_smoothness(e, edges, sets, ["sample"], "node", "gene", "x", "name", 40).collect()
    # sets x draws x genes of a set are the most rows that are written; nodes x draws would be 4,920
    assert max(most) == e.count() and max(most) < 60 * 2 * 41


def test_usages_of_close_spectra_do_not_hang_on_sweeps():
    rng = np.random.default_rng(8)
    h = rng.random(12) + rng.random((3, 12)) * 0.01
    x = rng.random((300, 3)) @ h + rng.random((300, 12)) * 0.1
    w = factors.usages(x, h)
    gradient = (w @ h - x) @ h.T
    assert (w >= 0).all() and gradient.min() > -1e-8 and np.abs(gradient * w).max() < 1e-8


@pytest.mark.parametrize("whole", [0, 40, 2_000_000])
def test_communities_are_the_same_in_tasks_and_in_rounds(spark, monkeypatch, whole):
    rng = random.Random(9)
    names = {g: [f"{g}{i:02d}" for i in range(n)] for g, n in (("p", 24), ("q", 9))}
    rows = [(g, a, b, round(0.1 + rng.random(), 4)) for g, own in names.items() for a in own for b in own if a < b and rng.random() < (0.6 if ord(a[-1]) % 3 == ord(b[-1]) % 3 else 0.15)]
    rows += [("q", "q03", "q03", 0.7), ("r", "x", "x", 1.0)]
    df = spark.createDataFrame(rows, "g string, a string, b string, w double")
    monkeypatch.setattr(communities, "WHOLE", whole)
    seen, rounds = [], communities._rounds
    monkeypatch.setattr(communities, "_rounds", lambda e, own: seen.append(e.select("resolution", "_by_0").distinct().count()) or rounds(e, own))
    got = {(r.g, r.resolution, r.node): (r.community, round(r.quality, 9)) for r in communities.communities(df, ["g"], "w", (0.8, 1.3)).collect()}
    assert seen == {0: [6], 40: [2], 2_000_000: []}[whole] and len(got) == 2 * (24 + 9 + 1)
    assert _COMMUNITIES.setdefault("all", got) == got


_COMMUNITIES = {}


def test_md5_order_of_many_names_is_that_of_hashlib():
    names = [str(7 * i) for i in range(2000)] + ["x" * 60, "", "é", "a" * 50, "dup", "dup"]
    order = hashes.Md5Order(pa.array(names))
    for prefix in ("lisa|1|", "lisa|12|", "lisa|999|", ""):
        want = sorted(range(len(names)), key=lambda i: (hashlib.md5((prefix + names[i]).encode()).hexdigest(), i))  # noqa: B023
        assert order.order(prefix.encode()).tolist() == want


def test_lisa_copies_a_group_no_more_often_than_its_tasks_need(spark, monkeypatch):
    cells = [(g, i, i // 6, 2 * (i % 6) + i // 6 % 2, float(i * i % 11)) for g in range(16) for i in range(24)]
    nodes = spark.createDataFrame(cells, "s int, node long, row long, col long, x double")
    edges = spatial.lattice_edges(nodes, ["s"], "node", "row", "col")
    seen, ends = [], F.sequence
    monkeypatch.setattr(F, "sequence", lambda a, b: seen.append(str(b)) or ends(a, b))
    got = {blocks: {(r.s, r.node): r.p for r in spatial.lisa(nodes, edges, ["s"], "node", "x", 20, blocks=blocks).collect()} for blocks in (1, 32)}
    assert got[1] == got[32] and len(got[1]) == 16 * 24 and all("'0'" in s for s in seen[::2])
    assert int(seen[-1].split("'")[1]) + 1 <= max(1, -(-4 * spark.sparkContext.defaultParallelism // 16))


@pytest.mark.parametrize("gathered", [0, 30, 4_000_000])
def test_pseudo_f_deals_small_groups_in_tasks(spark, monkeypatch, gathered):
    rng = random.Random(10)
    rows = [(g, i, rng.random() < 0.4, rng.random(), rng.random(), rng.random()) for g, n in (("a", 40), ("b", 25), (None, 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, m boolean, c double, u double, v double")
    monkeypatch.setattr(regression, "GATHERED", gathered)
    seen, places = [], regression._places
    monkeypatch.setattr(regression, "_places", lambda df, by, order: seen.append(df.select(by[0]).distinct().count()) or places(df, by, order))
    got = {r.g: (r.n, r["mode"], round(r.f, 9), round(r.r2, 9), r.p) for r in regression.pseudo_f(df, ["g"], "k", "m", ["u", "v"], "c", 25).collect()}
    assert seen == {0: [3, 3], 30: [1, 1], 4_000_000: []}[gathered] and len(got) == 3
    assert _PSEUDO.setdefault("all", got) == got


_PSEUDO = {}


def test_axes_of_random_pairs_settle_in_few_passes(spark):
    rng, n = np.random.default_rng(12), 300
    a, b = np.triu_indices(n, 1)
    some = rng.random(len(a)) < 0.05
    d = np.ones((n, n)) - np.eye(n)
    d[a[some], b[some]] = d[b[some], a[some]] = 1 - 1 / 59
    pairs = spark.createDataFrame([(int(x), int(y), float(d[x, y])) for x, y in zip(a[some], b[some], strict=True)], "a long, b long, d double")
    got = {(r.node, r.axis): (r.value, r.share) for r in factors.distance_scaling(pairs, spark.range(n).toDF("n"), "n", "d", 2, passes=30).collect()}
    j = np.eye(n) - 1 / n
    e, u = np.linalg.eigh(-j @ d**2 @ j / 2)
    for axis in (1, 2):
        mine = np.array([got[i, axis][0] for i in range(n)])
        assert np.allclose(np.abs(mine), np.abs(u[:, -axis]) * np.sqrt(e[-axis]), atol=1e-3) and got[0, axis][1] == pytest.approx(e[-axis] / e.sum(), abs=1e-6)
