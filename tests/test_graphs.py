"""Linkage, resamples, assignment, communities and estimating equations against brute force."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest

from quillon.operators import communities, gee, linkage, matching, similarity


def linked(names, sim):
    """Greedy average linkage, ties by names: (members, height) of each merge."""
    clusters, out = {n: [n] for n in names}, []
    far = lambda a, b: round(-sum(sim.get((min(x, y), max(x, y)), 0) for x in clusters[a] for y in clusters[b]) / (len(clusters[a]) * len(clusters[b])), 12)
    while len(clusters) > 1:
        h, a, b = min((far(a, b), a, b) for a in clusters for b in clusters if a < b)
        clusters[a] += clusters.pop(b)
        out.append((frozenset(clusters[a]), round(1 + h, 9)))
    return out


def silhouette(d, label):
    s = []
    for i in range(len(d)):
        own = label == label[i]
        if own.sum() < 2 or len(set(label)) < 2:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, label == c].mean() for c in set(label) if c != label[i])
        s.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(s))


def matrix(names, sim):
    d = np.ones((len(names), len(names)))
    np.fill_diagonal(d, 0)
    for (a, b), s in sim.items():
        i, j = names.index(a), names.index(b)
        d[i, j] = d[j, i] = 1 - s
    return d


@pytest.mark.parametrize("ties", [False, True])
def test_linkage_equals_the_greedy_one(spark, ties):
    rng = random.Random(3)
    rows, nodes, want = [], [], {}
    for g, n in (("x", 13), (None, 9), ("y", 1), ("z", 6)):
        names = list(range(n))
        sim = {(a, b): rng.randint(0, 4) / 8 if ties else rng.random() for a, b in combinations(names, 2) if rng.random() < (0.2 if g == "z" else 0.6)}
        rows += [(g, *((a, b) if rng.random() < 0.5 else (b, a)), s) for (a, b), s in sim.items()]
        nodes += [(g, n) for n in names]
        want[g] = names, sim
    rows += [("x", 2, 2, 0.9), ("x", None, 3, 0.9), ("x", 1, 50, float("nan"))]
    nodes += [("x", None)]
    pairs, nodes = spark.createDataFrame(rows, "n string, a long, b long, s double"), spark.createDataFrame(nodes, "n string, node long")
    tree = linkage.average_linkage(pairs, nodes, ["n"], "node", "s")
    merges, labels = tree.collect(), linkage.cuts(tree, nodes, ["n"], "node", [2, 3, 40]).collect()
    for g, (names, sim) in want.items():
        members, mine = {x: [x] for x in names}, []
        for r in sorted((r for r in merges if r.n == g), key=lambda r: r.place):
            assert (r.na, r.nb) == (len(members[r.parent]), len(members[r.child]))
            members[r.parent] = members[r.parent] + members.pop(r.child)
            mine.append((frozenset(members[r.parent]), round(r.height, 9)))
        assert set(mine) == set(linked(names, sim)) and len(mine) == len(names) - 1
        assert [h for _, h in mine] == sorted(h for _, h in mine)
        own = [r for r in labels if r.n == g]
        assert [r.node for r in sorted((r for r in own if r.k == 1), key=lambda r: r.leaf)] == members[min(names)]
        for k in (2, 3):
            assert len({r.root for r in own if r.k == k}) == (k if k <= len(names) else 0)
        for r in own:
            assert r.root == min(q.node for q in own if q.k == r.k and q.root == r.root)


def test_silhouettes_choice_of_k_and_cophenetic_r(spark):
    rng = np.random.default_rng(2)
    p = rng.normal(size=(14, 2)) + np.repeat([[0, 0], [6, 6]], 7, axis=0)
    d = np.minimum(np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)) / 9, 1)
    sim = {(a, b): float(1 - d[a, b]) for a, b in combinations(range(14), 2)}
    pairs = spark.createDataFrame([("g", a, b, s) for (a, b), s in sim.items()], "g string, a long, b long, s double")
    nodes = spark.createDataFrame([("g", i) for i in range(14)] + [("lone", 1)], "g string, node long")
    got = linkage.linkage_clusters(pairs, nodes, ["g"], "node", "s", range(2, 6)).collect()
    lone = [r for r in got if r.g == "lone"]
    got = sorted((r for r in got if r.g == "g"), key=lambda r: r.owner)
    assert [tuple(r[1:]) for r in lone] == [(1, 0, 0, 1, None, None)]
    assert [r.cluster for r in got] == [0] * 7 + [1] * 7 and {r.k for r in got} == {2} and sorted(r.place for r in got) == list(range(14))
    assert got[0].silhouette == pytest.approx(silhouette(d, np.array([0] * 7 + [1] * 7)))
    heights = {}
    members = {i: [i] for i in range(14)}
    for r in sorted(linkage.average_linkage(pairs.where("g = 'g'"), nodes.where("g = 'g'"), [], "node", "s").collect(), key=lambda r: r.place):
        heights |= {(min(x, y), max(x, y)): r.height for x in members[r.parent] for y in members[r.child]}
        members[r.parent] = members[r.parent] + members.pop(r.child)
    both = np.array([(1 - sim[e], heights[e]) for e in sim])
    assert got[0].cophenetic_r == pytest.approx(np.corrcoef(both.T)[0, 1])
    # all cuts, with clusters that share nothing and ties of names
    sparse = {e: s for e, s in sim.items() if (e[0] * 3 + e[1]) % 4}
    labels = [(k, i, i % k) for k in (2, 3, 5) for i in range(14)]
    found = linkage.silhouettes(spark.createDataFrame([(a, b, s) for (a, b), s in sparse.items()], "a long, b long, s double"), spark.createDataFrame(labels, "k int, node long, root long"), ["k"], "s").collect()
    for r in found:
        assert r.silhouette == pytest.approx(silhouette(matrix(list(range(14)), sparse), np.array([i % r.k for i in range(14)]))) and r.clusters == r.k


def test_linkage_of_nothing(spark):
    none = spark.createDataFrame([], "a long, b long, s double")
    assert linkage.average_linkage(none, spark.createDataFrame([], "node long"), [], "node", "s").count() == 0
    lone = linkage.average_linkage(none, spark.createDataFrame([(3,), (1,), (2,)], "node long"), [], "node", "s").orderBy("place").collect()
    assert [(r.parent, r.child, r.height, r.na) for r in lone] == [(1, 2, 1.0, 1), (1, 3, 1.0, 2)]


def test_resamples_families_and_separation(spark):
    rng = random.Random(8)
    sets = {o: sorted(rng.sample(range(40), rng.randint(3, 9))) for o in range(9)}
    items = spark.createDataFrame([(o, i) for o, s in sets.items() for i in s] + [(1, None), (None, 4)], "o long, i long")
    family = {o: "ab"[o % 2] if o < 8 else None for o in sets}
    families = spark.createDataFrame(list(family.items()), "o long, f string")
    times, size, k = 12, 6, 3
    labels, pairs = linkage.resampled_clusters(items, "o", "i", times, k, size)
    drawn, together, share, gaps = {}, {}, {}, {}
    for perm in range(1, times + 1):
        draw = {o: {s[int(hashlib.md5(f"boot|{perm}|{o}|{j}".encode()).hexdigest()[:8], 16) % len(s)] for j in range(size)} for o, s in sets.items()}
        drawn[perm] = {(a, b): len(draw[a] & draw[b]) / len(draw[a] | draw[b]) for a, b in combinations(sets, 2)}
    assert {(r.perm, r.a, r.b): pytest.approx(r.jaccard) for r in pairs.collect()} == {(p, a, b): s for p, sim in drawn.items() for (a, b), s in sim.items() if s}
    found = labels.collect()
    for perm, sim in drawn.items():
        label = {r.node: r.root for r in found if r.perm == perm}
        # k - 1 merges are undone; the ones of the greatest height, but for ties
        heights = sorted((h for _, h in linked(sorted(sets), sim)), reverse=True)
        parts = [frozenset(o for o in sets if label[o] == c) for c in set(label.values())]
        assert len(parts) == k
        if heights[k - 2] > heights[k - 1]:
            done = {m for m, h in linked(sorted(sets), sim) if h < heights[k - 2]}
            assert set(parts) == {m for m in done if not any(m < o for o in done)} | {frozenset([o]) for o in sets if not any(o in m for m in done)}
        for a, b in combinations(sets, 2):
            together[a, b] = together.get((a, b), 0) + (label[a] == label[b]) / times
        for f in "ab":
            own = [o for o in sets if family[o] == f]
            share.setdefault((f, None), []).append(np.mean([label[a] == label[b] for a, b in combinations(own, 2)]))
            for o in own:
                share.setdefault((f, o), []).append(np.mean([label[o] == label[x] for x in own if x != o]))
            rest = [o for o in sets if family[o] not in (f, None)]
            s = lambda a, b: sim[min(a, b), max(a, b)]  # noqa: B023, E731
            gaps.setdefault(f, []).append(np.mean([s(a, b) for a, b in combinations(own, 2)]) - np.mean([s(a, b) for a in own for b in rest]))
    assert {(r.a, r.b): pytest.approx(r.together) for r in linkage.co_clustering(labels, times).collect()} == {e: t for e, t in together.items() if t}
    assert {(r.family, r.node): pytest.approx(r.together) for r in linkage.family_stability(labels, families, "o", "f").collect()} == {key: np.mean(v) for key, v in share.items()}
    for r in linkage.family_separation(pairs, families, labels, "o", "f").collect():
        g = gaps[r.family]
        assert (r.resamples, r.mean, r.sd, r.least, r.above) == (times, *map(pytest.approx, (np.mean(g), np.std(g, ddof=1), min(g), np.mean(np.array(g) > 0))))


def least_total(a, b):
    a, b = sorted((sorted(a), sorted(b)), key=len)
    cost = np.zeros(len(b) + 1)
    for i, x in enumerate(a):
        new = np.full(len(b) + 1, np.inf)
        for j in range(i + 1, len(b) + 1):
            new[j] = min(new[j - 1], cost[j - 1] + abs(x - b[j - 1]))
        cost = new
    return cost[-1]


def test_used_rows_give_the_least_total():
    rng = random.Random(1)
    for _ in range(300):
        n, m = sorted((rng.randint(1, 8), rng.randint(1, 14)))
        value = lambda: rng.choice([rng.random() * 2 - 0.5, rng.randint(0, 4) / 4])
        points = sorted([(value(), 1) for _ in range(n)] + [(value(), 0) for _ in range(m)])
        x, few = np.array([p[0] for p in points]), np.array([p[1] == 1 for p in points])
        u = matching.used(x, few)
        assert u.sum() == n and not (u & few).any()
        assert np.abs(x[few] - x[u]).sum() == pytest.approx(least_total(x[few], x[~few]), abs=1e-9)
    # a hundred thousand rows without a table of pairs
    x = np.sort(np.random.default_rng(1).random(100_000))
    few = np.random.default_rng(2).random(100_000) < 0.49
    assert matching.used(x, few).sum() == few.sum()


def test_optimal_pairs_by_pieces(spark):
    rng = random.Random(4)
    rows = []
    for g, (n, m) in {"a": (5, 40), "b": (30, 33), "c": (40, 10), "d": (25, 25), "e": (1, 1), "f": (3, 0)}.items():
        rows += [(g, True, i, round(rng.gauss(0, 1), 1 if g == "b" else 9)) for i in range(n)] + [(g, False, 1000 + i, round(rng.gauss(0.5, 1), 1 if g == "b" else 9)) for i in range(m)]
    rows += [(None, True, 1, 1.0), (None, False, 2, 3.0), ("a", None, 7, 1.0), ("a", True, None, 1.0), ("a", True, 77, float("nan")), ("a", False, 78, None)]
    df = spark.createDataFrame(rows, "piece string, c boolean, _key int, x double").repartition(3)
    got = matching.optimal_pairs(df, ["piece"], "c", "_key", "x").collect()
    for g in ("a", "b", "c", "d", "e", "f", None):
        own = [r for r in rows if r[0] == g and None not in r[1:] and r[3] == r[3]]
        a, b = [r[3] for r in own if r[1]], [r[3] for r in own if not r[1]]
        mine = [r for r in got if r.piece == g]
        assert len(mine) == min(len(a), len(b)) == len({r.case for r in mine}) == len({r.control for r in mine})
        assert sum(abs(r.x_case - r.x_control) for r in mine) == pytest.approx(least_total(a, b), abs=1e-9)
        assert all((g, True, r.case, r.x_case) in own and (g, False, r.control, r.x_control) in own for r in mine)
    assert matching.optimal_pairs(df.limit(0), ["piece"], "c", "_key", "x").count() == 0


def modularity(edges, label, resolution):
    m, k, total = sum(edges.values()), {}, {}
    for (a, b), w in edges.items():
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
    for n, d in k.items():
        total[label[n]] = total.get(label[n], 0) + d
    return sum(w for (a, b), w in edges.items() if label[a] == label[b]) / m - resolution * sum(v * v for v in total.values()) / (2 * m) ** 2


def local_optimum(edges, nodes, resolution):
    label = {n: n for n in nodes}
    while True:
        q = modularity(edges, label, resolution)
        best = max(((modularity(edges, label | {n: c}, resolution), n, c) for n in nodes for c in set(label.values())), key=lambda x: x[0])
        if best[0] <= q + 1e-12:
            return q
        label[best[1]] = best[2]


def test_communities_reach_a_local_optimum(spark):
    rng = random.Random(6)
    graphs = {}
    clear = {(c * 6 + j, c * 6 + i): 1.0 for c in range(3) for i in range(6) for j in range(i) if rng.random() < 0.8}
    graphs["clear"] = clear | {(0, 7): 0.5, (6, 13): 0.5, (2, 16): 0.5}
    graphs[None] = {(a, b): round(rng.random(), 3) for a, b in combinations(range(12), 2) if rng.random() < 0.35}
    rows = [(g, *((a, b) if rng.random() < 0.5 else (b, a)), w) for g, e in graphs.items() for (a, b), w in e.items()]
    rows += [("clear", 1, 2, None), ("clear", 1, 2, float("nan")), ("clear", None, 2, 1.0), ("clear", 3, 4, -1.0)]
    found = communities.communities(spark.createDataFrame(rows, "com string, a long, b long, w double"), ["com"], "w", (0.7, 1.0)).collect()
    for g, e in graphs.items():
        nodes = sorted({n for ab in e for n in ab})
        for resolution in (0.7, 1.0):
            label = {r.node: r.community for r in found if r.com == g and r.resolution == resolution}
            assert sorted(label) == nodes
            q = modularity(e, label, resolution)
            assert all(r.quality == pytest.approx(q) for r in found if r.com == g and r.resolution == resolution)
            assert q >= local_optimum(e, nodes, resolution) - 1e-9
            assert all(modularity(e, label | {n: c}, resolution) <= q + 1e-9 for n in nodes for c in set(label.values()))
            for c in set(label.values()):
                own = {n for n in nodes if label[n] == c}
                seen, front = {min(own)}, {min(own)}
                while front:
                    front = {x for ab in e for x, y in (ab, ab[::-1]) if y in front and x in own} - seen
                    seen |= front
                assert seen == own and c == min(own)
    assert [{r.community for r in found if r.com == "clear" and r.resolution == 1.0}] == [{0, 6, 12}]


def test_resolution_is_chosen_by_silhouette(spark):
    rng = np.random.default_rng(3)
    p = rng.normal(size=(12, 2)) + np.repeat([[0, 0], [8, 0]], 6, axis=0)
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)] + [(50, None, 1.0)], "node long, x double, y double")
    labels = {1.0: [0] * 6 + [6] * 6, 2.0: [0, 0, 0, 3, 3, 3, 6, 6, 6, 9, 9, 11], 0.5: [0] * 12}
    found = spark.createDataFrame([(r, i, c, 0.1) for r, own in labels.items() for i, c in enumerate(own)], "resolution double, node long, community long, quality double")
    got = {r.resolution: r for r in communities.resolution_table(found, points, [], ["x", "y"], 2).collect()}
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    for r in (1.0, 2.0):
        assert got[r].silhouette == pytest.approx(silhouette(d, np.array(labels[r])))
    assert got[0.5].silhouette is None and [r for r in got if got[r].selected] == [1.0]
    assert {r: (g.clusters, g.least_size, g.most_size, g.valid) for r, g in got.items()} == {1.0: (2, 6, 6, True), 2.0: (5, 1, 3, False), 0.5: (1, 12, 12, False)}


def estimated(x, y, cluster, exchangeable):
    """The same equations with whole matrices."""
    x = np.column_stack([np.ones(len(y)), x])
    n, k = x.shape
    groups = [np.flatnonzero(cluster == c) for c in sorted(set(cluster))]
    rho = 0.0
    for _ in range(300):
        inverse = [np.linalg.inv((1 - rho) * np.eye(len(g)) + rho) for g in groups]
        a = sum(x[g].T @ v @ x[g] for g, v in zip(groups, inverse, strict=True))
        beta = np.linalg.solve(a, sum(x[g].T @ v @ y[g] for g, v in zip(groups, inverse, strict=True)))
        r = y - x @ beta
        if exchangeable:
            pairs = sum(len(g) * (len(g) - 1) / 2 for g in groups)
            rho = sum((r[g].sum() ** 2 - (r[g] ** 2).sum()) / 2 for g in groups) / ((r @ r) / (n - k)) / (pairs - k)
    meat = sum(np.outer(u, u) for u in (x[g].T @ v @ r[g] for g, v in zip(groups, inverse, strict=True)))
    return beta, np.sqrt(np.diag(np.linalg.inv(a) @ meat @ np.linalg.inv(a))), rho


@pytest.mark.parametrize("exchangeable", [True, False])
def test_estimating_equations_equal_dense_ones(spark, exchangeable):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g in ("u", None):
        cluster = rng.integers(0, 15, 120)
        x = rng.normal(size=(120, 2)) + [3, -1]
        y = 2 * x[:, 0] - x[:, 1] + rng.normal(size=15)[cluster] * 2 + rng.normal(size=120)
        rows += [(g, int(c), *map(float, v), float(z)) for c, v, z in zip(cluster, x, y, strict=True)]
        want[g] = estimated(x, y, cluster, exchangeable)
    rows += [("u", None, 1.0, 1.0, 1.0), ("u", 3, float("nan"), 1.0, 1.0), ("u", 3, 1.0, 1.0, None), ("few", 1, 1.0, 2.0, 3.0), ("flat", 1, 1.0, 1.0, 1.0), *[("flat", i % 3, 1.0, float(i), float(i * i)) for i in range(9)]]
    got = gee.gee(spark.createDataFrame(rows, "n string, s int, b double, r double, p double"), ["n"], "s", ["b", "r"], "p", exchangeable).collect()
    for g, (beta, se, rho) in want.items():
        own = {r.term: r for r in got if r[0] == g}
        for i, term in enumerate(("intercept", "b", "r")):
            r = own[term]
            assert (r.coefficient, r.se, r.correlation) == (pytest.approx(beta[i], rel=1e-7), pytest.approx(se[i], rel=1e-7), pytest.approx(rho, rel=1e-7, abs=1e-9))
            assert r.z == pytest.approx(beta[i] / se[i]) and 0 <= r.p <= 1 and r.clusters == 15
    assert all(r.coefficient is None and r.se is None and r.p is None for r in got if r[0] in ("few", "flat")) and sum(r[0] == "few" for r in got) == 3


def test_overlaps_keep_null_groups_and_odd_names(spark):
    rows = [(None, 1, "x"), (None, 2, "x"), ("g", 1, "x"), ("g", 3, "x"), ("g", 3, None), ("g", None, "x")]
    got = similarity.set_overlaps(spark.createDataFrame(rows, "n string, o int, i string"), ["n"], "o", "i").collect()
    assert sorted((repr(r[0]), r.a, r.b, r.shared, r.na, r.nb) for r in got) == [("'g'", 1, 3, 1, 1, 2), ("None", 1, 2, 1, 1, 1)]
    cos = similarity.cosine_pairs(spark.createDataFrame([(None, 1, "k", 2.0), (None, 2, "k", 3.0), (None, 2, "j", float("nan"))], "x string, o int, k string, v double"), ["x"], "o", "k", "v").collect()
    assert [(r[0], r.a, r.b, r.cosine) for r in cos] == [(None, 1, 2, 1.0)]
