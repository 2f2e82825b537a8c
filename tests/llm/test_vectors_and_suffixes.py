"""Whitening, centroid clustering and suffix dedup against brute force, and odd input."""

import hashlib
import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import lloyd, queries, suffixes, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, id string, q array<long>, component string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", [1], "c") for i, v in rows], SCHEMA)


def planted(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.linspace(3, 0.2, d) + rng.normal(size=d)
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(x)]


BAD = [(1000, None), (1001, []), (1002, [float("nan")] * 4), (1003, [1.0, None, 2.0, 3.0]), (1004, [float("inf"), 0.0, 0.0, 0.0]), (1005, [1.0, 2.0]), (None, [0.5, -0.25, 0.125, 1.0])]


def whitened_by_hand(rows, d, k):
    fit = [(i, v) for i, v in rows if v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in fit])
    n, s = len(x), x.sum(0)
    xc = x - s / n
    v = xc.T @ xc / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return fit, n, ((n * x.astype(object) - s) ** 2).sum(1), xc @ u / np.sqrt(e), e / np.trace(v)


def test_whitening_equals_numpy_with_odd_rows(spark):
    rows = planted(150, 4, 1) + BAD + [(3, planted(150, 4, 1)[3][1])]
    got = whitening.whitened_rows(vectors(spark, rows)).collect()
    fit, n, deviation, y, share = whitened_by_hand(rows, 4, 8)
    assert len(got) == 4 * len(fit) and {r.n for r in got} == {n}
    key = lambda v: -1 if v is None else v
    mine = {}
    for r in got:
        mine.setdefault((key(r.vec_id), r.component), []).append((r.deviation, abs(r.whitened)))
        assert abs(r.explained - share[r.component - 1]) < 1e-9 and 0 <= r.identity_error < 1e-9
    for j in range(4):
        for (i, _), dev, value in zip(fit, deviation, y[:, j], strict=True):
            assert any(d == dev and abs(v - abs(value)) < 1e-8 for d, v in mine[key(i), j + 1])
    # one sign for all rows of a component
    by = {(r.vec_id, r.component): r.whitened for r in got}
    for j in range(4):
        signs = {np.sign(by[i, j + 1] * value) for (i, _), value in zip(fit, y[:, j], strict=True) if abs(value) > 1e-6}
        assert len(signs) == 1


def test_whitening_without_variance_or_rows(spark):
    for rows in ([], BAD[:3], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        out = whitening.whitened_rows(vectors(spark, rows))
        assert out.count() == 0 and out.columns[:4] == ["vec_id", "component", "n", "deviation"]
    # a flat dimension gives no component of its own
    rows = [(i, [float(i % 7), 5.0, float(i % 3)]) for i in range(30)]
    assert {r.component for r in whitening.whitened_rows(vectors(spark, rows)).collect()} == {1, 2}
    with pytest.raises(Exception, match="no exact sum"):
        whitening.whitened_rows(vectors(spark, [(1, [3e30, 0.0]), (2, [0.0, 1.0])])).collect()


def test_eigenvectors_by_blocks_and_restarts():
    rng = np.random.default_rng(4)
    for d, block, keep in ((40, 3, 3), (40, 10, 8), (90, 10, 4), (5, 10, 8), (12, 8, 1)):
        a = rng.normal(size=(3 * d, d))
        v, calls = a.T @ a / len(a), []
        e, q, residual = whitening.eigenvectors(lambda x: (calls.append(x.shape[1]), v @ x)[1], d, min(3, d), block, keep)  # noqa: B023
        want = np.linalg.eigvalsh(v)[::-1][: len(e)]
        assert np.allclose(e, want, rtol=1e-11) and np.allclose(v @ q, q * e, atol=1e-11) and max(calls) <= max(block, 1)
    # equal eigenvalues and rank one
    e, q, _ = whitening.eigenvectors(lambda x: 2.0 * x, 6, 2, 4)
    assert np.allclose(e, 2) and np.allclose(q.T @ q, np.eye(2))
    one = np.outer(np.arange(6), np.arange(6)).astype(float)
    e, _, _ = whitening.eigenvectors(lambda x: one @ x, 6, 3, 4)
    assert np.allclose(e, [55, 0, 0], atol=1e-9)


def test_whitening_query_on_the_test_table(spark):
    got = queries.op11_whitening(spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    fit, n, deviation, y, share = whitened_by_hand([(i, list(v)) for i, v in zip(table.vec_id, table.embedding, strict=True)], 64, 8)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in fit]].to_numpy()
    assert np.abs(np.abs(wide) - np.abs(y)).max() < 1e-9
    first = got[got.component == 1].set_index("vec_id").deviation
    assert [first[i] for i, _ in fit] == deviation.tolist()


def lloyd_by_hand(rows, d, k=8, rounds=10, seed=3):
    kept = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    centroids = [q for _, q in start]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        centroids = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    at = [(i, *near(q)) for i, q in kept]
    per = {j: sum(f for _, f, c in at if c == j) for _, _, j in at}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, f, per[j], sum(per.values()), digest[j]) for i, f, j in at), key=repr)


def test_clustering_equals_lloyd_by_hand(spark):
    rows = planted(120, 4, 2)
    rows += [(500 + i, rows[7][1]) for i in range(90)] + [(3, rows[3][1]), *BAD]
    for k in (8, 3):
        got = lloyd.clustered(vectors(spark, rows), k=k, dimension=4).collect()
        assert sorted((tuple(r) for r in got), key=repr) == lloyd_by_hand(rows, 4, k)


def test_clustering_of_few_or_no_vectors(spark):
    assert lloyd.clustered(vectors(spark, []), dimension=4).count() == 0
    assert lloyd.clustered(vectors(spark, BAD[:6]), dimension=4).count() == 0
    rows = [(1, [1.0, 2.0, 3.0, 4.0]), (2, [1.0, 2.0, 3.0, 4.0]), (3, [-1.0, 0.0, 0.5, -0.0005])]
    got = lloyd.clustered(vectors(spark, rows), dimension=4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == lloyd_by_hand(rows, 4)


def test_clustering_query_equals_its_sql(spark):
    got = queries.op13_clustering(spark, SF)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
        want = con.execute(queries.oracle_sql()["op13_clustering"]).df()
    names = sorted(want.columns)
    assert sorted(map(tuple, got.toPandas()[names].to_numpy().tolist())) == sorted(map(tuple, want[names].to_numpy().tolist()))


def removed_by_hand(rows, length):
    seen, out = set(), []
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        data = (rows[i][1] or "").encode()
        covered = bytearray(len(data) + 1)
        for a in range(len(data) - length + 1):
            if data[a : a + length] in seen:
                covered[a : a + length] = b"\1" * length
            seen.add(data[a : a + length])
        edges = [k for k in range(len(covered)) if covered[k] != (covered[k - 1] if k else 0)]
        out.append((rows[i][0], len(data), tuple(zip(edges[::2], edges[1::2], strict=True)), bytes(c for c, gone in zip(data, covered) if not gone)))  # noqa: B905
    return sorted(out, key=repr)


def texts(spark, rows):
    return spark.createDataFrame([(i, t, b"x", 1, 2, 3) for i, t in rows], "doc_id long, text string, kept binary, bucket int, id int, n int")


def removed(spark, rows, length):
    return sorted(((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in suffixes.remove_repeats(texts(spark, rows), length).collect()), key=repr)


@pytest.mark.parametrize("length", [3, 5, 13, 30, 100])
def test_suffix_dedup_equals_brute_force(spark, length):
    rng = random.Random(length)
    letters = "ab" if length < 20 else "abcd é"
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(length, 6 * length))) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages)[rng.randint(0, 3) :] if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 3 * length))) for _ in range(rng.randint(0, 4))]
        rows.append((i * 7 % 61, "".join(parts)))
    rows += [(70, None), (71, ""), (72, passages[0]), (73, passages[0]), (73, passages[0]), (80, "a" * (5 * length)), (81, "ab" * (4 * length)), (None, passages[1]), (None, passages[1])]
    assert removed(spark, rows, length) == removed_by_hand(rows, length)


def test_suffix_dedup_over_slices_blocks_and_held_rows(spark, monkeypatch):
    rng = random.Random(1)
    passages = ["".join(rng.choice("abc") for _ in range(400)) for _ in range(4)]
    rows = [(i, "".join(rng.choice(passages)[rng.randint(0, 200) :] + str(i) for _ in range(4))) for i in range(40)]
    data = [(i, 0, t.encode()) for i, t in rows]
    for small in (257, 1 << 20):
        monkeypatch.setattr(suffixes, "SLICE", small)
        joined = [(keys.ids[d], int(p)) for keys, block in suffixes.blocks(iter(data), 900) for slab in suffixes.slabs(block, 50) for d, p in zip(slab[2], slab[3], strict=True)]
        assert sorted(joined) == sorted((i, p) for i, t in rows for p in range(len(t) - 49))
        words = {}
        for keys, block in suffixes.blocks(iter(data), 900):
            for slab, at, doc, pos in suffixes.slabs(block, 50):
                for h, d, p in zip(suffixes.fingerprints(slab, at, 50, 1).tolist(), doc, pos, strict=True):
                    words.setdefault(h, set()).add(block[d][p : p + 50])
        assert all(len(w) == 1 for w in words.values())
    assert removed(spark, rows, 50) == removed_by_hand(rows, 50)


def test_covers_hold_every_distance():
    for v, cover in suffixes.COVERS.items():
        assert {(a - b) % v for a, b in [*combinations(cover, 2), *((b, a) for a, b in combinations(cover, 2)), (0, 0)]} == set(range(v))
        assert cover == tuple(sorted(cover))
    assert suffixes.cover_for(100)[0] == 31 and suffixes.cover_for(113)[0] == 57 and suffixes.cover_for(1)[0] == 1


def test_packed_columns_return():
    rng = np.random.default_rng(2)
    keys = suffixes.Keys(np.sort(rng.integers(-(1 << 62), 1 << 62, 30)), rng.integers(0, 1 << 62, 30))
    doc = rng.integers(0, 30, 500)
    columns = [np.sort(rng.integers(0, 1 << 63, 500, dtype=np.uint64)), rng.integers(0, 9, 500).astype(np.uint64)]
    back, own, got = suffixes.unpack(suffixes.pack(keys, doc, *columns)[0])
    assert (back.ids[own] == keys.ids[doc]).all() and (back.ties[own] == keys.ties[doc]).all()
    assert all((a == b).all() for a, b in zip(got, columns, strict=True))


def test_suffix_dedup_of_long_empty_and_missing_texts(spark):
    assert suffixes.remove_repeats(texts(spark, [])).count() == 0
    word = "".join(random.Random(9).choices("abcdefgh ", k=700_000))
    rows = [(2, word[100_000:] + "é"), (1, word), (3, None), (4, "ab"), (4, "ab")]
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.digest(suffixes.remove_repeats(texts(spark, rows))).collect()}
    assert got == {(1, 700_000, 0, 0), (2, 600_002, 600_000, 1), (3, 0, 0, 0), (4, 2, 0, 0)}


def test_suffix_query_equals_brute_force_on_the_test_table(spark):
    got = queries.op12_suffix_dedup(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in removed_by_hand([tuple(r) for r in docs], 100)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r.n_removed for r in got) > 0


def test_results_do_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one = suffixes.digest(suffixes.remove_repeats(df.repartition(7, F.rand(3)))).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, queries.op12_suffix_dedup(spark, SF).collect()))
