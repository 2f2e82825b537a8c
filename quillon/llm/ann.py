"""Approximate nearest neighbours by learned partitions.

Fit, on a bounded sample (SAMPLE vectors by hash): the exact neighbour graph is cut into balanced parts, and a
small network (one hidden layer) learns a vector's part. Parts grow with the rows: one for LEAF rows, up to FAN at
the root; with more rows each root part is split again by a model of its own, fitted in a task on a bounded sample
of that part. Every vector goes to its most probable leaf. A query visits the most probable leaves until their
probabilities add up to the mass that, on sample rows kept out of the fit, kept TARGET of the neighbours; exact
distances rerank what lies there. Beyond FAN * FAN * LEAF rows leaves grow instead of their number.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, materialise

SAMPLE, FAN, LEAF, TARGET, NEIGHBOURS = 6_000, 64, 1_000, 0.94, 10
HIDDEN, EPOCHS = 48, 25
#: Vectors and queries of one task's block: bounded memory for any part.
BLOCK, QUERY_BLOCK = 20_000, 2_000
RESULT = "query_id long, rank int, vec_id long, score double"


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    norms, out = (x * x).sum(1), []
    for a in range(0, len(x), 1000):
        d = norms[None, :] - 2 * x[a : a + 1000] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out.append(np.argpartition(d, min(k, len(x) - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each node: halves along principal directions, then moves that cut fewer edges.

    A part never holds more than 1.1 times its share.
    """
    part = np.zeros(len(x), np.int64)

    def split(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1 or len(rows) < 2:
            part[rows] = first
            return
        own = x[rows] - x[rows].mean(0)
        at = np.argsort(own @ np.linalg.svd(own.T @ own)[0][:, 0], kind="stable")
        cut = len(rows) * (n // 2) // n
        split(rows[at[:cut]], first, n // 2)
        split(rows[at[cut:]], first + n // 2, n - n // 2)

    split(np.arange(len(x)), 0, parts)
    cap = int(np.ceil(1.1 * len(x) / parts))
    rows = np.arange(len(x))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int64)
        np.add.at(votes, (np.repeat(rows, graph.shape[1]), part[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        best = votes.argmax(1)
        gain = votes[rows, best] - votes[rows, part]
        filled, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if filled[best[i]] < cap:
                filled[part[i]] -= 1
                filled[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


class Network:
    """A classifier with one hidden layer of tanh units: x -> probabilities of the parts."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int):
        rng = np.random.default_rng(7)
        self.mean, self.scale = x.mean(0), 1.0 / max(1e-12, float(np.sqrt(((x - x.mean(0)) ** 2).mean())))
        d = x.shape[1]
        self.w = [rng.normal(size=(d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), rng.normal(size=(HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
        moments = [[np.zeros_like(w) for w in self.w] for _ in range(2)]
        z, step = (x - self.mean) * self.scale, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for a in range(0, len(x), 256):
                at, step = order[a : a + 256], step + 1
                h = np.tanh(z[at] @ self.w[0] + self.w[1])
                g = _softmax(h @ self.w[2] + self.w[3])
                g[np.arange(len(at)), part[at]] -= 1
                g /= len(at)
                back = (g @ self.w[2].T) * (1 - h * h)
                for i, grad in enumerate((z[at].T @ back, back.sum(0), h.T @ g, g.sum(0))):
                    moments[0][i] = 0.9 * moments[0][i] + 0.1 * grad
                    moments[1][i] = 0.99 * moments[1][i] + 0.01 * grad * grad
                    self.w[i] -= 0.01 * (moments[0][i] / (1 - 0.9**step)) / (np.sqrt(moments[1][i] / (1 - 0.99**step)) + 1e-8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return _softmax(np.tanh((x - self.mean) * self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3])


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit_network(x: np.ndarray, parts: int) -> Network | None:
    """Partition and classifier of a sample (None: one part)."""
    parts = min(parts, len(x) // 20)
    return Network(x, balanced_parts(x, neighbour_graph(x, NEIGHBOURS), parts), parts) if parts > 1 else None


class Router:
    """Leaves are numbered root part * FAN + part below it."""

    def __init__(self, root: Network | None, below: dict[int, Network], mass: float = 1.0):
        self.root, self.below, self.mass = root, below, mass

    def root_parts(self, x: np.ndarray) -> np.ndarray:
        return np.ones((len(x), 1)) if self.root is None else self.root(x)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the most probable root part, then the most probable part below it."""
        top = self.root_parts(x).argmax(1)
        out = top * FAN
        for p in np.unique(top):
            if p in self.below:
                out[top == p] += self.below[p](x[top == p]).argmax(1)
        return out

    def order(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each vector all leaves, the most probable first, with the probability of those before each."""
        top = self.root_parts(x)
        ids = [np.arange(n) + p * FAN for p, n in ((p, len(self.below[p].w[3]) if p in self.below else 1) for p in range(top.shape[1]))]
        chance = np.concatenate([top[:, p : p + 1] * self.below[p](x) if p in self.below else top[:, p : p + 1] for p in range(top.shape[1])], axis=1)
        leaves = np.concatenate(ids)
        at = np.argsort(-chance, axis=1, kind="stable")
        sums = np.cumsum(np.take_along_axis(chance, at, 1), axis=1)
        for i in range(len(x)):
            yield leaves[at[i]], np.concatenate([[0.0], sums[i, :-1]])

    def visits(self, x: np.ndarray, count: dict[int, int], least: int) -> list[list[int]]:
        """The leaves that each query visits: the probable ones, more while they hold fewer than `least` rows."""
        out = []
        for leaves, before in self.order(x):
            use, rows = [], 0
            for leaf, mass in zip(leaves.tolist(), before.tolist()):
                if mass > self.mass and rows >= least:
                    break
                if leaf in count:
                    use.append(leaf)
                    rows += count[leaf]
            out.append(use)
        return out

    def calibrate(self, x: np.ndarray, asked: np.ndarray, target: float) -> None:
        """Sets the mass that keeps `target` of the neighbours of the rows `asked` among all rows of x."""
        leaf, near = self.leaf(x), neighbour_graph(x, NEIGHBOURS)[asked]
        needed = []
        for (leaves, before), neighbours in zip(self.order(x[asked]), near):
            at = dict(zip(leaves.tolist(), before.tolist()))
            needed += [at[leaf[n]] for n in neighbours]
        self.mass = float(np.quantile(needed, target)) if needed else 1.0


def nearest(q: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(place of the query, vector id, distance) of the k nearest different ids of each query; ties to smaller ids."""
    norms = (x * x).sum(1)
    many = len(np.unique(xid)) < len(xid)
    for a in range(0, len(q), 200):
        part = q[a : a + 200]
        rough = norms[None, :] - 2 * part @ x.T + (part * part).sum(1)[:, None]
        slack = 1e-9 * (1 + norms.max() + (part * part).sum(1))
        for i in range(len(part)):
            take = k
            while True:
                take = min(take, len(x))
                kth = np.partition(rough[i], take - 1)[take - 1]
                at = np.flatnonzero(rough[i] <= kth + slack[i])
                if not many or take == len(x) or len(np.unique(xid[at])) >= k:
                    break
                take *= 2
            d = np.sqrt(((x[at] - part[i]) ** 2).sum(1))
            seen: set[int] = set()
            for j in np.lexsort((xid[at], d)):
                if xid[at[j]] not in seen:
                    seen.add(xid[at[j]])
                    yield a + i, int(xid[at[j]]), float(d[j])
                    if len(seen) == k:
                        break


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, h) of the vectors that take part: of finite components, not all zero; h is a hash of v."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # -0.0 as 0.0, so that equal vectors are equal arrays
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("h", F.xxhash64("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sample(rows: DataFrame, total: int, by: list[str]) -> DataFrame:
    """About SAMPLE different vectors (of each `by`): those whose hash lies below a threshold."""
    bits = 1 << 30
    least = max(1, min(bits, int(1.2 * bits * SAMPLE / max(1, total))))
    picked = rows.where(F.pmod(F.xxhash64("h"), F.lit(bits)) < least).groupBy(*by, "h").agg(F.min("v").alias("v"))
    order = Window.partitionBy(*by, F.lit(1)).orderBy("h")
    return picked.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= SAMPLE).drop("_i")


def fit(rows: DataFrame, total: int) -> Router:
    """The router of a table of (v, h) of one length, from bounded samples."""
    x = np.array([r.v for r in _sample(rows, total, []).select("v").collect()], np.float64)
    leaves = -(-total // LEAF)
    kept_out = np.arange(len(x)) % 6 == 5
    root = fit_network(x[~kept_out], min(FAN, leaves)) if len(x) > 40 else None
    router = Router(root, {})
    if root is None:
        return router
    if leaves > FAN:
        parts = len(root.w[3])

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([*batch.columns, pa.array(root(_matrix(batch.column(0))).argmax(1), pa.int64())], names=["v", "h", "part"])

        def fit_part(pdf: pd.DataFrame) -> pd.DataFrame:
            net = fit_network(np.stack(pdf["v"].to_numpy()), min(FAN, -(-leaves // parts)))
            return pd.DataFrame([(int(pdf["part"].iloc[0]), pickle.dumps(net))], columns=["part", "model"])

        marked = rows.select("v", "h").mapInArrow(mark, "v array<double>, h long, part long")
        models = _sample(marked, -(-total // parts), ["part"]).groupBy("part").applyInPandas(fit_part, "part long, model binary").collect()
        router.below = {r.part: net for r in models if (net := pickle.loads(bytes(r.model))) is not None}
    router.calibrate(x, np.flatnonzero(kept_out), TARGET)
    return router


def search_table(table: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by `every`.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without id, take no
    part. Vectors of one length are searched among themselves. Rows with a query's id are its own; a repeated
    query id is asked once, with its least vector; other repeated ids come out once, at their nearest. With
    fewer than k candidates all of them come out; an empty table gives no rows; other columns are not read.

    Of equal vectors only those of the k + 1 smallest ids can be in an answer, and equal queries are asked
    once: a vector that very many rows share costs its rows a pass, not pairs.
    """
    spark = table.sparkSession
    rows = valid_vectors(table, id_col, vector_col).withColumn("n", F.size("v"))
    lengths = {r.n: r["count"] for r in rows.groupBy("n").count().collect()}
    out = spark.createDataFrame([], RESULT)
    for n in sorted(lengths):
        out = out.unionByName(_search(rows.where(F.col("n") == n).drop("n"), lengths[n], k, every))
    return out


def _search(rows: DataFrame, total: int, k: int, every: int) -> DataFrame:
    spark = rows.sparkSession
    router = fit(rows, total)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(10 * BATCH_ROWS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = router.leaf(_matrix(batch.column(1)))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(leaf.astype(np.int32))], names=["id", "v", "part"])

    equal = Window.partitionBy("h", "v").orderBy("vec_id")
    first = rows.withColumn("_r", F.row_number().over(equal)).where(F.col("_r") <= k + 1)
    placed, _ = materialise(first.select("vec_id", "v").mapInArrow(place, "id long, v array<double>, part int"), "vectors")
    # the model's leaves: a few numbers each
    count = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = router.visits(_matrix(batch.column(1)), count, k + 1)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(use, pa.list_(pa.int32()))], names=["id", "v", "visits"])

    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "h")).alias("q")).select("vec_id", "q.v", "q.h")
    classes = queries.groupBy("h", "v").agg(F.min("vec_id").alias("id"))
    routed, _ = materialise(classes.select("id", "v").mapInArrow(route, "id long, v array<double>, visits array<int>"), "queries")
    visits = routed.select("id", "v", F.explode("visits").alias("part"))
    asked = {r.part: r["count"] for r in visits.groupBy("part").count().collect()}
    if not asked:
        return spark.createDataFrame([], RESULT)
    blocks = {p: -(-c // BLOCK) for p, c in count.items() if p in asked}
    query_blocks = {p: -(-c // QUERY_BLOCK) for p, c in asked.items()}
    lookup = lambda d: F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for p in sorted(d) if d[p] > 1 for y in (p, d[p])]), F.col("part")), F.lit(1)) if any(x > 1 for x in d.values()) else F.lit(1)
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda col, n: F.pmod(F.xxhash64(col), n).cast("int")
    base = placed.select("id", "v", "part", own("id", lookup(blocks)).alias("block"), spread(lookup(query_blocks)).alias("qblock"), F.lit(False).alias("query"))
    asks = visits.select("id", "v", "part", spread(lookup(blocks)).alias("block"), own("id", lookup(query_blocks)).alias("qblock"), F.lit(True).alias("query"))

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        q = pdf["query"].to_numpy()
        if not q.any() or q.all():
            return pd.DataFrame([], columns=["id", "vec_id", "score"])
        m, ids = np.stack(pdf["v"].to_numpy()), pdf["id"].to_numpy()
        return pd.DataFrame([(int(ids[q][i]), v, d) for i, v, d in nearest(m[q], m[~q], ids[~q], k + 1)], columns=["id", "vec_id", "score"])

    found = base.unionByName(asks).groupBy("part", "block", "qblock").applyInPandas(rerank, "id long, vec_id long, score double")
    once = found.groupBy("id", "vec_id").agg(F.min("score").alias("score"))
    order = lambda key: Window.partitionBy(key).orderBy("score", "vec_id")
    best = once.withColumn("_r", F.row_number().over(order("id"))).where(F.col("_r") <= k + 1).drop("_r")
    members = queries.join(classes, ["h", "v"]).select(F.col("vec_id").alias("query_id"), "id")
    told = members.join(best, "id").where("query_id <> vec_id").withColumn("rank", F.row_number().over(order("query_id")))
    return told.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
