"""Variable features by a fitted trend, residuals of count models, components, factorisation with consensus, and scaling of distances.

Rows are spread over tasks and meet small models (components x features) in passes: each task adds up its rows' share
of a small matrix, and Spark adds up the tasks'. The features are the ones that the caller chose; the driver and each task hold
one model of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.linear import eigenvectors
from quillon.functions.scalars import finite

from .ranks import discard, settled

# ---------------------------------------------------------------- variable features


def _cells(long: DataFrame, node: str, feature: str, x: str) -> DataFrame:
    """(node, feature, x) with finite x other than 0, cells of one place added up."""
    rows = long.select(F.col(node).alias("node"), F.col(feature).alias("feature"), finite(x).alias("x")).where("node is not null and feature is not null and x is not null")
    return rows.groupBy("node", "feature").agg(F.sum("x").alias("x"))


def variable_features(long: DataFrame, node: str, feature: str, x: str, width: float = 0.1, span: float = 1.0) -> DataFrame:
    """(feature, mean, variance, trend, variability, rank): variance of clipped standardised values, by the trend of variance over mean.

    A place without a row is 0; null, NaN and infinite values and null keys are left out. log10 variance is fitted on log10 mean by
    local quadratics: means are put into bins of `width`, and each bin has the least-squares quadratic of the bins
    within `span`, with tricube weights of their distance (where that has no unique solution, the weighted mean). Values
    are then cut off at mean + trend's sd * sqrt(nodes). Features with mean or variance 0 have no trend and
    variability 0; ranks go by variability, then by name.
    """
    cells = settled(_cells(long, node, feature, x))
    nodes = F.broadcast(cells.agg(F.countDistinct("node").cast("double").alias("n")))
    per = cells.groupBy("feature").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).crossJoin(nodes)
    mean, var = F.col("s") / F.col("n"), (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.nullif(F.col("n") - 1.0, F.lit(0.0))
    per = per.select("feature", "n", mean.alias("mean"), var.alias("variance"))
    ok = (F.col("mean") > 0) & (F.col("variance") > 1e-12)
    lx, ly = F.when(ok, F.log10("mean")), F.when(ok, F.log10("variance"))
    per = settled(per.withColumns({"lx": lx, "ly": ly}).withColumn("bin", F.floor(F.col("lx") / width).cast("int")))
    power = lambda i: F.sum(F.pow("lx", F.lit(float(i))))
    bins = per.where("bin is not null").groupBy("bin").agg(*[power(i).alias(f"x{i}") for i in range(5)], *[F.sum(F.pow("lx", F.lit(float(i))) * F.col("ly")).alias(f"y{i}") for i in range(3)])
    # as many bins as means have tenths of powers of ten
    reach = span / width + 1
    near = bins.select("bin").join(bins.withColumnRenamed("bin", "_other"), F.abs(F.col("bin") - F.col("_other")) < reach)
    weight = F.pow(1.0 - F.pow(F.abs(F.col("bin") - F.col("_other")) / F.lit(reach), F.lit(3.0)), F.lit(3.0))
    fit = near.groupBy("bin").agg(*[F.sum(weight * F.col(c)).alias(c) for c in (*[f"x{i}" for i in range(5)], *[f"y{i}" for i in range(3)])])
    m = [[F.col(f"x{i + j}") for j in range(3)] for i in range(3)]
    y = [F.col(f"y{i}") for i in range(3)]

    def det(a: list[list[Column]]) -> Column:
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    d = det(m)
    solved = [det([[y[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) / F.nullif(d, F.lit(0.0)) for k in range(3)]
    unique = F.abs(d) > 1e-9 * F.pow("x0", F.lit(3.0))
    plain = [F.col("y0") / F.col("x0"), F.lit(0.0), F.lit(0.0)]
    fit = fit.select("bin", *[F.when(unique, s).otherwise(p).alias(f"c{k}") for k, (s, p) in enumerate(zip(solved, plain, strict=True))])
    trend = per.join(F.broadcast(fit), "bin", "left").withColumn("trend", F.col("c0") + F.col("c1") * F.col("lx") + F.col("c2") * F.col("lx") * F.col("lx")).select("feature", "n", "mean", "variance", "trend")
    sd = F.sqrt(F.pow(F.lit(10.0), F.col("trend")))
    cut = F.least("x", F.col("mean") + sd * F.sqrt("n"))
    clipped = cells.join(trend, "feature").groupBy("feature", "n", "mean", "variance", "trend").agg(F.sum(cut).alias("c"), F.sum(cut * cut).alias("cc"))
    value = (F.col("n") * F.col("mean") * F.col("mean") + F.col("cc") - 2.0 * F.col("mean") * F.col("c")) / ((F.col("n") - 1.0) * F.pow(F.lit(10.0), F.col("trend")))
    out = clipped.withColumn("variability", F.coalesce(value, F.lit(0.0)))
    from .ranks import running_sum

    ranked = running_sum(out, [], [-F.round("variability", 9), F.col("feature")], F.lit(1), "rank")
    return ranked.select("feature", "mean", "variance", "trend", "variability", (F.col("rank") + 1).alias("rank"))


def residual_variance(long: DataFrame, node: str, feature: str, x: str, theta: float = 100.0) -> DataFrame:
    """(feature, total, squares, variance): analytic Pearson residuals of counts against products of margins, clipped at sqrt(nodes).

    A cell's expectation is m = node total * feature total / all, its residual (x - m) / sqrt(m + m^2 / theta). Cells without
    a row count as 0 but are not written: their squares depend on the node's total alone, so they are added up over
    the different totals, less what cells with a row would have had. variance is the mean square less the squared mean over all nodes.
    Null, NaN, infinite and negative values are left out.
    """
    cells = settled(_cells(long.where(F.col(x) >= 0), node, feature, x).where("x > 0"))
    rows, columns = cells.groupBy("node").agg(F.sum("x").alias("r")), cells.groupBy("feature").agg(F.sum("x").alias("c"))
    whole = F.broadcast(rows.agg(F.sum("r").alias("t"), F.count(F.lit(1)).cast("double").alias("n")))
    totals = rows.groupBy("r").agg(F.count(F.lit(1)).cast("double").alias("k"))
    m = F.col("r") * F.col("c") / F.col("t")
    sd, top = F.sqrt(m + m * m / F.lit(theta)), F.sqrt("n")
    residual = lambda v: F.greatest(F.least((v - m) / sd, top), -top)
    zero, own = residual(F.lit(0.0)), residual(F.col("x"))
    # features meet the different totals of nodes, not the nodes
    empty = columns.crossJoin(totals).crossJoin(whole).groupBy("feature", "c", "n").agg(F.sum(F.col("k") * zero).alias("s0"), F.sum(F.col("k") * zero * zero).alias("q0"))
    full = cells.join(rows, "node").join(columns, "feature").crossJoin(whole).groupBy("feature").agg(F.sum(own - zero).alias("s1"), F.sum(own * own - zero * zero).alias("q1"))
    s, q = F.col("s0") + F.col("s1"), F.col("q0") + F.col("q1")
    return empty.join(full, "feature").select("feature", F.col("c").alias("total"), q.alias("squares"), (q / F.col("n") - (s / F.col("n")) * (s / F.col("n"))).alias("variance"))


# ---------------------------------------------------------------- passes over sparse rows


def _dense(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The vectors of a batch of (node, places, values), a block of some 200,000 cells (at least 512 vectors) at a time."""
    block = max(512, 200_000 // max(width, 1))
    for a in range(0, batch.num_rows, block):
        p, v = batch.column(1).slice(a, block), batch.column(2).slice(a, block)
        out = np.zeros((len(p), width))
        out[np.repeat(np.arange(len(p)), p.value_lengths().to_numpy(zero_copy_only=False)), p.flatten().to_numpy(zero_copy_only=False)] = v.flatten().to_numpy(zero_copy_only=False)
        yield out


def _summed(df: DataFrame, size: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """The sum over all rows of what `add` puts into an array of this size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for batch in batches:
            add(sums, batch)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at])], ["cell", "value"])

    out = np.zeros(size)
    for r in df.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r.cell] = r.value
    return out


class SparseRows:
    """A table's rows as sparse vectors: one row for each node, with places and values of its features.

    names are the features in order; a row is as long as the features it has.
    """

    def __init__(self, long: DataFrame, node: str, feature: str, x: str):
        cells = settled(_cells(long, node, feature, x))
        self.names = [r.feature for r in cells.select("feature").distinct().orderBy("feature").collect()]
        spark, kind = long.sparkSession, dict(cells.dtypes)["feature"]
        places = spark.createDataFrame(list(zip(self.names, range(len(self.names)), strict=True)), f"feature {kind}, place int")
        packed = cells.where("x <> 0").join(F.broadcast(places), "feature").groupBy("node").agg(F.collect_list(F.struct("place", "x")).alias("v"))
        every = cells.select("node").distinct().join(packed, "node", "left")
        self.rows = settled(every.select("node", F.coalesce("v.place", F.array().cast("array<int>")).alias("place"), F.coalesce("v.x", F.array().cast("array<double>")).alias("x")))
        self.count = self.rows.count()
        discard(cells)

    def total(self, size: int, add: Callable[[np.ndarray, np.ndarray], None]) -> np.ndarray:
        """The sum over all rows of what `add` puts into an array of this size for a block of vectors."""
        width = len(self.names)

        def each(sums: np.ndarray, batch: pa.RecordBatch) -> None:
            for block in _dense(batch, width):
                add(sums, block)

        return _summed(self.rows, size, each)

    def mapped(self, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        """(node, y array) with y = fn(rows)."""
        width = len(self.names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = [fn(block) for block in _dense(batch, width)]
                if parts:
                    y = np.concatenate(parts)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "y"])

        return self.rows.mapInArrow(run, f"node {dict(self.rows.dtypes)['node']}, y array<double>")


def principal_components(long: DataFrame, node: str, feature: str, x: str, k: int = 50, largest: float = 10.0, passes: int = 60, tolerance: float = 1e-10) -> tuple[DataFrame, DataFrame]:
    """((node, component, value), (component, share, feature, loading)) of features scaled to unit variance and cut off at `largest`.

    A place without a row is 0. Features without variance are 0. Range finding by blocks: a pass multiplies k + 10
    directions with the covariance (see eigenvectors), until the residuals of the first k are at most `tolerance` of the
    largest eigenvalue (or `passes` are over, which is an error). A component's largest loading is positive.
    """
    rows = SparseRows(long, node, feature, x)
    p, n = len(rows.names), rows.count
    k = min(k, p, max(n - 1, 0))
    spark, kind = long.sparkSession, dict(rows.rows.dtypes)["node"]
    if k == 0:
        return spark.createDataFrame([], f"node {kind}, component int, value double"), spark.createDataFrame([], "component int, share double, feature string, loading double")
    s = rows.total(2 * p, lambda t, b: np.add(t, np.concatenate([b.sum(0), (b * b).sum(0)]), out=t))
    mean = s[:p] / n
    sd = np.sqrt(np.maximum(s[p:] - n * mean**2, 0) / max(n - 1, 1))
    sd[sd <= 1e-12 * np.maximum(np.abs(mean), 1e-300)] = np.inf
    scale = lambda b: np.clip((b - mean) / sd, -largest, largest)
    centre = rows.total(p, lambda t, b: np.add(t, scale(b).sum(0), out=t)) / n
    trace = rows.total(1, lambda t, b: np.add(t, ((scale(b) - centre) ** 2).sum(), out=t))[0] / max(n - 1, 1)
    def times(block: np.ndarray) -> np.ndarray:
        def add(t: np.ndarray, b: np.ndarray) -> None:
            z = scale(b) - centre
            t += (z.T @ (z @ block)).ravel()

        return rows.total(block.size, add).reshape(block.shape) / max(n - 1, 1)

    e, v, _ = eigenvectors(times, p, k, k + 10, passes=passes, tolerance=tolerance)
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    at = rows.mapped(lambda b: (scale(b) - centre) @ v).select("node", F.posexplode("y").alias("component", "value")).withColumn("component", F.col("component") + 1)
    loads = [(j + 1, float(e[j] / trace) if trace > 0 else None, str(f), float(v[i, j])) for j in range(k) for i, f in enumerate(rows.names)]
    return at, spark.createDataFrame(loads, "component int, share double, feature string, loading double")


# ---------------------------------------------------------------- factorisation


def _solved(g: np.ndarray, c: np.ndarray, w: np.ndarray, jump: bool) -> np.ndarray:
    """Columns of w that are done; they are set to the least squares over the places that they use, where these hold.

    Columns that use the same places are solved together. A solution holds if it is not negative and no place would move, to the
    same precision as in a sweep; with jump, the other columns go on from what of it is not negative. Places that depend on each
    other, and more than 60 of them, are left to the sweeps.
    """
    done = np.zeros(w.shape[1], bool)
    if len(g) > 60:
        return done
    code = (1 << np.arange(len(g))) @ (w > 0)
    order = np.argsort(code, kind="stable")
    found, first = np.unique(code[order], return_index=True)
    for one, columns in zip(found, np.split(order, first[1:]), strict=True):
        at = (int(one) >> np.arange(len(g))) & 1 == 1
        a = g[np.ix_(at, at)]
        if at.any() and np.linalg.cond(a) > 1e10:
            continue
        own = c[:, columns]
        v = np.zeros(own.shape)
        v[at] = np.linalg.solve(a, own[at])
        up = np.divide(own - g @ v, np.diag(g)[:, None], out=np.zeros(own.shape), where=np.diag(g)[:, None] > 0)[~at]
        ok = (v.min(0) >= 0) & (up.max(0, initial=0) <= 1e-12 * max(1.0, float(v.max(initial=0))))
        done[columns[ok]] = True
        w[:, columns] = np.maximum(v, 0) if jump else np.where(ok, v, w[:, columns])
    return done


def usages(x: np.ndarray, h: np.ndarray, sweeps: int = 500) -> np.ndarray:
    """Non-negative w of the least |x - w h|^2, by coordinate descent until nothing moves.

    After some sweeps most rows use the places that they will use in the end: they are solved for these at once and take no
    part any more, so a slow row keeps none of the others.
    """
    g, c = h @ h.T, h @ x.T
    out = np.zeros((len(h), len(x)))
    rows, w = np.arange(len(x)), out.copy()
    for sweep in range(1, sweeps + 1):
        most = 0.0
        for j in range(len(h)):
            if g[j, j] > 0:
                new = np.maximum(w[j] + (c[j] - g[j] @ w) / g[j, j], 0)
                most = max(most, float(np.abs(new - w[j]).max(initial=0)))
                w[j] = new
        if most <= 1e-12 * max(1.0, float(w.max(initial=0))):
            break
        if sweep % 2 == 0 and sweep <= 20 or sweep % 10 == 0:
            done = _solved(g, c, w, sweep <= 20)
            out[:, rows[done]] = w[:, done]
            rows, w, c = rows[~done], w[:, ~done], c[:, ~done]
            if not len(rows):
                break
    out[:, rows] = w
    return out.T


def _improved(h: np.ndarray, ww: np.ndarray, wx: np.ndarray, sweeps: int = 20) -> np.ndarray:
    """Spectra of a smaller loss for usages with these products."""
    h = h.copy()
    for _ in range(sweeps):
        for j in range(len(h)):
            if ww[j, j] > 0:
                h[j] = np.maximum(h[j] + (wx[j] - ww[j] @ h) / ww[j, j], 0)
    return h


def factorise(rows: SparseRows, k: int, restarts: int, iterations: int = 100, tolerance: float = 1e-6, seed: int = 14) -> tuple[np.ndarray, np.ndarray]:
    """(spectra restarts x k x features, losses restarts x iterations): x = w h with w and h not negative, for all restarts in the same passes.

    Rows solve for their usages given the spectra, so no usage is kept between passes and a lost task is just run
    again; what comes back are w'w, w'x and the loss. A restart's losses never grow; it stops where the gain of a pass is
    at most `tolerance` of its loss.
    """
    p = len(rows.names)
    mean = rows.total(1, lambda t, b: np.add(t, b.sum(), out=t))[0] / max(rows.count * p, 1)
    h = np.stack([np.random.default_rng([seed, r]).random((k, p)) * np.sqrt(max(mean, 1e-300) / k) for r in range(restarts)])
    losses, going, size = np.full((restarts, 0), np.nan), np.ones(restarts, bool), k * k + k * p + 1
    for _ in range(iterations):
        now, own = np.flatnonzero(going), h

        def add(t: np.ndarray, b: np.ndarray, now=now, own=own) -> None:
            for i, r in enumerate(now):
                w = usages(b, own[r])
                t[i * size : (i + 1) * size] += np.concatenate([(w.T @ w).ravel(), (w.T @ b).ravel(), [((b - w @ own[r]) ** 2).sum() / 2]])

        got = rows.total(len(now) * size, add).reshape(len(now), size)
        column = losses[:, -1].copy() if losses.shape[1] else np.full(restarts, np.nan)
        h = h.copy()
        for r, t in zip(now, got, strict=True):
            before, column[r] = column[r], t[-1]
            going[r] = not (before - t[-1] <= tolerance * max(t[-1], 1e-300))  # nan: the first pass
            if going[r]:
                h[r] = _improved(h[r], t[: k * k].reshape(k, k), t[k * k : -1].reshape(k, p))
        losses = np.column_stack([losses, column])
        if not going.any():
            break
    return h, losses


def consensus_spectra(h: np.ndarray, nearest: float = 0.3, density: float = 0.5, seed: int = 14) -> tuple[np.ndarray, float]:
    """(k spectra that sum to 1, silhouette): medians of clusters of all restarts' spectra, of those that have near neighbours.

    Spectra are scaled to length 1; those whose mean distance to the nearest `nearest` * restarts others is `density` or
    more are left out. There are restarts x k of them, whatever the number of rows.
    """
    restarts, k, _ = h.shape
    flat = h.reshape(restarts * k, -1)
    flat = flat[np.linalg.norm(flat, axis=1) > 0]
    s = flat / np.linalg.norm(flat, axis=1, keepdims=True)
    d = np.sqrt(np.maximum(2 - 2 * s @ s.T, 0))
    some = max(1, int(nearest * restarts))
    if restarts > 1:
        s = s[np.sort(d, axis=1)[:, 1 : some + 1].mean(1) < density]
    if len(s) < k:
        raise ValueError(f"{len(s)} of the spectra have near neighbours, fewer than {k}")
    best = None
    for start in range(10):
        rng = np.random.default_rng([seed, start])
        c = s[[rng.integers(len(s))]]
        for _ in range(k - 1):
            far = ((s[:, None] - c[None]) ** 2).sum(-1).min(1)
            c = np.concatenate([c, s[[rng.choice(len(s), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(s))]]])
        for _ in range(100):
            label = ((s[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            new = np.stack([s[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = float(((s - c[label]) ** 2).sum())
        if best is None or cost < best[0] - 1e-12:
            best = cost, label
    label = best[1]
    d = np.sqrt(np.maximum(2 - 2 * s @ s.T, 0))
    scores = []
    for i in range(len(s)):
        own = label == label[i]
        if own.sum() > 1 and len(set(label)) > 1:
            a, b = d[i, own].sum() / (own.sum() - 1), min(d[i, label == c].mean() for c in set(label) if c != label[i])
            scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
        else:
            scores.append(0.0)
    medians = np.stack([np.median(s[label == j], axis=0) if (label == j).any() else np.zeros(s.shape[1]) for j in range(k)])
    sums = medians.sum(1, keepdims=True)
    medians = np.divide(medians, sums, out=np.zeros_like(medians), where=sums > 0)
    return medians[np.lexsort(medians.T[::-1])[::-1]], float(np.mean(scores))


def programs(long: DataFrame, node: str, feature: str, x: str, ks: Sequence[int], restarts: int = 20, iterations: int = 100, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((k, silhouette, loss), (k, program, feature, loading), (k, node, program, usage)) for each k: factorisation, consensus, usages.

    Negative, null and non-finite values are left out; a place without a row is 0. Programs are numbered from 1, the
    one with the greatest first loading first; usages of a node add up to 1 (to 0 if it uses none). k that is
    more than the features, or that leaves too few spectra with near neighbours, gives no rows.
    """
    rows = SparseRows(long.where(F.col(x) >= 0), node, feature, x)
    spark, kinds = long.sparkSession, dict(rows.rows.dtypes)
    table, loads, used = [], [], None
    for k in ks:
        if k > len(rows.names):
            continue
        h, losses = factorise(rows, k, restarts, iterations)
        try:
            spectra, silhouette = consensus_spectra(h, **options)
        except ValueError:
            continue
        table.append((k, silhouette, float(np.nanmin(losses[:, -1]))))
        loads += [(k, j + 1, str(f), float(spectra[j, i])) for j in range(k) for i, f in enumerate(rows.names)]

        def share(b: np.ndarray, spectra=spectra) -> np.ndarray:
            w = usages(b, spectra)
            total = w.sum(1, keepdims=True)
            return np.divide(w, total, out=np.zeros_like(w), where=total > 0)

        one = rows.mapped(share).select(F.lit(int(k)).alias("k"), "node", F.posexplode("y").alias("program", "usage")).withColumn("program", F.col("program") + 1)
        used = one if used is None else used.unionByName(one)
    if used is None:
        used = spark.createDataFrame([], f"k int, node {kinds['node']}, program int, usage double")
    return spark.createDataFrame(table, "k int, silhouette double, loss double"), spark.createDataFrame(loads, "k int, program int, feature string, loading double"), used


# ---------------------------------------------------------------- scaling of distances


def _blocks(q: DataFrame, turn: np.ndarray | None = None) -> DataFrame | np.ndarray:
    """Of rows (node, s, t) with t = B s: without turn, s's, s't and t't; with it, (node, s turn, t turn)."""
    stack = lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if len(c) else np.zeros((0, 1))
    if turn is None:
        m = len(q.select("s").first().s)

        def add(sums: np.ndarray, batch: pa.RecordBatch) -> None:
            if batch.num_rows:
                s, t = stack(batch.column(0)), stack(batch.column(1))
                sums += np.concatenate([(s.T @ s).ravel(), (s.T @ t).ravel(), (t.T @ t).ravel()])

        return _summed(q.select("s", "t"), 3 * m * m, add).reshape(3, m, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cut = pa.array(np.arange(batch.num_rows + 1) * turn.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.ListArray.from_arrays(cut, pa.array((stack(batch.column(i)) @ turn).ravel())) for i in (1, 2)]], ["node", "s", "t"])

    return q.select("node", "s", "t").mapInArrow(run, f"node {dict(q.dtypes)['node']}, s array<double>, t array<double>")


def distance_scaling(pairs: DataFrame, nodes: DataFrame, node: str, distance: str, k: int = 2, far: float = 1.0, passes: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """(node, axis, value, share): coordinates whose distances fit those of the pairs (classical scaling).

    pairs: (a, b, distance), each unordered pair once; a pair that is not there is `far` apart. The squared distances
    are far^2 less a sparse table, so multiplying a block of vectors with their double centring B takes one join of the
    pairs and the block's means, and no table of all pairs is made. Each pass applies B to the residuals of the best
    vectors so far (k + 10 of them: eigenvalues of many sparse pairs lie close together) and takes the best of the span of these,
    the residuals and the last step, until the first k are eigenvectors to `tolerance` of the largest eigenvalue (an error after `passes`). Axes with an eigenvalue of 0 or less are left
    out; an axis's sign is such that the node of the greatest |value| (a tie: the smallest node) is positive. share is
    the eigenvalue over the trace. Null nodes and null or non-finite distances are left out.
    """
    n_of = settled(nodes.select(F.col(node).alias("node")).where("node is not null").distinct())
    n = n_of.count()
    spark, kind = pairs.sparkSession, dict(n_of.dtypes)["node"]
    empty = spark.createDataFrame([], f"node {kind}, axis int, value double, share double")
    b = min(k + 10, n - 1)
    if b < 1:
        return empty
    e = pairs.where("a <> b").select("a", "b", finite(distance).alias("d")).where("d is not null").select("a", "b", (F.col("d") * F.col("d") - F.lit(far * far)).alias("e")).where("e <> 0")
    both = settled(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "e")).join(n_of.withColumnRenamed("node", "a"), "a").join(n_of.withColumnRenamed("node", "b"), "b"))
    trace = ((n - 1) * far * far + (both.agg(F.sum("e")).first()[0] or 0.0) / n) / 2

    def centred(df: DataFrame, width: int, column: str) -> DataFrame:
        means = F.broadcast(df.agg(F.array(*[F.avg(F.get(column, F.lit(j))) for j in range(width)]).alias("_means")))
        return df.crossJoin(means).withColumn(column, F.zip_with(column, "_means", lambda x, m: x - m)).drop("_means")

    def times(df: DataFrame, width: int) -> DataFrame:
        """df (node, r) with y = B r = (far^2 r - E r) / 2, centred; r is centred."""
        r = df.select(F.col("node").alias("b"), "r")
        near = both.join(r, "b").groupBy(F.col("a").alias("node")).agg(F.array(*[F.sum(F.col("e") * F.get("r", F.lit(j))) for j in range(width)]).alias("_e"))
        y = df.join(near, "node", "left").withColumn("y", F.transform("r", lambda x, j: (F.lit(far * far) * x - F.coalesce(F.get("_e", j), F.lit(0.0))) / 2)).drop("_e")
        return centred(y, width, "y")

    start = centred(n_of.select("node", F.array(*[F.xxhash64("node", F.lit(j)) / F.lit(2.0**63) for j in range(b)]).alias("r")), b, "r")
    q = settled(times(start, b).select("node", F.col("r").alias("s"), F.col("y").alias("t")))
    width = b
    for turn in range(passes):
        if turn % 12 == 11:  # images of combinations drift from what B gives: anew, with the last step, without which it would start again
            fresh = settled(times(centred(q.select("node", F.col("s").alias("r")), width, "r"), width).select("node", F.col("r").alias("s"), F.col("y").alias("t")))
            discard(q)
            q = fresh
        g, t, tt = _blocks(q)
        # residuals (of the largest eigenvalue) that are done are noise: they and empty steps stay out of the span
        live = np.diag(g) > 1e-16 * max(np.diag(g)[:b].max(), 1e-300)
        scale = np.where(live, 1 / np.sqrt(np.maximum(np.diag(g), 1e-300)), 0.0)
        values, u = np.linalg.eigh(g * np.outer(scale, scale))
        white = (u[:, values > 1e-10] / np.sqrt(values[values > 1e-10])) * scale[:, None]
        values, u = np.linalg.eigh(white.T @ ((t + t.T) / 2) @ white)
        best = (white @ u[:, ::-1])[:, :b]
        values = values[::-1][: best.shape[1]]
        first = min(k, len(values))
        square = [float(best[:, j] @ tt @ best[:, j] - 2 * values[j] * (best[:, j] @ t @ best[:, j]) + values[j] ** 2 * (best[:, j] @ g @ best[:, j])) for j in range(first)]
        # roundoff of a difference of squares: a residual is known to the root of the machine's precision
        if max(np.sqrt(np.maximum(square, 0))) <= max(tolerance, 1e-7) * max(abs(values[0]), 1e-300) or white.shape[1] == n - 1:
            break
        step = best.copy()
        step[:b] = 0  # what the last step added: no part of the vectors before
        wide = settled(_blocks(q, np.concatenate([best, step] if len(g) > b else [best], axis=1)))
        m = best.shape[1]
        residual = F.zip_with(F.slice("t", 1, m), F.zip_with(F.slice("s", 1, m), F.array(*[F.lit(float(v)) for v in values]), lambda x, v: x * v), lambda x, y: (x - y) / F.lit(max(abs(float(values[0])), 1e-300)))
        moved = times(wide.withColumn("r", residual), m)
        parts = lambda c, new: F.concat(F.slice(c, 1, m), new, F.slice(c, m + 1, 3 * b))  # noqa: B023, E731
        after = settled(moved.select("node", parts("s", F.col("r")).alias("s"), parts("t", F.col("y")).alias("t")))
        discard(q, wide)
        q, width, b = after, 3 * m if len(g) > b else 2 * m, m
    else:
        raise RuntimeError(f"axes did not settle in {passes} passes")
    real = [j for j in range(first) if values[j] > 1e-9 * max(abs(values[0]), 1e-300)]
    if not real:
        return empty
    long = settled(_blocks(q, best[:, real] * np.sqrt(values[real]))).select("node", F.posexplode("s").alias("axis", "value"))
    top = long.groupBy("axis").agg(F.min(F.struct((-F.round(F.abs("value"), 9)).alias("s"), "node", "value")).alias("m"))
    shares = F.element_at(F.array(*[F.lit(float(values[j] / trace)) if trace > 0 else F.lit(None).cast("double") for j in real]), F.col("axis") + 1)
    return long.join(F.broadcast(top.select("axis", F.signum("m.value").alias("sign"))), "axis").select("node", (F.col("axis") + 1).alias("axis"), (F.col("value") * F.col("sign")).alias("value"), shares.alias("share"))
