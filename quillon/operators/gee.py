"""Generalised estimating equations for clustered rows (Gaussian, identity link), from sums of clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.distributions import normal_p

from .ranks import settled, with_groups
from .regression import _mapped, _square
from .statistics import finite_rows


def cluster_sums(df: DataFrame, by: Sequence[str], cluster: str, xs: Sequence[str], y: str) -> DataFrame:
    """(by.., cluster, n, s, p, q, sy, yy): per cluster the sums of (1, xs), their products, those with y, y and its squares."""
    rows = finite_rows(df, *xs, y).where(F.col(cluster).isNotNull())
    v = [F.lit(1.0), *[F.col(c) for c in xs]]
    k = range(len(v))
    return rows.groupBy(*by, F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(a) for a in v]).alias("s"), F.array(*[F.sum(v[i] * v[j]) for i in k for j in k if j >= i]).alias("p"),
        F.array(*[F.sum(a * F.col(y)) for a in v]).alias("q"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("yy"),
    )


def _estimate(sizes: np.ndarray, count: np.ndarray, ss: np.ndarray, sq: np.ndarray, sy2: np.ndarray, p: np.ndarray, q: np.ndarray, yy: float, exchangeable: bool) -> tuple[np.ndarray, float, np.ndarray] | None:
    """(coefficients, correlation, inverse of sum X' W X) of one group; rows of the arrays are cluster sizes.

    X' V^-1 X of a cluster is X'X - c(n) s s' with c = r / (1 + (n - 1) r), so its sums over clusters of a size do.
    """
    k, n, rho = len(q), float((sizes * count).sum()), 0.0
    if n <= k:
        return None
    pairs = float((count * sizes * (sizes - 1)).sum()) / 2
    beta = None
    for _ in range(200):
        c = rho / (1 + (sizes - 1) * rho)
        a = p - (c[:, None, None] * ss).sum(0)
        if np.linalg.cond(a) > 1e13:
            return None
        before, beta = beta, np.linalg.solve(a, q - (c[:, None] * sq).sum(0))
        if before is not None and np.abs(beta - before).max() <= 1e-13 * max(1.0, float(np.abs(beta).max())):
            break
        if exchangeable and pairs > k:
            rss = max(yy - 2 * beta @ q + beta @ p @ beta, 0.0)
            between = float((sy2 - 2 * sq @ beta + np.einsum("i,nij,j->n", beta, ss, beta)).sum())
            if rss <= 0:
                break
            new = (between - rss) / 2 / (rss / (n - k)) / (pairs - k)
            # the working correlation has to stay positive definite
            rho = float(np.clip(new, -0.999 / max(sizes.max() - 1, 1), 0.999))
    return beta, rho, np.linalg.inv(a)


def gee(df: DataFrame, by: Sequence[str], cluster: str, xs: Sequence[str], y: str, exchangeable: bool = True) -> DataFrame:
    """(by.., term, n, clusters, correlation, coefficient, se, z, p): y on (1, xs) with rows of a cluster correlated alike.

    Coefficient and working correlation are solved in turn (the moment estimate of the correlation of two residuals
    of a cluster); se is the robust (sandwich) one of clusters, z = coefficient / se, p two-sided normal. exchangeable =
    False: rows count as independent and only se knows the clusters. Rows with a null or non-finite value or a null
    cluster are left out; coefficients are null where there are too few rows or the columns depend on each other,
    se, z and p where there are under two clusters. Rows are read once into sums of clusters; what is solved in one
    task has one row for each different cluster size.
    """
    k = len(xs) + 1
    own = {c: f"_by_{i}" for i, c in enumerate(by)}
    names = {c: f"_v_{i}" for i, c in enumerate([*xs, y])}
    rows = df.select(*[F.col(c).alias(n) for c, n in own.items()], F.col(cluster).alias("_c"), *[F.col(c).alias(n) for c, n in names.items()])
    keys, vs = list(own.values()), list(names.values())
    sums = settled(cluster_sums(rows, keys, "_c", vs[:-1], vs[-1]))
    at = lambda c, i: F.get(c, F.lit(i))
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    per = sums.groupBy(*keys, "n").agg(
        F.count(F.lit(1)).alias("count"), F.array(*[F.sum(at("s", i) * at("s", j)) for i, j in upper]).alias("ss"), F.array(*[F.sum(at("s", i) * F.col("sy")) for i in range(k)]).alias("sq"), F.sum(F.col("sy") * F.col("sy")).alias("sy2"),
        F.array(*[F.sum(at("p", i)) for i in range(len(upper))]).alias("p"), F.array(*[F.sum(at("q", i)) for i in range(k)]).alias("q"), F.sum("yy").alias("yy"),
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        stack = lambda c: np.stack(pdf[c].to_numpy())
        sizes, count = pdf["n"].to_numpy(float), pdf["count"].to_numpy(float)
        found = _estimate(sizes, count, np.stack([_square(m, k) for m in pdf["ss"]]), stack("sq"), pdf["sy2"].to_numpy(float), _square(stack("p").sum(0), k), stack("q").sum(0), float(pdf["yy"].sum()), exchangeable)
        beta, rho, bread = found if found is not None else (None, None, None)
        out = pd.DataFrame({"n": [int((sizes * count).sum())], "clusters": [int(count.sum())], "b": [None if beta is None else beta.tolist()], "r": [rho], "bread": [None if beta is None else bread.ravel().tolist()]})
        for c in reversed(keys):
            out.insert(0, c, [pdf[c].iloc[0]])
        return out

    kinds = dict(per.dtypes)
    state = settled(per.groupBy(*keys).applyInPandas(solve, ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "n long, clusters long, b array<double>, r double, bread array<double>"])))
    # the sandwich's middle: squares of each cluster's score
    here = with_groups(sums, state.where("b is not null").select(*keys, "b", "r"), keys)
    place = {ij: i for i, ij in enumerate(upper)}
    residual = F.col("sy") - sum((at("b", i) * at("s", i) for i in range(k)), F.lit(0.0))
    c = F.col("r") / (1.0 + (F.col("n") - 1) * F.col("r"))
    score = [at("q", j) - sum((at("p", place[min(i, j), max(i, j)]) * at("b", i) for i in range(k)), F.lit(0.0)) - c * at("s", j) * residual for j in range(k)]
    scored = here.select(*keys, *[s.alias(f"_u_{j}") for j, s in enumerate(score)])
    meat = scored.groupBy(*keys).agg(F.array(*[F.sum(F.col(f"_u_{i}") * F.col(f"_u_{j}")) for i, j in upper]).alias("meat"))

    def errors(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples(index=False):
            if row.b is None or row.meat is None or row.clusters < 2:
                out.append(None)
                continue
            bread = np.array(row.bread).reshape(k, k)
            out.append(np.sqrt(np.maximum(np.diag(bread @ _square(np.array(row.meat), k) @ bread), 0)).tolist())
        return pd.DataFrame({**{c: pdf[c] for c in keys}, "n": pdf["n"], "clusters": pdf["clusters"], "b": pdf["b"], "r": pdf["r"], "e": out})

    solved = _mapped(with_groups(state, meat, keys, "left"), keys, errors, "n long, clusters long, b array<double>, r double, e array<double>")
    terms = F.posexplode(F.array(F.lit("intercept"), *[F.lit(x) for x in xs])).alias("_i", "term")
    rows = solved.select(*keys, "n", "clusters", "b", "r", "e", terms)
    coefficient, se = F.get("b", F.col("_i")), F.get("e", F.col("_i"))
    out = rows.select(*keys, "term", "n", "clusters", F.col("r").alias("correlation"), coefficient.alias("coefficient"), se.alias("se"), F.when(se > 0, coefficient / F.nullif(se, F.lit(0.0))).alias("z"))
    return out.select(*[F.col(n).alias(c) for c, n in own.items()], "term", "n", "clusters", "correlation", "coefficient", "se", "z", normal_p(F.col("z")).alias("p"))
