"""Least squares, ridge and elastic net by groups, with folds by hash, and tests of nested models.

Moments are sums: each fold's normal equations come from one distributed aggregate, of p * (p + 1) / 2 numbers
a group and fold, whatever the number of rows; a group's small systems are then solved in one task each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillon.functions.hashes import Md5Order

from .ranks import any_group_name
from .statistics import finite_rows

#: A group of at most so many rows is dealt anew in tasks that hold it.
GATHERED = 4_000_000


def fold_of(key: Column, folds: int, seed: str = "fold") -> Column:
    """The fold of a key, from an md5: any engine gives the same."""
    return F.pmod(F.conv(F.substr(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"))), F.lit(1), F.lit(8)), 16, 10).cast("long"), F.lit(folds)).cast("int")


def moments(df: DataFrame, by: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """(by.., n, m array): the sums of all products of (1, xs.., y), upper triangle row by row.

    Values are taken less their whole-table means first (with the means as `centre`), so sums of squares keep their digits.
    """
    names = [*xs, y]
    rows = finite_rows(df, *names)
    centre = rows.agg(*[F.avg(c).alias(f"_c_{i}") for i, c in enumerate(names)])
    v = [F.lit(1.0), *[F.col(c) - F.col(f"_c_{i}") for i, c in enumerate(names)]]
    products = [F.sum(v[i] * v[j]) for i in range(len(v)) for j in range(i, len(v))]
    return rows.crossJoin(centre).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*products).alias("m"), F.array(*[F.max(f"_c_{i}") for i in range(len(names))]).alias("centre"))


def _square(m: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = m
    return out + np.triu(out, 1).T


def _fit(s: np.ndarray, alpha: float, l1: float = 0.0, steps: int = 2000) -> tuple[np.ndarray, float]:
    """Standardised slopes' raw coefficients and intercept from a moment matrix of (1, xs.., y).

    alpha is the penalty per row of standardised x (0: least squares), l1 its lasso share (coordinate descent).
    """
    n, mean = s[0, 0], s[0, 1:] / s[0, 0]
    c = s[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(c)[:-1], 0))
    ok = sd > 1e-9 * max(1.0, float(np.abs(mean[:-1]).max(initial=0)))
    b = np.zeros(len(sd))
    if ok.any():
        g, r = c[:-1, :-1][np.ix_(ok, ok)] / np.outer(sd[ok], sd[ok]), c[:-1, -1][ok] / sd[ok]
        if l1 <= 0 or alpha == 0:
            w = np.linalg.lstsq(g + alpha * np.eye(len(r)), r, rcond=None)[0]
        else:
            w = np.zeros(len(r))
            for _ in range(steps):
                before = w.copy()
                for j in range(len(r)):
                    rho = r[j] - g[j] @ w + g[j, j] * w[j]
                    w[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (g[j, j] + alpha * (1 - l1))
                if np.abs(w - before).max() < 1e-10:
                    break
        b[ok] = w / sd[ok]
    return b, float(mean[-1] - mean[:-1] @ b)


def _rss(s: np.ndarray, b: np.ndarray, a: float) -> float:
    v = np.concatenate([[-a], -b, [1.0]])
    return float(v @ s @ v)


def _raw(b: np.ndarray, a: float, centre: np.ndarray) -> float:
    """The intercept for values that aren't centred."""
    return float(a + centre[-1] - centre[:-1] @ b)


def ols(df: DataFrame, by: Sequence[str], xs: Sequence[str], y: str, alpha: float = 0.0) -> DataFrame:
    """Coefficients on the raw scale, intercept, residual sum of squares and in-sample R2 (alpha > 0: ridge on standardised x)."""
    k = len(xs) + 2

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples(index=False):
            s = _square(np.array(row.m), k)
            b, a = _fit(s, alpha)
            sst = s[-1, -1] - s[0, -1] ** 2 / s[0, 0]
            rss = _rss(s, b, a)
            out.append((*[getattr(row, c) for c in by], row.n, b.tolist(), _raw(b, a, np.array(row.centre)), rss, 1 - rss / sst if sst > 1e-12 * max(1.0, s[-1, -1]) else None))
        return pd.DataFrame(out, columns=[*by, "n", "coefficients", "intercept", "rss", "r2"])

    return _mapped(moments(df, by, xs, y), by, solve, "n long, coefficients array<double>, intercept double, rss double, r2 double")


def _mapped(m: DataFrame, by: Sequence[str], solve, more: str) -> DataFrame:
    kinds = dict(m.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], more])

    def run(parts):
        for pdf in parts:
            if len(pdf):
                yield solve(pdf)

    return m.mapInPandas(run, schema)


def cross_validated(df: DataFrame, by: Sequence[str], key: str, xs: Sequence[str], y: str, alphas: Sequence[float] = (0.0,), l1s: Sequence[float] = (0.0,), folds: int = 5, group: str | None = None, seed: str = "fold") -> DataFrame:
    """Pooled cross-validated R2 with alpha and lasso share chosen inside: outer folds by hash of key (or of `group`, so its rows stay together).

    For each outer fold the settings are chosen by inner folds among the rest, then the fold is predicted by
    the fit on the rest. Only the folds' moments enter, so rows are read once. NULL with fewer than two folds.
    """
    k = len(xs) + 2
    rows = df.withColumn("_fold", fold_of(F.col(group or key), folds, seed))
    m = moments(rows, [*by, "_fold"], xs, y)
    gathered = m.groupBy(*by).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("_fold", "m"))).alias("folds"), F.first("centre").alias("centre"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples(index=False):
            parts = [_square(np.array(f["m"]), k) for f in row.folds]
            if len(parts) < 2:
                out.append((*[getattr(row, c) for c in by], row.n, None, None, None, None))
                continue
            whole, sse, chosen = sum(parts), 0.0, []
            for i, own in enumerate(parts):
                rest = [p for j, p in enumerate(parts) if j != i]
                train = whole - own
                settings = [(a, l) for a in alphas for l in l1s]
                best = settings[0]
                if len(settings) > 1 and len(rest) > 1:
                    best = min(settings, key=lambda s: (sum(_rss(p, *_fit(train - p, *s)) for p in rest), settings.index(s)))
                chosen.append(best)
                sse += _rss(own, *_fit(train, *best))
            sst = whole[-1, -1] - whole[0, -1] ** 2 / whole[0, 0]
            b, _ = _fit(whole, *chosen[0])
            out.append((*[getattr(row, c) for c in by], row.n, 1 - sse / sst if sst > 1e-12 * max(1.0, whole[-1, -1]) else None, float(np.median([a for a, _ in chosen])), float(np.median([l for _, l in chosen])), int(np.count_nonzero(np.abs(b) > 1e-12))))
        return pd.DataFrame(out, columns=[*by, "n", "cv_r2", "alpha", "l1", "nonzero"])

    return _mapped(gathered, by, solve, "n long, cv_r2 double, alpha double, l1 double, nonzero int")


def held_out_groups(df: DataFrame, group: str, xs: Sequence[str], y: str, alphas: Sequence[float], l1s: Sequence[float] = (0.5,), inner: int = 5) -> DataFrame:
    """Leave-one-group-out: each group predicted by a net fitted on all others, its settings chosen by inner folds of whole groups.

    All groups' moments (p squared numbers each) meet in one task: groups are samples, not rows.
    """
    k = len(xs) + 2
    m = moments(df.where(F.col(group).isNotNull()), [group], xs, y).groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col(group).cast("string").alias("g"), "n", "m"))).alias("groups"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [(g["g"], g["n"], _square(np.array(g["m"]), k)) for g in pdf["groups"].iloc[0]] if len(pdf) and pdf["groups"].iloc[0] is not None else []
        whole, out = sum((s for _, _, s in found), np.zeros((k, k))), []
        for i, (name, n, own) in enumerate(found if len(found) > 1 else []):
            train, rest = whole - own, [s for j, (_, _, s) in enumerate(found) if j != i]
            inside = [sum(rest[j::inner]) for j in range(min(inner, len(rest)))]
            settings = [(a, l) for a in alphas for l in l1s]
            best = min(settings, key=lambda s: (sum(_rss(p, *_fit(train - p, *s)) for p in inside), settings.index(s))) if len(inside) > 1 else settings[0]
            b, a = _fit(train, *best)
            sst = own[-1, -1] - own[0, -1] ** 2 / own[0, 0]
            out.append((name, int(n), 1 - _rss(own, b, a) / sst if sst > 1e-12 else None, best[0], best[1], int(np.count_nonzero(np.abs(b) > 1e-12))))
        return pd.DataFrame(out, columns=["held_out", "n", "r2", "alpha", "l1", "nonzero"])

    return _mapped(m, [], solve, "held_out string, n long, r2 double, alpha double, l1 double, nonzero int")


def ladder(df: DataFrame, by: Sequence[str], key: str, models: dict[str, Sequence[str]], y: str, alphas: Sequence[float] = (0.0,), folds: int = 5) -> DataFrame:
    """cross_validated for each named set of columns, with the gain over the model before."""
    from pyspark.sql import Window

    out = None
    for place, (name, xs) in enumerate(models.items()):
        one = cross_validated(df, by, key, xs, y, alphas, folds=folds).select(*by, F.lit(name).alias("model"), F.lit(place).alias("place"), "n", "cv_r2")
        out = one if out is None else out.union(one)
    return out.withColumn("gain", F.col("cv_r2") - F.lag("cv_r2").over(Window.partitionBy(*by).orderBy("place")))


def residuals(df: DataFrame, by: Sequence[str], covariates: Sequence[str], y: str, out: str) -> DataFrame:
    """y less its least-squares fit on covariates within the group; rows with a missing value get NULL."""
    from .ranks import with_groups

    fit = ols(df, by, covariates, y).select(*by, "coefficients", "intercept")
    rows = with_groups(df, fit, by, "left")
    fitted = F.col("intercept")
    for i, c in enumerate(covariates):
        fitted = fitted + F.get("coefficients", F.lit(i)) * F.col(c)
    return rows.withColumn(out, F.col(y) - fitted).drop("coefficients", "intercept")


def principal_parts(df: DataFrame, by: Sequence[str], xs: Sequence[str], anchor: str, k: int = 3) -> DataFrame:
    """The first k principal components' loadings and shares of variance; a component's sign makes the anchor's loading positive."""
    at = list(xs).index(anchor)
    m = moments(df.withColumn("_one", F.lit(0.0)), by, xs, "_one")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples(index=False):
            s = _square(np.array(row.m), len(xs) + 2)[:-1, :-1]
            mean = s[0, 1:] / s[0, 0]
            values, vectors = np.linalg.eigh(s[1:, 1:] / s[0, 0] - np.outer(mean, mean))
            order = np.argsort(-values)[:k]
            for i, c in enumerate(order):
                v = vectors[:, c] * (-1 if vectors[at, c] < 0 else 1)
                out.append((*[getattr(row, b) for b in by], i + 1, float(max(values[c], 0) / max(values.clip(0).sum(), 1e-300)), v.tolist()))
        return pd.DataFrame(out, columns=[*by, "component", "share", "loadings"])

    return _mapped(m, by, solve, "component int, share double, loadings array<double>")


def nested_f(df: DataFrame, by: Sequence[str], small: Sequence[str], large: Sequence[str], y: str) -> DataFrame:
    """F test of a model against a smaller one within it."""
    from quillon.functions.distributions import f_p
    from quillon.functions.scalars import ratio

    from .ranks import with_groups

    rows = finite_rows(df, *large, y)
    a = ols(rows, by, small, y).select(*by, F.col("rss").alias("_small"))
    b = ols(rows, by, large, y).select(*by, "n", F.col("rss").alias("_large"))
    d1 = float(len(large) - len(small))
    d2 = F.col("n") - float(len(large) + 1)
    x = with_groups(b, a, by).withColumn("f", ratio((F.col("_small") - F.col("_large")) / d1, F.when(d2 > 0, F.col("_large") / d2)))
    return x.withColumn("d1", F.lit(d1)).withColumn("d2", d2.cast("double")).withColumn("p", f_p("f", "d1", "d2")).drop("_small", "_large")


@any_group_name
def permanova(df: DataFrame, by: Sequence[str], key: str, label: str, xs: Sequence[str], times: int = 199, seed: str = "permanova") -> DataFrame:
    """Pseudo-F of a label over vectors (squared Euclidean distance) with p by labels dealt anew in md5 order.

    Sums of squares within labels come from sums of x and x squared, so no pairs are made. A group of at most GATHERED rows is
    dealt in tasks of some draws each, which give back these sums, so no row is shuffled once a draw; a larger one is put in order by ranges.
    """
    from .ranks import settled, with_groups

    rows = settled(finite_rows(df.where(F.col(label).isNotNull()), *xs).select(*by, key, label, *xs))
    g = rows.groupBy(*by, F.lit(0).alias("perm"), label).agg(*_label_sums(xs))
    size = settled(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_all")))
    small, large = size.where(F.col("_all") <= GATHERED), size.where(F.col("_all") > GATHERED)
    f = _within(g, by, xs)
    if not small.isEmpty():
        f = f.unionByName(_dealt_labels(with_groups(rows, small.select(*by), by) if by else rows, by, key, label, xs, size.count(), times, seed, f.schema))
    if not large.isEmpty():
        f = f.unionByName(_within(_ranged_labels(with_groups(rows, large.select(*by), by) if by else rows, by, key, label, xs, times, seed), by, xs))
    f = settled(f)
    f = f.withColumn("f", ((F.col("_t") - F.col("_w")) / F.nullif(F.col("labels") - 1.0, F.lit(0.0))) / F.nullif(F.col("_w") / F.nullif(F.col("n") - F.col("labels").cast("double"), F.lit(0.0)), F.lit(0.0)))
    seen = f.where("perm = 0").select(*by, "n", "labels", "f")
    # draws are merged with what was seen, and not sent through the driver
    hits = with_groups(f.where("perm > 0").select(*by, F.col("f").alias("_f")).hint("merge"), seen.select(*by, "f"), by).groupBy(*by).agg(F.count_if(F.col("_f") >= F.col("f") - 1e-9).alias("_b"))
    return with_groups(seen, hits, by).withColumn("p", (F.col("_b") + 1.0) / (times + 1.0)).drop("_b")


def _label_sums(xs: Sequence[str]) -> list[Column]:
    return [F.count(F.lit(1)).alias("_n"), *[F.sum(x).alias(f"_s{i}") for i, x in enumerate(xs)], F.sum(sum((F.col(x) * F.col(x) for x in xs), F.lit(0.0))).alias("_q")]


def _within(g: DataFrame, by: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """(by.., perm, n, labels, _w, _t): sums of squares within labels and in all, from each label's sums."""
    within = F.sum(F.col("_q") - sum((F.col(f"_s{i}") ** 2 for i in range(len(xs))), F.lit(0.0)) / F.col("_n"))
    total = F.sum("_q") - sum((F.sum(f"_s{i}") ** 2 for i in range(len(xs))), F.lit(0.0)) / F.sum("_n")
    return g.groupBy(*by, "perm").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("labels"), within.alias("_w"), total.alias("_t"))


def _dealt_labels(rows: DataFrame, by: Sequence[str], key: str, label: str, xs: Sequence[str], groups: int, times: int, seed: str, schema: StructType) -> DataFrame:
    """The rows of `_within` for permutations 1 to times: a task holds one group's rows as arrays and deals a block of permutations."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(times, -(-4 * cores // groups)))
    values = [F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)]
    dealt = rows.select(*by, F.col(key).alias("_key"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_name"), F.col(label).alias("_label"), *values)
    dealt = dealt.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(8 * cores, *by, "_block")

    def sums(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        group = group.take(pc.sort_indices(group["_key"], null_placement="at_start"))
        x = [group[f"_x{i}"].to_numpy() for i in range(len(xs))]
        code = group["_label"].combine_chunks().dictionary_encode().indices.to_numpy()
        count = np.bincount(code).astype(float)
        whole = float(sum((v * v).sum() for v in x))
        order, perms = Md5Order(group["_name"]), np.arange(group["_block"][0].as_py() + 1, times + 1, blocks)
        between = []
        for perm in perms:
            # the row at a place along the keys gets the label at that place along the hashes
            new = code[order.order(f"{seed}|{perm}|".encode())]
            between.append(float(sum((np.bincount(new, v, len(count)) ** 2 / count).sum() for v in x)))
        first = group.slice(0, 1)
        cells = {c: pa.array(first[c].to_pylist() * len(perms), group.schema.field(c).type) for c in by}
        same = {"n": group.num_rows, "labels": len(count), "_t": whole - float(sum(v.sum() ** 2 for v in x)) / group.num_rows}
        cells |= {"perm": pa.array(perms, pa.int32()), "_w": pa.array([whole - b for b in between], pa.float64())} | {c: pa.array([v] * len(perms), pa.float64() if c == "_t" else pa.int64()) for c, v in same.items()}
        return pa.table({f.name: cells[f.name] for f in schema})

    return dealt.groupBy(*by, "_block").applyInArrow(sums, schema)


def _ranged_labels(rows: DataFrame, by: Sequence[str], key: str, label: str, xs: Sequence[str], times: int, seed: str) -> DataFrame:
    """Each label's sums for permutations 1 to times of groups that no task holds: rows meet the labels at their place in a draw."""
    from .nulls import numbered

    at = {c: f"_at_{i}" for i, c in enumerate(by)}
    own = _places(rows.select(*by, F.col(key).alias("_key"), *xs), by, ["_key", F.monotonically_increasing_id()])
    places = own.select(*[F.col(c).alias(n) for c, n in at.items()], F.col("_place").alias("_k"), *xs)
    word = F.md5(F.concat_ws("|", F.lit(seed), F.col("perm").cast("string"), F.coalesce(F.col("_key").cast("string"), F.lit(""))))
    dealt = _places(numbered(rows.select(*by, F.col(key).alias("_key"), label), times), [*by, "perm"], [word, F.col("_key"), F.monotonically_increasing_id()])
    # a place along the keys has the same vector in every draw, so draws meet the rows and not themselves; files are small, draws
    # are not, so the join is merged: a broadcast of draws would go through the driver
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(n)) for c, n in at.items()], F.col("_place") == F.col("_k"))
    return dealt.hint("merge").join(places, same).groupBy(*by, "perm", label).agg(*_label_sums(xs))


@any_group_name
def pseudo_f(df: DataFrame, by: Sequence[str], key: str, member: str, xs: Sequence[str], covariate: str | None = None, times: int = 999, seed: str = "pseudo") -> DataFrame:
    """(by.., n, mode, f, r2, p): pseudo-F of membership over vectors xs, given a covariate, with residuals dealt anew.

    Squared residuals of (1, covariate) against those of (1, covariate, member), summed over xs; for p the residuals of the
    smaller model are permuted by md5 of the key (rows in order of the key take residuals in order of the hash) and both
    models are fitted again. Everything is a sum of products of the residuals with the centred covariate and with
    what membership adds to it. A group of at most GATHERED rows is dealt in tasks of some permutations each, which give back these
    sums, so no row is shuffled once a permutation; larger groups are put in order by ranges. Rows with a null flag, key or value, NaN or infinity are
    left out. A covariate without variance is not used (mode group_only); f, r2 and p are null where membership adds no
    direction or nothing is left over, or where n is at most the number of regressors.
    """
    from .ranks import scaled, settled, with_groups

    names = [f"_y{i}" for i in range(len(xs))]
    given = F.col(covariate).cast("double") if covariate else F.lit(0.0)
    rows = df.select(*by, F.col(key).alias("_key"), F.col(member).cast("double").alias("_g"), given.alias("_m"), *[F.col(x).alias(n) for x, n in zip(xs, names, strict=True)])
    rows = settled(finite_rows(rows, "_g", "_m", *names).where(F.col("_key").isNotNull()))
    means = [F.avg(c) for c in ("_g", "_m", *names)]
    rows = scaled(rows, by, (means, lambda c: {n: F.col(n) - m for n, m in zip(("_g", "_m", *names), c, strict=True)}))
    # the covariate's slopes, then what it leaves of membership and of the values
    slope = [F.try_divide(F.sum(F.col("_m") * F.col(c)), F.sum(F.col("_m") * F.col("_m"))) for c in ("_g", *names)]
    used = F.sum(F.col("_m") * F.col("_m")) > 1e-18 * F.count(F.lit(1))
    rest = lambda c: {n: F.col(n) - F.when(c[0], F.coalesce(b, F.lit(0.0)) * F.col("_m")).otherwise(0.0) for n, b in zip(("_g", *names), c[1:], strict=True)} | {"_used": c[0]}
    rows = settled(scaled(settled(rows), by, ([used, *slope], rest)))
    square = sum((F.col(n) * F.col(n) for n in names), F.lit(0.0))

    def moments(both: DataFrame) -> DataFrame:
        return both.groupBy(*by, "perm", "_used").agg(
            F.count(F.lit(1)).alias("n"), F.sum(square).alias("_q"), F.sum(F.col("_g") * F.col("_g")).alias("_gg"), F.sum(F.col("_m") * F.col("_m")).alias("_mm"),
            *[F.sum(F.col(n) * F.col("_g")).alias(f"_b{i}") for i, n in enumerate(names)], *[F.sum(F.col(n) * F.col("_m")).alias(f"_a{i}") for i, n in enumerate(names)],
        )

    size = settled(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_all")))
    small, large = size.where(F.col("_all") <= GATHERED), size.where(F.col("_all") > GATHERED)
    sums = moments(rows.select(*by, F.lit(0).alias("perm"), "_g", "_m", "_used", *names))
    if not small.isEmpty():
        sums = sums.unionByName(_dealt_moments(with_groups(rows, small.select(*by), by) if by else rows, by, names, size.count(), times, seed, sums.schema))
    if not large.isEmpty():
        wide = settled(with_groups(rows, large.select(*by), by)) if by else rows
        word = F.md5(F.concat_ws("|", F.lit(seed), "perm", F.col("_key").cast("string")))
        perms = wide.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(int(times)))))
        # places along a group: by key for the regressors, by hash for the residuals
        fixed = _places(wide.select(*by, "_key", "_g", "_m", "_used"), by, ["_key"]).drop("_key")
        dealt = _places(perms.select(*by, "perm", "_key", *names), [*by, "perm"], [word, F.col("_key")]).drop("_key")
        sums = sums.unionByName(moments(with_groups(dealt, fixed, [*by, "_place"])))
    along = lambda t: sum((F.col(f"{t}{i}") * F.col(f"{t}{i}") for i in range(len(names))), F.lit(0.0))
    small = F.col("_q") - F.when(F.col("_used"), F.try_divide(along("_a"), F.col("_mm"))).otherwise(0.0)
    effect = F.when(F.col("_gg") > 1e-18 * F.col("n"), along("_b") / F.nullif("_gg", F.lit(0.0)))
    left = F.col("n") - F.when(F.col("_used"), 3.0).otherwise(2.0)
    f = sums.withColumns({"_small": small, "_effect": effect}).withColumn("f", F.when((left > 0) & (F.col("_small") - F.col("_effect") > 0), F.col("_effect") / ((F.col("_small") - F.col("_effect")) / F.nullif(left, F.lit(0.0)))))
    f = settled(f.select(*by, "perm", "n", F.when(F.col("_used"), "group_plus_covariate").otherwise("group_only").alias("mode"), "f", F.try_divide("_effect", "_small").alias("r2")))
    seen = f.where("perm = 0").select(*by, "n", "mode", "f", F.when(F.col("f").isNotNull(), F.col("r2")).alias("r2"))
    hits = with_groups(f.where("perm > 0 and f is not null").select(*by, F.col("f").alias("_f")), seen.select(*by, F.col("f").alias("_o")), by)
    hits = hits.groupBy(*by).agg(F.count_if(F.col("_f") >= F.col("_o") - 1e-9).alias("_b"), F.count(F.lit(1)).alias("_c"))
    return with_groups(seen, hits, by, "left").select(*by, "n", "mode", "f", "r2", F.when(F.col("f").isNotNull(), (F.col("_b") + 1.0) / (F.col("_c") + 1.0)).alias("p"))


def _dealt_moments(rows: DataFrame, by: Sequence[str], names: Sequence[str], groups: int, times: int, seed: str, schema: StructType) -> DataFrame:
    """The sums of pseudo_f for permutations 1 to times: a task holds one group's rows as arrays and deals a block of permutations."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(times, -(-4 * cores // groups)))
    dealt = rows.select(*by, "_key", F.col("_key").cast("string").alias("_name"), "_g", "_m", "_used", *names).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(8 * cores, *by, "_block")

    def sums(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("_key")
        fixed = np.stack([group[c].to_numpy() for c in ("_g", "_m")])
        y = np.stack([group[c].to_numpy() for c in names])
        order, perms = Md5Order(group["_name"]), np.arange(group["_block"][0].as_py() + 1, times + 1, blocks)
        cross = np.stack([fixed @ y[:, order.order(f"{seed}|{perm}|".encode())].T for perm in perms]) if len(perms) else np.zeros((0, 2, len(y)))
        first = group.slice(0, 1)
        same = {"n": group.num_rows, "_q": float((y * y).sum()), "_gg": float(fixed[0] @ fixed[0]), "_mm": float(fixed[1] @ fixed[1])}
        cells = {c: pa.array(first[c].to_pylist() * len(perms), group.schema.field(c).type) for c in (*by, "_used")}
        cells |= {"perm": pa.array(perms, pa.int32())} | {c: pa.array([v] * len(perms)) for c, v in same.items()}
        cells |= {f"_{t}{i}": pa.array(cross[:, k, i]) for k, t in enumerate("ba") for i in range(len(y))}
        return pa.table({f.name: cells[f.name] for f in schema})

    return dealt.groupBy(*by, "_block").applyInArrow(sums, schema)


def _places(df: DataFrame, by: Sequence[str], order) -> DataFrame:
    """df with _place, a row's number within its group; ranges count apart."""
    from .ranks import running_sum

    return running_sum(df, by, order, F.lit(1), "_place")
