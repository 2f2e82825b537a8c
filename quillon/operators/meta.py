"""Meta-analysis over effect rows, direction consistency and enrichment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.distributions import binomial_p, fisher_p, normal_p
from quillon.functions.scalars import fisher_z, ratio

from .ranks import over, with_groups
from .statistics import finite_rows, one_sample_t, sign_test, signed_rank_test


def stouffer(df: DataFrame, by: Sequence[str], z: str) -> DataFrame:
    return df.where(F.col(z).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("k"), (F.sum(z) / F.sqrt(F.count(F.lit(1)))).alias("z"))


def inverse_variance(df: DataFrame, by: Sequence[str], effect: str, se: str) -> DataFrame:
    """Fixed effect, its standard error, Q, tau^2 (DerSimonian-Laird), I^2 and the random effect."""
    rows = finite_rows(df, effect, se).where(F.col(se) > 0).withColumn("_w", 1.0 / (F.col(se) * F.col(se))).withColumn("_y", F.col(effect))
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum("_w").alias("sw"), F.sum(F.col("_w") * F.col("_w")).alias("sw2"), F.sum(F.col("_w") * F.col("_y")).alias("swy"))
    g = g.withColumn("fixed", F.col("swy") / F.col("sw"))
    q = with_groups(rows, g.select(*by, "fixed"), by).groupBy(*by).agg(F.sum(F.col("_w") * (F.col("_y") - F.col("fixed")) * (F.col("_y") - F.col("fixed"))).alias("q"))
    g = with_groups(g, q, by)
    tau2 = F.greatest(F.lit(0.0), F.coalesce(ratio(F.col("q") - (F.col("k") - 1), F.col("sw") - F.col("sw2") / F.col("sw")), F.lit(0.0)))
    g = g.withColumn("tau2", tau2).withColumn("i2", F.greatest(F.lit(0.0), F.coalesce(ratio(F.col("q") - (F.col("k") - 1), "q"), F.lit(0.0))))
    r = with_groups(rows, g.select(*by, "tau2"), by).withColumn("_v", 1.0 / (F.col(se) * F.col(se) + F.col("tau2"))).groupBy(*by).agg((F.sum(F.col("_v") * F.col("_y")) / F.sum("_v")).alias("random"), F.sqrt(1.0 / F.sum("_v")).alias("random_se"))
    return with_groups(g, r, by).select(*by, "k", "fixed", F.sqrt(1.0 / F.col("sw")).alias("fixed_se"), "q", "tau2", "i2", "random", "random_se")


def reml(df: DataFrame, by: Sequence[str], effect: str, se: str, steps: int = 100) -> DataFrame:
    """Random-effects mean with tau^2 by restricted maximum likelihood (Fisher scoring), per group of studies."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y, v = pdf[effect].to_numpy(float), pdf[se].to_numpy(float) ** 2
        ok = np.isfinite(y) & np.isfinite(v) & (v > 0)
        y, v, tau2 = y[ok], v[ok], 0.0
        for _ in range(steps if len(y) > 1 else 0):
            w = 1 / (v + tau2)
            m = (w * y).sum() / w.sum()
            trace = (w * w).sum() - 2 * (w**3).sum() / w.sum() + ((w * w).sum() / w.sum()) ** 2
            score = (w * w * (y - m) ** 2).sum() - w.sum() + (w * w).sum() / w.sum()
            new = max(0.0, tau2 + score / trace)
            if abs(new - tau2) < 1e-12:
                break
            tau2 = new
        w = 1 / (v + tau2)
        m = (w * y).sum() / w.sum() if len(y) else None
        return pd.DataFrame([[*pdf[list(by)].iloc[0], len(y), m, (1 / w.sum()) ** 0.5 if len(y) else None, tau2]], columns=[*by, "k", "estimate", "se", "tau2"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "k long, estimate double, se double, tau2 double"])
    return df.select(*by, effect, se).groupBy(*by).applyInPandas(one, schema)


def pooled_correlation(df: DataFrame, by: Sequence[str], r: str, n: str) -> DataFrame:
    """Fisher-z pooled correlation: weighted by n - 3, and the plain mean; both back-transformed."""
    rows = df.where(F.col(r).isNotNull() & (F.col(n) > 3)).withColumn("z", fisher_z(r)).withColumn("w", F.col(n) - 3.0)
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), (F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("zw"), F.avg("z").alias("zm"), F.sqrt(1.0 / F.sum("w")).alias("se"))
    return g.select(*by, "k", F.tanh("zw").alias("r_weighted"), F.tanh("zm").alias("r_mean"), ratio("zw", "se").alias("z"))


def consistency(df: DataFrame, by: Sequence[str], effect: str) -> DataFrame:
    """Summary of effects with the three ways to say how far they agree in sign."""
    rows = finite_rows(df, effect)
    g = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.avg(effect).alias("mean"), F.percentile(effect, F.lit(0.5)).alias("median"), F.stddev_samp(effect).alias("sd"), F.min(effect).alias("min"), F.max(effect).alias("max"),
        ratio(F.count_if(F.col(effect) > 0), F.count(F.lit(1))).alias("positive"),
    )
    with_g = with_groups(rows, g.select(*by, F.col("median").alias("_md"), F.col("mean").alias("_mn")), by)
    s = with_g.groupBy(*by).agg(F.avg((F.signum(effect) == F.signum("_md")).cast("double")).alias("same_as_median"), F.avg((F.signum(effect) == F.signum("_mn")).cast("double")).alias("same_as_mean"))
    return with_groups(g.withColumn("majority", F.greatest(F.col("positive"), 1.0 - F.col("positive"))), s, by)


def leave_one_out(df: DataFrame, by: Sequence[str], group: str, effect: str) -> DataFrame:
    """The mean effect without each group: from totals, in one pass."""
    g = df.where(F.col(effect).isNotNull()).groupBy(*by, group).agg(F.sum(effect).alias("s"), F.count(F.lit(1)).alias("n"))
    w = over(by)
    return g.select(*by, F.col(group).alias("left_out"), ratio(F.sum("s").over(w) - F.col("s"), F.sum("n").over(w) - F.col("n")).alias("mean_without"))


def pooled_reml(df: DataFrame, by: Sequence[str], effect: str, n: Column) -> DataFrame:
    """REML on Fisher's z with variance 1 / (n - 3): estimate, interval, z and p, back-transformed.

    effect lies in [-1, 1] (a correlation, or a rank-biserial effect with n = n1 + n2).
    """
    rows = finite_rows(df.withColumn("_n", n.cast("double")), effect, "_n").where("_n > 3")
    rows = rows.withColumn("_z", fisher_z(effect)).withColumn("_se", 1.0 / F.sqrt(F.col("_n") - 3.0))
    g = reml(rows, by, "_z", "_se").withColumn("z", ratio("estimate", "se"))
    half = F.lit(1.959963984540054) * F.col("se")
    return g.withColumn("p", normal_p("z")).select(*by, "k", F.tanh("estimate").alias("estimate"), F.tanh(F.col("estimate") - half).alias("ci_low"), F.tanh(F.col("estimate") + half).alias("ci_high"), "tau2", "z", "p")


def fisher_z_summary(df: DataFrame, by: Sequence[str], r: str) -> DataFrame:
    """Mean and median of Fisher's z over samples, back-transformed, with one-sample t, sign and signed-rank tests."""
    rows = finite_rows(df, r).withColumn("_z", fisher_z(r))
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.tanh(F.avg("_z")).alias("mean_r"), F.tanh(F.percentile("_z", F.lit(0.5))).alias("median_r"), F.count_if(F.col("_z") > 0).alias("positive"))
    g = with_groups(g, one_sample_t(rows, by, "_z").select(*by, "t", F.col("p").alias("p_t")), by)
    g = with_groups(g, sign_test(rows, by, "_z").select(*by, F.col("p").alias("p_sign")), by)
    return with_groups(g, signed_rank_test(rows, by, "_z").select(*by, F.col("p").alias("p_rank")), by, "left")


def weighted_effects(df: DataFrame, by: Sequence[str], effect: str, weight: str) -> DataFrame:
    """Weighted mean, its z (mean * sqrt of the weights' sum), p, and the sign test of the effects."""
    rows = finite_rows(df, effect, weight).where(F.col(weight) > 0)
    g = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), (F.sum(F.col(effect) * F.col(weight)) / F.sum(weight)).alias("mean"), F.sum(weight).alias("weight"),
        F.count_if(F.col(effect) > 0).alias("positive"), F.count_if(F.col(effect) != 0).alias("_n"),
    )
    g = g.withColumn("z", F.col("mean") * F.sqrt("weight"))
    return g.withColumn("p", normal_p("z")).withColumn("p_sign", binomial_p(F.col("positive").cast("double"), F.col("_n").cast("double"), F.lit(0.5))).drop("_n")


def over_representation(lists: DataFrame, terms: DataFrame, universe: DataFrame, by: Sequence[str], item: str, term: str, keep_zero: bool = False) -> DataFrame:
    """Hypergeometric over-representation of terms in item lists against a universe.

    overlap, list size, term size, universe size, fold enrichment, odds ratio and P(X >= overlap), which is
    Fisher's one-sided p. Lists and terms are cut to the universe. Terms without overlap are left out unless keep_zero.
    """
    u = universe.select(item).distinct()
    lst = lists.select(*by, item).distinct().join(u, item, "left_semi")
    trm = terms.select(term, item).distinct().join(u, item, "left_semi")
    n_list, n_term = lst.groupBy(*by).agg(F.count(F.lit(1)).alias("list_size")), trm.groupBy(term).agg(F.count(F.lit(1)).alias("term_size"))
    hits = lst.join(trm, item).groupBy(*by, term).agg(F.count(F.lit(1)).alias("overlap"))
    if keep_zero:
        hits = n_list.select(*by).crossJoin(n_term.select(term)).join(hits, [*by, term], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    out = hits.join(n_list, list(by)).join(n_term, term).crossJoin(u.agg(F.count(F.lit(1)).alias("universe")))
    fold = ratio(F.col("overlap").cast("double") * F.col("universe"), F.col("list_size") * F.col("term_size"))
    a, m, n, t = (F.col(c) for c in ("overlap", "list_size", "term_size", "universe"))
    tests = fisher_p(a, m - a, n - a, t - m - n + a)
    odds = ratio(a * (t - m - n + a), (m - a) * (n - a))
    return out.withColumn("_p", tests).select(*by, term, "overlap", "list_size", "term_size", "universe", fold.alias("fold"), odds.alias("odds_ratio"), F.col("_p.p_greater").alias("p"))


def sided_enrichment(rows: DataFrame, terms: DataFrame, universe: DataFrame, side: str, item: str, term: str, least: int = 10, most: int = 500, least_list: int = 3) -> DataFrame:
    """Over-representation for each side (UP, DOWN) of terms whose size in the universe lies in [least, most]; sides with fewer than least_list items are left out.

    With Benjamini-Hochberg values within a side.
    """
    from .statistics import adjust

    u = universe.select(item).distinct()
    known = terms.select(term, item).distinct().join(u, item, "left_semi")
    sized = known.groupBy(term).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(least, most)).select(term)
    lists = rows.select(side, item).distinct().join(u, item, "left_semi")
    full = lists.groupBy(side).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_list).select(side)
    found = over_representation(lists.join(full, side, "left_semi"), known.join(sized, term, "left_semi"), u, [side], item, term)
    return adjust(found, [side], "p", term).drop("holm", "bonferroni")
