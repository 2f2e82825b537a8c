"""Gene-set scores, projections of signatures, and filters of differential rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import finite, ratio

from .ranks import centred_of, over, rank_average, scaled, settled, top_n, with_groups, z_score
from .statistics import finite_rows, rank_sum


def projected(spectra: DataFrame, signature: DataFrame, program: str, gene: str, x: str, weight: str) -> DataFrame:
    """Dot products of each program's spectrum with a weighted signature: raw, over the weights' absolute sum, positive and negative part, genes met."""
    rows = spectra.select(program, gene, F.col(x).cast("double").alias("_x")).join(signature.select(gene, F.col(weight).cast("double").alias("_w")), gene)
    d = F.col("_x") * F.col("_w")
    part = lambda test: F.sum(F.when(test, d).otherwise(0.0))
    return rows.groupBy(program).agg(F.count(F.lit(1)).alias("genes"), F.sum(d).alias("raw"), ratio(F.sum(d), F.sum(F.abs("_w"))).alias("normalised"), part(F.col("_w") > 0).alias("positive"), part(F.col("_w") < 0).alias("negative"))


def mean_z_scores(expr: DataFrame, sets: DataFrame, by: Sequence[str], spot: str, gene: str, x: str, name: str, least: int = 3) -> DataFrame:
    """Per spot and set the mean over genes of the z-score within the sample (sd 0 counts as 1); sets with fewer than `least` genes found are left out."""
    z = z_score(expr, [*by, gene], x, "_z", constant=0.0)
    found = sets.join(expr.select(gene).distinct(), gene, "left_semi")
    wide = found.groupBy(name).agg(F.countDistinct(gene).alias("_n")).where(F.col("_n") >= least).select(name)
    rows = z.join(found.join(wide, name, "left_semi").select(name, gene).distinct(), gene)
    return rows.groupBy(*by, spot, name).agg(F.count(F.lit(1)).alias("genes"), F.avg("_z").alias("score"))


def mean_scores(expr: DataFrame, sets: DataFrame, by: Sequence[str], spot: str, gene: str, x: str, name: str) -> DataFrame:
    """Per spot and set the plain mean of the genes' values."""
    rows = expr.join(sets.select(name, gene).distinct(), gene)
    return rows.groupBy(*by, spot, name).agg(F.count(F.lit(1)).alias("genes"), F.avg(x).alias("score"))


def background_scores(expr: DataFrame, sets: DataFrame, by: Sequence[str], spot: str, gene: str, x: str, name: str, bins: int = 25, controls: int = 50, seed: str = "ctrl") -> DataFrame:
    """Mean of a set's genes less the mean of control genes of the same expression bins.

    Genes fall into `bins` by the rank of their mean; each bin that a set meets gives its `controls` genes
    that come first by md5 and are not in the set, so any engine picks the same.
    """
    means = expr.groupBy(gene).agg(F.avg(x).alias("_m"))
    ranked = means.withColumn("_r", F.row_number().over(over([], F.round("_m", 9), F.col(gene)))).crossJoin(means.agg(F.count(F.lit(1)).alias("_n")))
    binned = ranked.select(gene, F.floor((F.col("_r") - 1) * bins / F.col("_n")).alias("_bin"))
    own = sets.select(name, gene).distinct().join(binned, gene)
    pool = own.select(name, "_bin").distinct().join(binned, "_bin").join(own.select(name, gene), [name, gene], "left_anti")
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(name).cast("string"), F.col(gene).cast("string")))
    picked = top_n(pool.withColumn("_o", order), [name, "_bin"], [F.col("_o"), F.col(gene)], controls, "_i").select(name, gene)
    a = mean_scores(expr, own, by, spot, gene, x, name)
    b = mean_scores(expr, picked, by, spot, gene, x, name).select(*by, spot, name, F.col("score").alias("_control"))
    return a.join(b, [*by, spot, name], "left").select(*by, spot, name, "genes", (F.col("score") - F.coalesce("_control", F.lit(0.0))).alias("score"))


def differential(df: DataFrame, p: str, effect: str, q: float = 0.05, least: float = 1.0) -> DataFrame:
    """Rows with adjusted p below q and |effect| above `least`, as UP or DOWN."""
    return df.where((F.col(p) < q) & (F.abs(effect) > least)).withColumn("side", F.when(F.col(effect) > 0, "UP").otherwise("DOWN"))


def markers(expr: DataFrame, gene: str, x: str, group: str, n: int = 50) -> DataFrame:
    """Per group the n genes that rank highest in it against all other rows (rank-sum z), with their rank.

    expr holds a row, with its group, for every spot and gene that are compared; null groups and non-finite values are
    left out. A gene's rows are ranked once: ranks and ties are the same whichever group is held against the
    rest, so a group's rank sum and size are one aggregate.
    """
    rows = finite_rows(expr.where(F.col(group).isNotNull() & F.col(gene).isNotNull()), x).select(F.col(gene).alias("_gene"), F.col(group).alias("_group"), F.col(x).alias("_x"))
    ranked = settled(rank_average(rows, ["_gene"], "_x", "_r"))
    ties = ranked.groupBy("_gene", "_x").agg(F.count(F.lit(1)).cast("double").alias("t")).groupBy("_gene").agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"), F.sum("t").alias("n"))
    own = ranked.groupBy("_gene", "_group").agg(F.count(F.lit(1)).alias("n1"), F.sum("_r").alias("r1")).join(ties, "_gene")
    _, z = rank_sum(F.col("r1"), F.col("n1"), F.col("n") - F.col("n1"), F.col("ties"))
    scored = own.select("_group", "_gene", z.alias("z")).where("z is not null").withColumn("_k", F.round("z", 9))
    return top_n(scored, ["_group"], [F.desc("_k"), F.col("_gene")], n).select(F.col("_group").alias(group), F.col("_gene").alias(gene), "z", "rank")


def smoothed_scores(expr: DataFrame, weights: DataFrame, edges: DataFrame, by: Sequence[str], spot: str, gene: str, x: str, weight: str, covariates: Sequence[str] = (), of_spots: DataFrame | None = None) -> DataFrame:
    """(by.., spot, genes, raw, smoothed, score): weighted mean of genes, mean with the neighbours, less what covariates explain.

    A surrogate of a published score whose smoothing and correction are not given in closed form: raw is sum(weight * x) /
    sum(|weight|) over the signature's genes that the spot measures, smoothed the mean of raw over the spot and its
    neighbours (edges src -> dst) that have one, and score the residual of smoothed on the covariates of of_spots
    (by.., spot, covariates..) within the group, or smoothed less its mean without any. Null and non-finite values and weights are
    left out; a spot without a covariate has no score.
    """
    from .regression import residuals

    w = weights.select(F.col(gene).alias("_gene"), finite(weight).alias("_w")).where("_w <> 0")
    rows = expr.select(*by, F.col(spot).alias("_spot"), F.col(gene).alias("_gene"), finite(x).alias("_x")).where("_x is not null").join(w, "_gene")
    raw = settled(rows.groupBy(*by, "_spot").agg(F.count(F.lit(1)).alias("genes"), ratio(F.sum(F.col("_w") * F.col("_x")), F.sum(F.abs("_w"))).alias("raw")))
    near = edges.select(*by, F.col("src").alias("_spot"), F.col("dst").alias("_from")).unionByName(raw.select(*by, "_spot", F.col("_spot").alias("_from"))).join(raw.select(*by, F.col("_spot").alias("_from"), F.col("raw").alias("_r")), [*by, "_from"])
    smooth = raw.join(near.groupBy(*by, "_spot").agg(F.avg("_r").alias("smoothed")), [*by, "_spot"])
    if covariates:
        smooth = smooth.join(of_spots.select(*by, F.col(spot).alias("_spot"), *[finite(c).alias(c) for c in covariates]), [*by, "_spot"], "left")
        out = residuals(settled(smooth), by, list(covariates), "smoothed", "score")
    else:
        out = scaled(smooth, by, centred_of("smoothed", "score"))
    return out.select(*by, F.col("_spot").alias(spot), "genes", "raw", "smoothed", "score")


def signature_variants(weights: DataFrame, gene: str, weight: str, n: int = 50) -> DataFrame:
    """(variant, gene, weight): all, positive, negative, strongest n, and signs alone; NaN and infinite weights are left out."""
    w = weights.select(gene, finite(weight).alias("weight")).where("weight is not null")
    # the strongest n alone: a limit by order, which keeps n rows of each task
    strongest = w.orderBy(F.abs("weight").desc(), F.col(gene)).limit(n)
    one = lambda name, df, value=F.col("weight"): df.select(F.lit(name).alias("variant"), gene, value.alias("weight"))
    return one("all", w).union(one("positive", w.where("weight > 0"))).union(one("negative", w.where("weight < 0"))).union(one("strongest", strongest)).union(one("signs", w.where("weight <> 0"), F.signum("weight")))


def variant_summary(variants: DataFrame) -> DataFrame:
    return variants.groupBy("variant").agg(F.count(F.lit(1)).alias("genes"), F.count_if(F.col("weight") > 0).alias("positive"), F.sum(F.abs("weight")).alias("mass"))


def coefficient_shares(df: DataFrame, by: Sequence[str], name: str, x: str) -> DataFrame:
    """|coefficient| over its model's sum, its rank (a tie: the first by name) and sign."""
    rows = df.where(F.col(x).isNotNull()).withColumn("_a", F.abs(x))
    rows = with_groups(rows, rows.groupBy(*by).agg(F.sum("_a").alias("_t")), by).withColumn("share", ratio("_a", "_t"))
    return rows.withColumn("rank", F.row_number().over(over(by, F.desc("_a"), F.col(name)))).withColumn("sign", F.signum(x).cast("int")).drop("_a", "_t")


def variable_genes(expr: DataFrame, gene: str, x: str, n: int) -> DataFrame:
    """The n genes of the largest dispersion (variance over mean) of values."""
    d = expr.groupBy(gene).agg(F.avg(x).alias("mean"), F.var_samp(x).alias("variance")).withColumn("dispersion", ratio("variance", "mean"))
    return top_n(d.where("dispersion is not null").withColumn("_k", F.round("dispersion", 9)), [], [F.desc("_k"), F.col(gene)], n).drop("_k")


def consensus_items(items: DataFrame, group: str, owner: str, sample: Column, item: str, x: str, n: int = 50) -> DataFrame:
    """A group's items by five keys: owners, samples, mean value, largest value, name; the first n."""
    g = items.withColumn("_s", sample).groupBy(group, item).agg(F.countDistinct(owner).alias("owners"), F.countDistinct("_s").alias("samples"), F.avg(x).alias("mean"), F.max(x).alias("largest"))
    return top_n(g.withColumn("_k", F.round("mean", 9)), [group], [F.desc("owners"), F.desc("samples"), F.desc("_k"), F.desc("largest"), F.col(item)], n).drop("_k")
