"""Grouped statistics, correlations, effect sizes, tests and multiple-testing correction."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.distributions import binomial_p, chi_square_p, fisher_p, normal_p, signed_rank_p, student_p
from quillon.functions.scalars import finite, fisher_z, ratio

from .ranks import Ranges, any_group_name, fresh, over, rank_average, running_sum, settled, unwrap, with_groups, wrap, wrapped


def finite_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which every one of the columns is a finite number, as doubles: NaN and infinities count as missing."""
    rows = df.withColumns({c: finite(c) for c in columns})
    return rows.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]))


def finite_columns(df: DataFrame, *columns: str) -> DataFrame:
    """All rows, NaN and infinities of the columns as NULL."""
    return df.withColumns({c: finite(c) for c in columns})


def describe(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """n, mean, sample sd, quartiles, interquartile range, ends and the 95 % interval of the mean."""
    v = finite(x)
    g = wrap(df, by, v.alias("v")).groupBy(*wrapped(by).values()).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max("v").alias("max"))
    half = F.lit(1.96) * F.col("sd") / F.sqrt(F.col("n"))
    q = lambda i: F.get("q", F.lit(i))
    return g.select(
        *unwrap(by), "n", "mean", "sd", "min", q(0).alias("q1"), q(1).alias("median"), q(2).alias("q3"), "max",
        (q(2) - q(0)).alias("iqr"), (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"),
    )


@any_group_name
def moments(df: DataFrame, by: Sequence[str], x: str, least: int = 4, bimodal: float = 0.555) -> DataFrame:
    """Population skewness, excess kurtosis, bias-adjusted skewness, coefficient of variation and bimodality."""
    m = finite_columns(df, x).groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    ok = (F.col("n") >= least) & (F.col("sd") > 0)
    n = F.col("n").cast("double")
    bc = (F.col("g1") * F.col("g1") + 1.0) / F.nullif(F.col("g2") + 3.0, F.lit(0.0))
    return m.select(
        *by, "n", F.when(ok, F.col("g1")).alias("skewness"), F.when(ok, F.col("g2")).alias("kurtosis"),
        F.when(ok, F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * F.col("g1")).alias("skewness_adjusted"),
        ratio("sd", "mean").alias("cv"), F.when(ok, bc).alias("bimodality"), F.coalesce(F.when(ok, bc > bimodal), F.lit(False)).alias("is_bimodal"),
    )


@any_group_name
def label_entropy(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Shannon entropy (natural log) of label shares, the number of labels and the most frequent one (a tie: the smallest).

    Rows without a label count for nothing.
    """
    n = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    p = n.withColumn("p", ratio("n", F.sum("n").over(over(by))))
    return p.groupBy(*by).agg((-F.sum(F.col("p") * F.ln("p"))).alias("entropy"), F.count(F.lit(1)).alias("labels"), F.min(F.struct((-F.col("n")).alias("k"), F.col(label).alias("l"))).getField("l").alias("mode"))


@any_group_name
def between_within(df: DataFrame, by: Sequence[str], group: str, x: str) -> DataFrame:
    """Variance of group means over the mean of group variances, both population."""
    g = finite_columns(df, x).groupBy(*by, group).agg(F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    return g.groupBy(*by).agg(F.var_pop("m").alias("between"), F.avg("v").alias("within")).withColumn("ratio", ratio("between", "within"))


@any_group_name
def contingency(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Counts of pairs of labels with row share, column share and the Jaccard index of the two labels' rows; rows that lack a label count for nothing."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("na", F.sum("n").over(over([*by, a]))).withColumn("nb", F.sum("n").over(over([*by, b])))
    return n.select(*by, a, b, "n", ratio("n", "na").alias("row_share"), ratio("n", "nb").alias("column_share"), ratio("n", F.col("na") + F.col("nb") - F.col("n")).alias("jaccard"))


@any_group_name
def chi_square(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Statistic and degrees of freedom of a contingency table, without continuity correction; rows that lack a label count for nothing."""
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("na", F.sum("n").over(over([*by, a]))).withColumn("nb", F.sum("n").over(over([*by, b])))
    out = n.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(ratio(F.col("n").cast("double") * F.col("n"), F.col("na") * F.col("nb"))).alias("s"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"))
    return out.select(*by, (F.col("total") * (F.col("s") - 1.0)).alias("chi2"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("dof"))


def _pearson(x: Column, y: Column) -> Column:
    """Correlation from centred sums; NULL for fewer than three pairs or a constant side."""
    n, both = F.count_if(x.isNotNull() & y.isNotNull()).cast("double"), F.covar_pop(x, y)
    return F.when((n >= 3) & (F.var_pop(x) > 1e-24) & (F.var_pop(y) > 1e-24), both / F.sqrt(F.nullif(F.var_pop(x) * F.var_pop(y), F.lit(0.0))))


@any_group_name
def pearson(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return finite_rows(df, x, y).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), _pearson(F.col(x), F.col(y)).alias("r"))


def correlation_p(r: str, n: str, covariates: int = 0) -> Column:
    """Two-sided p of a (partial) correlation from Student's t with n - 2 - covariates degrees of freedom."""
    df = F.col(n).cast("double") - 2.0 - covariates
    low = 1.0 - F.col(r) * F.col(r)
    t = F.when(low > 1e-15, F.col(r) * F.sqrt(df / F.nullif(low, F.lit(0.0)))).otherwise(F.signum(r) * 1e9)
    return student_p(F.when(df > 0, t), df)


def _ranked(rows: DataFrame, by: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """(by.., ranks, _w): average ranks of the columns, less the group's mean rank; equal rows are one row of weight _w.

    Rows are counted before anything is shuffled, and a rank comes from running counts over a column's values
    (see ranks.running_sum), so what moves is no more than the different rows.
    """
    counted = settled(rows.groupBy(*by, *columns).agg(F.count(F.lit(1)).alias("_w")))
    middle = counted.groupBy(*by).agg(((F.sum("_w") + 1) / F.lit(2.0)).alias("_mid"))
    out = with_groups(counted, middle, by)
    for c, rank in columns.items():
        values = running_sum(counted.groupBy(*by, c).agg(F.sum("_w").alias("_t")), by, [c], F.col("_t"), "_before")
        out = with_groups(out, values.select(*by, c, (F.col("_before") + (F.col("_t") + 1) / F.lit(2.0)).alias(rank)), [*by, c])
    return out.select(*by, *[(F.col(r) - F.col("_mid")).alias(r) for r in columns.values()], "_w")


def _weighted(x: str, y: str) -> Column:
    """Correlation of centred columns with weights _w; NULL for fewer than three rows or a constant side."""
    s = lambda a, b: F.sum(F.col(a) * F.col(b) * F.col("_w"))
    n = F.sum("_w").cast("double")
    return F.when((n >= 3) & (s(x, x) / n > 1e-24) & (s(y, y) / n > 1e-24), s(x, y) / F.sqrt(F.nullif(s(x, x), F.lit(0.0))) / F.sqrt(F.nullif(s(y, y), F.lit(0.0))))


@any_group_name
def spearman(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson's r of average ranks over rows with both values."""
    if x == y:
        df, y = df.withColumn("_same", F.col(x)), "_same"
    rows = _ranked(finite_rows(df, x, y), by, {x: "_rx", y: "_ry"})
    return rows.groupBy(*by).agg(F.sum("_w").alias("n"), _weighted("_rx", "_ry").alias("rho"))


@any_group_name
def partial_spearman(df: DataFrame, by: Sequence[str], x: str, y: str, given: str) -> DataFrame:
    """Correlation of ranks with one covariate's rank taken out, from the three rank correlations."""
    rows = _ranked(finite_rows(df, x, y, given), by, {x: "_rx", y: "_ry", given: "_rz"})
    r = rows.groupBy(*by).agg(F.sum("_w").alias("n"), _weighted("_rx", "_ry").alias("a"), _weighted("_rx", "_rz").alias("b"), _weighted("_ry", "_rz").alias("c"))
    low = (1.0 - F.col("b") * F.col("b")) * (1.0 - F.col("c") * F.col("c"))
    return r.select(*by, "n", F.when(low > 1e-12, (F.col("a") - F.col("b") * F.col("c")) / F.sqrt(low)).alias("rho"))


@any_group_name
def correlation_pairs(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Pearson's r of every pair of columns, long."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = finite_columns(df, *columns).groupBy(*by).agg(*[_pearson(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.select(*by, F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])).alias("p"))
    return long.select(*by, "p.a", "p.b", "p.r")


def two_groups(df: DataFrame, by: Sequence[str], is_first: Column, x: str) -> DataFrame:
    """Means, Cohen's d (pooled by degrees of freedom), d of plain mean variance, and t of two groups of rows."""
    a, b = F.when(is_first, finite(x)), F.when(~is_first, finite(x))
    g = df.groupBy(*by).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    gap = F.col("m1") - F.col("m2")
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / F.nullif((F.col("n1") + F.col("n2") - 2).cast("double"), F.lit(0.0))
    return g.select(
        *by, "n1", "n2", "m1", "m2", ratio(gap, F.sqrt(pooled)).alias("cohens_d"), ratio(gap, F.sqrt((F.col("v1") + F.col("v2")) / 2.0)).alias("smd"),
        ratio(gap, F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))).alias("welch_t"),
    )


def rank_sum(r1: Column, n1: Column, n2: Column, ties: Column) -> tuple[Column, Column]:
    """(U of the first group, its tie-corrected normal z with continuity 0.5) from its rank sum; ties is the sum of t^3 - t over ties."""
    n1, n2 = n1.cast("double"), n2.cast("double")
    u, n = r1 - n1 * (n1 + 1) / 2.0, n1 + n2
    var = n1 * n2 / 12.0 * (n + 1 - ties / F.nullif(n * (n - 1), F.lit(0.0)))
    gap = u - n1 * n2 / 2.0
    return u, F.signum(gap) * F.greatest(F.abs(gap) - 0.5, F.lit(0.0)) / F.sqrt(F.when(var > 0, var))


def mann_whitney(df: DataFrame, by: Sequence[str], is_first: Column, x: str) -> DataFrame:
    """U of the first group, rank-biserial correlation and the tie-corrected normal z (continuity 0.5).

    Rows with a null flag or value belong to neither group and are not ranked.
    """
    rows = finite_rows(df.withColumn("_f", is_first).where("_f is not null"), x)
    rows = rank_average(rows, by, x, "_r")
    ties = rows.groupBy(*by, x).agg(F.count(F.lit(1)).alias("t")).groupBy(*by).agg(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    g = rows.groupBy(*by).agg(F.count_if("_f").alias("n1"), F.count_if(~F.col("_f")).alias("n2"), F.sum(F.when(F.col("_f"), F.col("_r")).otherwise(0.0)).alias("r1"))
    g = with_groups(g, ties, by)
    u, z = rank_sum(F.col("r1"), F.col("n1"), F.col("n2"), F.col("ties"))
    return g.select(*by, "n1", "n2", u.alias("u"), z.alias("z"), (ratio(2.0 * u, F.col("n1").cast("double") * F.col("n2")) - 1.0).alias("rank_biserial"))


def signed_rank(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Wilcoxon's signed-rank sums over non-zero values, with the tie-corrected normal z."""
    rows = finite_rows(df, x).where(F.col(x) != 0).withColumn("_a", F.abs(x))
    rows = rank_average(rows, by, "_a", "_r")
    ties = rows.groupBy(*by, "_a").agg(F.count(F.lit(1)).alias("t")).groupBy(*by).agg(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(x) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col(x) < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    return with_groups(g, ties, by).select(*by, "n", "w_plus", "w_minus", ((F.col("w_plus") - n * (n + 1) / 4.0) / F.sqrt(F.when(var > 0, var))).alias("z"), (F.col("ties") > 0).alias("has_ties"))


def signed_rank_test(df: DataFrame, by: Sequence[str], x: str, exact_up_to: int = 50) -> DataFrame:
    """signed_rank with p: exact for up to exact_up_to values without ties, else of the normal z."""
    g = signed_rank(df, by, x)
    exact = ~F.col("has_ties") & (F.col("n") <= exact_up_to)
    g = g.withColumn("_e", signed_rank_p(F.when(exact, F.col("w_plus")), F.col("n").cast("double"))).withColumn("_a", normal_p("z"))
    return g.select(*by, "n", "w_plus", "w_minus", "z", F.coalesce("_e", "_a").alias("p"), F.when(exact, "exact").otherwise("normal").alias("method"))


def one_sample_t(df: DataFrame, by: Sequence[str], x: str, mu: float = 0.0) -> DataFrame:
    g = finite_columns(df, x).groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("sd"))
    g = g.select(*by, "n", ratio((F.col("m") - mu) * F.sqrt("n"), "sd").alias("t"), ratio(F.col("m") - mu, "sd").alias("d_z"))
    return g.withColumn("p", student_p("t", F.col("n") - 1.0))


def chi_square_test(df: DataFrame, by: Sequence[str], a: str, b: str, yates: bool = True) -> DataFrame:
    """chi_square with p; a 2 x 2 table takes Yates' correction if asked. Cells that never occur count as zero."""
    n = df.groupBy(*by, a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = n.groupBy(*by, a).agg(F.sum("n").alias("na"))
    columns = n.groupBy(*by, b).agg(F.sum("n").alias("nb"))
    grid = with_groups(rows, columns.withColumnRenamed(b, "_b"), by).withColumnRenamed("_b", b)
    cells = with_groups(grid, n, [*by, a, b], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    cells = with_groups(cells, rows.groupBy(*by).agg(F.sum("na").alias("total"), F.count(F.lit(1)).alias("ka")), by)
    cells = with_groups(cells, columns.groupBy(*by).agg(F.count(F.lit(1)).alias("kb")), by)
    expected = F.col("na") * F.col("nb") / F.col("total")
    gap = F.abs(F.col("n") - expected)
    small = F.when((F.col("ka") == 2) & (F.col("kb") == 2) & F.lit(yates), F.least(F.lit(0.5), gap)).otherwise(0.0)
    g = cells.groupBy(*by).agg(F.sum((gap - small) * (gap - small) / expected).alias("chi2"), ((F.max("ka") - 1) * (F.max("kb") - 1)).alias("dof"))
    return g.withColumn("p", chi_square_p("chi2", F.col("dof").cast("double")))


def fisher_test(df: DataFrame, by: Sequence[str], first: Column, second: Column) -> DataFrame:
    """Fisher's exact test of two flags of the rows: the 2 x 2 counts, odds ratio (NULL with a zero below), both p-values."""
    rows = df.withColumn("_x", first).withColumn("_y", second).where("_x is not null and _y is not null")
    n = lambda c, name: F.count_if(c).alias(name)
    x, y = F.col("_x"), F.col("_y")
    g = rows.groupBy(*by).agg(n(x & y, "a"), n(x & ~y, "b"), n(~x & y, "c"), n(~x & ~y, "d"))
    g = g.withColumn("odds_ratio", ratio(F.col("a") * F.col("d"), F.col("b") * F.col("c"))).withColumn("_p", fisher_p("a", "b", "c", "d"))
    return g.select(*by, "a", "b", "c", "d", "odds_ratio", "_p.p_greater", "_p.p_two_sided")


def sign_test(df: DataFrame, by: Sequence[str], x: str, p0: float = 0.5) -> DataFrame:
    """Exact binomial test of how many non-zero values are positive."""
    g = finite_rows(df, x).groupBy(*by).agg(F.count_if(F.col(x) > 0).alias("k"), F.count_if(F.col(x) != 0).alias("n"))
    return g.withColumn("p", binomial_p(F.col("k").cast("double"), F.col("n").cast("double"), F.lit(p0)))


def adjust(df: DataFrame, family: Sequence[str], p: str, key: str) -> DataFrame:
    """Benjamini-Hochberg, Holm and Bonferroni values within families; rows without p, or with NaN for it, count for nothing.

    Equal p-values are ordered by key, which changes no adjusted value. Ranges of a family's p-values pass on their
    counts and extremes, so no task holds a family.
    """
    at = fresh(df, "_p")
    r = Ranges(df.withColumn(at, finite(p)).where(F.col(at).isNotNull()), family, [at, key])
    up = r.within()
    counts = r.totals(r.rows, F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*r.group)
    counts = counts.select(*r.part, F.coalesce(F.sum("_c").over(r.before()), F.lit(0)).alias(f"{at}_before"), F.sum("_c").over(whole).cast("double").alias(f"{at}_n"))
    i, n, own = F.col(f"{at}_before") + F.row_number().over(up), F.col(f"{at}_n"), F.col(at)
    rows = r.join(r.rows, counts).withColumn(f"{at}_i", i)
    rows = rows.withColumns({f"{at}_bh": own * n / F.col(f"{at}_i"), f"{at}_holm": own * (n - F.col(f"{at}_i") + 1)})
    ends = r.totals(rows, F.min(f"{at}_bh").alias("_lo"), F.max(f"{at}_holm").alias("_hi"))
    ends = ends.select(*r.part, F.min("_lo").over(r.after()).alias(f"{at}_later"), F.max("_hi").over(r.before()).alias(f"{at}_sooner"))
    # the least from here on is a running one from the end: a frame that reaches to the end is read anew for every row
    down = over(r.part, F.desc(f"{at}_i"))
    bh = F.least(F.min(f"{at}_bh").over(down.rowsBetween(Window.unboundedPreceding, 0)), F.col(f"{at}_later"), F.lit(1.0))
    holm = F.least(F.greatest(F.max(f"{at}_holm").over(up.rowsBetween(Window.unboundedPreceding, 0)), F.col(f"{at}_sooner")), F.lit(1.0))
    return r.join(rows, ends).select(*df.columns, bh.alias("bh"), holm.alias("holm"), F.least(F.lit(1.0), own * n).alias("bonferroni"))


def correlation_gap(r1: Column | str, n1: Column | str, r2: Column | str, n2: Column | str) -> Column:
    """z of the difference of two independent correlations."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return (fisher_z(r1) - fisher_z(r2)) / F.sqrt(1.0 / (c(n1) - 3.0) + 1.0 / (c(n2) - 3.0))


def correlation_gap_p(r1: str, n1: str, r2: str, n2: str) -> Column:
    return normal_p(correlation_gap(r1, n1, r2, n2))


def linear_fit(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Least squares of y on x in each group with the residual sum of squares; a constant x: the mean alone."""
    rows = finite_rows(df, x, y).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    g = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mx"), F.avg("_y").alias("my"), F.var_pop("_x").alias("vx"), F.var_pop("_y").alias("vy"), F.covar_pop("_x", "_y").alias("c"))
    slope = F.when(F.col("vx") > 1e-24, ratio("c", "vx")).otherwise(0.0)
    return g.withColumn("slope", slope).select(*by, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), (F.col("n") * (F.col("vy") - F.col("slope") * F.col("c"))).alias("rss"))


def threshold_sweep(df: DataFrame, by: Sequence[str], x: str, thresholds: Sequence[float]) -> DataFrame:
    """threshold, n, n_above and fraction_above (x >= threshold) of each group: one pass, whatever the thresholds.

    A null x counts in nothing; a group without values has a null fraction.
    """
    found = finite_columns(df, x).groupBy(*by).agg(F.count(x).alias("n"), F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.count_if(F.col(x) >= float(t)).alias("n_above")) for t in thresholds]).alias("_sweep"))
    rows = found.select(*by, "n", F.explode("_sweep").alias("_at"))
    return rows.select(*by, "_at.threshold", "n", "_at.n_above", (F.col("_at.n_above") / F.nullif("n", F.lit(0))).alias("fraction_above"))


def binned_profile(df: DataFrame, by: Sequence[str], x: str, y: str, bins: int) -> DataFrame:
    """n, fraction, mean and quartiles of y in equal-width bins (from 0) of x between a group's extremes.

    The largest x is in the last bin; a constant x is in bin 0. Rows with a null x or y are left out. The
    extremes come from partial aggregates, so a large group is not gathered in a window.
    """
    rows = finite_rows(df, x, y).select(*by, x, y)
    ends = rows.groupBy(*by).agg(F.min(x).alias("_low"), F.max(x).alias("_high"), F.count("*").alias("_total"))
    placed = with_groups(rows, ends, by)
    width = F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))
    at = F.least(F.lit(bins - 1), F.coalesce(F.floor((F.col(x) - F.col("_low")) / width * bins), F.lit(0))).cast("int")
    found = placed.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"), F.max("_total").alias("_total"), F.avg(y).alias("mean"), *[F.percentile(y, F.lit(q)).alias(c) for q, c in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))])
    return found.select(*by, "bin", "n", (F.col("n") / F.col("_total")).alias("fraction"), "mean", "q25", "median", "q75")


def partial_spearman_many(df: DataFrame, by: Sequence[str], x: str, y: str, given: Sequence[str]) -> DataFrame:
    """Correlation of two columns' ranks after least squares on any number of covariates' ranks, with p.

    Both come from the ranks' sums of products: rows are counted and ranked (see _ranked), and a group is a small matrix.
    A rank that the covariates' ranks give wholly has no correlation.
    """
    import numpy as np
    import pandas as pd

    from .regression import _mapped

    names = {c: f"_rank_{i}" for i, c in enumerate((*given, x, y))}
    rows = _ranked(finite_rows(df, x, y, *given), by, names)
    k = len(names)
    ranks = list(names.values())
    m = rows.groupBy(*by).agg(F.sum("_w").alias("n"), F.array(*[F.sum(F.col(a) * F.col(b) * F.col("_w")) for a in ranks for b in ranks]).alias("m"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rho = []
        for m, n in zip(pdf["m"], pdf["n"], strict=True):
            s = np.array(m).reshape(k, k)
            unit = 1 / np.sqrt(np.maximum(np.diag(s), 1e-300))
            c = s * np.outer(unit, unit)
            left = c[-2:, -2:] - c[-2:, :-2] @ np.linalg.pinv(c[:-2, :-2], rcond=1e-12, hermitian=True) @ c[:-2, -2:]
            rho.append(left[0, 1] / np.sqrt(left[0, 0] * left[1, 1]) if n >= 3 and min(np.diag(s)[-2:]) > 0 and min(left[0, 0], left[1, 1]) > 1e-12 else None)
        return pdf.drop(columns="m").assign(rho=pd.Series(rho, dtype="object"))

    return _mapped(m, by, solve, "n long, rho double").withColumn("p", correlation_p("rho", "n", len(given)))
