"""Registered queries of the analytics operators, each with an equivalent in DuckDB's SQL.

Emitted doubles are rounded, so that sums in another order compare equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import meta, ranks, similarity, spatial, statistics

from .cohort import LATTICE_SQL, PROGRAMS_SQL, SPOTS_SQL, TERMS_SQL, Tables
from .registry import BY, CORR as _CORR, QUERIES, SQL, query, rank_sql as _rank, rounded  # noqa: F401


@query(
    f"""WITH {SPOTS_SQL}, long AS (SELECT dataset, sample, price, unnest(['discount', 'quantity', 'tax']) AS variable, unnest([discount, quantity, tax]) AS v FROM spots),
    r AS (SELECT *, {_rank('price', 'dataset, sample, variable')} AS rx, {_rank('v', 'dataset, sample, variable')} AS ry FROM long),
    e AS (SELECT dataset, sample, variable, {_CORR.format(x='rx', y='ry')} AS rho FROM r GROUP BY ALL),
    g AS (SELECT variable, count(*) AS k, avg(rho) AS mean, quantile_cont(rho, 0.5) AS median, stddev_samp(rho) AS sd, min(rho) AS mn, max(rho) AS mx, count(*) FILTER (rho > 0) / CAST(count(*) AS DOUBLE) AS positive FROM e GROUP BY 1)
    SELECT g.variable, k, round(mean, 6) AS mean, round(median, 6) AS median, round(sd, 6) AS sd, round(mn, 6) AS min, round(mx, 6) AS max, round(positive, 6) AS positive,
      round(greatest(positive, 1 - positive), 6) AS majority, round(avg(CAST(sign(rho) = sign(median) AS DOUBLE)), 6) AS same_as_median, round(avg(CAST(sign(rho) = sign(mean) AS DOUBLE)), 6) AS same_as_mean
    FROM g JOIN e ON g.variable = e.variable GROUP BY ALL"""
)
def cohort_spearman_summary(t: Tables) -> DataFrame:
    """Spearman's rho of price with three measures in each sample, summed up over samples."""
    long = t.spots().select(*BY, "price", F.explode(F.create_map(*[x for c in ("discount", "quantity", "tax") for x in (F.lit(c), F.col(c))])).alias("variable", "v"))
    return rounded(meta.consistency(statistics.spearman(long, [*BY, "variable"], "price", "v"), ["variable"], "rho"))


@query(f"WITH {SPOTS_SQL} SELECT dataset, sample, count(*) AS n, round({_CORR.format(x='price', y='quantity')}, 6) AS r FROM spots GROUP BY 1, 2")
def pearson_by_sample(t: Tables) -> DataFrame:
    return rounded(statistics.pearson(t.spots(), BY, "price", "quantity"))


@query(
    f"""WITH {SPOTS_SQL}, r AS (SELECT dataset, sample, {_rank('price')} AS x, {_rank('discount')} AS y, {_rank('quantity')} AS z FROM spots),
    c AS (SELECT dataset, sample, count(*) AS n, {_CORR.format(x='x', y='y')} AS a, {_CORR.format(x='x', y='z')} AS b, {_CORR.format(x='y', y='z')} AS c FROM r GROUP BY 1, 2)
    SELECT dataset, sample, n, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) + 0.0 AS rho FROM c"""
)
def partial_spearman_by_sample(t: Tables) -> DataFrame:
    return rounded(statistics.partial_spearman(t.spots(), BY, "price", "discount", "quantity"))


@query(
    f"WITH {SPOTS_SQL} "
    + " UNION ALL ".join(f"SELECT dataset, '{a}' AS a, '{b}' AS b, round({_CORR.format(x=a, y=b)}, 6) + 0.0 AS r FROM spots GROUP BY 1" for a, b in (("price", "quantity"), ("price", "discount"), ("quantity", "discount")))
)
def correlation_pairs_by_dataset(t: Tables) -> DataFrame:
    return rounded(statistics.correlation_pairs(t.spots(), ["dataset"], ["price", "quantity", "discount"]))


@query(
    f"""WITH {SPOTS_SQL}, g AS (SELECT dataset, sample, count(price) AS n, avg(price) AS m, stddev_samp(price) AS sd, min(price) AS mn, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS md, quantile_cont(price, 0.75) AS q3, max(price) AS mx FROM spots GROUP BY 1, 2)
    SELECT dataset, sample, n, round(m, 4) AS mean, round(sd, 4) AS sd, round(mn, 4) AS min, round(q1, 4) AS q1, round(md, 4) AS median, round(q3, 4) AS q3, round(mx, 4) AS max, round(q3 - q1, 4) AS iqr, round(m - 1.96 * sd / sqrt(n), 4) AS ci_low, round(m + 1.96 * sd / sqrt(n), 4) AS ci_high FROM g"""
)
def describe_by_sample(t: Tables) -> DataFrame:
    return rounded(statistics.describe(t.spots(), BY, "price"), 4)


_M = "avg((quantity - m) ** {k})"


@query(
    f"""WITH {SPOTS_SQL}, c AS (SELECT *, avg(quantity) OVER (PARTITION BY dataset, sample) AS m FROM spots),
    g AS (SELECT dataset, sample, count(*) AS n, avg(quantity) AS mean, {_M.format(k=2)} AS m2, {_M.format(k=3)} AS m3, {_M.format(k=4)} AS m4 FROM c GROUP BY 1, 2),
    h AS (SELECT *, m3 / m2 ** 1.5 AS g1, m4 / m2 ** 2 - 3 AS g2 FROM g)
    SELECT dataset, sample, n, round(g1, 5) + 0.0 AS skewness, round(g2, 5) + 0.0 AS kurtosis, round(sqrt(CAST(n AS DOUBLE) * (n - 1)) / (n - 2) * g1, 5) + 0.0 AS skewness_adjusted,
      round(sqrt(m2) / mean, 5) AS cv, round((g1 * g1 + 1) / (g2 + 3), 5) AS bimodality, (g1 * g1 + 1) / (g2 + 3) > 0.555 AS is_bimodal FROM h"""
)
def moments_by_sample(t: Tables) -> DataFrame:
    return rounded(statistics.moments(t.spots(), BY, "quantity"), 5)


@query(
    f"""WITH {SPOTS_SQL}, n AS (SELECT dataset, sample, l_returnflag AS l, count(*) AS n FROM spots GROUP BY ALL), p AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY dataset, sample) AS DOUBLE) AS p FROM n)
    SELECT dataset, sample, round(-sum(p * ln(p)), 6) AS entropy, count(*) AS labels, min(CAST(1e9 - n AS BIGINT) || '|' || l)[-1:] AS mode FROM p GROUP BY 1, 2"""
)
def label_entropy_by_sample(t: Tables) -> DataFrame:
    return rounded(statistics.label_entropy(t.spots(), BY, "l_returnflag"))


@query(
    f"""WITH {SPOTS_SQL}, g AS (SELECT dataset, sample, l_returnflag, avg(quantity) AS m, var_pop(quantity) AS v FROM spots GROUP BY ALL)
    SELECT dataset, sample, round(var_pop(m), 6) AS between, round(avg(v), 6) AS within, round(var_pop(m) / avg(v), 6) AS ratio FROM g GROUP BY 1, 2"""
)
def between_within_by_sample(t: Tables) -> DataFrame:
    return rounded(statistics.between_within(t.spots(), BY, "l_returnflag", "quantity"))


_TABLE = f"""WITH {SPOTS_SQL}, n AS (SELECT dataset, l_returnflag, l_linestatus, count(*) AS n FROM spots GROUP BY ALL),
    m AS (SELECT *, CAST(sum(n) OVER (PARTITION BY dataset, l_returnflag) AS DOUBLE) AS na, CAST(sum(n) OVER (PARTITION BY dataset, l_linestatus) AS DOUBLE) AS nb FROM n)"""


@query(_TABLE + " SELECT dataset, l_returnflag, l_linestatus, n, round(n / na, 6) AS row_share, round(n / nb, 6) AS column_share, round(n / (na + nb - n), 6) AS jaccard FROM m")
def contingency_by_dataset(t: Tables) -> DataFrame:
    return rounded(statistics.contingency(t.spots(), ["dataset"], "l_returnflag", "l_linestatus"))


@query(_TABLE + " SELECT dataset, round(sum(n) * (sum(n * n / (na * nb)) - 1), 4) AS chi2, (count(DISTINCT l_returnflag) - 1) * (count(DISTINCT l_linestatus) - 1) AS dof FROM m GROUP BY 1")
def chi_square_by_dataset(t: Tables) -> DataFrame:
    return rounded(statistics.chi_square(t.spots(), ["dataset"], "l_returnflag", "l_linestatus"), 4)


@query(
    f"""WITH {SPOTS_SQL}, g AS (SELECT dataset, sample, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, avg(price) FILTER (f) AS m1, avg(price) FILTER (NOT f) AS m2, var_samp(price) FILTER (f) AS v1, var_samp(price) FILTER (NOT f) AS v2
      FROM (SELECT *, l_returnflag = 'R' AS f FROM spots) GROUP BY 1, 2)
    SELECT dataset, sample, n1, n2, round(m1, 4) AS m1, round(m2, 4) AS m2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 4) + 0.0 AS cohens_d,
      round((m1 - m2) / sqrt((v1 + v2) / 2), 4) + 0.0 AS smd, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) + 0.0 AS welch_t FROM g"""
)
def two_groups_by_sample(t: Tables) -> DataFrame:
    return rounded(statistics.two_groups(t.spots(), BY, F.col("l_returnflag") == "R", "price"), 4)


@query(
    f"""WITH {SPOTS_SQL}, r AS (SELECT *, l_returnflag = 'R' AS f, {_rank('quantity')} AS r FROM spots),
    t AS (SELECT dataset, sample, sum(n * n * n - n) AS ties FROM (SELECT dataset, sample, quantity, CAST(count(*) AS DOUBLE) AS n FROM spots GROUP BY ALL) GROUP BY 1, 2),
    g AS (SELECT dataset, sample, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, sum(r) FILTER (f) AS r1 FROM r GROUP BY 1, 2),
    u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u, CAST(n1 + n2 AS DOUBLE) AS n, CAST(n1 AS DOUBLE) * n2 AS nn FROM g JOIN t USING (dataset, sample))
    SELECT dataset, sample, n1, n2, round(u, 4) AS u, round(sign(u - nn / 2) * greatest(abs(u - nn / 2) - 0.5, 0) / sqrt(nn / 12 * (n + 1 - ties / (n * (n - 1)))), 4) + 0.0 AS z, round(2 * u / nn - 1, 4) + 0.0 AS rank_biserial FROM u"""
)
def mann_whitney_by_sample(t: Tables) -> DataFrame:
    return rounded(statistics.mann_whitney(t.spots(), BY, F.col("l_returnflag") == "R", "quantity"), 4)


@query(
    f"""WITH {SPOTS_SQL}, d AS (SELECT dataset, sample, quantity - 25 AS x, abs(quantity - 25) AS a FROM spots WHERE quantity <> 25), r AS (SELECT *, {_rank('a')} AS r FROM d),
    t AS (SELECT dataset, sample, sum(n * n * n - n) AS ties FROM (SELECT dataset, sample, a, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY ALL) GROUP BY 1, 2),
    g AS (SELECT dataset, sample, CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN x > 0 THEN r ELSE 0 END) AS p, sum(CASE WHEN x < 0 THEN r ELSE 0 END) AS m FROM r GROUP BY 1, 2)
    SELECT dataset, sample, CAST(n AS BIGINT) AS n, round(p, 4) AS w_plus, round(m, 4) AS w_minus, round((p - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 4) + 0.0 AS z FROM g JOIN t USING (dataset, sample)"""
)
def signed_rank_by_sample(t: Tables) -> DataFrame:
    return rounded(statistics.signed_rank(t.spots().withColumn("x", F.col("quantity") - 25), BY, "x").drop("has_ties"), 4)


_SIMPLE_P = "least(1.0, 1.0 / (1.0 + s_acctbal * s_acctbal / 1e6))"


@query(
    f"""WITH p AS (SELECT s_nationkey, s_suppkey, {_SIMPLE_P.replace('s_acctbal', 'CAST(s_acctbal AS DOUBLE)')} AS p FROM supplier),
    r AS (SELECT *, row_number() OVER w AS i, CAST(count(*) OVER (PARTITION BY s_nationkey) AS DOUBLE) AS n FROM p WINDOW w AS (PARTITION BY s_nationkey ORDER BY p, s_suppkey))
    SELECT s_nationkey, s_suppkey, round(p, 6) AS p, round(least(1.0, min(p * n / i) OVER (PARTITION BY s_nationkey ORDER BY p, s_suppkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS bh,
      round(least(1.0, max(p * (n - i + 1)) OVER (PARTITION BY s_nationkey ORDER BY p, s_suppkey ROWS UNBOUNDED PRECEDING)), 6) AS holm, round(least(1.0, p * n), 6) AS bonferroni FROM r"""
)
def multiple_testing(t: Tables) -> DataFrame:
    """Adjusted values of p-values made from supplier balances, by nation."""
    b = F.col("s_acctbal").cast("double")
    rows = t.supplier.select("s_nationkey", "s_suppkey", F.least(F.lit(1.0), 1.0 / (1.0 + b * b / 1e6)).alias("p"))
    return rounded(statistics.adjust(rows, ["s_nationkey"], "p", "s_suppkey"))


_EFFECTS = f"""{SPOTS_SQL}, eff AS (SELECT l_returnflag AS variable, dataset, sample, avg(discount) AS y, stddev_samp(discount) / sqrt(count(*)) AS se, count(*) AS n FROM spots GROUP BY 1, 2, 3)"""


def _effects(t: Tables) -> DataFrame:
    return t.spots().groupBy(F.col("l_returnflag").alias("variable"), *BY).agg(F.avg("discount").alias("y"), (F.stddev_samp("discount") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_EFFECTS}, g AS (SELECT variable, count(*) AS k, sum(1 / (se * se)) AS sw, sum(1 / se ** 4) AS sw2, sum(y / (se * se)) / sum(1 / (se * se)) AS f FROM eff GROUP BY 1),
    q AS (SELECT g.variable, k, sw, sw2, f, sum((y - f) ** 2 / (se * se)) AS q FROM g JOIN eff USING (variable) GROUP BY ALL),
    t AS (SELECT *, greatest(0, (q - (k - 1)) / (sw - sw2 / sw)) AS tau2, greatest(0, (q - (k - 1)) / q) AS i2 FROM q),
    r AS (SELECT variable, sum(y / (se * se + tau2)) / sum(1 / (se * se + tau2)) AS random, sqrt(1 / sum(1 / (se * se + tau2))) AS random_se FROM t JOIN eff USING (variable) GROUP BY 1)
    SELECT variable, k, round(f, 6) AS fixed, round(sqrt(1 / sw), 6) AS fixed_se, round(q, 4) AS q, round(tau2, 8) + 0.0 AS tau2, round(i2, 4) AS i2, round(random, 6) AS random, round(random_se, 6) AS random_se FROM t JOIN r USING (variable)"""
)
def meta_inverse_variance(t: Tables) -> DataFrame:
    g = meta.inverse_variance(_effects(t), ["variable"], "y", "se")
    r = lambda c, d: (F.round(c, d) + F.lit(0.0)).alias(c)
    return g.select("variable", "k", r("fixed", 6), r("fixed_se", 6), r("q", 4), r("tau2", 8), r("i2", 4), r("random", 6), r("random_se", 6))


@query()
def meta_reml(t: Tables) -> DataFrame:
    """Random effects by restricted maximum likelihood: iterative, so not SQL."""
    return rounded(meta.reml(_effects(t), ["variable"], "y", "se"), 8)


@query(f"WITH {_EFFECTS} SELECT variable, count(*) AS k, round(sum((y - 0.05) / se) / sqrt(count(*)), 4) + 0.0 AS z FROM eff GROUP BY 1")
def meta_stouffer(t: Tables) -> DataFrame:
    return rounded(meta.stouffer(_effects(t).withColumn("z", (F.col("y") - 0.05) / F.col("se")), ["variable"], "z"), 4)


@query(
    f"""WITH {SPOTS_SQL}, e AS (SELECT dataset, sample, count(*) AS n, {_CORR.format(x='price', y='quantity')} AS r FROM spots GROUP BY 1, 2), z AS (SELECT dataset, n - 3.0 AS w, 0.5 * ln((1 + r) / (1 - r)) AS z FROM e)
    SELECT dataset, count(*) AS k, round(tanh(sum(w * z) / sum(w)), 6) AS r_weighted, round(tanh(avg(z)), 6) AS r_mean, round(sum(w * z) / sum(w) / sqrt(1 / sum(w)), 3) AS z FROM z GROUP BY 1"""
)
def meta_correlation(t: Tables) -> DataFrame:
    g = meta.pooled_correlation(statistics.pearson(t.spots(), BY, "price", "quantity"), ["dataset"], "r", "n")
    return g.select("dataset", "k", F.round("r_weighted", 6).alias("r_weighted"), F.round("r_mean", 6).alias("r_mean"), F.round("z", 3).alias("z"))


@query(
    f"""WITH {_EFFECTS}, g AS (SELECT variable, dataset, sum(y) AS s, count(*) AS n FROM eff GROUP BY 1, 2)
    SELECT variable, dataset AS left_out, round((sum(s) OVER w - s) / (sum(n) OVER w - n), 6) AS mean_without FROM g WINDOW w AS (PARTITION BY variable)"""
)
def leave_one_dataset_out(t: Tables) -> DataFrame:
    return rounded(meta.leave_one_out(_effects(t), ["variable"], "dataset", "y"))


_PAIRS = f"""WITH {PROGRAMS_SQL}, pairs AS (SELECT a.program AS a, b.program AS b, count(*) AS shared FROM programs a JOIN programs b ON a.gene = b.gene AND a.program < b.program GROUP BY 1, 2),
    sizes AS (SELECT program, count(*) AS n FROM programs GROUP BY 1),
    sims AS (SELECT a, b, shared, x.n AS na, y.n AS nb, shared / CAST(x.n + y.n - shared AS DOUBLE) AS jaccard, shared / CAST(least(x.n, y.n) AS DOUBLE) AS overlap FROM pairs JOIN sizes x ON a = x.program JOIN sizes y ON b = y.program)"""


def _pairs(t: Tables) -> DataFrame:
    return similarity.set_overlaps(t.programs(), [], "program", "gene")


@query(_PAIRS + " SELECT a, b, shared, na, nb, round(jaccard, 6) AS jaccard, round(overlap, 6) AS overlap FROM sims")
def program_overlaps(t: Tables) -> DataFrame:
    return rounded(_pairs(t))


@query(
    _PAIRS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, e AS (SELECT a, b FROM sims WHERE shared >= 3 UNION SELECT b, a FROM sims WHERE shared >= 3), reach(n, m) AS (SELECT a, a FROM e UNION SELECT r.n, e.b FROM reach r JOIN e ON r.m = e.a)
    SELECT n AS node, min(m) AS component FROM reach GROUP BY 1"""
)
def program_components(t: Tables) -> DataFrame:
    """Components of the threshold graph of programs."""
    return similarity.components(_pairs(t).where("shared >= 3"))


@query(
    f"""WITH {PROGRAMS_SQL}, n AS (SELECT program, sqrt(sum(loading * loading)) AS l FROM programs GROUP BY 1), d AS (SELECT a.program AS a, b.program AS b, sum(a.loading * b.loading) AS dot FROM programs a JOIN programs b ON a.gene = b.gene AND a.program < b.program GROUP BY 1, 2)
    SELECT a, b, round(dot / (x.l * y.l), 6) AS cosine FROM d JOIN n x ON a = x.program JOIN n y ON b = y.program"""
)
def program_cosine(t: Tables) -> DataFrame:
    return rounded(similarity.cosine_pairs(t.programs(), [], "program", "gene", "loading"))


@query(
    f"""WITH {PROGRAMS_SQL}, s AS (SELECT DISTINCT program % 5 AS g, program AS o, gene AS i FROM programs), ow AS (SELECT g, count(DISTINCT o) AS n FROM s GROUP BY 1),
    c AS (SELECT g, i, count(*) AS n_in FROM s GROUP BY 1, 2), f AS (SELECT g, i, n_in, n_in / CAST(n AS DOUBLE) AS fr FROM c JOIN ow USING (g)),
    x AS (SELECT a.g, a.i, a.n_in, a.fr, coalesce(sum(b.n_in), 0) AS n_out, coalesce(max(b.fr), 0) AS fo FROM f a LEFT JOIN f b ON a.i = b.i AND a.g <> b.g GROUP BY ALL)
    SELECT g AS "group", i AS item, n_in, round(fr, 6) AS fraction_in, CAST(n_out AS BIGINT) AS n_out, round(fo, 6) AS fraction_other, round(fr - fo, 6) + 0.0 AS difference, round(fr / (fo + 1e-6), 3) AS specificity FROM x"""
)
def item_recurrence(t: Tables) -> DataFrame:
    r = similarity.recurrence(t.programs().withColumn("g", F.col("program") % 5), "g", "program", "gene")
    return r.select("group", "item", "n_in", F.round("fraction_in", 6).alias("fraction_in"), "n_out", F.round("fraction_other", 6).alias("fraction_other"), (F.round("difference", 6) + F.lit(0.0)).alias("difference"), F.round("specificity", 3).alias("specificity"))


@query(
    f"""WITH {SPOTS_SQL}, n AS (SELECT dataset, l_returnflag AS a, l_linestatus AS b, CAST(count(*) AS DOUBLE) AS n FROM spots GROUP BY ALL), t AS (SELECT dataset, sum(n) AS t, sum(n * (n - 1) / 2) AS sij, -sum(n / tt * ln(n / tt)) AS hab FROM (SELECT *, sum(n) OVER (PARTITION BY dataset) AS tt FROM n) GROUP BY 1),
    a AS (SELECT dataset, sum(m * (m - 1) / 2) AS sa, -sum(m / tt * ln(m / tt)) AS ha FROM (SELECT dataset, a, sum(n) AS m, sum(sum(n)) OVER (PARTITION BY dataset) AS tt FROM n GROUP BY 1, 2) GROUP BY 1),
    b AS (SELECT dataset, sum(m * (m - 1) / 2) AS sb, -sum(m / tt * ln(m / tt)) AS hb FROM (SELECT dataset, b, sum(n) AS m, sum(sum(n)) OVER (PARTITION BY dataset) AS tt FROM n GROUP BY 1, 2) GROUP BY 1)
    SELECT dataset, round((sij - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) + 0.0 AS ari, round((ha + hb - hab) / ((ha + hb) / 2), 6) + 0.0 AS nmi FROM t JOIN a USING (dataset) JOIN b USING (dataset)"""
)
def label_agreement(t: Tables) -> DataFrame:
    return rounded(similarity.agreement(t.spots(), ["dataset"], "l_returnflag", "l_linestatus"))


@query(f"WITH {LATTICE_SQL} SELECT sample, src, dst FROM edges")
def lattice_edges(t: Tables) -> DataFrame:
    return spatial.lattice_edges(t.lattice(), ["sample"], "node", "row", "col")


def _grid(t: Tables) -> tuple[DataFrame, DataFrame]:
    nodes = t.lattice()
    return nodes, spatial.lattice_edges(nodes, ["sample"], "node", "row", "col")


@query(f"WITH {LATTICE_SQL} SELECT e.sample, src AS node, count(*) AS neighbours, round(avg(value), 6) AS mean_value FROM edges e JOIN lattice l ON e.sample = l.sample AND dst = node GROUP BY 1, 2")
def neighbour_means(t: Tables) -> DataFrame:
    return rounded(spatial.neighbour_mean(*_grid(t), ["sample"], "node", ["value"]))


@query(
    f"""WITH {LATTICE_SQL}, z AS (SELECT sample, node, value - avg(value) OVER (PARTITION BY sample) AS z FROM lattice), b AS (SELECT sample, count(*) AS n, sum(z * z) AS zz FROM z GROUP BY 1),
    w AS (SELECT e.sample, count(*) AS w, sum(a.z * c.z) AS ab FROM edges e JOIN z a ON src = a.node AND e.sample = a.sample JOIN z c ON dst = c.node AND e.sample = c.sample GROUP BY 1)
    SELECT sample, n, w, round(n / CAST(w AS DOUBLE) * ab / zz, 6) + 0.0 AS moran_i FROM b JOIN w USING (sample)"""
)
def global_moran(t: Tables) -> DataFrame:
    return rounded(spatial.moran(*_grid(t), ["sample"], "node", "value"))


@query(
    f"""WITH {LATTICE_SQL}, z AS (SELECT sample, node, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM lattice WINDOW w AS (PARTITION BY sample)), g AS (SELECT e.sample, src AS node, avg(z) AS lag FROM edges e JOIN z ON e.sample = z.sample AND dst = node GROUP BY 1, 2)
    SELECT sample, node, round(z, 6) + 0.0 AS z, round(lag, 6) + 0.0 AS lag, round(z * lag, 6) + 0.0 AS local_i, CASE WHEN z > 0 THEN 'High' ELSE 'Low' END || '-' || CASE WHEN lag > 0 THEN 'High' ELSE 'Low' END AS quadrant FROM z JOIN g USING (sample, node)"""
)
def local_moran(t: Tables) -> DataFrame:
    return rounded(spatial.local_moran(*_grid(t), ["sample"], "node", "value"))


@query(
    f"""WITH {LATTICE_SQL}, v AS (SELECT sample, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM lattice GROUP BY 1), a AS (SELECT * FROM edges UNION ALL SELECT sample, node, node FROM lattice), g AS (SELECT a.sample, src, sum(value) AS sx, CAST(count(*) AS DOUBLE) AS w FROM a JOIN lattice l ON a.sample = l.sample AND dst = node GROUP BY 1, 2)
    SELECT sample, src AS node, round((sx - m * w) / (s * sqrt((n * w - w * w) / (n - 1))), 5) + 0.0 AS gi_star FROM g JOIN v USING (sample)"""
)
def getis_ord(t: Tables) -> DataFrame:
    return rounded(spatial.getis_ord(*_grid(t), ["sample"], "node", "value"), 5)


#: High is the upper third of a sample's values: five high neighbours of six are then rare but do occur.
_HIGH_SQL = "h AS (SELECT sample, node, value >= quantile_cont(value, 0.66) OVER (PARTITION BY sample) AS h FROM lattice)"


def _high(nodes: DataFrame) -> DataFrame:
    cut = nodes.groupBy("sample").agg(F.percentile("value", F.lit(0.66)).alias("_cut"))
    return ranks.with_groups(nodes, cut, ["sample"]).withColumn("high", F.col("value") >= F.col("_cut")).drop("_cut")


@query(f"WITH {LATTICE_SQL}, {_HIGH_SQL}, n AS (SELECT e.sample, src AS node, count(*) FILTER (h) AS k FROM edges e JOIN h ON e.sample = h.sample AND dst = node GROUP BY 1, 2) SELECT sample, node, k AS high_neighbours FROM h JOIN n USING (sample, node) WHERE h AND k >= 5")
def dense_hotspots(t: Tables) -> DataFrame:
    nodes, edges = _grid(t)
    return spatial.dense_hotspots(_high(nodes), edges, ["sample"], "node", F.col("high"), 5)


@query(f"WITH {LATTICE_SQL}, {_HIGH_SQL} SELECT DISTINCT e.sample, dst AS node FROM edges e JOIN h ON e.sample = h.sample AND src = h.node AND h.h WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.sample = e.sample AND x.node = dst AND x.h)")
def hot_halo(t: Tables) -> DataFrame:
    nodes, edges = _grid(t)
    return spatial.halo(_high(nodes), edges, ["sample"], "node", F.col("high"))


@query(
    f"""WITH {LATTICE_SQL}, r0 AS (SELECT sample, node FROM (SELECT *, avg(value) OVER w + stddev_pop(value) OVER w AS least FROM lattice WINDOW w AS (PARTITION BY sample)) WHERE value >= least),
    r1 AS (SELECT e.sample, dst AS node FROM edges e JOIN r0 ON e.sample = r0.sample AND src = node EXCEPT SELECT * FROM r0),
    r2 AS (SELECT e.sample, dst AS node FROM edges e JOIN r1 ON e.sample = r1.sample AND src = node EXCEPT SELECT * FROM r1 EXCEPT SELECT * FROM r0),
    r3 AS (SELECT e.sample, dst AS node FROM edges e JOIN r2 ON e.sample = r2.sample AND src = node EXCEPT SELECT * FROM r2 EXCEPT SELECT * FROM r1 EXCEPT SELECT * FROM r0)
    SELECT sample, node, 0 AS ring FROM r0 UNION ALL SELECT sample, node, 1 FROM r1 UNION ALL SELECT sample, node, 2 FROM r2 UNION ALL SELECT sample, node, 3 FROM r3"""
)
def high_rings(t: Tables) -> DataFrame:
    """Three rings around every high node of the whole lattice: a standard deviation or more above its sample's mean."""
    nodes, edges = _grid(t)
    high = ranks.sd_groups(nodes, ["sample"], "value", "level").where("level = 'HIGH'")
    return spatial.rings(edges, high, ["sample"], "node", 3)


@query(
    f"""WITH {LATTICE_SQL}, b AS (SELECT sample, node, value, row_number() OVER (PARTITION BY sample ORDER BY node) AS i FROM lattice), p AS (SELECT sample, perm, node, value, i, row_number() OVER (PARTITION BY sample, perm ORDER BY md5('null|' || perm || '|' || node), node) AS j FROM b, range(1, 6) t(perm))
    SELECT x.sample, CAST(x.perm AS INTEGER) AS perm, x.node, y.value AS x FROM p x JOIN p y ON x.sample = y.sample AND x.perm = y.perm AND x.i = y.j"""
)
def permutation_null(t: Tables) -> DataFrame:
    return spatial.permuted(t.lattice(), ["sample"], "node", "value", 5, "null")


@query(
    f"""WITH {LATTICE_SQL}, z AS (SELECT sample, node, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z, row_number() OVER (PARTITION BY sample ORDER BY node) AS i FROM lattice WINDOW w AS (PARTITION BY sample)),
    dealt AS (SELECT sample, perm, node, z, i, row_number() OVER (PARTITION BY sample, perm ORDER BY md5('lisa|' || perm || '|' || node), node) AS j FROM z, range(1, 1000) t(perm)), u AS (SELECT x.sample, x.perm, x.node, y.z FROM dealt x JOIN dealt y ON x.sample = y.sample AND x.perm = y.perm AND x.i = y.j),
    real AS (SELECT z.sample, z.node, any_value(z.z) AS z, avg(b.z) AS lag FROM z JOIN edges e ON e.sample = z.sample AND src = z.node JOIN z b ON b.sample = z.sample AND b.node = dst GROUP BY 1, 2),
    fake AS (SELECT a.sample, a.perm, a.node, any_value(a.z) * avg(b.z) AS li FROM u a JOIN edges e ON e.sample = a.sample AND src = a.node JOIN u b ON b.sample = a.sample AND b.perm = a.perm AND b.node = dst GROUP BY 1, 2, 3),
    p AS (SELECT sample, node, (count(*) FILTER (round(abs(li), 9) >= round(abs(z * lag), 9)) + 1) / 1000.0 AS p FROM fake JOIN real USING (sample, node) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY p, node) AS i, count(*) OVER (PARTITION BY sample) AS n FROM p), q AS (SELECT sample, node, p, least(1, min(p * n / i) OVER (PARTITION BY sample ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)
    SELECT sample, node, round(z, 5) + 0.0 AS z, round(lag, 5) + 0.0 AS lag, round(z * lag, 5) + 0.0 AS local_i, CASE WHEN z > 0 THEN 'High' ELSE 'Low' END || '-' || CASE WHEN lag > 0 THEN 'High' ELSE 'Low' END AS quadrant, round(p, 5) AS p, round(q + 1e-9, 5) AS q,
      CASE WHEN q < 0.05 THEN CASE WHEN z > 0 THEN 'High' ELSE 'Low' END || '-' || CASE WHEN lag > 0 THEN 'High' ELSE 'Low' END ELSE 'Not significant' END AS category FROM real JOIN q USING (sample, node)"""
)
def lisa_permutation(t: Tables) -> DataFrame:
    """Local Moran with p-values of 999 permutations (the md5 kernel of permutation_null), Benjamini-Hochberg within a sample, category at q < 0.05."""
    found = statistics.adjust(spatial.lisa(*_grid(t), ["sample"], "node", "value", 999), ["sample"], "p", "node").drop("holm", "bonferroni").withColumnRenamed("bh", "q")
    found = found.withColumn("q", F.col("q") + 1e-9)  # p * n / i often lies on a rounding tie
    return rounded(found.withColumn("category", F.when(F.col("q") < 0.05, F.col("quadrant")).otherwise("Not significant")), 5)


@query(
    f"""WITH {PROGRAMS_SQL}, {TERMS_SQL}, u AS (SELECT DISTINCT p_partkey AS gene FROM part), l AS (SELECT program, count(*) AS n FROM programs GROUP BY 1), k AS (SELECT term, count(*) AS n FROM terms GROUP BY 1),
    h AS (SELECT program, term, count(*) AS overlap FROM programs JOIN terms USING (gene) GROUP BY 1, 2)
    SELECT program, term, overlap, l.n AS list_size, k.n AS term_size, (SELECT count(*) FROM u) AS universe, round(overlap * CAST((SELECT count(*) FROM u) AS DOUBLE) / (l.n * k.n), 6) AS fold FROM h JOIN l USING (program) JOIN k USING (term)"""
)
def term_enrichment(t: Tables) -> DataFrame:
    """Over-representation of type words in programs: counts and fold (p-values: term_enrichment_p)."""
    return rounded(_enriched(t).drop("p", "odds_ratio"))


def _enriched(t: Tables) -> DataFrame:
    return meta.over_representation(t.programs(), t.terms(), t.part.select(F.col("p_partkey").alias("gene")), ["program"], "gene", "term")


_COMB = "lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)"
_TAIL = f"list_sum(list_transform(range(overlap, least(list_size, term_size) + 1), lambda i: exp({_COMB.format(n='term_size', k='i')} + {_COMB.format(n='(universe - term_size)', k='(list_size - i)')} - ({_COMB.format(n='universe', k='list_size')}))))"


@query(
    f"""WITH {PROGRAMS_SQL}, {TERMS_SQL}, l AS (SELECT program, count(*) AS list_size FROM programs GROUP BY 1), k AS (SELECT term, count(*) AS term_size FROM terms GROUP BY 1), u AS (SELECT count(DISTINCT p_partkey) AS universe FROM part),
    h AS (SELECT program, term, count(*) AS overlap FROM programs JOIN terms USING (gene) GROUP BY 1, 2), x AS (SELECT * FROM h JOIN l USING (program) JOIN k USING (term) CROSS JOIN u), y AS (SELECT *, least(1, {_TAIL}) AS p FROM x),
    r AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY p, term) AS i, count(*) OVER (PARTITION BY program) AS n FROM y)
    SELECT program, term, overlap, round(p, 6) AS p, round(CASE WHEN (list_size - overlap) * (term_size - overlap) > 0 THEN overlap * CAST(universe - list_size - term_size + overlap AS DOUBLE) / ((list_size - overlap) * (term_size - overlap)) END, 4) AS odds_ratio,
      round(least(1, min(p * n / i) OVER (PARTITION BY program ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 5) AS bh FROM r"""
)
def term_enrichment_p(t: Tables) -> DataFrame:
    """Fisher's one-sided (hypergeometric) p with odds ratio and Benjamini-Hochberg values within programs."""
    x = statistics.adjust(_enriched(t), ["program"], "p", "term")
    return x.select("program", "term", "overlap", F.round("p", 6).alias("p"), F.round("odds_ratio", 4).alias("odds_ratio"), F.round("bh", 5).alias("bh"))


@query(
    f"""WITH {SPOTS_SQL} SELECT dataset, sample, spot, round(CASE WHEN stddev_pop(price) OVER w > 1e-12 THEN (price - avg(price) OVER w) / stddev_pop(price) OVER w END, 5) + 0.0 AS z,
    round((quantity - min(quantity) OVER w) / (max(quantity) OVER w - min(quantity) OVER w), 5) AS scaled, round(price / sum(price) OVER w, 9) AS share,
    CASE WHEN price >= avg(price) OVER w + stddev_pop(price) OVER w THEN 'HIGH' WHEN price <= avg(price) OVER w - stddev_pop(price) OVER w THEN 'LOW' ELSE 'MID' END AS level FROM spots WINDOW w AS (PARTITION BY dataset, sample)"""
)
def scaled_spots(t: Tables) -> DataFrame:
    x = ranks.scaled(t.spots(), BY, ranks.z_of("price", "z"), ranks.min_max_of("quantity", "scaled"), ranks.share_of("price", "share"), ranks.sd_level_of("price", "level"))
    return x.select(*BY, "spot", (F.round("z", 5) + F.lit(0.0)).alias("z"), F.round("scaled", 5).alias("scaled"), F.round("share", 9).alias("share"), "level")


@query(f"WITH {SPOTS_SQL} SELECT * FROM (SELECT dataset, sample, spot, price, row_number() OVER (PARTITION BY dataset, sample ORDER BY price DESC, spot) AS rank FROM spots) WHERE rank <= 5")
def top_spots(t: Tables) -> DataFrame:
    return ranks.top_n(t.spots().select(*BY, "spot", "price"), BY, [F.desc("price"), F.col("spot")], 5)


@query("SELECT * FROM (SELECT c_nationkey, c_custkey, CAST(c_acctbal AS DOUBLE) AS x, CASE WHEN c_acctbal > 0 THEN 'positive' ELSE 'negative' END AS tail, row_number() OVER (PARTITION BY c_nationkey, sign(c_acctbal) ORDER BY abs(CAST(c_acctbal AS DOUBLE)) DESC, c_custkey) AS rank FROM customer WHERE c_acctbal <> 0) WHERE rank <= 6")
def strongest_tails(t: Tables) -> DataFrame:
    return ranks.both_tails(t.customer.select("c_nationkey", "c_custkey", F.col("c_acctbal").cast("double").alias("x")), ["c_nationkey"], "x", "c_custkey", 6)


@query(
    f"""WITH {SPOTS_SQL}, g AS (SELECT dataset, sample, count(*) AS n, avg(quantity) AS mx, avg(price) AS my, var_pop(quantity) AS vx, var_pop(price) AS vy, covar_pop(quantity, price) AS c FROM spots GROUP BY 1, 2)
    SELECT dataset, sample, n, round(c / vx, 4) AS slope, round(my - c / vx * mx, 4) + 0.0 AS intercept, round(n * (vy - c / vx * c) / 1e6, 3) AS rss_millions FROM g"""
)
def segment_fits(t: Tables) -> DataFrame:
    g = statistics.linear_fit(t.spots(), BY, "quantity", "price")
    return g.select(*BY, "n", F.round("slope", 4).alias("slope"), (F.round("intercept", 4) + F.lit(0.0)).alias("intercept"), F.round(F.col("rss") / 1e6, 3).alias("rss_millions"))


_PARTS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(
    f"""WITH c AS (SELECT o_custkey AS id, {', '.join(f"count(*) FILTER (o_orderpriority = '{p}') AS n{i}" for i, p in enumerate(_PARTS))}, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1),
    f AS (SELECT id, {', '.join(f'n{i} / n AS f{i}' for i in range(5))}, {' + '.join(f'CAST(n{i} = 0 AS INTEGER)' for i in range(5))} AS z FROM c), r AS (SELECT id, {', '.join(f'CASE WHEN f{i} = 0 THEN 0.01 ELSE f{i} * (1 - z * 0.01) END AS p{i}' for i in range(5))} FROM f)
    SELECT id, round(sqrt(6 / 5.0) * ((ln(p0) + ln(p1)) / 2 - (ln(p2) + ln(p3) + ln(p4)) / 3), 6) + 0.0 AS urgent_rest, round(sqrt(1 / 2.0) * (ln(p0) - ln(p1)), 6) + 0.0 AS urgent_high FROM r"""
)
def composition_balances(t: Tables) -> DataFrame:
    """Order priorities of a customer as a composition: closure, zero replacement, log-ratio balances."""
    names = [f"p{i}" for i in range(5)]
    n = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(*[F.count_if(F.col("o_orderpriority") == p).alias(c) for p, c in zip(_PARTS, names)])
    f = n.select("id", *[c.alias(x) for c, x in zip(S.closed(names), names)])
    p = f.select("id", *[c.alias(x) for c, x in zip(S.zero_replaced(names, 0.01), names)])
    c = [F.col(x) for x in names]
    return rounded(p.select("id", S.balance(c[:2], c[2:]).alias("urgent_rest"), S.balance(c[:1], c[1:2]).alias("urgent_high")))


@query(
    """SELECT s_suppkey, s_acctbal > 0 AS positive, round(greatest(-3.0, least(3.0, CAST(s_acctbal AS DOUBLE) / 1000)) / 3, 6) + 0.0 AS capped, CASE WHEN s_acctbal > 0 THEN 'enriched' WHEN s_acctbal < 0 THEN 'depleted' ELSE 'none' END AS direction,
    CASE WHEN s_suppkey % 7 <= 1 THEN 'sample_specific' WHEN s_suppkey % 7 <= 3 THEN 'subset_specific' ELSE 'cohort_recurrent' END AS tier, CASE WHEN abs(s_acctbal) < 1000 THEN 'negligible' WHEN abs(s_acctbal) < 2000 THEN 'weak' WHEN abs(s_acctbal) < 3500 THEN 'moderate' ELSE 'strong' END AS strength FROM supplier"""
)
def supplier_labels(t: Tables) -> DataFrame:
    b = F.col("s_acctbal").cast("double")
    return t.supplier.select("s_suppkey", S.truthy((b > 0).cast("string")).alias("positive"), (S.cap_scale(b / 1000) + F.lit(0.0)).alias("capped"), S.direction(b).alias("direction"), S.tier(F.col("s_suppkey") % 7).alias("tier"), S.strength(b / 10_000).alias("strength"))


@query("SELECT * FROM (SELECT o_custkey AS id, 'orders' AS side FROM orders EXCEPT SELECT c_custkey, 'orders' FROM customer) UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def key_differences(t: Tables) -> DataFrame:
    """Keys that one source lacks: orders without customer, customers without a finished order."""
    orders, customers = t.orders.select(F.col("o_custkey").alias("id"), "o_orderstatus"), t.customer.select(F.col("c_custkey").alias("id"))
    first = similarity.set_differences(orders, customers, ["id"]).where("side = 'only_a'")
    d = first.union(similarity.set_differences(orders.where("o_orderstatus = 'F'"), customers, ["id"]).where("side = 'only_b'"))
    return d.select("id", F.when(F.col("side") == "only_a", "orders").otherwise("customer").alias("side"))


@query(
    f"""WITH {SPOTS_SQL} SELECT CASE WHEN grouping(dataset) = 1 THEN 'pooled' ELSE dataset END AS dataset, l_returnflag, count(*) AS n, round(avg(discount), 6) AS mean_discount, round(quantile_cont(price, 0.5), 4) AS median_price, count(DISTINCT sample) AS samples FROM spots GROUP BY GROUPING SETS ((dataset, l_returnflag), (l_returnflag))"""
)
def pooled_and_by_dataset(t: Tables) -> DataFrame:
    """Each dataset's rows and a pooled one, by grouping sets."""
    x = t.spots().groupingSets([["dataset", "l_returnflag"], ["l_returnflag"]], "dataset", "l_returnflag").agg(
        F.when(F.grouping("dataset") == 1, "pooled").otherwise(F.col("dataset")).alias("name"), F.count(F.lit(1)).alias("n"), F.avg("discount").alias("mean_discount"),
        F.percentile("price", F.lit(0.5)).alias("median_price"), F.countDistinct("sample").alias("samples"),
    )
    return x.select(F.col("name").alias("dataset"), "l_returnflag", "n", F.round("mean_discount", 6).alias("mean_discount"), F.round("median_price", 4).alias("median_price"), "samples")


@query(
    f"""WITH {SPOTS_SQL} SELECT dataset, sample, CAST(t AS DOUBLE) AS threshold, count(*) AS n, count(*) FILTER (quantity >= t) AS n_above, round(count(*) FILTER (quantity >= t) / count(*), 6) AS fraction_above
    FROM spots CROSS JOIN (VALUES (10), (20), (30), (40)) v(t) GROUP BY 1, 2, 3"""
)
def threshold_sweep_by_sample(t: Tables) -> DataFrame:
    return rounded(statistics.threshold_sweep(t.spots(), BY, "quantity", (10, 20, 30, 40)))


@query(
    f"""WITH {SPOTS_SQL}, e AS (SELECT dataset, sample, min(quantity) AS lo, max(quantity) AS hi, count(*) AS total FROM spots GROUP BY 1, 2),
    b AS (SELECT dataset, sample, CAST(least(4, coalesce(floor((quantity - lo) / nullif(hi - lo, 0) * 5), 0)) AS INTEGER) AS bin, price, total FROM spots JOIN e USING (dataset, sample))
    SELECT dataset, sample, bin, count(*) AS n, round(count(*) / max(total), 6) AS fraction, round(avg(price), 4) AS mean, round(quantile_cont(price, 0.25), 4) AS q25, round(quantile_cont(price, 0.5), 4) AS median, round(quantile_cont(price, 0.75), 4) AS q75 FROM b GROUP BY 1, 2, 3"""
)
def binned_profile_by_sample(t: Tables) -> DataFrame:
    x = statistics.binned_profile(t.spots(), BY, "quantity", "price", 5)
    return x.select(*BY, "bin", "n", F.round("fraction", 6).alias("fraction"), *[F.round(c, 4).alias(c) for c in ("mean", "q25", "median", "q75")])
