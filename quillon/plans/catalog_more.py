"""Further report and composition queries, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import meta, ranks, reports, statistics

from .cohort import PROGRAMS_SQL, SPOTS_SQL, TERMS_SQL, Tables
from .registry import BY, CORR, query, rank_sql, rounded

_P = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_TREE = [("urgent", _P[:2], _P[2:]), ("first", _P[:1], _P[1:2]), ("rest", _P[2:3], _P[3:]), ("last", _P[3:4], _P[4:])]


@query(
    "WITH n AS (SELECT o_custkey AS id, o_orderpriority AS part, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2), f AS (SELECT id, part, n / sum(n) OVER (PARTITION BY id) AS x FROM n), b(balance, part, weight) AS (VALUES "
    + ", ".join(f"('{b}', '{p}', {w!r}::DOUBLE)" for b, plus, minus in _TREE for p, w in [*((p, (len(minus) / (len(plus) * (len(plus) + len(minus)))) ** 0.5) for p in plus), *((p, -((len(plus) / (len(minus) * (len(plus) + len(minus)))) ** 0.5)) for p in minus)])
    + "), c AS (SELECT balance, count(*) AS need FROM b GROUP BY 1) SELECT id, balance, round(CASE WHEN count(x) = any_value(need) THEN sum(weight * ln(x)) END, 6) + 0.0 AS value FROM f JOIN b USING (part) JOIN c USING (balance) GROUP BY 1, 2"
)
def order_balances(t: Tables) -> DataFrame:
    """All balances of a partition tree, from its basis."""
    n = t.orders.groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("part")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return rounded(reports.balances(ranks.share(n, ["id"], "n", "x"), reports.log_ratio_basis(t.spark, _TREE), ["id"], "part", "x"))


_TWO = f"""WITH {SPOTS_SQL}, m AS (SELECT dataset, l_partkey AS gene, l_returnflag = 'R' AS f, round(avg(discount - 0.05) * 100, 9) AS z FROM spots GROUP BY 1, 2, 3)"""


def _models(t: Tables) -> tuple[DataFrame, DataFrame]:
    m = t.spots().groupBy("dataset", F.col("l_partkey").alias("gene"), (F.col("l_returnflag") == "R").alias("f")).agg(F.round(F.avg(F.col("discount") - 0.05) * 100, 9).alias("z"))
    return m.where("f").drop("f"), m.where("not f").drop("f")


@query(_TWO + " SELECT dataset, gene, CASE WHEN b.z IS NULL THEN 'first_only' WHEN a.z IS NULL THEN 'second_only' ELSE 'shared' END AS class, sign(a.z) = sign(b.z) AS agree, round((coalesce(a.z, 0) + coalesce(b.z, 0)) / CASE WHEN a.z IS NULL OR b.z IS NULL THEN 1 ELSE sqrt(2) END, 5) + 0.0 AS z FROM (SELECT * FROM m WHERE f) a FULL JOIN (SELECT * FROM m WHERE NOT f) b USING (dataset, gene)")
def gene_models(t: Tables) -> DataFrame:
    """Two models' rows by gene: class, agreement, Stouffer's z."""
    return rounded(reports.two_model_summary(*_models(t), ["dataset", "gene"], "z"), 5)


@query(_TWO + f", j AS (SELECT dataset, a.z AS x, b.z AS y FROM m a JOIN m b USING (dataset, gene) WHERE a.f AND NOT b.f), r AS (SELECT *, {rank_sql('x', 'dataset')} AS rx, {rank_sql('y', 'dataset')} AS ry FROM j) SELECT dataset, count(*) AS n, round({CORR.format(x='x', y='y')}, 5) + 0.0 AS r, round({CORR.format(x='rx', y='ry')}, 5) + 0.0 AS rho FROM r GROUP BY 1")
def source_alignment(t: Tables) -> DataFrame:
    """Correlation of a value across two sources, joined by key."""
    a, b = _models(t)
    both = a.withColumnRenamed("z", "x").join(b.withColumnRenamed("z", "y"), ["dataset", "gene"])
    return rounded(ranks.with_groups(statistics.pearson(both, ["dataset"], "x", "y"), statistics.spearman(both, ["dataset"], "x", "y").drop("n"), ["dataset"]), 5)


@query(
    f"""WITH {PROGRAMS_SQL}, {TERMS_SQL}, g AS (SELECT DISTINCT gene FROM programs WHERE rank <= 5), f AS (SELECT term, count(*) AS found, string_agg(CAST(gene AS VARCHAR), ';' ORDER BY CAST(gene AS VARCHAR)) AS genes FROM terms JOIN g USING (gene) GROUP BY 1)
    SELECT term, count(*) AS size, coalesce(any_value(found), 0) AS found, coalesce(any_value(genes), '') AS genes, round(100.0 * coalesce(any_value(found), 0) / count(*), 5) AS percent, coalesce(any_value(found), 0) >= 20 AS scored FROM terms LEFT JOIN f USING (term) GROUP BY 1"""
)
def set_overlap_audit(t: Tables) -> DataFrame:
    """Which sets have enough genes to be scored."""
    return rounded(reports.set_audit(t.programs().where("rank <= 5"), t.terms(), "term", "gene", 20), 5)


@query(
    f"""WITH x AS (SELECT l_suppkey AS spot, CASE WHEN l_partkey % 19 = 0 THEN 'MT-' ELSE 'G' END || l_partkey AS gene, CAST(sum(l_quantity) AS DOUBLE) AS c FROM lineitem GROUP BY 1, 2), q AS (SELECT spot, sum(c) AS total, count(*) AS detected, 100 * sum(CASE WHEN starts_with(gene, 'MT-') THEN c ELSE 0 END) / sum(c) AS mito FROM x GROUP BY 1),
    j AS (SELECT s_nationkey % 5 AS g, CAST(s_acctbal AS DOUBLE) AS score, total, detected, mito FROM q JOIN supplier ON spot = s_suppkey), l AS (SELECT g, score, unnest(['total', 'detected', 'mito']) AS covariate, unnest([total, CAST(detected AS DOUBLE), mito]) AS v FROM j), r AS (SELECT g, covariate, {rank_sql('score', 'g, covariate')} AS a, {rank_sql('round(v, 9)', 'g, covariate')} AS b FROM l)
    SELECT g, covariate, count(*) AS n, round({CORR.format(x='a', y='b')}, 5) + 0.0 AS rho FROM r GROUP BY 1, 2"""
)
def confounding_screen(t: Tables) -> DataFrame:
    """Quality covariates of spots against a score."""
    # cells are added up by number and named afterwards
    x = t.lineitem.groupBy(F.col("l_suppkey").alias("spot"), "l_partkey").agg(F.sum("l_quantity").cast("double").alias("c"))
    x = x.select("spot", F.concat(F.when(F.col("l_partkey") % 19 == 0, "MT-").otherwise("G"), F.col("l_partkey").cast("string")).alias("gene"), "c")
    q = reports.quality_covariates(x, [], "spot", "gene", "c", unique=True).withColumn("mito", F.round("mito", 9))
    j = q.join(t.supplier, F.col("spot") == F.col("s_suppkey")).select((F.col("s_nationkey") % 5).alias("g"), F.col("s_acctbal").cast("double").alias("score"), "total", "detected", "mito")
    long = reports.long(j, ["g", "score"], ["total", "detected", "mito"], "covariate", "v")
    return rounded(statistics.spearman(long, ["g", "covariate"], "score", "v"), 5)


@query("WITH s AS (SELECT p_partkey, unnest(['' || p_name, p_type]) AS term, unnest([p_size / 10.0, NULL]) AS value FROM part) SELECT p_partkey, term, round(CAST(value AS DOUBLE), 3) AS value FROM s")
def annotation_rows(t: Tables) -> DataFrame:
    """`term:NES=value|term` parsed into rows."""
    text = F.concat("p_name", F.lit(":NES="), F.format_string("%.3f", F.col("p_size") / 10.0), F.lit("| "), "p_type", F.lit(" ||"))
    return rounded(t.part.select("p_partkey", F.inline(T.annotation_items(text))), 3)


_COMB = "lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)"


@query(
    f"""WITH {TERMS_SQL}, x AS (SELECT DISTINCT CASE WHEN p_retailprice > 950 THEN 'UP' ELSE 'DOWN' END AS side, p_partkey AS gene FROM part WHERE abs(p_retailprice - 950) > 30), u AS (SELECT count(*) AS universe FROM part), k AS (SELECT term, count(*) AS term_size FROM terms GROUP BY 1 HAVING count(*) BETWEEN 10 AND 500), l AS (SELECT side, count(*) AS list_size FROM x GROUP BY 1 HAVING count(*) >= 3),
    h AS (SELECT side, term, count(*) AS overlap FROM x JOIN terms USING (gene) GROUP BY 1, 2), j AS (SELECT * FROM h JOIN k USING (term) JOIN l USING (side) CROSS JOIN u),
    p AS (SELECT *, least(1, list_sum(list_transform(range(overlap, least(list_size, term_size) + 1), lambda i: exp({_COMB.format(n='term_size', k='i')} + {_COMB.format(n='(universe - term_size)', k='(list_size - i)')} - ({_COMB.format(n='universe', k='list_size')}))))) AS p FROM j),
    r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY p, term) AS i, count(*) OVER (PARTITION BY side) AS n FROM p) SELECT side, term, overlap, round(p, 5) AS p, round(least(1, min(p * n / i) OVER (PARTITION BY side ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 5) AS bh FROM r"""
)
def sided_enrichment_p(t: Tables) -> DataFrame:
    """Over-representation of both sides, terms of 10 to 500 genes."""
    price = F.col("p_retailprice").cast("double")
    x = t.part.where(F.abs(price - 950) > 30).select(F.when(price > 950, "UP").otherwise("DOWN").alias("side"), F.col("p_partkey").alias("gene"))
    found = meta.sided_enrichment(x, t.terms(), t.part.select(F.col("p_partkey").alias("gene")), "side", "gene", "term")
    return rounded(found.select("side", "term", "overlap", "p", "bh"), 5)


@query(
    f"""WITH {SPOTS_SQL}, r AS (SELECT dataset, sample, {rank_sql('price')} AS x, {rank_sql('quantity')} AS y, {rank_sql('discount')} AS z, {rank_sql('tax')} AS w FROM spots), c AS (SELECT dataset, sample, count(*) AS n, corr(x, y) AS xy, corr(x, z) AS xz, corr(x, w) AS xw, corr(y, z) AS yz, corr(y, w) AS yw, corr(z, w) AS zw FROM r GROUP BY 1, 2),
    p AS (SELECT dataset, sample, n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS a, (xw - xz * zw) / sqrt((1 - xz * xz) * (1 - zw * zw)) AS b, (yw - yz * zw) / sqrt((1 - yz * yz) * (1 - zw * zw)) AS d FROM c) SELECT dataset, sample, n, round((a - b * d) / sqrt((1 - b * b) * (1 - d * d)), 5) + 0.0 AS rho FROM p"""
)
def partial_spearman_two(t: Tables) -> DataFrame:
    """Partial rank correlation given two covariates; the SQL takes them out one after the other."""
    return rounded(statistics.partial_spearman_many(t.spots(), BY, "price", "quantity", ["discount", "tax"]).drop("p"), 5)
