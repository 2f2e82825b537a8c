"""Variable features, residuals, components, programs, maps and nulls of smoothness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import factors, nulls, ranks, regression, scoring, similarity, spatial

from .cohort import LATTICE_SQL, PROGRAMS_SQL, Tables
from .registry import query, rounded

_D = lambda c: F.col(c).cast("double")


def _counts(t: Tables) -> DataFrame:
    """Quantities of parts by supplier: suppliers as nodes, parts as features."""
    return t.lineitem.select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("feature"), _D("l_quantity").alias("x"))


_CELLS = "c AS (SELECT l_suppkey AS node, l_partkey AS feature, sum(CAST(l_quantity AS DOUBLE)) AS x FROM lineitem GROUP BY 1, 2)"
_DET = "({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _det(*m: str) -> str:
    return _DET.format(**dict(zip("abcdefghi", m, strict=True)))


@query(
    f"""WITH {_CELLS}, n AS (SELECT CAST(count(DISTINCT node) AS DOUBLE) AS n FROM c), g AS (SELECT feature, n, sum(x) / n AS mean, (sum(x * x) - sum(x) * sum(x) / n) / (n - 1) AS variance FROM c CROSS JOIN n GROUP BY feature, n),
    p AS (SELECT *, CASE WHEN mean > 0 AND variance > 1e-12 THEN log10(mean) END AS lx, CASE WHEN mean > 0 AND variance > 1e-12 THEN log10(variance) END AS ly FROM g), b AS (SELECT CAST(floor(lx / 0.1) AS INTEGER) AS bin, count(*) AS x0, sum(lx) AS x1, sum(lx ** 2) AS x2, sum(lx ** 3) AS x3, sum(lx ** 4) AS x4, sum(ly) AS y0, sum(lx * ly) AS y1, sum(lx ** 2 * ly) AS y2 FROM p WHERE lx IS NOT NULL GROUP BY 1),
    w AS (SELECT a.bin, (1 - (abs(a.bin - o.bin) / 11.0) ** 3) ** 3 AS w, o.* EXCLUDE bin FROM b a JOIN b o ON abs(a.bin - o.bin) < 11), f AS (SELECT bin, {", ".join(f"sum(w * {c}) AS {c}" for c in ("x0", "x1", "x2", "x3", "x4", "y0", "y1", "y2"))} FROM w GROUP BY 1),
    d AS (SELECT *, {_det("x0", "x1", "x2", "x1", "x2", "x3", "x2", "x3", "x4")} AS d FROM f), k AS (SELECT bin, CASE WHEN abs(d) > 1e-9 * x0 ** 3 THEN {_det("y0", "x1", "x2", "y1", "x2", "x3", "y2", "x3", "x4")} / d ELSE y0 / x0 END AS c0, CASE WHEN abs(d) > 1e-9 * x0 ** 3 THEN {_det("x0", "y0", "x2", "x1", "y1", "x3", "x2", "y2", "x4")} / d ELSE 0 END AS c1, CASE WHEN abs(d) > 1e-9 * x0 ** 3 THEN {_det("x0", "x1", "y0", "x1", "x2", "y1", "x2", "x3", "y2")} / d ELSE 0 END AS c2 FROM d),
    t AS (SELECT p.*, c0 + c1 * lx + c2 * lx * lx AS trend FROM p LEFT JOIN k ON k.bin = floor(lx / 0.1)), v AS (SELECT t.feature, n, mean, variance, trend, sum(least(x, mean + sqrt(10 ** trend) * sqrt(n))) AS s, sum(least(x, mean + sqrt(10 ** trend) * sqrt(n)) ** 2) AS q FROM t JOIN c ON c.feature = t.feature GROUP BY 1, 2, 3, 4, 5),
    r AS (SELECT *, coalesce((n * mean * mean + q - 2 * mean * s) / ((n - 1) * 10 ** trend), 0) AS y FROM v) SELECT feature, round(mean, 5) AS mean, round(variance, 4) AS variance, round(trend, 5) + 0.0 AS trend, round(y, 5) AS variability, CAST(row_number() OVER (ORDER BY round(y, 9) DESC, feature) AS BIGINT) AS rank FROM r"""
)
def trended_parts(t: Tables) -> DataFrame:
    """Variable features by a local quadratic trend of variance over mean."""
    x = factors.variable_features(_counts(t), "node", "feature", "x")
    return x.select("feature", F.round("mean", 5).alias("mean"), F.round("variance", 4).alias("variance"), (F.round("trend", 5) + F.lit(0.0)).alias("trend"), F.round("variability", 5).alias("variability"), "rank")


@query(
    f"""WITH {_CELLS}, r AS (SELECT node, sum(x) AS r FROM c GROUP BY 1), g AS (SELECT feature, sum(x) AS c FROM c GROUP BY 1), w AS (SELECT sum(r) AS t, CAST(count(*) AS DOUBLE) AS n FROM r), a AS (SELECT g.feature, g.c, n, r.r * g.c / t AS m, coalesce(x, 0) AS x FROM g CROSS JOIN r CROSS JOIN w LEFT JOIN c ON c.node = r.node AND c.feature = g.feature),
    z AS (SELECT feature, c, n, greatest(least((x - m) / sqrt(m + m * m / 100.0), sqrt(n)), -sqrt(n)) AS z FROM a) SELECT feature, round(c, 5) AS total, round(sum(z * z), 4) AS squares, round(sum(z * z) / n - (sum(z) / n) ** 2, 5) AS variance FROM z GROUP BY feature, c, n"""
)
def part_residuals(t: Tables) -> DataFrame:
    """Variance of analytic Pearson residuals by part; the SQL writes out every cell."""
    x = factors.residual_variance(_counts(t), "node", "feature", "x")
    return x.select("feature", F.round("total", 5).alias("total"), F.round("squares", 4).alias("squares"), F.round("variance", 5).alias("variance"))


def _brands(t: Tables) -> DataFrame:
    """Quantities of brands by customer."""
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = t.lineitem.join(part, "l_partkey").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return rows.select(F.col("o_custkey").alias("node"), F.col("p_brand").alias("feature"), _D("l_quantity").alias("x"))


@query()
def customer_components(t: Tables) -> DataFrame:
    """Components of customers by the brands they buy, scaled to unit variance (held against numpy in a test)."""
    at, _ = factors.principal_components(_brands(t), "node", "feature", "x", 5)
    return rounded(at, 5)


@query()
def customer_programs(t: Tables) -> DataFrame:
    """Consensus programs of brands by non-negative factorisation, for two numbers of programs (held against planted ones in a test)."""
    _, loads, _ = factors.programs(_brands(t), "node", "feature", "x", (3, 4), 8, 30, density=2.0)
    return rounded(loads, 5)


@query()
def program_map(t: Tables) -> DataFrame:
    """Programs in the plane by 1 - Jaccard (held against planted points in a test)."""
    pairs = similarity.set_overlaps(t.programs(), [], "program", "gene").select("a", "b", (1.0 - F.col("jaccard")).alias("d"))
    return rounded(factors.distance_scaling(pairs, t.programs(), "program", "d"), 4)


_TIMES = 199
_DEALT = f"""k AS (SELECT c_nationkey % 5 AS g, c_custkey AS key, CAST(c_mktsegment = 'BUILDING' AS INTEGER)::DOUBLE AS m, CAST(c_acctbal AS DOUBLE) / 1000 AS x, CAST(c_custkey % 17 AS DOUBLE) AS y, CAST(c_custkey % 11 AS DOUBLE) AS c FROM customer)"""


@query(
    f"""WITH {_DEALT}, a AS (SELECT g, avg(m) AS am, avg(x) AS ax, avg(y) AS ay, avg(c) AS ac FROM k GROUP BY 1), z AS (SELECT k.g, key, m - am AS m, x - ax AS x, y - ay AS y, c - ac AS c FROM k JOIN a ON k.g = a.g), s AS (SELECT g, sum(c * m) / sum(c * c) AS bm, sum(c * x) / sum(c * c) AS bx, sum(c * y) / sum(c * c) AS bv FROM z GROUP BY 1),
    e AS (SELECT z.g, key, m - bm * c AS m, x - bx * c AS x, y - bv * c AS y, c, row_number() OVER (PARTITION BY z.g ORDER BY key) AS i FROM z JOIN s ON z.g = s.g), d AS (SELECT g, perm, x, y, row_number() OVER (PARTITION BY g, perm ORDER BY md5('pseudo|' || perm || '|' || key), key) AS i FROM e CROSS JOIN (SELECT p AS perm FROM range(1, {_TIMES + 1}) r(p))),
    u AS (SELECT g, 0 AS perm, m, c, x, y FROM e UNION ALL SELECT e.g, perm, m, c, d.x, d.y FROM e JOIN d ON e.g = d.g AND e.i = d.i), t AS (SELECT g, perm, count(*) AS n, sum(x * x + y * y) - (sum(x * c) ** 2 + sum(y * c) ** 2) / sum(c * c) AS small, (sum(x * m) ** 2 + sum(y * m) ** 2) / sum(m * m) AS effect FROM u GROUP BY 1, 2),
    f AS (SELECT *, effect / ((small - effect) / (n - 3)) AS f FROM t) SELECT o.g, o.n, 'group_plus_covariate' AS mode, round(o.f, 5) AS f, round(o.effect / o.small, 6) AS r2, round((1 + count(*) FILTER (p.f >= o.f - 1e-9)) / {_TIMES + 1}.0, 4) AS p FROM f o JOIN f p ON o.g = p.g AND p.perm > 0 WHERE o.perm = 0 GROUP BY o.g, o.n, o.f, o.effect, o.small"""
)
def segment_pseudo_f(t: Tables) -> DataFrame:
    """Pseudo-F of a segment over two values, given a covariate, with 199 permutations of residuals."""
    c = t.customer.select((F.col("c_nationkey") % 5).alias("g"), F.col("c_custkey").alias("key"), (F.col("c_mktsegment") == "BUILDING").alias("m"), (_D("c_acctbal") / 1000).alias("x"), (F.col("c_custkey") % 17).cast("double").alias("y"), (F.col("c_custkey") % 11).cast("double").alias("c"))
    x = regression.pseudo_f(c, ["g"], "key", "m", ["x", "y"], "c", _TIMES)
    return x.select("g", "n", "mode", F.round("f", 5).alias("f"), F.round("r2", 6).alias("r2"), F.round("p", 4).alias("p"))


_DRAWS = 50


@query(
    f"""WITH {LATTICE_SQL}, x AS (SELECT sample, node, l_orderkey % 40 AS gene, sum(CAST(l_quantity AS DOUBLE)) AS x FROM lattice JOIN lineitem ON l_partkey = node GROUP BY 1, 2, 3), sets AS (SELECT 'low' AS name, g AS gene FROM range(0, 6) r(g) UNION ALL SELECT 'spread', g * 5 + 9 FROM range(0, 6) r(g)), p AS (SELECT DISTINCT sample, gene FROM x),
    s AS (SELECT sample, name, count(*) AS n FROM p JOIN sets USING (gene) GROUP BY 1, 2), h AS (SELECT p.sample, s.name, s.n, perm, p.gene, row_number() OVER (PARTITION BY p.sample, s.name, perm ORDER BY md5('matched|' || perm || '|' || p.gene), p.gene) AS i FROM p JOIN s ON s.sample = p.sample LEFT JOIN sets o ON o.name = s.name AND o.gene = p.gene CROSS JOIN (SELECT p AS perm FROM range(1, {_DRAWS + 1}) r(p)) WHERE o.gene IS NULL),
    d AS (SELECT sample, name, perm, gene, n FROM h WHERE i <= n UNION ALL SELECT p.sample, s.name, 0, p.gene, s.n FROM p JOIN sets USING (gene) JOIN s ON s.sample = p.sample AND s.name = sets.name), k AS (SELECT DISTINCT sample, name, perm, n FROM d), u AS (SELECT DISTINCT sample, node FROM x), w AS (SELECT d.sample, name, perm, node, sum(x) AS v FROM d JOIN x ON x.sample = d.sample AND x.gene = d.gene GROUP BY 1, 2, 3, 4),
    v AS (SELECT k.sample, k.name, k.perm, u.node, coalesce(w.v, 0) / n AS v FROM k JOIN u ON u.sample = k.sample LEFT JOIN w ON w.sample = k.sample AND w.name = k.name AND w.perm = k.perm AND w.node = u.node), z AS (SELECT *, v - avg(v) OVER (PARTITION BY sample, name, perm) AS z FROM v),
    e AS (SELECT a.sample, a.name, a.perm, count(*) AS w, sum(a.z * b.z) AS ab FROM z a JOIN edges ON edges.sample = a.sample AND src = a.node JOIN z b ON b.sample = a.sample AND b.name = a.name AND b.perm = a.perm AND b.node = dst GROUP BY 1, 2, 3), q AS (SELECT sample, name, perm, count(*) AS n, sum(z * z) AS zz FROM z GROUP BY 1, 2, 3),
    i AS (SELECT sample, name, perm, CASE WHEN zz > 1e-12 THEN n / CAST(w AS DOUBLE) * ab / zz END AS i FROM q JOIN e USING (sample, name, perm)), o AS (SELECT * FROM i WHERE perm = 0) SELECT o.sample, o.name, count(*) AS draws, round(o.i, 5) + 0.0 AS moran_i, round(avg(i.i), 5) + 0.0 AS null_moran, round(stddev_pop(i.i), 5) AS null_moran_sd, round((1.0 + count(*) FILTER (i.i >= o.i - 1e-12)) / (1 + count(*)), 5) AS p_moran FROM o JOIN i ON i.sample = o.sample AND i.name = o.name AND i.perm > 0 AND i.i IS NOT NULL GROUP BY o.sample, o.name, o.i"""
)
def matched_smoothness(t: Tables) -> DataFrame:
    """Moran's I of set scores over the lattice of parts against as many random features; an order's key gives the feature."""
    cells = t.lineitem.groupBy(F.col("l_partkey").cast("long").alias("node"), (F.col("l_orderkey") % 40).cast("long").alias("gene")).agg(F.sum(_D("l_quantity")).alias("x")).join(t.lattice().select("sample", "node"), "node")
    sets = t.spark.range(6).select(F.explode(F.array(F.struct(F.lit("low").alias("name"), F.col("id").alias("gene")), F.struct(F.lit("spread").alias("name"), (F.col("id") * 5 + 9).alias("gene")))).alias("s")).select("s.*")
    edges = ranks.settled(spatial.lattice_edges(t.lattice(), ["sample"], "node", "row", "col"))
    x = nulls.matched_set_smoothness(cells, edges, sets, ["sample"], "node", "gene", "x", "name", _DRAWS)
    return rounded(x.select("sample", "name", "draws", "moran_i", "null_moran", "null_moran_sd", "p_moran"), 5)


@query(
    f"""WITH {LATTICE_SQL}, w AS (SELECT g AS gene, CASE WHEN g % 2 = 0 THEN 1.5 ELSE -0.5 END AS w FROM range(0, 12) r(g)), x AS (SELECT l_partkey AS spot, l_orderkey % 40 AS gene, sum(CAST(l_quantity AS DOUBLE)) AS x FROM lineitem GROUP BY 1, 2), r AS (SELECT sample, spot, count(*) AS genes, sum(w * x) / sum(abs(w)) AS raw FROM x JOIN w USING (gene) JOIN lattice ON node = spot GROUP BY 1, 2),
    n AS (SELECT sample, src AS spot, dst AS o FROM edges UNION ALL SELECT sample, spot, spot FROM r), s AS (SELECT r.sample, r.spot, any_value(r.genes) AS genes, any_value(r.raw) AS raw, avg(q.raw) AS smoothed FROM r JOIN n ON n.sample = r.sample AND n.spot = r.spot JOIN r q ON q.sample = r.sample AND q.spot = n.o GROUP BY 1, 2),
    k AS (SELECT s.*, value AS c FROM s JOIN lattice l ON l.node = s.spot), b AS (SELECT sample, covar_pop(c, smoothed) / var_pop(c) AS b, avg(c) AS mc, avg(smoothed) AS ms FROM k GROUP BY 1) SELECT k.sample, spot, genes, round(raw, 5) + 0.0 AS raw, round(smoothed, 5) + 0.0 AS smoothed, round(smoothed - ms - b * (c - mc), 5) + 0.0 AS score FROM k JOIN b ON b.sample = k.sample"""
)
def smoothed_part_scores(t: Tables) -> DataFrame:
    """A weighted score of parts, smoothed over their lattice neighbours and freed of a covariate."""
    cells = t.lineitem.groupBy(F.col("l_partkey").cast("long").alias("node"), (F.col("l_orderkey") % 40).cast("long").alias("gene")).agg(F.sum(_D("l_quantity")).alias("x")).join(t.lattice().select("sample", "node"), "node")
    weights = t.spark.range(12).select(F.col("id").alias("gene"), F.when(F.col("id") % 2 == 0, 1.5).otherwise(-0.5).alias("w"))
    edges = ranks.settled(spatial.lattice_edges(t.lattice(), ["sample"], "node", "row", "col"))
    x = scoring.smoothed_scores(cells, weights, edges, ["sample"], "node", "gene", "x", "w", ["value"], t.lattice())
    return rounded(x.withColumnRenamed("node", "spot"), 5)


@query(
    f"""WITH {PROGRAMS_SQL}, f AS (SELECT s_suppkey AS program, CAST(s_nationkey % 8 AS INTEGER) AS family FROM supplier), m AS (SELECT DISTINCT f.program, family FROM f JOIN programs USING (program)), g AS (SELECT a.program AS a, b.program AS b, a.family AS fa, b.family AS fb FROM m a JOIN m b ON a.program <> b.program), s AS (SELECT a.program AS a, b.program AS b, count(*) / 30.0 AS s FROM programs a JOIN programs b ON a.gene = b.gene AND a.program <> b.program GROUP BY 1, 2),
    v AS (SELECT g.a, fa = fb AS own, coalesce(s, 0) AS s FROM g LEFT JOIN s ON s.a = g.a AND s.b = g.b), z AS (SELECT family, count(*) AS members FROM m GROUP BY 1) SELECT m.family, m.program AS node, any_value(members) AS members, round(quantile_cont(s, 0.5) FILTER (own), 6) AS within, round(quantile_cont(s, 0.5) FILTER (NOT own), 6) AS outside FROM m JOIN z USING (family) LEFT JOIN v ON v.a = m.program GROUP BY 1, 2"""
)
def family_coherence(t: Tables) -> DataFrame:
    """Medians of each program's overlap shares within its family and with the others."""
    p = t.programs()
    pairs = similarity.set_overlaps(p, [], "program", "gene").select("a", "b", (F.col("shared") / F.lit(30.0)).alias("share"))
    families = t.supplier.select(F.col("s_suppkey").alias("program"), (F.col("s_nationkey") % 8).cast("int").alias("family")).join(p.select("program").distinct(), "program")
    return rounded(similarity.family_coherence(pairs, families, "program", "family", "share"))
