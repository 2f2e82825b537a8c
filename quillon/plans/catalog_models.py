"""Queries of scores, null models and regressions, with their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import nulls, ranks, regression, scoring, similarity, spatial, statistics

from .cohort import LATTICE_SQL, PROGRAMS_SQL, SPOTS_SQL, TERMS_SQL, Tables
from .registry import BY, SIMPSON, f_sql, query, rounded

_D = lambda c: F.col(c).cast("double")
_SIG = "sig AS (SELECT p_partkey AS gene, round(greatest(-3.0, least(3.0, (CAST(p_retailprice AS DOUBLE) - 950) / 20)) / 3, 6) AS w FROM part)"


def _signature(t: Tables) -> DataFrame:
    from quillon.functions.scalars import cap_scale

    return t.part.select(F.col("p_partkey").alias("gene"), cap_scale((_D("p_retailprice") - 950) / 20).alias("w"))


@query(f"WITH {PROGRAMS_SQL}, {_SIG}, j AS (SELECT program, loading / 1000 * w AS d, w FROM programs JOIN sig USING (gene)) SELECT program, count(*) AS genes, round(sum(d), 4) + 0.0 AS raw, round(sum(d) / sum(abs(w)), 5) + 0.0 AS normalised, round(sum(CASE WHEN w > 0 THEN d ELSE 0 END), 4) AS positive, round(sum(CASE WHEN w < 0 THEN d ELSE 0 END), 4) + 0.0 AS negative FROM j GROUP BY 1")
def signature_projection(t: Tables) -> DataFrame:
    x = scoring.projected(t.programs().withColumn("x", F.col("loading") / 1000), _signature(t), "program", "gene", "x", "w")
    r = lambda c, d: (F.round(c, d) + F.lit(0.0)).alias(c)
    return x.select("program", "genes", r("raw", 4), r("normalised", 5), r("positive", 4), r("negative", 4))


#: Expression: quantity of a part by supplier, every pair that occurs; sets are the words of part types.
_EXPR = f"expr AS (SELECT l_suppkey % 2 AS s, l_suppkey AS spot, l_partkey AS gene, CAST(sum(l_quantity) AS DOUBLE) AS x FROM lineitem GROUP BY 1, 2, 3), {TERMS_SQL}"


def _expr(t: Tables) -> DataFrame:
    return t.lineitem.groupBy((F.col("l_suppkey") % 2).alias("s"), F.col("l_suppkey").alias("spot"), F.col("l_partkey").alias("gene")).agg(F.sum("l_quantity").cast("double").alias("x"))


@query(
    f"""WITH {_EXPR}, z AS (SELECT s, spot, gene, CASE WHEN stddev_pop(x) OVER w > 1e-12 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w ELSE 0 END AS z, x FROM expr WINDOW w AS (PARTITION BY s, gene)), k AS (SELECT term FROM terms JOIN (SELECT DISTINCT gene FROM expr) USING (gene) GROUP BY 1 HAVING count(DISTINCT gene) >= 3)
    SELECT s, spot, term, count(*) AS genes, round(avg(z), 5) + 0.0 AS score, round(avg(x), 5) AS mean FROM z JOIN terms USING (gene) JOIN k USING (term) GROUP BY 1, 2, 3"""
)
def set_scores(t: Tables) -> DataFrame:
    """Mean-z and mean-expression scores of gene sets."""
    a = scoring.mean_z_scores(_expr(t), t.terms(), ["s"], "spot", "gene", "x", "term")
    b = scoring.mean_scores(_expr(t), t.terms(), ["s"], "spot", "gene", "x", "term").select("s", "spot", "term", F.col("score").alias("mean"))
    return rounded(a.join(b, ["s", "spot", "term"]), 5)


@query(
    f"""WITH {_EXPR}, m AS (SELECT gene, round(avg(x), 9) AS m FROM expr GROUP BY 1), b AS (SELECT gene, CAST(floor((row_number() OVER (ORDER BY m, gene) - 1) * 10 / CAST(count(*) OVER () AS DOUBLE)) AS BIGINT) AS bin FROM m), own AS (SELECT DISTINCT term, gene, bin FROM terms JOIN b USING (gene)),
    pool AS (SELECT o.term, o.bin, b.gene FROM (SELECT DISTINCT term, bin FROM own) o JOIN b ON b.bin = o.bin WHERE NOT EXISTS (SELECT 1 FROM own x WHERE x.term = o.term AND x.gene = b.gene)), pick AS (SELECT term, gene FROM (SELECT *, row_number() OVER (PARTITION BY term, bin ORDER BY md5('ctrl|' || term || '|' || gene), gene) AS i FROM pool) WHERE i <= 5),
    a AS (SELECT s, spot, term, count(*) AS genes, avg(x) AS a FROM expr JOIN own USING (gene) GROUP BY 1, 2, 3), c AS (SELECT s, spot, term, avg(x) AS c FROM expr JOIN pick USING (gene) GROUP BY 1, 2, 3)
    SELECT s, spot, term, genes, round(a - coalesce(c, 0), 5) + 0.0 AS score FROM a LEFT JOIN c USING (s, spot, term)"""
)
def background_matched_scores(t: Tables) -> DataFrame:
    return rounded(scoring.background_scores(_expr(t), t.terms(), ["s"], "spot", "gene", "x", "term", 10, 5), 5)


@query(
    f"""WITH {SPOTS_SQL}, r AS (SELECT l_partkey AS gene, count(*) AS n, avg(discount - 0.05) / nullif(stddev_samp(discount) / sqrt(count(*)), 0) AS z, avg(price) / 10000 - 2.4 AS e FROM spots GROUP BY 1), p AS (SELECT gene, round(exp(-z * z), 12) AS p, e FROM r WHERE z IS NOT NULL), q AS (SELECT *, row_number() OVER (ORDER BY p, gene) AS i, count(*) OVER () AS n FROM p),
    b AS (SELECT gene, e, least(1, min(p * n / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM q) SELECT gene, round(q, 5) AS bh, round(e, 5) + 0.0 AS e, CASE WHEN e > 0 THEN 'UP' ELSE 'DOWN' END AS side FROM b WHERE q < 0.9 AND abs(e) > 0.1"""
)
def differential_parts(t: Tables) -> DataFrame:
    g = t.spots().groupBy(F.col("l_partkey").alias("gene")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("discount") - 0.05).alias("m"), F.stddev_samp("discount").alias("sd"), (F.avg("price") / 10000 - 2.4).alias("e"))
    z = F.col("m") / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))
    x = statistics.adjust(g.withColumn("p", F.round(F.exp(-z * z), 12)), [], "p", "gene")
    return rounded(scoring.differential(x, "bh", "e", 0.9, 0.1).select("gene", "bh", "e", "side"), 5)


@query(f"WITH {_SIG}, r AS (SELECT gene, w, row_number() OVER (ORDER BY abs(w) DESC, gene) AS i FROM sig), v AS (SELECT 'all' AS variant, w FROM r UNION ALL SELECT 'positive', w FROM r WHERE w > 0 UNION ALL SELECT 'negative', w FROM r WHERE w < 0 UNION ALL SELECT 'strongest', w FROM r WHERE i <= 50 UNION ALL SELECT 'signs', sign(w) FROM r WHERE w <> 0) SELECT variant, count(*) AS genes, count(*) FILTER (w > 0) AS positive, round(sum(abs(w)), 5) AS mass FROM v GROUP BY 1")
def signature_variants(t: Tables) -> DataFrame:
    return rounded(scoring.variant_summary(scoring.signature_variants(_signature(t), "gene", "w")), 5)


@query(f"WITH {PROGRAMS_SQL}, c AS (SELECT program, gene, loading - avg(loading) OVER (PARTITION BY program) AS x FROM programs), r AS (SELECT program, gene, round(x, 4) AS x FROM c) SELECT program, gene, round(abs(x) / sum(abs(x)) OVER (PARTITION BY program), 6) AS share, CAST(row_number() OVER (PARTITION BY program ORDER BY abs(x) DESC, gene) AS INTEGER) AS rank, CAST(sign(x) AS INTEGER) AS sign FROM r")
def coefficient_shares(t: Tables) -> DataFrame:
    p = t.programs()
    p = ranks.with_groups(p, p.groupBy("program").agg(F.avg("loading").alias("m")), ["program"]).withColumn("x", F.round(F.col("loading") - F.col("m"), 4))
    return rounded(scoring.coefficient_shares(p.select("program", "gene", "x"), ["program"], "gene", "x"))[["program", "gene", "share", "rank", "sign"]]


@query(f"WITH {_EXPR}, d AS (SELECT gene, avg(x) AS m, var_samp(x) AS v FROM expr GROUP BY 1), k AS (SELECT gene, m, v, round(v / m, 9) AS d FROM d WHERE v IS NOT NULL) SELECT gene, round(m, 5) AS mean, round(v, 4) AS variance, round(d, 5) AS dispersion, CAST(row_number() OVER (ORDER BY d DESC, gene) AS INTEGER) AS rank FROM k QUALIFY rank <= 40")
def variable_parts(t: Tables) -> DataFrame:
    x = scoring.variable_genes(_expr(t), "gene", "x", 40)
    return x.select("gene", F.round("mean", 5).alias("mean"), F.round("variance", 4).alias("variance"), F.round("dispersion", 5).alias("dispersion"), "rank")


@query(f"WITH {PROGRAMS_SQL}, g AS (SELECT program % 5 AS g, gene, count(DISTINCT program) AS owners, count(DISTINCT program % 3) AS samples, avg(loading) AS m, max(loading) AS x FROM programs GROUP BY 1, 2) SELECT g, gene, owners, samples, round(m, 3) AS mean, round(x, 3) AS largest, CAST(row_number() OVER (PARTITION BY g ORDER BY owners DESC, samples DESC, round(m, 9) DESC, x DESC, gene) AS INTEGER) AS rank FROM g QUALIFY rank <= 50")
def consensus_genes(t: Tables) -> DataFrame:
    p = t.programs().withColumn("g", F.col("program") % 5)
    return rounded(scoring.consensus_items(p, "g", "program", F.col("program") % 3, "gene", "loading"), 3)


@query(
    f"""WITH {SPOTS_SQL}, k AS (SELECT dataset, l_partkey % 40 AS gene, l_returnflag AS g, quantity AS x FROM spots), f AS (SELECT k.gene, h.g AS grp, k.g = h.g AS f, x FROM k, (SELECT DISTINCT g FROM k) h), r AS (SELECT *, rank() OVER (PARTITION BY grp, gene ORDER BY x) + (count(*) OVER (PARTITION BY grp, gene, x) - 1) / 2.0 AS r FROM f),
    t AS (SELECT grp, gene, sum(n * n * n - n) AS ties FROM (SELECT grp, gene, x, CAST(count(*) AS DOUBLE) AS n FROM f GROUP BY ALL) GROUP BY 1, 2), u AS (SELECT grp, gene, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, CAST(count(*) AS DOUBLE) AS n, sum(r) FILTER (f) - count(*) FILTER (f) * (count(*) FILTER (f) + 1) / 2.0 AS u FROM r GROUP BY 1, 2),
    z AS (SELECT grp, gene, round(sign(u - n1 * n2 / 2.0) * greatest(abs(u - n1 * n2 / 2.0) - 0.5, 0) / sqrt(CAST(n1 AS DOUBLE) * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 9) AS z FROM u JOIN t USING (grp, gene))
    SELECT grp AS g, gene, round(z, 4) + 0.0 AS z, CAST(row_number() OVER (PARTITION BY grp ORDER BY z DESC, gene) AS INTEGER) AS rank FROM z QUALIFY rank <= 10"""
)
def flag_markers(t: Tables) -> DataFrame:
    """Rank-sum markers of each group against the rest."""
    s = t.spots().select((F.col("l_partkey") % 40).alias("gene"), F.col("quantity").alias("x"), F.col("l_returnflag").alias("g"))
    return rounded(scoring.markers(s, "gene", "x", "g", 10), 4)


_HOT = "lab AS (SELECT *, value >= avg(value) OVER w + stddev_pop(value) OVER w AS hot FROM lattice WINDOW w AS (PARTITION BY sample))"


@query(
    f"""WITH {LATTICE_SQL}, {_HOT}, m AS (SELECT e.sample, src AS node, avg(value) AS m FROM edges e JOIN lattice l ON e.sample = l.sample AND dst = l.node GROUP BY 1, 2), k AS (SELECT lab.*, m.m FROM lab JOIN m USING (sample, node)), o AS (SELECT sample, avg(m) AS o, count(*) AS n FROM k WHERE hot GROUP BY 1),
    d AS (SELECT k.sample, perm, k.m, row_number() OVER (PARTITION BY k.sample, perm ORDER BY md5('subset|' || perm || '|' || node), node) AS i, o.n FROM k JOIN o ON o.sample = k.sample, range(1, 1001) p(perm)), u AS (SELECT sample, perm, avg(m) AS x FROM d WHERE i <= n GROUP BY 1, 2), a AS (SELECT sample, avg(x) AS nm, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi FROM u GROUP BY 1)
    SELECT o.sample, round(o, 4) AS value, round(nm, 4) AS null_mean, round(lo, 4) AS null_low, round(hi, 4) AS null_high, round((1 + (SELECT count(*) FROM u WHERE u.sample = o.sample AND abs(x - nm) >= abs(o - nm) - 1e-12)) / 1001.0, 4) AS p FROM o JOIN a ON a.sample = o.sample"""
)
def subset_null(t: Tables) -> DataFrame:
    """Neighbour composition of hot nodes against 1,000 random groups of their number."""
    nodes = ranks.sd_groups(t.lattice(), ["sample"], "value", "level")
    edges = spatial.lattice_edges(t.lattice(), ["sample"], "node", "row", "col")
    return rounded(nulls.subset_neighbourhood(nodes, edges, ["sample"], "node", F.col("level") == "HIGH", "value", 1000).drop("draws"), 4)


@query(
    f"""WITH {LATTICE_SQL}, {_HOT}, o0 AS (SELECT sample, node FROM lab WHERE hot), o1 AS (SELECT DISTINCT e.sample, dst AS node FROM edges e JOIN o0 ON e.sample = o0.sample AND src = node EXCEPT SELECT * FROM o0), o AS (SELECT sample, avg(value) AS o FROM o1 JOIN lattice USING (sample, node) GROUP BY 1), n AS (SELECT sample, count(*) AS n FROM o0 GROUP BY 1),
    d AS (SELECT l.sample, perm, node, row_number() OVER (PARTITION BY l.sample, perm ORDER BY md5('ring|' || perm || '|' || node), node) AS i, n FROM lattice l JOIN n ON n.sample = l.sample, range(1, 200) p(perm)), r0 AS (SELECT sample, perm, node FROM d WHERE i <= n), r1 AS (SELECT DISTINCT e.sample, perm, dst AS node FROM edges e JOIN r0 ON e.sample = r0.sample AND src = node EXCEPT SELECT * FROM r0),
    u AS (SELECT sample, perm, avg(value) AS x FROM r1 JOIN lattice USING (sample, node) GROUP BY 1, 2), a AS (SELECT sample, avg(x) AS nm FROM u GROUP BY 1) SELECT o.sample, 1 AS ring, round(o, 4) AS value, round(nm, 4) AS null_mean, round((1 + (SELECT count(*) FROM u WHERE u.sample = o.sample AND abs(x - nm) >= abs(o - nm) - 1e-12)) / 200.0, 4) AS p FROM o JOIN a ON a.sample = o.sample"""
)
def ring_null_values(t: Tables) -> DataFrame:
    """The first ring around hot nodes against rings around 39 random groups."""
    nodes = ranks.sd_groups(t.lattice(), ["sample"], "value", "level")
    edges = spatial.lattice_edges(t.lattice(), ["sample"], "node", "row", "col")
    x = nulls.ring_null(nodes, edges, ["sample"], "node", F.col("level") == "HIGH", "value", 1, 199)
    return rounded(x.select("sample", "ring", "value", "null_mean", "p"), 4)


_Z = "g AS (SELECT s_nationkey % 5 AS g, l_partkey % 400 AS gene, round(avg(l_discount) * 100 - 5, 9) AS z FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), sets AS (SELECT DISTINCT gene, gene % 7 AS name FROM g WHERE gene % 7 < 3)"


def _z(t: Tables) -> tuple[DataFrame, DataFrame]:
    g = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy((F.col("s_nationkey") % 5).alias("g"), (F.col("l_partkey") % 400).alias("gene")).agg(F.round(F.avg(_D("l_discount")) * 100 - 5, 9).alias("z"))
    return g, g.select("gene", (F.col("gene") % 7).alias("name")).where("name < 3").distinct()


@query(
    f"""WITH {_Z.replace('avg(l_discount)', 'avg(CAST(l_discount AS DOUBLE))')}, o AS (SELECT g, name, count(*) AS n, avg(z) AS o FROM g JOIN sets USING (gene) GROUP BY 1, 2), d AS (SELECT g, perm, z, row_number() OVER w AS i, avg(z) OVER (w ROWS UNBOUNDED PRECEDING) AS m FROM g, range(1, 1001) p(perm) WINDOW w AS (PARTITION BY g, perm ORDER BY md5('set|' || perm || '|' || gene), gene))
    SELECT o.g, name, n, round(o, 5) + 0.0 AS mean_z, round((1 + count(*) FILTER (abs(m) >= abs(o) - 1e-12)) / 1001.0, 4) AS p FROM o JOIN d ON d.g = o.g AND d.i = o.n GROUP BY 1, 2, 3, 4""".replace("GROUP BY 1, 2, 3, 4", "GROUP BY o.g, name, n, o")
)
def set_permutations(t: Tables) -> DataFrame:
    """Competitive set permutation."""
    g, sets = _z(t)
    x = nulls.set_permutation(g, sets, ["g"], "gene", "z", "name", 1000)
    return x.select("g", "name", "n", (F.round("mean_z", 5) + F.lit(0.0)).alias("mean_z"), F.round("p", 4).alias("p"))


@query(
    f"""WITH {_Z.replace('avg(l_discount)', 'avg(CAST(l_discount AS DOUBLE))')}, s AS (SELECT g, name, gene, CAST(sign(z) AS BIGINT) AS s FROM g JOIN sets USING (gene)), o AS (SELECT name, count(*) FILTER (abs(t) >= 3) AS genes FROM (SELECT name, gene, sum(s) AS t FROM s GROUP BY 1, 2) GROUP BY 1),
    f AS (SELECT g, perm, CASE WHEN substr(md5('flip|' || perm || '|' || g), 1, 1) < '8' THEN 1 ELSE -1 END AS f FROM (SELECT DISTINCT g FROM g), range(1, 1001) p(perm)), u AS (SELECT name, perm, count(*) FILTER (abs(t) >= 3) AS genes FROM (SELECT name, perm, gene, sum(s * f) AS t FROM s JOIN f USING (g) GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT o.name, any_value(o.genes) AS genes, round(avg(u.genes), 5) AS null_mean, round((1 + count(*) FILTER (u.genes >= o.genes)) / 1001.0, 5) AS p FROM o JOIN u ON u.name = o.name GROUP BY 1"""
)
def sign_flips(t: Tables) -> DataFrame:
    """Sample-sign-flip null of reproducible signs."""
    g, sets = _z(t)
    x = nulls.sign_flip(g.withColumn("s", F.signum("z")), sets, "g", "gene", "s", "name", 3, 1000)
    return rounded(x.select("name", "genes", "null_mean", "p"), 5)


@query(
    f"""WITH {SPOTS_SQL}, k AS (SELECT dataset, spot || '-' || l_suppkey || '-' || l_partkey || '-' || CAST(round(price * 100) AS BIGINT) AS key, l_returnflag = 'R' AS f, price AS x, discount AS y FROM spots), c AS (SELECT dataset, 0 AS perm, f, corr(x, y) AS r FROM k GROUP BY 1, 2, 3), n AS (SELECT dataset, count(*) FILTER (f) AS n FROM k GROUP BY 1),
    d AS (SELECT k.dataset, perm, x, y, row_number() OVER (PARTITION BY k.dataset, perm ORDER BY md5('gap|' || perm || '|' || key), key) <= n AS f FROM k JOIN n ON n.dataset = k.dataset, range(1, 200) p(perm)), a AS (SELECT * FROM c UNION ALL SELECT dataset, perm, f, corr(x, y) FROM d GROUP BY 1, 2, 3), g AS (SELECT dataset, perm, atanh(max(r) FILTER (f)) - atanh(max(r) FILTER (NOT f)) AS gap FROM a GROUP BY 1, 2)
    SELECT o.dataset, round(o.gap, 5) + 0.0 AS gap, round((1 + count(*) FILTER (abs(u.gap) >= abs(o.gap) - 1e-12)) / 200.0, 4) AS p FROM g o JOIN g u ON u.dataset = o.dataset AND u.perm > 0 WHERE o.perm = 0 GROUP BY o.dataset, o.gap"""
)
def correlation_gap_nulls(t: Tables) -> DataFrame:
    """Label permutation of the difference of Fisher's z."""
    rows = t.spots().withColumn("key", F.concat_ws("-", "spot", "l_suppkey", "l_partkey", F.round(F.col("price") * 100).cast("long")))
    x = nulls.correlation_gap_null(rows, ["dataset"], "key", F.col("l_returnflag") == "R", "price", "discount", 199)
    return x.select("dataset", (F.round("gap", 5) + F.lit(0.0)).alias("gap"), F.round("p", 4).alias("p"))


@query(
    f"""WITH {PROGRAMS_SQL}, real AS (SELECT DISTINCT gene FROM programs WHERE rank <= 2), pool AS (SELECT DISTINCT p_partkey AS gene FROM part WHERE p_partkey NOT IN (SELECT gene FROM real)), d AS (SELECT perm, gene, row_number() OVER (PARTITION BY perm ORDER BY md5('matched|' || perm || '|' || gene), gene) AS i FROM pool, range(1, 21) p(perm))
    SELECT CAST(perm AS INTEGER) AS perm, count(*) AS genes, round(avg(CAST(p_retailprice AS DOUBLE)), 5) AS mean FROM d JOIN part ON gene = p_partkey WHERE i <= 15 GROUP BY 1"""
)
def matched_set_means(t: Tables) -> DataFrame:
    """Size-matched random sets, the real genes excluded, and their mean values."""
    sets = nulls.matched_sets(t.part.select(F.col("p_partkey").alias("gene")), t.programs().where("rank <= 2"), "gene", 15, 20)
    x = sets.join(t.part, F.col("gene") == F.col("p_partkey")).groupBy("perm").agg(F.count(F.lit(1)).alias("genes"), F.avg(_D("p_retailprice")).alias("mean"))
    return rounded(x, 5)


@query(
    f"""WITH {PROGRAMS_SQL}, {_SIG}, r AS (SELECT gene, w, row_number() OVER (ORDER BY abs(w) DESC, gene) AS i FROM sig), v AS (SELECT d AS dropped, gene, w FROM r, (VALUES (0), (1), (5), (10)) k(d) WHERE i > d), s AS (SELECT dropped, program, sum(loading / 1000 * w) AS x FROM v JOIN programs USING (gene) GROUP BY 1, 2)
    SELECT a.dropped, count(*) AS programs, round(corr(a.x, b.x), 5) AS r FROM s a JOIN s b ON a.program = b.program AND b.dropped = 0 GROUP BY 1"""
)
def leave_top_out(t: Tables) -> DataFrame:
    """Scores without the 1, 5, 10 strongest genes against the full score."""
    v = nulls.without_top(_signature(t), "gene", "w").join(t.programs(), "gene")
    s = v.groupBy("dropped", "program").agg(F.sum(F.col("loading") / 1000 * F.col("weight")).alias("x"))
    both = s.join(s.where("dropped = 0").select("program", F.col("x").alias("y")), "program")
    x = statistics.pearson(both, ["dropped"], "x", "y")
    return x.select("dropped", F.col("n").alias("programs"), F.round("r", 5).alias("r"))


@query(
    f"""WITH {SPOTS_SQL}, g AS (SELECT dataset, sample, count(*) AS n, avg(quantity) AS mx, avg(discount) AS mz, avg(price) AS my, var_pop(quantity) AS vx, var_pop(discount) AS vz, covar_pop(quantity, discount) AS xz, covar_pop(quantity, price) AS xy, covar_pop(discount, price) AS zy, var_pop(price) AS vy FROM spots GROUP BY 1, 2),
    b AS (SELECT *, (xy * vz - zy * xz) / (vx * vz - xz * xz) AS b1, (zy * vx - xy * xz) / (vx * vz - xz * xz) AS b2 FROM g) SELECT dataset, sample, n, round(b1, 3) AS b_quantity, round(b2 / 1000, 3) + 0.0 AS b_discount_k, round((my - b1 * mx - b2 * mz) / 1000, 4) + 0.0 AS intercept_k, round((b1 * xy + b2 * zy) / vy, 5) AS r2 FROM b"""
)
def ols_by_sample(t: Tables) -> DataFrame:
    """Two-predictor least squares: the SQL solves the normal equations by hand."""
    x = regression.ols(t.spots(), BY, ["quantity", "discount"], "price")
    c = lambda i: F.get("coefficients", F.lit(i))
    return x.select(*BY, "n", F.round(c(0), 3).alias("b_quantity"), (F.round(c(1) / 1000, 3) + F.lit(0.0)).alias("b_discount_k"), (F.round(F.col("intercept") / 1000, 4) + F.lit(0.0)).alias("intercept_k"), F.round("r2", 5).alias("r2"))


@query(
    f"""WITH {SPOTS_SQL}, k AS (SELECT dataset, sample, quantity AS x, price AS y, CAST(CAST('0x' || substr(md5('fold|' || spot), 1, 8) AS BIGINT) % 5 AS INTEGER) AS f FROM spots), t AS (SELECT a.dataset, a.sample, h.f, covar_pop(x, y) / var_pop(x) AS b, avg(y) - covar_pop(x, y) / var_pop(x) * avg(x) AS a FROM k a JOIN (SELECT DISTINCT dataset, sample, f FROM k) h ON h.dataset = a.dataset AND h.sample = a.sample AND h.f <> a.f GROUP BY 1, 2, 3),
    m AS (SELECT dataset, sample, avg(y) AS m FROM k GROUP BY 1, 2) SELECT k.dataset, k.sample, count(*) AS n, round(1 - sum((y - a - b * x) ** 2) / sum((y - m) ** 2), 5) AS cv_r2 FROM k JOIN t ON t.dataset = k.dataset AND t.sample = k.sample AND t.f = k.f JOIN m ON m.dataset = k.dataset AND m.sample = k.sample GROUP BY 1, 2"""
)
def cross_validated_r2(t: Tables) -> DataFrame:
    """Five-fold pooled R2, folds by md5."""
    x = regression.cross_validated(t.spots(), BY, "spot", ["quantity"], "price")
    return rounded(x.select(*BY, "n", "cv_r2"), 5)


@query()
def ridge_ladder(t: Tables) -> DataFrame:
    """A ladder of ridge models with nested folds kept together by part (brute-forced in a test)."""
    x = t.spots().withColumn("q2", F.col("quantity") * F.col("quantity"))
    return rounded(regression.ladder(x, ["dataset"], "spot", {"tax": ["tax"], "quantity": ["tax", "quantity"], "square": ["tax", "quantity", "q2"]}, "price", [10.0**e for e in range(-4, 3)]), 6)


@query()
def elastic_net_by_dataset(t: Tables) -> DataFrame:
    """Nested elastic net over a grid of penalties and lasso shares (brute-forced in a test)."""
    return rounded(regression.cross_validated(t.spots(), ["dataset"], "spot", ["quantity", "discount", "tax"], "price", [1.0, 10.0, 100.0, 1000.0], [0.1, 0.5, 0.9], group="l_partkey"), 6)


@query()
def held_out_samples(t: Tables) -> DataFrame:
    """Leave-one-sample-out elastic net (brute-forced in a test)."""
    return rounded(regression.held_out_groups(t.spots(), "sample", ["quantity", "discount", "tax"], "price", [1.0, 10.0, 100.0], [0.1, 0.5, 0.9]), 6)


@query()
def spot_components(t: Tables) -> DataFrame:
    """Residuals on a covariate, then principal components with an anchored sign."""
    x = regression.residuals(t.spots(), BY, ["quantity"], "price", "rest").withColumns({"a": F.col("rest") / 1000, "b": F.col("discount") * 100, "c": F.col("tax") * 100})
    p = regression.principal_parts(x, BY, ["a", "b", "c"], "a")
    return p.select(*BY, "component", F.round("share", 5).alias("share"), F.round(F.abs(F.get("loadings", F.lit(0))), 4).alias("anchor"))


@query(
    f"""WITH {SPOTS_SQL}, {SIMPSON}, g AS (SELECT dataset, sample, count(*) AS n, var_pop(quantity) AS vx, var_pop(tax) AS vz, covar_pop(quantity, tax) AS xz, covar_pop(quantity, discount) AS xy, covar_pop(tax, discount) AS zy, var_pop(discount) AS vy FROM spots GROUP BY 1, 2),
    f AS (SELECT dataset, sample, n, n * (vy - xy * xy / vx) AS s, n * (vy - ((xy * vz - zy * xz) * xy + (zy * vx - xy * xz) * zy) / (vx * vz - xz * xz)) AS l FROM g), h AS (SELECT dataset, sample, n, (s - l) / (l / (n - 3)) AS f FROM f) SELECT dataset, sample, n, round(f, 4) AS f, round({f_sql('f', '1', '(n - 3)')}, 4) AS p FROM h"""
)
def nested_f_by_sample(t: Tables) -> DataFrame:
    """F test of a second predictor."""
    x = regression.nested_f(t.spots(), BY, ["quantity"], ["quantity", "tax"], "discount")
    return rounded(x.select(*BY, "n", "f", "p"), 4)


@query(
    f"""WITH k AS (SELECT c_nationkey % 5 AS g, c_custkey AS key, c_mktsegment AS l, CAST(c_acctbal AS DOUBLE) / 1000 AS x, CAST(c_custkey % 17 AS DOUBLE) AS y, row_number() OVER (PARTITION BY c_nationkey % 5 ORDER BY c_custkey) AS i FROM customer), d AS (SELECT g, perm, l, x, y, i, row_number() OVER (PARTITION BY g, perm ORDER BY md5('permanova|' || perm || '|' || key), key) AS j FROM k, range(1, 1000) p(perm)),
    a AS (SELECT g, 0 AS perm, l, x, y FROM k UNION ALL SELECT p.g, p.perm, q.l, p.x, p.y FROM d p JOIN d q ON p.g = q.g AND p.perm = q.perm AND p.i = q.j), w AS (SELECT g, perm, l, count(*) AS n, sum(x * x + y * y) - (sum(x) ** 2 + sum(y) ** 2) / count(*) AS w, sum(x) AS sx, sum(y) AS sy, sum(x * x + y * y) AS q FROM a GROUP BY 1, 2, 3),
    f AS (SELECT g, perm, CAST(sum(n) AS BIGINT) AS n, count(*) AS labels, ((sum(q) - (sum(sx) ** 2 + sum(sy) ** 2) / sum(n) - sum(w)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS f FROM w GROUP BY 1, 2) SELECT o.g, o.n, o.labels, round(o.f, 5) AS f, round((1 + count(*) FILTER (u.f >= o.f - 1e-9)) / 1000.0, 4) AS p FROM f o JOIN f u ON u.g = o.g AND u.perm > 0 WHERE o.perm = 0 GROUP BY o.g, o.n, o.labels, o.f"""
)
def segment_permanova(t: Tables) -> DataFrame:
    """Pseudo-F of a label over two-dimensional vectors with 999 permutations."""
    c = t.customer.select((F.col("c_nationkey") % 5).alias("g"), F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("l"), (_D("c_acctbal") / 1000).alias("x"), (F.col("c_custkey") % 17).cast("double").alias("y"))
    x = regression.permanova(c, ["g"], "key", "l", ["x", "y"], 999)
    return x.select("g", "n", "labels", F.round("f", 5).alias("f"), F.round("p", 4).alias("p"))
