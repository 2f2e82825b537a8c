"""Queries of neighbourhoods, graphs and similarity, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import ranks, similarity, spatial, statistics

from .cohort import LATTICE_SQL, PROGRAMS_SQL, SPOTS_SQL, Tables
from .registry import CORR, query, rank_sql, rounded

_L = f"WITH {LATTICE_SQL}, lab AS (SELECT CAST(p_partkey AS BIGINT) AS node, split_part(p_type, ' ', 1) AS label, CAST(p_size AS DOUBLE) AS size FROM part), n AS (SELECT * FROM lattice JOIN lab USING (node))"


def _grid(t: Tables) -> tuple[DataFrame, DataFrame]:
    lab = t.part.select(F.col("p_partkey").cast("long").alias("node"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("label"), F.col("p_size").cast("double").alias("size"))
    nodes = t.lattice().join(lab, "node")
    return nodes, spatial.lattice_edges(t.lattice(), ["sample"], "node", "row", "col")


_NEAR = "e AS (SELECT edges.sample, src, dst, s.label AS sl, d.label AS dl, d.value, d.size FROM edges JOIN n s ON s.sample = edges.sample AND s.node = src JOIN n d ON d.sample = edges.sample AND d.node = dst)"


@query(
    f"""{_L}, {_NEAR}, a AS (SELECT sample, src, avg(value) AS v, avg(size) AS s FROM e WHERE sl = 'ECONOMY' GROUP BY 1, 2), b AS (SELECT sample, src, avg(value) AS v, avg(size) AS s FROM e WHERE sl = 'ECONOMY' AND dl <> 'ECONOMY' GROUP BY 1, 2)
    SELECT sample, 'all' AS scope, count(*) AS nodes, round(avg(v), 5) AS mean_value, round(avg(s), 5) AS mean_size FROM a GROUP BY 1 UNION ALL SELECT sample, 'outside', count(*), round(avg(v), 5), round(avg(s), 5) FROM b GROUP BY 1"""
)
def group_neighbourhoods(t: Tables) -> DataFrame:
    """Neighbour composition of one label, with and without neighbours of that label."""
    nodes, edges = _grid(t)
    one = lambda scope: spatial.group_neighbourhood(nodes, edges, ["sample"], "node", F.col("label") == "ECONOMY", ["value", "size"], scope == "outside").withColumn("scope", F.lit(scope))
    return rounded(one("all").unionByName(one("outside")), 5)


_TOP = "r0 AS (SELECT sample, node FROM (SELECT *, avg(value) OVER w + stddev_pop(value) OVER w AS least FROM lattice WINDOW w AS (PARTITION BY sample)) WHERE value >= least)"


@query(
    f"""{_L}, {_TOP}, r1 AS (SELECT e.sample, dst AS node FROM edges e JOIN r0 ON e.sample = r0.sample AND src = node EXCEPT SELECT * FROM r0), r2 AS (SELECT e.sample, dst AS node FROM edges e JOIN r1 ON e.sample = r1.sample AND src = node EXCEPT SELECT * FROM r1 EXCEPT SELECT * FROM r0),
    r AS (SELECT *, 0 AS ring FROM r0 UNION ALL SELECT *, 1 FROM r1 UNION ALL SELECT *, 2 FROM r2), v AS (SELECT sample, node, value / 1000 / (1 - size / 51) AS x FROM n WHERE 1 - size / 51 >= 0.05)
    SELECT sample, ring, count(*) AS nodes, round(avg(x), 5) AS mean_x FROM r JOIN v USING (sample, node) GROUP BY 1, 2"""
)
def ring_compositions(t: Tables) -> DataFrame:
    """Mean values of rings around high nodes, rescaled to what another part leaves."""
    nodes, edges = _grid(t)
    nodes = nodes.withColumn("x", F.col("value") / 1000).withColumn("rest", F.col("size") / 51)
    seeds = ranks.sd_groups(nodes, ["sample"], "value", "level").where("level = 'HIGH'")
    return rounded(spatial.ring_composition(nodes, edges, ["sample"], "node", seeds, 2, ["x"], "rest"), 5)


@query(
    f"""{_L}, l AS (SELECT DISTINCT label FROM n), z AS (SELECT sample, node, l.label, CAST(n.label = l.label AS DOUBLE) AS x FROM n, l), m AS (SELECT *, x - avg(x) OVER (PARTITION BY sample, label) AS z FROM z), b AS (SELECT sample, label, count(*) AS n, sum(z * z) AS zz, CAST(sum(x) AS BIGINT) AS size FROM m GROUP BY 1, 2),
    w AS (SELECT a.sample, a.label, count(*) AS w, sum(a.z * c.z) AS ab FROM edges e JOIN m a ON a.sample = e.sample AND a.node = src JOIN m c ON c.sample = e.sample AND c.node = dst AND c.label = a.label GROUP BY 1, 2), i AS (SELECT sample, label, size, n / CAST(w AS DOUBLE) * ab / zz AS i FROM b JOIN w USING (sample, label) WHERE size > 0)
    SELECT sample, label, size, round(i, 5) + 0.0 AS moran_i FROM i UNION ALL SELECT sample, 'mean', CAST(sum(size) AS BIGINT), round(sum(size * i) / sum(size), 5) + 0.0 FROM i GROUP BY 1"""
)
def label_morans(t: Tables) -> DataFrame:
    """Moran's I of every label's map and the size-weighted mean."""
    nodes, edges = _grid(t)
    found = spatial.label_moran(nodes, edges, ["sample"], "node", "label")
    mean = spatial.mean_label_moran(found, ["sample"]).select("sample", F.lit("mean").alias("label"), "moran_i")
    total = found.where("moran_i is not null").groupBy("sample").agg(F.sum("size").alias("size"))
    return rounded(found.unionByName(mean.join(total, "sample").select("sample", "label", "size", "moran_i")), 5)


_GI = """v AS (SELECT sample, count(*) AS n, avg(value) AS m, stddev_pop(value) AS s FROM lattice GROUP BY 1), a AS (SELECT * FROM edges UNION ALL SELECT sample, node, node FROM lattice), g AS (SELECT a.sample, src, sum(value) AS sx, CAST(count(*) AS DOUBLE) AS w FROM a JOIN lattice l ON a.sample = l.sample AND dst = node GROUP BY 1, 2),
    gi AS (SELECT sample, src AS node, (sx - m * w) / (s * sqrt((n * w - w * w) / (n - 1))) AS gi FROM g JOIN v USING (sample)), top AS (SELECT sample, node FROM (SELECT *, quantile_cont(value, 0.7) OVER (PARTITION BY sample) AS q FROM lattice) WHERE value >= q)"""


def _calls(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = _grid(t)
    gi = spatial.gi_calls(spatial.getis_ord(nodes, edges, ["sample"], "node", "value"), 1.0)
    cut = nodes.groupBy("sample").agg(F.percentile("value", F.lit(0.7)).alias("q"))
    return gi, ranks.with_groups(nodes, cut, ["sample"]).where("value >= q"), nodes


@query(f"{_L}, {_GI} SELECT sample, node, round(gi, 5) + 0.0 AS gi_star, CASE WHEN gi > 1.959963984540054 THEN 'hot' WHEN gi < -1.959963984540054 THEN 'cold' ELSE 'none' END AS call FROM gi")
def gi_hot_and_cold(t: Tables) -> DataFrame:
    return rounded(spatial.gi_calls(spatial.getis_ord(*_grid(t), ["sample"], "node", "value")), 5)


@query(f"{_L}, {_GI} SELECT sample, node FROM gi WHERE gi > 1 INTERSECT SELECT * FROM top INTERSECT SELECT sample, node FROM n WHERE size > 10")
def consensus_hotspots(t: Tables) -> DataFrame:
    gi, top, nodes = _calls(t)
    return spatial.consensus(gi.where("call = 'hot'"), top, nodes.where("size > 10"), ["sample", "node"])


@query(f"{_L}, {_GI}, x AS (SELECT sample, node, true AS a FROM gi WHERE gi > 1), j AS (SELECT sample, x.a IS NOT NULL AS a, y.b IS NOT NULL AS b FROM x FULL JOIN (SELECT *, true AS b FROM top) y USING (sample, node)) SELECT sample, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS both, round(count(*) FILTER (a AND b) / count(*), 6) AS jaccard FROM j GROUP BY 1")
def hotspot_methods(t: Tables) -> DataFrame:
    """Agreement of two hot-spot calls."""
    gi, top, _ = _calls(t)
    return rounded(spatial.call_agreement(gi.where("call = 'hot'"), top, ["sample"], ["sample", "node"]))


@query(
    f"""{_L}, d AS (SELECT a.sample, a.node, a.label AS component, k.t AS target, min(sqrt((a."row" - b."row") ** 2 * 3 + (a.col - b.col) ** 2)) AS d FROM n a JOIN (VALUES ('x'), ('y')) k(t) ON true JOIN n b ON a.sample = b.sample AND (k.t = 'x' AND b.size <= 5 OR k.t = 'y' AND b.size >= 46) WHERE a.size BETWEEN 6 AND 45 GROUP BY 1, 2, 3, 4),
    c AS (SELECT sample, component, target, quantile_cont(d, 0.5) AS m FROM d GROUP BY 1, 2, 3), s AS (SELECT sample, avg(m) FILTER (target = 'x') AS a, avg(m) FILTER (target = 'y') AS b FROM c GROUP BY 1) SELECT sample, round(a, 5) AS first, round(b, 5) AS second, round(a - b, 5) + 0.0 AS difference FROM s"""
)
def distance_contrasts(t: Tables) -> DataFrame:
    """Distances of labels' nodes to two kinds of targets: component medians, then the samples' differences."""
    nodes, _ = _grid(t)
    p = nodes.withColumn("x", F.col("col").cast("double")).withColumn("y", F.col("row").cast("double") * 3.0**0.5)
    own = p.where("size between 6 and 45")
    d = lambda where, name: spatial.nearest_target(own, p.where(where), ["sample"], "node", "x", "y", 4.0).withColumn("target", F.lit(name))
    both = d("size <= 5", "x").unionByName(d("size >= 46", "y")).join(nodes.select("sample", "node", F.col("label").alias("component")), ["sample", "node"])
    return rounded(spatial.distance_contrast(spatial.component_distances(both, ["sample"], "component", "target"), ["sample"], "target", "x", "y"), 5)


@query(f"{_L}, m AS (SELECT e.sample, src AS node, round(avg(value), 9) AS m FROM edges e JOIN lattice l ON e.sample = l.sample AND dst = node GROUP BY 1, 2), r AS (SELECT sample, {rank_sql('value', 'sample')} AS a, {rank_sql('m', 'sample')} AS b FROM m JOIN lattice USING (sample, node)) SELECT sample, count(*) AS n, round({CORR.format(x='a', y='b')}, 5) + 0.0 AS rho FROM r GROUP BY 1")
def self_neighbour_rho(t: Tables) -> DataFrame:
    nodes, edges = _grid(t)
    return rounded(spatial.self_neighbour_correlation(nodes, edges, ["sample"], "node", "value"), 5)


@query(
    f"""{_L}, m AS (SELECT e.sample, src AS node, round(avg(d.value), 9) AS m FROM edges e JOIN n d ON e.sample = d.sample AND dst = d.node GROUP BY 1, 2), j AS (SELECT sample, label, size AS x, m FROM m JOIN n USING (sample, node)), r AS (SELECT *, {rank_sql('x', 'sample, label')} AS a, {rank_sql('m', 'sample, label')} AS b FROM j)
    SELECT sample, label, count(*) AS n, round({CORR.format(x='x', y='m')}, 5) + 0.0 AS r, round({CORR.format(x='a', y='b')}, 5) + 0.0 AS rho FROM r GROUP BY 1, 2"""
)
def ring_correlations(t: Tables) -> DataFrame:
    """Centre against ring-1 mean, by source group."""
    nodes, edges = _grid(t)
    return rounded(spatial.ring_correlation(nodes, edges, ["sample"], "node", "label", "size", "value"), 5)


_FIT = """f AS (SELECT l_suppkey % 20 AS item, CAST(floor(quantity / 10.001) AS INTEGER) AS seg, covar_pop(quantity, price / 1000) / var_pop(quantity) AS slope, avg(price / 1000) - covar_pop(quantity, price / 1000) / var_pop(quantity) * avg(quantity) AS icpt FROM spots GROUP BY 1, 2)"""


def _fits(t: Tables) -> DataFrame:
    s = t.spots().select((F.col("l_suppkey") % 20).alias("item"), F.floor(F.col("quantity") / 10.001).cast("int").alias("seg"), "quantity", (F.col("price") / 1000).alias("y"))
    return statistics.linear_fit(s, ["item", "seg"], "quantity", "y")


@query(f"WITH {SPOTS_SQL}, {_FIT}, r AS (SELECT item, seg, round(slope, 9) AS slope FROM f), c AS (SELECT seg, quantile_cont(abs(slope), 0.9) AS cut FROM r GROUP BY 1), k AS (SELECT item, r.seg, slope, CASE WHEN abs(slope) >= cut AND slope <> 0 THEN CASE WHEN slope > 0 THEN 'rising' ELSE 'falling' END ELSE 'flat' END AS class FROM r JOIN c ON r.seg = c.seg) SELECT item, seg, round(slope, 5) + 0.0 AS slope, class, CAST(row_number() OVER (PARTITION BY seg, class ORDER BY abs(slope) DESC, item) AS INTEGER) AS rank FROM k")
def slope_class_ranks(t: Tables) -> DataFrame:
    return rounded(spatial.slope_classes(_fits(t).select("item", "seg", F.round("slope", 9).alias("slope")), ["seg"], "item", "slope"), 5)


@query(f"WITH {SPOTS_SQL}, {_FIT}, j AS (SELECT item, seg, round(slope * 10 * seg + icpt - (lag(slope) OVER w * 10 * seg + lag(icpt) OVER w), 9) AS jump FROM f WINDOW w AS (PARTITION BY item ORDER BY seg)) SELECT item, seg, round(jump, 4) + 0.0 AS jump, abs(jump) >= (SELECT quantile_cont(abs(jump), 0.9) FROM j) AS discontinuous FROM j WHERE jump IS NOT NULL")
def segment_jumps(t: Tables) -> DataFrame:
    fits = _fits(t).withColumn("at", F.col("seg") * 10.0)
    found = spatial.discontinuities(fits, ["item"], "seg", "at")
    return rounded(found.select("item", "seg", "jump", "discontinuous"), 4)


_PAIRS = f"""WITH {PROGRAMS_SQL}, o AS (SELECT DISTINCT program FROM programs), j30 AS (SELECT a.program AS a, b.program AS b, count(*) AS s FROM programs a JOIN programs b ON a.gene = b.gene AND a.program < b.program GROUP BY 1, 2), j10 AS (SELECT a.program AS a, b.program AS b, count(*) AS s FROM programs a JOIN programs b ON a.gene = b.gene AND a.program < b.program WHERE a.rank <= 10 AND b.rank <= 10 GROUP BY 1, 2),
    z AS (SELECT program, count(*) AS n, count(*) FILTER (rank <= 10) AS n10 FROM programs GROUP BY 1), m AS (SELECT x.program AS a, y.program AS b, coalesce(j30.s, 0) / CAST(x.n + y.n - coalesce(j30.s, 0) AS DOUBLE) AS j30, coalesce(j10.s, 0) / CAST(x.n10 + y.n10 - coalesce(j10.s, 0) AS DOUBLE) AS j10 FROM z x JOIN z y ON x.program < y.program LEFT JOIN j30 ON j30.a = x.program AND j30.b = y.program LEFT JOIN j10 ON j10.a = x.program AND j10.b = y.program)"""


def _metrics(t: Tables) -> DataFrame:
    """Two top-N Jaccard indices of the pairs that share an item; the others are 0 in both, under any cut."""
    p = ranks.settled(t.programs())
    j = lambda n: similarity.set_overlaps(p.where(F.col("rank") <= n), [], "program", "gene").select("a", "b", F.col("jaccard").alias(f"j{n}"))
    return j(30).join(j(10), ["a", "b"], "left").na.fill(0.0, ["j10"])


@query(_PAIRS + " SELECT 'j30' AS metric, count(*) AS pairs, round(min(j30), 6) AS least, round(quantile_cont(j30, 0.5), 6) AS median, round(avg(j30), 6) AS mean, round(max(j30), 6) AS greatest, round(avg(CAST(j30 = 0 AS DOUBLE)), 6) AS zero_share FROM m UNION ALL SELECT 'j10', count(*), round(min(j10), 6), round(quantile_cont(j10, 0.5), 6), round(avg(j10), 6), round(max(j10), 6), round(avg(CAST(j10 = 0 AS DOUBLE)), 6) FROM m")
def pair_summaries(t: Tables) -> DataFrame:
    """Off-diagonal distribution of two top-N Jaccard tables, pairs that share nothing included."""
    lists = t.programs().withColumn("metric", F.explode(F.array(F.lit("j30"), F.lit("j10")))).where((F.col("metric") == "j30") | (F.col("rank") <= 10))
    found = similarity.set_overlaps(lists, ["metric"], "program", "gene")
    # owners of the longer list are owners of both
    owners = t.programs().select("program", F.explode(F.array(F.lit("j30"), F.lit("j10"))).alias("metric"))
    return rounded(similarity.pair_summary(found, ["metric"], "jaccard", owners, "program"))


@query(_PAIRS + " SELECT a, b, CAST((j10 >= 0.05) AS INTEGER) AS met FROM m WHERE j30 >= 0.03 AND j10 >= 0.05")
def robust_program_edges(t: Tables) -> DataFrame:
    """Edges that two metrics confirm."""
    return similarity.robust_edges(_metrics(t), [], {"j30": 0.03, "j10": 0.05}, "j30", 1)


@query(
    """WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey + 7 AS b, s_nationkey FROM supplier WHERE s_acctbal > 2000), ab AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(n, m) AS (SELECT a, a FROM ab UNION SELECT r.n, ab.b FROM reach r JOIN ab ON r.m = ab.a), c AS (SELECT n AS node, min(m) AS component FROM reach GROUP BY 1),
    x AS (SELECT component, count(*) AS members, count(DISTINCT s_nationkey) AS samples, count(DISTINCT s_suppkey % 3) AS kinds FROM c JOIN supplier ON node = s_suppkey GROUP BY 1)
    SELECT component, members, samples, kinds, CASE WHEN members < 2 THEN 'singleton' WHEN samples >= 3 THEN 'recurs_across_samples' WHEN kinds >= 3 THEN 'recurs_across_kinds' ELSE 'not_recurrent' END AS reason, CASE WHEN members < 2 THEN false ELSE samples >= 3 OR kinds >= 3 END AS kept FROM x"""
)
def retained_components(t: Tables) -> DataFrame:
    """Retention rules on components of a supplier graph."""
    e = t.supplier.where("s_acctbal > 2000").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 7).alias("b"))
    c = similarity.components(e).join(t.supplier.select(F.col("s_suppkey").alias("node"), "s_nationkey", (F.col("s_suppkey") % 3).alias("kind")), "node")
    return similarity.retention(c, "component", "s_nationkey", "kind", 3, 3)


_CHAIN = """e AS (SELECT node AS a, dst AS b FROM edges JOIN n s ON s.sample = edges.sample AND s.node = src JOIN (SELECT sample AS ds, node AS dn, label AS dlab FROM n) ON ds = edges.sample AND dn = dst WHERE s.label = dlab), reach(n, m) AS (SELECT a, a FROM e UNION SELECT r.n, e.b FROM reach r JOIN e ON r.m = e.a), c AS (SELECT n AS node, min(m) AS component FROM reach GROUP BY 1)"""


@query(_L.replace("WITH ", "WITH RECURSIVE ", 1) + f', {_CHAIN}, k AS (SELECT n.*, coalesce(component, n.node) AS component FROM n LEFT JOIN c ON c.node = n.node) SELECT label, component, count(*) AS size, round(avg("row"), 5) AS row_centre, round(avg(col), 5) AS column_centre FROM k GROUP BY 1, 2 HAVING count(*) >= 3')
def label_patches(t: Tables) -> DataFrame:
    """Connected patches of equal label with size and centroid."""
    nodes, edges = _grid(t)
    return rounded(similarity.mask_components(edges.select("src", "dst"), nodes, "node", "label", "row", "col"), 5)


@query(_L.replace("WITH ", "WITH RECURSIVE ", 1) + f", {_CHAIN}, k AS (SELECT coalesce(component, n.node) AS component, count(*) AS s FROM n LEFT JOIN c ON c.node = n.node GROUP BY 1) SELECT CAST(sum(s) AS BIGINT) AS nodes, count(*) AS components, round(max(s) / sum(s), 6) AS largest_share FROM k")
def graph_connectivity(t: Tables) -> DataFrame:
    nodes, edges = _grid(t)
    l = nodes.select("node", "label")  # noqa: E741
    own = edges.join(l.withColumnRenamed("node", "src"), "src").join(l.select(F.col("node").alias("dst"), F.col("label").alias("to")), "dst").where("label = to")
    return rounded(similarity.connectivity(own.select(F.col("src").alias("a"), F.col("dst").alias("b")), nodes, "node"))
