"""Lattice and nearest-neighbour operators over (by.., node) tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.hashes import Md5Order
from quillon.functions.scalars import finite, ratio

from .ranks import any_group_name, centred_of, discard, over, scaled, settled, top_n, with_groups, z_score
from .statistics import finite_rows, pearson, spearman

#: Offsets of the six neighbours on a hexagonal lattice whose columns go in steps of two.
HEX = ((0, -2), (0, 2), (-1, -1), (-1, 1), (1, -1), (1, 1))


@any_group_name
def lattice_edges(nodes: DataFrame, by: Sequence[str], node: str, row: str, column: str, offsets=HEX) -> DataFrame:
    """(by.., src, dst) of nodes whose coordinates differ by an offset: one join, merged, for nodes are small as files and would go through the driver."""
    near = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets]))
    left = nodes.select(*by, F.col(node).alias("src"), F.col(row).alias("_r"), F.col(column).alias("_c"), near.alias("o")).select(*by, "src", (F.col("_r") + F.col("o.r")).alias("_r"), (F.col("_c") + F.col("o.c")).alias("_c"))
    right = nodes.select(*by, F.col(node).alias("dst"), F.col(row).alias("_r"), F.col(column).alias("_c"))
    return left.hint("merge").join(right, [*by, "_r", "_c"]).select(*by, "src", "dst")


def _near(sources: DataFrame, targets: DataFrame, by: Sequence[str], k: int, cell: float) -> DataFrame:
    """(by.., src, dst, rank, d2): the k nearest targets (by.., dst, x, y) of each source (by.., src, x0, y0), exactly.

    Looked for in the 3 x 3 cells around a source: exact if k lie within the cell. The sources that have fewer
    go on with twice the cell, until it spans the group; every round's table is checkpointed. The first cell is `cell` or what
    makes a target's cell hold few targets, if that is less, so a source meets about as many in dense tables as in sparse ones.
    Of targets at one place only the k + 1 first can be among the k nearest. Joins are merged: written tables of
    ids are small files, and a broadcast of them would go through the driver.
    """
    targets = settled(top_n(targets, [*by, "x", "y"], [F.col("dst")], k + 1, "_place").drop("_place"))
    few, shrunk = 4.0 * (k + 1), 0
    while shrunk < 8:
        held = targets.groupBy(*by, F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)).agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
        if held <= 2 * few:
            break
        cell, shrunk = cell * max((few / held) ** 0.5, 1 / 16), shrunk + 1
    sources = settled(sources)
    at = lambda x, y, c: [F.floor(F.col(x) / c).alias("cx"), F.floor(F.col(y) / c).alias("cy")]
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    ends = targets.select(*by, "x", "y").union(sources.select(*by, "x0", "y0")).groupBy(*by).agg(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("d")).agg(F.max("d")).first()[0] or 0.0
    d2 = (F.col("x") - F.col("x0")) ** 2 + (F.col("y") - F.col("y0")) ** 2
    rest, found = sources, None
    while True:
        left = rest.select(*by, "src", "x0", "y0", *at("x0", "y0", cell)).withColumn("_s", steps).select(*by, "src", "x0", "y0", (F.col("cx") + F.col("_s.i")).alias("cx"), (F.col("cy") + F.col("_s.j")).alias("cy"))
        right = targets.select(*by, "dst", "x", "y", *at("x", "y", cell))
        pairs = left.hint("merge").join(right, [*by, "cx", "cy"]).where(~F.col("src").eqNullSafe(F.col("dst"))).withColumn("d2", d2)
        last = cell > ends
        best = top_n(pairs if last else pairs.where(F.col("d2") <= cell * cell), [*by, "src"], [F.col("d2"), F.col("dst")], k).select(*by, "src", "dst", "rank", "d2")
        done = settled(best if last else best.withColumn("_most", F.max("rank").over(over([*by, "src"]))).where(F.col("_most") == k).drop("_most"))
        found = done if found is None else found.union(done)
        if last:
            return found
        before, rest = rest, settled(rest.hint("merge").join(done.where("rank = 1").select(*by, "src"), [*by, "src"], "left_anti"))
        discard(before)
        if not rest.limit(1).count():
            return found
        cell *= 2


def knn_edges(nodes: DataFrame, by: Sequence[str], node: str, x: str, y: str, k: int, cell: float) -> DataFrame:
    """The k nearest others of each node, ties to the smaller id; cell is where the search starts, results are exact.

    Nodes without coordinates take no part; a group of fewer than k + 1 nodes gives all that there are.
    """
    p = finite_rows(nodes, x, y).select(*by, F.col(node).alias("dst"), F.col(x).alias("x"), F.col(y).alias("y"))
    sources = p.select(*by, F.col("dst").alias("src"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    return _near(sources, p, by, k, cell).select(*by, "src", "dst", "rank", F.sqrt("d2").alias("distance"))


@any_group_name
def neighbour_mean(nodes: DataFrame, edges: DataFrame, by: Sequence[str], node: str, values: Sequence[str]) -> DataFrame:
    """The mean of each value over a node's neighbours that have it (NaN and infinities do not); nodes without neighbours are left out."""
    v = nodes.select(*by, F.col(node).alias("dst"), *[finite(c).alias(c) for c in values])
    return edges.hint("merge").join(v, [*by, "dst"]).groupBy(*by, F.col("src").alias(node)).agg(F.count(F.lit(1)).alias("neighbours"), *[F.avg(c).alias(f"mean_{c}") for c in values])


@any_group_name
def rings(edges: DataFrame, seeds: DataFrame, by: Sequence[str], node: str, n: int) -> DataFrame:
    """(by.., node, ring): ring 0 are the seeds, ring i what i steps reach first.

    A ring is written before the next one starts from it, so none is made twice; joins are merged, for broadcasts go through the driver.
    """
    edges = settled(edges.select(*by, "src", "dst"))
    seen = last = settled(seeds.select(*by, F.col(node).alias("node")).distinct().withColumn("ring", F.lit(0)))
    for i in range(1, n + 1):
        step = last.select(*by, F.col("node").alias("src")).hint("merge").join(edges, [*by, "src"]).select(*by, F.col("dst").alias("node")).distinct()
        last = settled(step.hint("merge").join(seen, [*by, "node"], "left_anti").withColumn("ring", F.lit(i)))
        seen = seen.union(last)
    return seen


@any_group_name
def moran(nodes: DataFrame, edges: DataFrame, by: Sequence[str], node: str, x: str) -> DataFrame:
    """Global Moran's I with binary weights (directed edges) over nodes with a finite x."""
    z = scaled(finite_rows(nodes, x), by, centred_of(x, "z")).select(*by, F.col(node).alias("node"), "z")
    base = z.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("z") * F.col("z")).alias("zz"))
    cross = edges.join(z.withColumnRenamed("node", "src").withColumnRenamed("z", "a"), [*by, "src"]).join(z.withColumnRenamed("node", "dst").withColumnRenamed("z", "b"), [*by, "dst"])
    w = cross.groupBy(*by).agg(F.count(F.lit(1)).alias("w"), F.sum(F.col("a") * F.col("b")).alias("ab"))
    return base.join(w, list(by)).select(*by, "n", "w", F.when(F.col("zz") > 1e-12, F.col("n") / F.col("w").cast("double") * F.col("ab") / F.nullif("zz", F.lit(0.0))).alias("moran_i"))


@any_group_name
def local_moran(nodes: DataFrame, edges: DataFrame, by: Sequence[str], node: str, x: str) -> DataFrame:
    """z, the neighbours' mean z, local I and its quadrant, for nodes with a finite x and neighbours."""
    z = z_score(finite_rows(nodes, x), by, x, "z").where("z is not null").select(*by, F.col(node).alias("node"), "z")
    lag = edges.join(z.select(*by, F.col("node").alias("dst"), F.col("z").alias("b")), [*by, "dst"]).groupBy(*by, F.col("src").alias("node")).agg(F.avg("b").alias("lag"))
    out = z.join(lag, [*by, "node"])
    name = F.concat(F.when(F.col("z") > 0, "High").otherwise("Low"), F.lit("-"), F.when(F.col("lag") > 0, "High").otherwise("Low"))
    return out.select(*by, F.col("node").alias(node), "z", "lag", (F.col("z") * F.col("lag")).alias("local_i"), name.alias("quadrant"))


def permuted(nodes: DataFrame, by: Sequence[str], node: str, x: str, times: int, seed: str) -> DataFrame:
    """(by.., perm, node, x): the values of x dealt anew to the nodes, by md5 order; any engine repeats it."""
    w = over(by, F.col(node))
    n = nodes.select(*by, F.col(node).alias("node"), F.col(x).alias("x")).withColumn("_i", F.row_number().over(w))
    perms = n.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(times))))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col("perm").cast("string"), F.col("node").cast("string")))
    dealt = perms.withColumn("_j", F.row_number().over(over([*by, "perm"], order, F.col("node"))))
    return dealt.select(*by, "perm", F.col("_i").alias("_k"), "node").join(dealt.select(*by, "perm", F.col("_j").alias("_k"), "x"), [*by, "perm", "_k"]).select(*by, "perm", F.col("node").alias(node), "x")


@any_group_name
def lisa(nodes: DataFrame, edges: DataFrame, by: Sequence[str], node: str, x: str, times: int = 99, seed: str = "lisa", blocks: int = 32) -> DataFrame:
    """Local Moran with the share of permutations at least as extreme, (b + 1) / (m + 1).

    The permutations are those of `permuted`, dealt to tasks in at most `blocks` blocks a group, so that there are some four tasks a
    core; a task holds one group's nodes, edges and one permutation as arrays, and gives back counts only.
    """
    z = settled(z_score(finite_rows(nodes, x), by, x, "_z").where("_z is not null").select(*by, F.col(node).alias("_node"), "_z"))
    near = edges.hint("merge").join(z.select(*by, F.col("_node").alias("dst")), [*by, "dst"]).groupBy(*by, F.col("src").alias("_node")).agg(F.collect_list("dst").alias("_near"))
    whole = z.hint("merge").join(near, [*by, "_node"], "left").withColumn("_name", F.col("_node").cast("string"))
    cores = z.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(times, blocks, -(-4 * cores // max(1, z.select(*by).distinct().count() if by else 1))))
    dealt = whole.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(8 * cores, *by, "_block")
    schema = z.select(*by, "_node").schema.add("_hits", "long")
    kept = [f.name for f in schema][:-1]

    def count(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("_node")
        v, block = group["_z"].to_numpy(), group["_block"][0].as_py()
        lists = group["_near"].combine_chunks()
        degree = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        src = np.repeat(np.arange(len(v)), degree)
        dst = pc.index_in(lists.flatten(), group["_node"].combine_chunks()).to_numpy(zero_copy_only=False)
        extreme = lambda u: np.round(np.abs(u * np.bincount(src, u[dst], len(v)) / np.maximum(degree, 1)), 9)
        real, hits, names = extreme(v), np.zeros(len(v), np.int64), Md5Order(group["_name"])
        for perm in range(block + 1, times + 1, blocks):
            hits += extreme(v[names.order(f"{seed}|{perm}|".encode())]) >= real
        return group.select(kept).append_column("_hits", pa.array(hits)).filter(pa.array(degree > 0))

    counted = dealt.groupBy(*by, "_block").applyInArrow(count, schema)
    p = counted.groupBy(*by, F.col("_node").alias(node)).agg(((F.sum("_hits") + 1) / (F.lit(times) + 1.0)).alias("p"))
    return local_moran(nodes, edges, by, node, x).join(p, [*by, node])


@any_group_name
def getis_ord(nodes: DataFrame, edges: DataFrame, by: Sequence[str], node: str, x: str) -> DataFrame:
    """Gi* of each node with itself among its neighbours (binary weights)."""
    v = nodes.select(*by, F.col(node).alias("dst"), finite(x).alias("x")).where("x is not null")
    all_of = v.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    loops = v.select(*by, F.col("dst").alias("src"), "dst")
    near = edges.unionByName(loops).hint("merge").join(v, [*by, "dst"]).groupBy(*by, "src").agg(F.sum("x").alias("sx"), F.count(F.lit(1)).cast("double").alias("w"))
    low = F.col("s") * F.sqrt((F.col("n") * F.col("w") - F.col("w") * F.col("w")) / F.nullif(F.col("n") - 1.0, F.lit(0.0)))
    return near.join(F.broadcast(all_of), list(by)).select(*by, F.col("src").alias(node), ratio(F.col("sx") - F.col("m") * F.col("w"), low).alias("gi_star"))


def dense_hotspots(nodes: DataFrame, edges: DataFrame, by: Sequence[str], node: str, high: Column, least: int = 5) -> DataFrame:
    """High nodes with at least `least` high neighbours."""
    h = nodes.select(*by, F.col(node).alias("node"), high.alias("h"))
    n = edges.join(h.select(*by, F.col("node").alias("dst"), "h"), [*by, "dst"]).groupBy(*by, F.col("src").alias("node")).agg(F.count_if("h").alias("high_neighbours"))
    return h.where("h").join(n, [*by, "node"]).where(F.col("high_neighbours") >= least).select(*by, F.col("node").alias(node), "high_neighbours")


def halo(labels: DataFrame, edges: DataFrame, by: Sequence[str], node: str, hot: Column) -> DataFrame:
    """Neighbours of hot nodes that are not hot themselves."""
    inside = labels.where(hot).select(*by, F.col(node).alias("src"))
    ring = inside.join(edges, [*by, "src"]).select(*by, F.col("dst").alias(node)).distinct()
    return ring.join(inside.withColumnRenamed("src", node), [*by, node], "left_anti")


def nearest_target(sources: DataFrame, targets: DataFrame, by: Sequence[str], node: str, x: str, y: str, cell: float = 1.0) -> DataFrame:
    """For each source node the distance to the nearest target of its group (no row without a target)."""
    s = finite_rows(sources, x, y).select(*by, F.col(node).alias("src"), F.col(x).alias("x0"), F.col(y).alias("y0"))
    t = finite_rows(targets, x, y).select(*by, F.lit(None).cast(s.schema["src"].dataType).alias("dst"), F.col(x).alias("x"), F.col(y).alias("y"))
    return _near(s, t, by, 1, cell).select(*by, F.col("src").alias(node), F.sqrt("d2").alias("distance"))


def group_neighbourhood(nodes: DataFrame, edges: DataFrame, by: Sequence[str], node: str, inside: Column, values: Sequence[str], exclude: bool = False) -> DataFrame:
    """The mean over a group's nodes of their neighbours' mean values; exclude leaves neighbours of the group out."""
    n = nodes.withColumn("_in", F.coalesce(inside, F.lit(False)))
    v = n.select(*by, F.col(node).alias("dst"), *values, F.col("_in").alias("_there"))
    near = edges.join(n.where("_in").select(*by, F.col(node).alias("src")), [*by, "src"]).join(v, [*by, "dst"])
    near = near.where("not _there") if exclude else near
    each = near.groupBy(*by, "src").agg(*[F.avg(c).alias(c) for c in values])
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("nodes"), *[F.avg(c).alias(f"mean_{c}") for c in values])


def ring_composition(nodes: DataFrame, edges: DataFrame, by: Sequence[str], node: str, seeds: DataFrame, n: int, values: Sequence[str], rest_of: str | None = None, least: float = 0.05) -> DataFrame:
    """Mean values of each ring around the seeds; with rest_of the values are first divided by 1 - rest_of, where that is at least `least`."""
    v = nodes.select(*by, F.col(node).alias("node"), *values, *([F.col(rest_of).alias("_rest")] if rest_of else []))
    if rest_of:
        left = 1.0 - F.col("_rest")
        v = v.where(left >= least).select(*by, "node", *[(F.col(c) / left).alias(c) for c in values])
    return rings(edges, seeds, by, node, n).join(v, [*by, "node"]).groupBy(*by, "ring").agg(F.count(F.lit(1)).alias("nodes"), *[F.avg(c).alias(f"mean_{c}") for c in values])


def label_moran(nodes: DataFrame, edges: DataFrame, by: Sequence[str], node: str, label: str) -> DataFrame:
    """Moran's I of each label's 0/1 map, from counts: nodes, edges, edges that touch and that join the label."""
    n = nodes.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"))
    size = nodes.groupBy(*by, label).agg(F.count(F.lit(1)).cast("double").alias("size"))
    l = nodes.select(*by, F.col(node).alias("_n"), F.col(label).alias("_l"))  # noqa: E741
    both = edges.join(l.withColumnRenamed("_n", "src").withColumnRenamed("_l", label), [*by, "src"]).join(l.withColumnRenamed("_n", "dst").withColumnRenamed("_l", "_to"), [*by, "dst"])
    w = both.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("w"))
    from_label = both.groupBy(*by, label).agg(F.count(F.lit(1)).cast("double").alias("touch"), F.count_if(F.col("_to") == F.col(label)).cast("double").alias("join"))
    m = with_groups(with_groups(with_groups(size, from_label, [*by, label], "left"), n, by), w, by)
    p = F.col("size") / F.col("n")
    # the sum of (x - p)(y - p) over edges; every edge goes both ways, so touching counts are equal on either end
    cross = F.coalesce("join", F.lit(0.0)) - 2.0 * p * F.coalesce("touch", F.lit(0.0)) + p * p * F.col("w")
    return m.select(*by, label, F.col("size").cast("long").alias("size"), ratio(F.col("n") * cross, F.col("w") * F.col("size") * (1.0 - p)).alias("moran_i"))


def mean_label_moran(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """The size-weighted mean of label_moran; labels without a value are left out."""
    ok = found.where("moran_i is not null")
    return ok.groupBy(*by).agg(F.count(F.lit(1)).alias("labels"), (F.sum(F.col("size") * F.col("moran_i")) / F.sum("size")).alias("moran_i"))


def gi_calls(found: DataFrame, critical: float = 1.959963984540054) -> DataFrame:
    """getis_ord with a hot, cold or no call at a two-sided critical value."""
    return found.withColumn("call", F.when(F.col("gi_star") > critical, "hot").when(F.col("gi_star") < -critical, "cold").otherwise("none"))


def consensus(a: DataFrame, b: DataFrame, mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that both call sets and the mask hold."""
    return a.select(*keys).intersect(b.select(*keys)).intersect(mask.select(*keys))


def call_agreement(a: DataFrame, b: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Sizes, overlap and Jaccard index of two call sets in each group."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    g = x.join(y, list(keys), "full").groupBy(*by).agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count(F.col("_a") + F.col("_b")).alias("both"), F.count(F.lit(1)).alias("_u"))
    return g.withColumn("jaccard", ratio("both", "_u")).drop("_u")


def component_distances(distances: DataFrame, by: Sequence[str], component: str, target: str, x: str = "distance") -> DataFrame:
    """Least, median, mean and greatest nearest distance of each component to each target."""
    return distances.groupBy(*by, component, target).agg(F.count(x).alias("nodes"), F.min(x).alias("least"), F.percentile(x, F.lit(0.5)).alias("median"), F.avg(x).alias("mean"), F.max(x).alias("greatest"))


def distance_contrast(summary: DataFrame, by: Sequence[str], target: str, first: str, second: str, x: str = "median") -> DataFrame:
    """Per group the mean over components of x to the first target less that to the second."""
    side = lambda v: F.avg(F.when(F.col(target) == v, F.col(x)))
    return summary.groupBy(*by).agg(side(first).alias("first"), side(second).alias("second")).withColumn("difference", F.col("first") - F.col("second")).where("difference is not null")


def self_neighbour_correlation(nodes: DataFrame, edges: DataFrame, by: Sequence[str], node: str, x: str, method: str = "spearman") -> DataFrame:
    """Correlation of a node's value with the mean of its neighbours (to 9 digits: ties don't hang on the order of sums)."""
    both = neighbour_mean(nodes, edges, by, node, [x]).withColumn(f"mean_{x}", F.round(f"mean_{x}", 9)).join(nodes.select(*by, node, x), [*by, node])
    return (spearman if method == "spearman" else pearson)(both, by, x, f"mean_{x}")


def ring_correlation(nodes: DataFrame, edges: DataFrame, by: Sequence[str], node: str, source: str, x: str, y: str) -> DataFrame:
    """By source group: Pearson and Spearman of the centre's x with the neighbours' mean y (to 9 digits, for ties)."""
    both = neighbour_mean(nodes, edges, by, node, [y]).withColumn(f"mean_{y}", F.round(f"mean_{y}", 9)).join(nodes.select(*by, node, source, x), [*by, node])
    groups = [*by, source]
    return with_groups(pearson(both, groups, x, f"mean_{y}"), spearman(both, groups, x, f"mean_{y}").drop("n"), groups)


def slope_classes(slopes: DataFrame, by: Sequence[str], item: str, slope: str, q: float = 0.9) -> DataFrame:
    """Items whose |slope| reaches the group's quantile: rising or falling, ranked by size within the class; the others are flat."""
    cut = slopes.groupBy(*by).agg(F.percentile(F.abs(slope), F.lit(q)).alias("_cut"))
    rows = with_groups(slopes, cut, by)
    rows = rows.withColumn("class", F.when((F.abs(slope) >= F.col("_cut")) & (F.col(slope) != 0), F.when(F.col(slope) > 0, "rising").otherwise("falling")).otherwise("flat"))
    return rows.withColumn("rank", F.row_number().over(over([*by, "class"], F.abs(slope).desc(), F.col(item)))).drop("_cut")


def discontinuities(fits: DataFrame, by: Sequence[str], segment: str, start: str, q: float = 0.9) -> DataFrame:
    """Jumps between the lines (slope, intercept) of successive segments at their border, and whether a jump reaches the quantile of all |jumps|."""
    w = over(by, F.col(segment))
    before = F.lag("slope").over(w) * F.col(start) + F.lag("intercept").over(w)
    rows = fits.withColumn("jump", F.col("slope") * F.col(start) + F.col("intercept") - before).where("jump is not null")
    cut = rows.agg(F.percentile(F.abs("jump"), F.lit(q)).alias("_cut"))
    return rows.crossJoin(cut).withColumn("discontinuous", F.abs("jump") >= F.col("_cut")).drop("_cut")
