"""Average linkage in rounds of reciprocal nearest neighbours, cuts, silhouettes and stability, as joins and aggregates.

Clusters are named by their smallest member. A pair table holds sums of similarities between clusters, so a merge
only renames and adds rows; pairs that share nothing are not in it. All groups (and resamples, cuts, numbers of top
items: any key) go through the same rounds together. A piece (a group, or what hangs together of a large one) that has
at most WHOLE pairs left goes through its last rounds in one task; no task holds more of a group, nor any matrix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.hashes import Md5Order
from quillon.functions.scalars import finite, ratio

from . import similarity
from .ranks import any_group_name, discard, over, running_sum, settled, with_groups

#: Similarities are compared at this many digits, so that sums of different order tie alike.
DIGITS = 12
#: So many pairs of a piece are merged in one task (16 million took a Python worker of 1.9 GB); what is named anew in a round is so at most STRIPE pairs at a time.
WHOLE, STRIPE = 20_000_000, 2_000_000
#: So many nodes meet as many others in a task of co_clustering.
BLOCK = 4_000
#: Owners' lists of so many items, and a resample of so many pairs, are held by a task of resampled_labels (some 1 GB at most).
ENTRIES, MET = 20_000_000, 8_000_000
#: So many resamples go through the rounds of jobs together where a task can't hold one.
SOME = 10


def pair_sums(pairs: DataFrame, by: Sequence[str], sim: str) -> DataFrame:
    """(by, a, b, total, na, nb): the pairs as clusters of one member each; a < b, missing and zero similarities left out."""
    s = finite(sim)
    return pairs.where(F.col("a") != F.col("b")).select(*by, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), s.alias("total")).where("total <> 0").withColumns({"na": F.lit(1).cast("long"), "nb": F.lit(1).cast("long")})


def reciprocal(c: DataFrame, by: Sequence[str]) -> DataFrame:
    """The pairs that are nearest for both of their clusters: greatest mean similarity, ties to the smaller names."""
    mean = F.round(F.col("total") / (F.col("na").cast("double") * F.col("nb")), DIGITS)
    order = F.struct((-mean).alias("far"), "a", "b", "total", "na", "nb")
    best = c.select(*by, F.explode(F.array("a", "b")).alias("_x"), order.alias("_o")).groupBy(*by, "_x").agg(F.min("_o").alias("_o"))
    return best.groupBy(*by, "_o").agg(F.count(F.lit(1)).alias("_n")).where("_n = 2").select(*by, "_o.a", "_o.b", "_o.total", "_o.na", "_o.nb")


def merged(c: DataFrame, chosen: DataFrame, by: Sequence[str]) -> DataFrame:
    """The pair table after the chosen pairs became one cluster each."""
    size = F.col("na") + F.col("nb")
    names = chosen.select(*by, F.explode(F.array(F.struct(F.col("a").alias("old"), F.col("a").alias("new"), size.alias("size")), F.struct(F.col("b").alias("old"), F.col("a").alias("new"), size.alias("size")))).alias("_m")).select(*by, "_m.*")
    for x, n in (("a", "na"), ("b", "nb")):
        side = names.select(*by, F.col("old").alias(x), F.col("new").alias("_new"), F.col("size").alias("_size"))
        c = c.join(side, [*by, x], "left").withColumns({x: F.coalesce("_new", x), n: F.coalesce("_size", n)}).drop("_new", "_size")
    turned = F.col("a") > F.col("b")
    side = lambda p, q: F.when(turned, F.col(q)).otherwise(F.col(p))
    c = c.where("a <> b").select(*by, side("a", "b").alias("a"), side("b", "a").alias("b"), "total", side("na", "nb").alias("na"), side("nb", "na").alias("nb"))
    return c.groupBy(*by, "a", "b", "na", "nb").agg(F.sum("total").alias("total")).select(*by, "a", "b", "total", "na", "nb")


def _rounds(a: np.ndarray, b: np.ndarray, total: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The rounds of `reciprocal` and `merged` on pairs a < b: (a, b, total, na, nb) of each round's merges, in order of (a, b).

    Only the pairs of clusters that were merged are named and added up anew.
    """
    n, size = len(size), size.copy()
    mean = np.round(total / (size[a].astype(float) * size[b]), DIGITS)
    while len(a):
        best, first = np.full(n, -np.inf), np.full(n, n * n)
        for x in (a, b):
            np.maximum.at(best, x, mean)
        at = np.flatnonzero((mean == best[a]) | (mean == best[b]))
        x, y = a[at].astype(np.int64), b[at].astype(np.int64)
        code = x * n + y
        for z in (x, y):
            top = mean[at] == best[z]
            np.minimum.at(first, z[top], code[top])
        hit = (first[x] == code) & (first[y] == code)
        at = at[hit][np.argsort(code[hit])]
        x, y = a[at], b[at]
        yield x, y, total[at], size[x], size[y]
        name, part = np.arange(n, dtype=a.dtype), np.zeros(n, bool)
        name[y], part[x], part[y] = x, True, True
        size[x] += size[y]
        moved = part[a]
        moved |= part[b]
        keep = ~moved
        out = [(a[keep], b[keep], total[keep], mean[keep])]
        mean = None
        a, b, total = name[a[moved]], name[b[moved]], total[moved]
        a, b = np.minimum(a, b), np.maximum(a, b)
        # the smaller names of a stripe are its own, so no pair is in two
        ends = np.append(np.unique(np.searchsorted(np.cumsum(np.bincount(a, minlength=n)), np.arange(0, len(a), STRIPE), side="right")), n)
        for low, high in zip(ends[:-1], ends[1:], strict=True):
            at = np.flatnonzero((a >= low) & (a < high) & (a != b)) if len(ends) > 2 else np.flatnonzero(a != b)
            code = a[at] * np.int64(n) + b[at]
            order = np.argsort(code, kind="stable")
            code, t = code[order], total[at[order]]
            at = np.flatnonzero(np.diff(code, prepend=-1))
            code, t = code[at], np.add.reduceat(t, at) if len(at) else t
            x, y = (code // n).astype(a.dtype), (code % n).astype(a.dtype)
            out.append((x, y, t, np.round(t / (size[x].astype(float) * size[y]), DIGITS)))
        a = b = total = None
        a, b, total, mean = (np.concatenate(c) for c in zip(*out, strict=True))


def _in_tasks(c: DataFrame, keys: Sequence[str], piece: Sequence[str], step: int) -> DataFrame:
    """(keys, a, b, total, na, nb, step): all merges of a pair table that is dealt by keys and piece, from this step on."""
    kinds = dict(c.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, total, sizes, first = ([], []), [], ([], []), None
        for batch in batches:
            first = first or pa.RecordBatch.from_pydict({k: batch[k].slice(0, 1) for k in keys}) if keys else None
            for i, (x, n) in enumerate((("a", "na"), ("b", "nb"))):
                ends[i].append(batch[x])
                sizes[i].append(batch[n].to_numpy().astype(np.int32))
            total.append(batch["total"].to_numpy())
        names = pc.unique(pa.chunked_array([pc.unique(x) for x in (*ends[0], *ends[1])]))
        names = names.take(pc.sort_indices(names))
        code = [np.concatenate([pc.index_in(x, value_set=names).to_numpy() for x in end]) for end in ends]
        size = np.ones(len(names), np.int64)
        for x, n in zip(code, sizes, strict=True):
            size[x] = np.concatenate(n)
        total = np.concatenate(total)
        ends = sizes = None
        # at most as many merges as nodes
        for i, (x, y, *rest) in enumerate(_rounds(*code, total, size)):
            code = total = None
            own = [first[k].take(pa.array(np.zeros(len(x), np.int64))) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, names.take(pa.array(x)), names.take(pa.array(y)), *map(pa.array, rest), pa.array(np.full(len(x), step + i, np.int32))], [*keys, "a", "b", "total", "na", "nb", "step"])

    dealt = c.repartition(4 * c.sparkSession.sparkContext.defaultParallelism, *keys, *piece) if [*keys, *piece] else c
    return dealt.groupBy(*keys, *piece).applyInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in (*keys, "a", "b", "total", "na", "nb")) + ", step int")


def _pieces(c: DataFrame, keys: Sequence[str]) -> DataFrame:
    """c with _piece: the least node that a pair hangs together with."""
    name = lambda x: F.struct(*keys, F.col(x).alias("x"))
    part = similarity.components(c.select(name("a").alias("a"), name("b").alias("b")))
    return c.join(part.select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.x").alias("a"), F.col("component.x").alias("_piece")), [*keys, "a"])


def average_linkage(pairs: DataFrame, nodes: DataFrame, by: Sequence[str], node: str, sim: str) -> DataFrame:
    """Merges of a group's nodes by mean similarity: (by, child, parent, height, total, na, nb, step, place).

    pairs: (by, a, b, sim), each unordered pair once at most; a pair that isn't there has similarity 0, so with negative
    similarities every pair has to be there. nodes: (by, node). A row says that the cluster named child (of
    nb members) joined the one named parent (na members, keeps its name) at height 1 - mean similarity; total is the
    sum of similarities between the two. step grows from child to parent, and place counts merges in order of height
    (then step and names), so the last k - 1 of a group are those that a cut into k undoes. Null nodes and null, NaN or
    zero similarities are left out, a group with a null key is a group. Reciprocal nearest neighbours of a
    reducible linkage merge as one by one they would; ties are broken by names.
    """
    own = _keys(by)
    coded = lambda df, *more: df.select(*[F.struct(c).alias(own[c]) for c in by], *more)
    keys = list(own.values())
    nodes = settled(coded(nodes, F.col(node).alias("node")).where("node is not null").distinct())
    c = settled(pair_sums(coded(pairs, "a", "b", sim), keys, sim))
    done, step, piece = None, 0, []
    coded_alike = {dict(c.dtypes)[x] for x in "ab"}.issubset({"tinyint", "smallint", "int", "bigint", "string"})
    while True:
        if coded_alike:
            sizes = settled(c.groupBy(*keys, *piece).agg(F.count(F.lit(1)).alias("_pairs")))
            if not piece and not sizes.where(F.col("_pairs") > WHOLE).isEmpty():
                # groups that fit a task need no pieces
                fit = sizes.where(F.col("_pairs") <= WHOLE).select(*keys)
                if keys and not fit.isEmpty():
                    last = settled(_in_tasks(with_groups(c, fit, keys), keys, [], step))
                    done = last if done is None else done.unionByName(last)
                    c = settled(c.join(fit, keys, "left_anti"))
                piece = ["_piece"]
                c = settled(_pieces(c, keys))
                continue
            few = sizes.where(F.col("_pairs") <= WHOLE)
            if not few.isEmpty():
                # small pieces share a task's table, which goes through the rounds as they would
                at = [F.when(F.col("_pairs") > WHOLE // 8, F.xxhash64("_piece")).otherwise(F.pmod(F.xxhash64("_piece"), F.greatest(F.lit(1), (F.col("_sum") * 8 / WHOLE).cast("long")))).alias("_deal")] if piece else []
                few = with_groups(few, few.groupBy(*keys).agg(F.sum("_pairs").alias("_sum")), keys).select(*keys, *piece, *at)
                dealt = with_groups(c, few, [*keys, *piece]) if piece else with_groups(c, few, keys) if keys else c
                last = settled(_in_tasks(dealt.drop(*piece), keys, ["_deal"] if piece else [], step))
                done = last if done is None else done.unionByName(last)
                rest = c.join(few.drop("_deal"), [*keys, *piece], "left_anti") if [*keys, *piece] else c.limit(0)
                if sizes.where(F.col("_pairs") > WHOLE).isEmpty():
                    break
                c = settled(rest)
        chosen = settled(reciprocal(c, [*keys, *piece]).withColumn("step", F.lit(step)))
        if chosen.isEmpty():
            break
        mine = chosen.drop(*piece)
        done = mine if done is None else done.unionByName(mine)
        if step % 20 == 19:
            done = settled(done)
        after = settled(merged(c, chosen, [*keys, *piece]))
        discard(c)
        c, step = after, step + 1
    kind = dict(nodes.dtypes)["node"]
    if done is None:
        done = nodes.limit(0).select(*keys, F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("total"), F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb"), F.lit(0).alias("step"))
    done = settled(done)
    step = (done.agg(F.max("step")).first()[0] or 0) + 1
    done = done.select(*keys, F.col("b").cast(kind).alias("child"), F.col("a").cast(kind).alias("parent"), (1.0 - F.col("total") / (F.col("na").cast("double") * F.col("nb"))).alias("height"), "total", "na", "nb", "step")
    # what is left shares nothing: it joins the smallest name at height 1, one after the other
    size = done.groupBy(*keys, F.col("parent").alias("node")).agg(F.sum("nb").alias("more"))
    roots = nodes.join(done.select(*keys, F.col("child").alias("node")), [*keys, "node"], "left_anti").join(size, [*keys, "node"], "left").select(*keys, "node", (F.coalesce("more", F.lit(0)) + 1).alias("nb"))
    roots = with_groups(running_sum(roots, keys, ["node"], F.col("nb"), "na"), roots.groupBy(*keys).agg(F.min("node").alias("parent")), keys)
    late = roots.where("node <> parent").select(*keys, F.col("node").alias("child"), "parent", F.lit(1.0).alias("height"), F.lit(0.0).alias("total"), "na", "nb", F.lit(step).alias("step"))
    out = running_sum(done.unionByName(late), keys, [F.round("height", DIGITS), F.col("step"), F.col("parent"), F.col("child")], F.lit(1), "place")
    return settled(out.select(*[F.col(f"`{own[c]}`.`{c}`").alias(c) for c in by], "child", "parent", "height", "total", "na", "nb", "step", (F.col("place") + 1).alias("place")))


def _keys(by: Sequence[str]) -> dict[str, str]:
    """Names of our own for group columns, which are wrapped as structs so that a null key joins and counts as any other."""
    return {c: f"_by_{i}" for i, c in enumerate(by)}


def climb(parents: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, node, root, offset): parents (by, node, up, offset) followed to the top, offsets added up; a root is its own parent.

    Every round doubles the steps taken, so rounds grow with the logarithm of the depth.
    """
    at = held = settled(parents.select(*by, "node", "up", "offset"))
    while True:
        above = at.where("node <> up").select(*by, F.col("node").alias("up"), F.col("up").alias("_up"), F.col("offset").alias("_offset"))
        new = at.join(above, [*by, "up"], "left")
        new = settled(new.select(*by, "node", F.coalesce("_up", "up").alias("up"), (F.col("offset") + F.coalesce("_offset", F.lit(0))).alias("offset"), F.col("_up").isNotNull().alias("_moved")))
        if new.where("_moved").isEmpty():
            discard(new)
            return at.withColumnRenamed("up", "root")
        discard(held)
        held, at = new, new.drop("_moved")


def cuts(merges: DataFrame, nodes: DataFrame, by: Sequence[str], node: str, ks: Sequence[int]) -> DataFrame:
    """(by, k, node, root, leaf) for each k that a group has nodes for, and for k = 1.

    root names the cluster by its smallest member; leaf, given for k = 1, is the node's place in the tree's leaf order
    (a merge puts the child's leaves after the parent's).
    """
    own = _keys(by)
    keys = list(own.values())
    coded = lambda df, *more: df.select(*[F.struct(c).alias(own[c]) for c in by], *more)
    nodes = coded(nodes, F.col(node).alias("node")).where("node is not null").distinct()
    m = coded(merges, F.col("child").alias("node"), "parent", "na", "place")
    sizes = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    all_ks = F.array(*[F.lit(int(k)) for k in sorted({1, *ks})])
    rows = with_groups(nodes.join(m, [*keys, "node"], "left"), sizes, keys).withColumn("k", F.explode(all_ks)).where("k <= _n")
    kept = F.coalesce(F.col("place") <= F.col("_n") - F.col("k"), F.lit(False))
    tree = climb(rows.select(*keys, "k", "node", F.when(kept, F.col("parent")).otherwise(F.col("node")).alias("up"), F.when(kept, F.col("na")).otherwise(F.lit(0)).alias("offset")), [*keys, "k"])
    return tree.select(*[F.col(f"`{own[c]}`.`{c}`").alias(c) for c in by], "k", "node", "root", F.when(F.col("k") == 1, F.col("offset")).cast("int").alias("leaf"))


@any_group_name
def cophenetic(merges: DataFrame, pairs: DataFrame, by: Sequence[str], sim: str) -> DataFrame:
    """Correlation of distances and merge heights over all pairs of a group's nodes, from sums alone.

    A merge of na and nb members sets na * nb heights at once, and their distances add up to na * nb - total.
    """
    n = F.col("na").cast("double") * F.col("nb")
    h = F.col("height")
    tree = merges.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(h * n).alias("c"), F.sum(h * h * n).alias("cc"), F.sum(h * (n - F.col("total"))).alias("dc"))
    s = pair_sums(pairs, by, sim).groupBy(*by).agg(F.sum("total").alias("s"), F.sum(F.col("total") * F.col("total")).alias("ss"))
    both = with_groups(tree, s, by, "left").na.fill(0.0, ["s", "ss"])
    n, c, cc, dc, s, ss = (F.col(x) for x in ("n", "c", "cc", "dc", "s", "ss"))
    d, dd = n - s, n - 2.0 * s + ss
    vd, vc = dd / n - (d / n) * (d / n), cc / n - (c / n) * (c / n)
    return both.select(*by, F.when((n > 1) & (vd > 1e-24) & (vc > 1e-24), (dc / n - d * c / n / n) / F.sqrt(vd * vc)).alias("cophenetic_r"))


@any_group_name
def silhouettes(pairs: DataFrame, labels: DataFrame, by: Sequence[str], sim: str) -> DataFrame:
    """(by, silhouette, clusters, least): mean silhouette of labels (by, node, root), 1 - similarity as distance.

    From each node's sums to clusters; a node alone in its cluster has 0, and so has everything with a single cluster.
    pairs may lack columns of `by` (as k): a pair then counts for each of their values.
    """
    shared = [c for c in by if c in pairs.columns]
    sizes = labels.groupBy(*by, "root").agg(F.count(F.lit(1)).alias("_size"))
    p = pairs.select(*shared, "a", "b", finite(sim).alias("_s")).where("_s <> 0")
    both = p.unionByName(p.select(*shared, F.col("b").alias("a"), F.col("a").alias("b"), "_s"))
    sums = both.join(labels.select(*by, F.col("node").alias("b"), "root"), [*shared, "b"]).groupBy(*by, F.col("a").alias("node"), "root").agg(F.sum("_s").alias("_s"))
    per = sums.join(sizes, [*by, "root"]).select(*by, "node", F.col("root").alias("_other"), "_s", "_size")
    counts = sizes.groupBy(*by).agg(F.count(F.lit(1)).alias("clusters"), F.min("_size").alias("least"))
    rows = with_groups(labels.select(*by, "node", "root").join(sizes, [*by, "root"]).withColumnRenamed("_size", "_own"), counts, by).join(per, [*by, "node"], "left")
    inside = F.col("_other") == F.col("root")
    mean = F.col("_s") / F.col("_size")
    g = rows.groupBy(*by, "node", "_own", "clusters", "least").agg(F.sum(F.when(inside, F.col("_s"))).alias("_in"), F.max(F.when(~inside, mean)).alias("_best"), F.count_if(~inside).alias("_met"))
    a = 1.0 - F.coalesce("_in", F.lit(0.0)) / F.nullif(F.col("_own") - 1, F.lit(0))
    # a cluster that a node shares nothing with is at distance 1
    near = F.when(F.col("_met") < F.col("clusters") - 1, F.greatest(F.coalesce("_best", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("_best"))
    b = 1.0 - near
    s = F.when((F.col("_own") < 2) | (F.col("clusters") < 2) | (F.greatest(a, b) <= 0), 0.0).otherwise((b - a) / F.greatest(a, b))
    return g.groupBy(*by, "clusters", "least").agg(F.avg(s).alias("silhouette")).select(*by, "silhouette", "clusters", "least")


@any_group_name
def linkage_clusters(pairs: DataFrame, nodes: DataFrame, by: Sequence[str], node: str, sim: str, ks: Sequence[int], least: int = 1) -> DataFrame:
    """Per node its leaf place, cluster (numbered by smallest members) and the chosen k, silhouette and cophenetic r of its group.

    pairs and nodes as for average_linkage; group keys are not null here. k is the one of the best silhouette (at 12 digits;
    a tie: the smaller k) among those whose clusters all have at least `least` nodes; without any, k is 1.
    """
    pairs, nodes = settled(pairs.select(*by, "a", "b", sim)), settled(nodes.select(*by, F.col(node).alias("node")).where("node is not null").distinct())
    merges = average_linkage(pairs, nodes, by, "node", sim)
    labels = settled(cuts(merges, nodes, by, "node", ks))
    wanted = labels.where(F.col("k").isin([int(k) for k in ks]))
    scores = silhouettes(pairs, wanted, [*by, "k"], sim).where(F.col("least") >= least)
    best = scores.groupBy(*by).agg(F.min(F.struct((-F.round("silhouette", DIGITS)).alias("s"), "k")).alias("_b"))
    groups = with_groups(nodes.select(*by).distinct(), best, by, "left").select(*by, F.coalesce("_b.k", F.lit(1)).alias("k"), (-F.col("_b.s")).alias("silhouette")) if by else nodes.groupBy().agg(F.count(F.lit(1))).select().crossJoin(best).select(F.coalesce("_b.k", F.lit(1)).alias("k"), (-F.col("_b.s")).alias("silhouette"))
    groups = settled(with_groups(groups, cophenetic(merges, pairs, by, sim), by, "left"))
    chosen = labels.join(F.broadcast(groups) if not by else groups, [*by, "k"])
    # as many roots a group as its k
    numbers = chosen.select(*by, "root").distinct().withColumn("cluster", F.row_number().over(over(by, F.col("root"))) - 1)
    out = chosen.join(numbers, [*by, "root"]).join(labels.where("k = 1").select(*by, "node", F.col("leaf").alias("place")), [*by, "node"])
    return out.select(*by, F.col("node").alias("owner"), "place", "cluster", "k", "silhouette", "cophenetic_r")


# ---------------------------------------------------------------- resamples


def resampled(items: DataFrame, owner: str, item: str, times: int, size: int, seed: str = "boot", first: int = 1) -> DataFrame:
    """(perm, owner, item): for each resample the different items among `size` draws with replacement from each owner's, by md5."""
    sets = items.select(F.col(owner).alias("owner"), F.col(item).alias("item")).where("owner is not null and item is not null").distinct()
    # an owner's items are one row: a program's list, not a table's rows
    lists = sets.groupBy("owner").agg(F.array_sort(F.collect_list("item")).alias("_items"))
    draws = lists.select("owner", "_items", F.explode(F.sequence(F.lit(int(first)), F.lit(int(first + times - 1)))).alias("perm")).select("owner", "_items", "perm", F.explode(F.sequence(F.lit(0), F.lit(int(size) - 1))).alias("_j"))
    word = F.md5(F.concat_ws("|", F.lit(seed), "perm", F.col("owner").cast("string"), "_j"))
    at = F.pmod(F.conv(F.substr(word, F.lit(1), F.lit(8)), 16, 10).cast("long"), F.size("_items")).cast("int")
    return draws.select("perm", "owner", F.get("_items", at).alias("item")).distinct()


def resampled_clusters(items: DataFrame, owner: str, item: str, times: int = 250, k: int = 8, size: int = 50, seed: str = "boot", first: int = 1) -> tuple[DataFrame, DataFrame]:
    """(labels (perm, node, root), Jaccard pairs (perm, a, b, jaccard)) of every resample cut into k clusters (or as many as there are owners).

    The resample is a key of the merge rounds, so all resamples go through them together. first is the number of the first one.
    """
    draws = settled(resampled(items, owner, item, times, size, seed, first))
    pairs = settled(similarity.set_overlaps(draws, ["perm"], "owner", "item").select("perm", "a", "b", "jaccard"))
    nodes = draws.select("perm", F.col("owner").alias("node")).distinct()
    merges = average_linkage(pairs, nodes, ["perm"], "node", "jaccard")
    few = nodes.groupBy("perm").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 1
    labels = cuts(merges, nodes, ["perm"], "node", [min(int(k), few)])
    found = settled(labels.where(F.col("k") == min(int(k), few)).select("perm", "node", "root"))
    discard(draws, merges)
    return found, pairs


def _met(a: np.ndarray, item: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, shared) of owners a < b below n that share an item, from different (owner, item) in order of (item, owner)."""
    first = np.flatnonzero(np.diff(item, prepend=-1))
    many = np.diff(np.append(first, len(item)))
    later = np.repeat(first + many, many) - np.arange(len(item)) - 1
    x = np.repeat(np.arange(len(item)), later)
    y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later) - later, later)
    code = np.sort(a[x] * np.int64(n) + a[y])
    at = np.flatnonzero(np.diff(code, prepend=-1))
    return (code[at] // n).astype(np.int32), (code[at] % n).astype(np.int32), np.diff(np.append(at, len(code)))


def _cut(a: np.ndarray, b: np.ndarray, total: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Each node's smallest fellow in the cut into k of the average linkage of pairs of similarity over 0, as `average_linkage` and `cuts` have it."""
    n = len(size)
    done = [(x, y, 1.0 - t / (na.astype(float) * nb), np.full(len(x), i)) for i, (x, y, t, na, nb) in enumerate(_rounds(a, b, total, size))]
    parent, child, height, step = (np.concatenate([np.zeros(0, np.int64), *p]) for p in zip(*done, strict=True)) if done else [np.zeros(0, np.int64)] * 4
    parent, child = parent.astype(np.int64), child.astype(np.int64)
    late = np.ones(n, bool)
    late[child] = False
    late = np.flatnonzero(late)[1:]
    # what is left shares nothing: it joins the first node, after all others
    order = np.lexsort((child, parent, step, np.round(height, DIGITS)))
    parent, child = np.append(parent[order], np.zeros(len(late), np.int64))[: n - k], np.append(child[order], late)[: n - k]
    up = np.arange(n)
    up[child] = parent
    while (up[up] != up).any():
        up = up[up]
    return up


def resampled_labels(items: DataFrame, owner: str, item: str, times: int = 250, k: int = 8, size: int = 50, seed: str = "boot") -> DataFrame:
    """The labels of `resampled_clusters`, without a table of its draws, pairs or merges.

    A resample is drawn, joined, merged and cut in one task, which holds the owners' lists and takes some resamples one after
    the other, if these have at most ENTRIES items and a resample may be expected to have at most MET pairs. Larger ones
    take the rounds of jobs, SOME resamples at a time, so that no more of their pairs are on disk.
    """
    sets = items.select(F.col(owner).alias("owner"), F.col(item).alias("item")).where("owner is not null and item is not null").distinct()
    # an owner's items are one row: a program's list, not a table's rows
    lists = settled(sets.groupBy("owner").agg(F.array_sort(F.collect_list("item")).alias("_items")))
    drawn = 1.0 - F.pow(1.0 - 1.0 / F.size("_items"), F.lit(float(size)))
    shares = lists.select(F.explode("_items").alias("item"), drawn.alias("_p")).groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("_p").alias("s"), F.sum(F.col("_p") * F.col("_p")).alias("q"))
    entries, pairs = shares.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.lit(0.0))).first()
    kinds = dict(sets.dtypes)
    plain = {"tinyint", "smallint", "int", "bigint", "string"}
    if kinds["owner"] not in plain or entries > ENTRIES or pairs > MET:
        parts = []
        for first in range(1, times + 1, SOME):
            labels, jaccard = resampled_clusters(items, owner, item, min(SOME, times + 1 - first), k, size, seed, first)
            discard(jaccard)
            parts.append(labels)
        return reduce(DataFrame.unionByName, parts)
    blocks = max(1, min(times, 2 * lists.sparkSession.sparkContext.defaultParallelism))
    dealt = lists.select("owner", F.col("owner").cast("string").alias("_name"), "_items").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        block, t = t["_block"][0].as_py(), t.take(pc.sort_indices(t["owner"])).drop_columns(["_block"])
        cells, n = t["_items"].combine_chunks(), t.num_rows
        code = pc.dictionary_encode(cells.flatten()).indices.to_numpy()
        long = pc.list_value_length(cells).to_numpy()
        start, of = np.cumsum(long) - long, np.repeat(np.arange(n, dtype=np.int32), long)
        order = np.argsort(code, kind="stable").astype(np.int32)
        code, of_order = code[order], of[order]
        names, ends = t["_name"].combine_chunks(), pa.array([f"|{j}" for j in range(size)])
        words = []
        for at in range(0, n, 4096):
            part = names.slice(at, 4096)
            m = len(part)
            words.append(Md5Order(pc.binary_join_element_wise(part.take(pa.array(np.repeat(np.arange(m), size))), ends.take(pa.array(np.tile(np.arange(size), m))), "")))
        for perm in range(block + 1, times + 1, blocks):
            head = f"{seed}|{perm}|".encode()
            draw = np.concatenate([w.first_words(head) for w in words]) % np.repeat(long, size)
            taken = np.zeros(len(code), bool)
            taken[np.repeat(start, size) + draw] = True
            degree = np.bincount(of[taken], minlength=n)
            here = taken[order]
            a, b, shared = _met(of_order[here], code[here], n)
            up = _cut(a, b, shared / (degree[a] + degree[b] - shared), np.ones(n, np.int64), min(int(k), n))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, perm, np.int32)), t["owner"].combine_chunks(), t["owner"].combine_chunks().take(pa.array(up))], ["perm", "node", "root"])

    return settled(dealt.repartition(blocks, "_block").groupBy("_block").applyInArrow(run, f"perm int, node {kinds['owner']}, root {kinds['owner']}"))


def co_clustering(labels: DataFrame, times: int) -> DataFrame:
    """(a, b, together): the share of resamples in which two nodes fall into one cluster; pairs that never do are left out.

    A node is one row with its cluster's number in each resample, in as few bytes as these take, and nodes meet in blocks of some
    BLOCK each: the pairs are as many as the result may have, but none is dealt once for each resample, and a task gives
    them back a few nodes at a time. With few clusters a block's counts are products of 0-1 matrices.
    """
    rows = labels.where("node is not null and root is not null")
    # resamples and a resample's clusters get numbers: few rows
    perms = rows.select("perm").distinct().withColumn("_p", F.row_number().over(over([], "perm")) - 1)
    roots = settled(rows.select("perm", "root").distinct().withColumn("_c", F.row_number().over(over(["perm"], F.col("root")))))
    coded = rows.join(roots, ["perm", "root"]).join(F.broadcast(perms), "perm")
    width, clusters, most = perms.count(), roots.count(), roots.agg(F.max("_c")).first()[0] or 0
    number = np.dtype(np.uint8 if most < 256 else np.uint16 if most < 65_536 else np.uint32)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.zeros((batch.num_rows, width), number)
            code[np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch["_p"]).to_numpy()), batch["_p"].flatten()] = batch["_c"].flatten()
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array([x.tobytes() for x in code], pa.binary())], ["node", "_l"])

    kind = dict(labels.dtypes)["node"]
    packed = coded.groupBy("node").agg(F.collect_list(F.struct("_p", "_c")).alias("_l")).select("node", F.col("_l._p").alias("_p"), F.col("_l._c").alias("_c"))
    packed = settled(packed.mapInArrow(pack, f"node {kind}, _l binary"))
    many = max(1, -(-packed.count() // BLOCK))
    block = F.pmod(F.xxhash64("node"), F.lit(many)).cast("int")
    met = packed.withColumn("_own", block).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    met = met.select("node", "_l", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own")
    few = clusters <= 32 * width

    def hot(code: np.ndarray) -> np.ndarray:
        """A column for each cluster, 1 for its members."""
        return np.concatenate([code[:, p, None] == np.arange(1, tops[p] + 1, dtype=number) for p in range(width)], axis=1).astype(np.float32)

    tops = [r[0] for r in roots.join(F.broadcast(perms), "perm").groupBy("_p").agg(F.max("_c").alias("_c")).orderBy("_p").select("_c").collect()] if few else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        i, j, own = (t[c].to_numpy() for c in ("_i", "_j", "_own"))
        names, code = t["node"].combine_chunks(), np.frombuffer(b"".join(t["_l"].to_pylist()), number).reshape(t.num_rows, width)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        columns = np.ascontiguousarray((hot(code[right]) if few else code[right]).T)
        for at in range(0, len(left), 64):
            part = left[at : at + 64]
            if few:
                count = np.rint(hot(code[part]) @ columns).astype(np.int64)
            else:
                count = np.zeros((len(part), len(right)), np.int64)
                for k, x in enumerate(part):
                    for p in np.flatnonzero(code[x]):
                        count[k] += columns[p] == code[x, p]
            if i[0] == j[0]:
                count[right <= part[:, None]] = 0
            x, y = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(part[x])), names.take(pa.array(right[y])), pa.array(count[x, y])], ["x", "y", "n"])

    pairs = met.repartition(4 * met.sparkSession.sparkContext.defaultParallelism, "_i", "_j").groupBy("_i", "_j").applyInArrow(run, f"x {kind}, y {kind}, n long")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("n") / F.lit(float(times))).alias("together"))


def family_stability(labels: DataFrame, families: DataFrame, node: str, family: str) -> DataFrame:
    """(family, node, members, together): how often members of a family of two or more fall into one cluster, by aggregates.

    A row without node is the family's: the mean over resamples of the share of its pairs that are in one cluster;
    a row with a node is the mean share of the family's other members in that node's cluster.
    """
    f = families.select(F.col(node).alias("node"), F.col(family).alias("family")).where("family is not null").distinct()
    rows = labels.join(f, "node")
    size = rows.groupBy("perm", "family").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    cells = rows.groupBy("perm", "family", "root").agg(F.count(F.lit(1)).alias("_c"))
    pairs = cells.join(size, ["perm", "family"]).groupBy("perm", "family", "members").agg((F.sum(F.col("_c") * (F.col("_c") - 1)) / (F.col("members").cast("double") * (F.col("members") - 1))).alias("_t"))
    whole = pairs.groupBy("family").agg(F.max("members").alias("members"), F.avg("_t").alias("together")).withColumn("node", F.lit(None).cast(dict(f.dtypes)["node"]))
    own = rows.join(cells, ["perm", "family", "root"]).join(size, ["perm", "family"]).groupBy("family", "node").agg(F.max("members").alias("members"), F.avg((F.col("_c") - 1) / (F.col("members") - 1)).alias("together"))
    return whole.select("family", "node", "members", "together").unionByName(own.select("family", "node", "members", "together"))


def family_separation(pairs: DataFrame, families: DataFrame, labels: DataFrame, node: str, family: str) -> DataFrame:
    """(family, resamples, mean, sd, least, above): over resamples, mean similarity within a family less that to the other families.

    From sums over the pairs that share something; all pairs count. above is the share of resamples over 0.
    """
    f = families.select(F.col(node).alias("node"), F.col(family).alias("family")).where("family is not null").distinct()
    here = labels.select("perm", "node").join(f, "node")
    size = here.groupBy("perm", "family").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    total = size.groupBy("perm").agg(F.sum("_n").alias("_t"))
    p = pairs.join(f.select(F.col("node").alias("a"), F.col("family").alias("_fa")), "a").join(f.select(F.col("node").alias("b"), F.col("family").alias("_fb")), "b")
    inside = F.col("_fa") == F.col("_fb")
    ends = p.select("perm", F.explode(F.array_distinct(F.array("_fa", "_fb"))).alias("family"), inside.alias("_inside"), "jaccard")
    sums = ends.groupBy("perm", "family").agg(F.sum(F.when(F.col("_inside"), F.col("jaccard"))).alias("_in"), F.sum(F.when(~F.col("_inside"), F.col("jaccard"))).alias("_out"))
    return _separation(size.join(total, "perm").join(sums, ["perm", "family"], "left"))


def _separation(rows: DataFrame) -> DataFrame:
    """family_separation's columns from (family, _n, _t, _in, _out), a row for each resample."""
    rows = rows.na.fill(0.0, ["_in", "_out"])
    gap = ratio("_in", F.col("_n") * (F.col("_n") - 1) / 2.0) - ratio("_out", F.col("_n") * (F.col("_t") - F.col("_n")))
    s = rows.withColumn("_gap", gap)
    return s.groupBy("family").agg(F.count("_gap").alias("resamples"), F.avg("_gap").alias("mean"), F.stddev_samp("_gap").alias("sd"), F.min("_gap").alias("least"), F.avg((F.col("_gap") > 0).cast("double")).alias("above"))


def _masked(bits: pa.Array, values: pa.Array, times: int, kind: str) -> np.ndarray:
    """(rows, times): a row's values where it has a bit, else 0."""
    flat = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint8)
    mask = np.unpackbits(flat(bits).reshape(len(bits), -1), axis=1, count=times).astype(bool)
    out = np.zeros(mask.shape, np.int64)
    out[mask] = flat(values).view(kind)
    return out


def drawn_bits(items: DataFrame, owner: str, item: str, times: int, size: int, seed: str = "boot") -> DataFrame:
    """(owner, item, bits, sizes): the draws of `resampled` as one row for each owner and item, with a bit for each resample that has it.

    sizes are the numbers of different items that the owner has in those resamples, two bytes each.
    """
    sets = items.select(F.col(owner).alias("owner"), F.col(item).alias("item")).where("owner is not null and item is not null").distinct()
    # an owner's items are one row: a program's list, not a table's rows
    lists = sets.groupBy("owner").agg(F.array_sort(F.collect_list("item")).alias("_items")).select("owner", F.col("owner").cast("string").alias("_name"), "_items")
    ends = [str(j).encode() for j in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(2)[i].values
                heads = [f"{seed}|{perm}|{batch.column(1)[i].as_py()}|".encode() for perm in range(1, times + 1)]
                at = np.frombuffer(b"".join(hashlib.md5(head + end).digest()[:4] for head in heads for end in ends), ">u4") % len(own)
                drawn = np.zeros((len(own), times), bool)
                drawn[at, np.repeat(np.arange(times), size)] = True
                many, some = drawn.sum(0).astype("<u2"), np.flatnonzero(drawn.any(1))
                bits, sizes = [np.packbits(drawn[k]).tobytes() for k in some], [many[drawn[k]].tobytes() for k in some]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(some), i))), own.take(pa.array(some)), pa.array(bits, pa.binary()), pa.array(sizes, pa.binary())], ["owner", "item", "bits", "sizes"])

    kinds = dict(sets.dtypes)
    return lists.repartition(4 * lists.sparkSession.sparkContext.defaultParallelism, "owner").mapInArrow(run, f"owner {kinds['owner']}, item {kinds['item']}, bits binary, sizes binary")


def resampled_separation(items: DataFrame, owner: str, item: str, families: DataFrame, node: str, family: str, times: int = 250, size: int = 50, seed: str = "boot") -> DataFrame:
    """family_separation over the resamples of `resampled`, whose pairs are not written once for each resample.

    Owners meet once for each item that they both may draw; what leaves a task are bits and sizes of the resamples
    in which both have it, and sums by family and resample.
    """
    f = settled(families.select(F.col(node).alias("owner"), F.col(family).alias("family")).where("family is not null").distinct())
    rows = settled(drawn_bits(items, owner, item, times, size, seed).join(f, "owner"))
    n = settled(rows.select("owner", "family").distinct().groupBy("family").agg(F.count(F.lit(1)).cast("double").alias("_n")))
    names = {"owner": "_b", "family": "_fb", "bits": "_bits", "sizes": "_sizes"}
    met = rows.hint("merge").join(rows.withColumnsRenamed(names), "item").where("owner < _b").select(F.col("owner").alias("_a"), "_b", F.col("family").alias("_fa"), "_fb", "bits", "sizes", "_bits", "_sizes")
    kinds = dict(met.dtypes)
    keys = ["_a", "_b", "_fa", "_fb"]

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                a, b = _masked(part.column(4), part.column(5), times, "<u2"), _masked(part.column(6), part.column(7), times, "<u2")
                mask = (a > 0) & (b > 0)
                some, total = np.flatnonzero(mask.any(1)), (a + b).astype("<u2")
                out = [pa.array([x.tobytes() for x in np.packbits(mask[some], axis=1)], pa.binary()), pa.array([total[k][mask[k]].tobytes() for k in some], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(pa.array(some)) for i in range(4)], *out], [*keys, "bits", "sizes"])

    packed = met.mapInArrow(both, ", ".join(f"{c} {kinds[c]}" for c in keys) + ", bits binary, sizes binary").repartition(*keys).sortWithinPartitions(*keys)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        last, shared, total = None, np.zeros(times), np.zeros(times)

        def close(pairs: list, k: np.ndarray, s: np.ndarray) -> None:
            jaccard = np.divide(k, s - k, out=np.zeros(k.shape), where=k > 0)
            for kind in {p[2:] for p in pairs}:
                found = jaccard[[p[2:] == kind for p in pairs]].sum(0)
                for one in set(kind):
                    sums.setdefault(one, np.zeros((2, times)))[int(kind[0] != kind[1])] += found

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                own = list(zip(*[part.column(i).to_pylist() for i in range(4)], strict=True))
                s = _masked(part.column(4), part.column(5), times, "<u2")
                first = [i for i, p in enumerate(own) if not i or p != own[i - 1]]
                k, s, pairs = np.add.reduceat(s > 0, first, axis=0, dtype=float), np.maximum.reduceat(s, first, axis=0).astype(float), [own[i] for i in first]
                # a pair's rows may go on in the next part
                if last == pairs[0]:
                    k[0], s[0] = k[0] + shared, np.maximum(s[0], total)
                elif last is not None:
                    close([last], shared[None], total[None])
                close(pairs[:-1], k[:-1], s[:-1])
                last, shared, total = pairs[-1], k[-1], s[-1]
        if last is not None:
            close([last], shared[None], total[None])
        for one, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([one] * times), pa.array(np.arange(1, times + 1), pa.int32()), pa.array(x[0]), pa.array(x[1])], ["family", "perm", "_in", "_out"]).cast(pa.schema([("family", batch.schema.field(2).type), ("perm", pa.int32()), ("_in", pa.float64()), ("_out", pa.float64())]))

    sums = packed.mapInArrow(add, f"family {kinds['_fa']}, perm int, _in double, _out double").groupBy("perm", "family").agg(F.sum("_in").alias("_in"), F.sum("_out").alias("_out"))
    every = n.crossJoin(n.agg(F.sum("_n").alias("_t"))).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(int(times)))))
    return _separation(every.join(sums, ["perm", "family"], "left"))


def top_n_sweep(items: DataFrame, owner: str, item: str, rank: str, tops: Sequence[int], k: int) -> DataFrame:
    """For each pair of top-N item lists the adjusted Rand index of their k clusters, with either one's silhouette.

    N is a key: one pair table and one set of merge rounds for all of them.
    """
    # written once: pairs and nodes are both made from them
    lists = settled(items.where(F.col(owner).isNotNull()).select(owner, item, rank)).withColumn("n", F.explode(F.array(*[F.lit(int(n)) for n in tops]))).where(F.col(rank) <= F.col("n"))
    pairs = settled(similarity.set_overlaps(lists, ["n"], owner, item).select("n", "a", "b", "jaccard"))
    found = settled(linkage_clusters(pairs, lists.select("n", owner), ["n"], owner, "jaccard", [k]))
    side = lambda t: found.select("owner", F.col("n").alias(f"n_{t}"), F.col("cluster").alias(f"c{t}"), F.col("silhouette").alias(f"silhouette_{t}"))
    both = side("a").join(side("b"), "owner").where("n_a < n_b")
    ari = similarity.agreement(both, ["n_a", "n_b"], "ca", "cb").select("n_a", "n_b", "ari")
    return ari.join(both.groupBy("n_a", "n_b").agg(F.max("silhouette_a").alias("silhouette_a"), F.max("silhouette_b").alias("silhouette_b")), ["n_a", "n_b"])


def functional_order(df: DataFrame, group: str, order: Sequence[str], clusters: DataFrame, owner: str) -> DataFrame:
    """Owners by the given order of groups, then the leaf place within their group: (group, owner, place from 1).

    Groups that are not in the order come last, by name; numbers are counted across ranges, not in one task.
    """
    rows = df.select(group, owner).distinct().join(clusters.select(F.col("owner").alias(owner), F.col("place").alias("_leaf")), owner)
    at = F.array_position(F.array(*map(F.lit, order)), F.col(group))
    g: Column = F.when(at > 0, at).otherwise(len(order) + 1)
    counted = running_sum(rows, [], [g, F.col(group), F.col("_leaf"), F.col(owner)], F.lit(1), "_before")
    return counted.select(group, owner, (F.col("_before") + 1).cast("int").alias("place"))
