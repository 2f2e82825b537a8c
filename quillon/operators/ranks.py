"""Rankings, top-N, dedupe, bins and windows within groups."""

from __future__ import annotations

import atexit
import functools
import inspect
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import finite, ratio


def over(by: Sequence[str], *order: Column | str):
    w = Window.partitionBy(*by)
    return w.orderBy(*order) if order else w


def settled(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read again: lineage ends there, and a lost executor costs no more than this step.

    The folder is spark.checkpoint.dir; only a local session without one gets a temporary folder. A written table has a
    size that joins can see, and unlike checkpoint() it hands no constraints on, which grow with every round of a loop.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(f"file://{folder}")
    path = f"{sc.getCheckpointDir()}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes settled tables that nothing will read any more; others stay as they are."""
    for df in tables:
        if path := getattr(df, "_settled_at", None):
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def with_groups(df: DataFrame, groups: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """df with the columns of its group, one row a group; groups with a null key find each other.

    The few rows of `groups` come from partial aggregates, so no group is gathered in one task.
    """
    if not by:
        return df.crossJoin(groups)
    names = {c: f"_group_{c}" for c in by}
    renamed = groups.select(*[F.col(c).alias(n) for c, n in names.items()], *[c for c in groups.columns if c not in by])
    return df.join(renamed, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]), how).drop(*names.values())


def wrapped(by: Sequence[str]) -> dict[str, str]:
    """Names of our own for group columns. As structs (see wrap) null keys join like any other, and no column of ours clashes with them."""
    return {c: f"_by_{i}" for i, c in enumerate(by)}


def wrap(df: DataFrame, by: Sequence[str], *columns: Column | str) -> DataFrame:
    return df.select(*[F.struct(F.col(c).alias("key")).alias(n) for c, n in wrapped(by).items()], *columns)


def unwrap(by: Sequence[str]) -> list[Column]:
    return [F.col(f"{n}.key").alias(c) for c, n in wrapped(by).items()]


def fresh(df: DataFrame, prefix: str) -> str:
    """The prefix with as many underscores before it as no column of df starts with (names ignore case)."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(prefix.lower()) for c in taken):
        prefix = "_" + prefix
    return prefix


def any_group_name(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Lets the group columns of an operator with a `by` have any name, also one that the operator gives to its own columns.

    Tables that have all group columns are read under other names for these, and the result gets the names back.
    """
    signature = inspect.signature(operator)

    @functools.wraps(operator)
    def run(*args, **options):
        bound = signature.bind(*args, **options)
        by = list(bound.arguments["by"])
        tables = {k: v for k, v in bound.arguments.items() if isinstance(v, DataFrame) and set(by) <= set(v.columns)}
        prefix = "_by_"
        for df in tables.values():
            prefix = fresh(df, prefix)
        names = {c: f"{prefix}{i}" for i, c in enumerate(by)}
        for k, df in tables.items():
            bound.arguments[k] = df.withColumnsRenamed(names)
        bound.arguments["by"] = list(names.values())
        out = operator(*bound.args, **bound.kwargs)
        back = {n: c for c, n in names.items()}
        return out.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in out.columns])

    return run


class Ranges:
    """A table dealt by ranges of (group, order) and written, so that what runs along a group needs no task with the whole group.

    A range works on its own rows; what the ranges before or after it pass on is one row for each range of a group.
    Rows of equal order always share a range.
    """

    def __init__(self, df: DataFrame, by: Sequence[str], order: Sequence[Column | str]):
        self.columns, own = df.columns, fresh(df, "_range")
        self.group = [f"{own}_by_{i}" for i in range(len(by))]
        self.order = [f"{own}_order_{i}" for i in range(len(order))]
        keys = dict(zip(self.group, map(F.col, by), strict=True)) | dict(zip(self.order, [F.col(c) if isinstance(c, str) else c for c in order], strict=True))
        self.part = [*self.group, own]
        self.rows = settled(df.withColumns(keys).repartitionByRange(*keys).withColumn(own, F.spark_partition_id()))

    def within(self):
        """Window over a range's rows in order."""
        return over(self.part, *self.order)

    def totals(self, rows: DataFrame, *aggregates: Column) -> DataFrame:
        return rows.groupBy(*self.part).agg(*aggregates)

    def before(self):
        """Window over the ranges of a group that come before."""
        return over(self.group, self.part[-1]).rowsBetween(Window.unboundedPreceding, -1)

    def after(self):
        return over(self.group, self.part[-1]).rowsBetween(1, Window.unboundedFollowing)

    def join(self, rows: DataFrame, totals: DataFrame) -> DataFrame:
        return with_groups(rows, totals, self.part)


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], x: Column, out: str) -> DataFrame:
    """Sum of x over the rows of the group that come before this one; `order` tells all rows of a group apart (see Ranges)."""
    at = fresh(df, "_sum")
    r = Ranges(df.withColumn(at, x.cast("long")), by, order)
    sums = r.totals(r.rows, F.sum(at).alias(f"{at}_s")).withColumn(f"{at}_start", F.coalesce(F.sum(f"{at}_s").over(r.before()), F.lit(0))).drop(f"{at}_s")
    own = F.coalesce(F.sum(at).over(r.within().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return r.join(r.rows, sums).withColumn(out, F.col(f"{at}_start") + own).select(*df.columns, out)


def rank_average(df: DataFrame, by: Sequence[str], x: str, out: str) -> DataFrame:
    """Average rank of ties, from 1. NULL has no rank.

    The first place of the ties is the rank, the last one the rows up to and with them: one sort for both, of a range
    of the group's values (see Ranges). Rows of one value are in one range.
    """
    missing = F.when(F.col(x).isNull(), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    r = Ranges(df, by, [F.col(x).isNull(), F.col(x), missing])
    at = fresh(r.rows, "_before")
    counts = r.totals(r.rows, F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn(at, F.coalesce(F.sum("n").over(r.before()), F.lit(0))).drop("n")
    w = over(r.part, r.order[1])
    place = (F.rank().over(w) + F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, 0))) / F.lit(2.0)
    rows = r.join(r.rows.where(F.col(x).isNotNull()), counts).withColumn(out, (F.col(at) + place).cast("double")).select(*[c for c in df.columns if c != out], out)
    none = r.rows.where(F.col(x).isNull()).withColumn(out, F.lit(None).cast("double")).select(*[c for c in df.columns if c != out], out)
    return rows.unionByName(none)


def row_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(over(by, *order)))


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark limits the groups before the shuffle."""
    return row_rank(df, by, order, out).where(F.col(out) <= n)


def both_tails(df: DataFrame, by: Sequence[str], x: str, key: str, n: int) -> DataFrame:
    """The n most positive and n most negative rows of each group, zero, NaN and infinities in neither."""
    side = F.when(finite(x) > 0, "positive").when(finite(x) < 0, "negative")
    rows = df.withColumn("tail", side).where("tail is not null")
    return top_n(rows, [*by, "tail"], [F.abs(F.col(x)).desc(), F.col(key)], n)


def strongest(df: DataFrame, by: Sequence[str], x: str, key: str, n: int = 8) -> DataFrame:
    """The n rows of the largest |x| in each group; rows whose x is null, NaN or infinite are left out."""
    return top_n(df.where(finite(x).isNotNull()), by, [F.abs(F.col(x)).desc(), F.col(key)], n)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in this order."""
    return top_n(df, keys, order, 1, "_first").drop("_first")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: Sequence[Column] = ()) -> DataFrame:
    """Rows of both; where a key is in both, the new row.

    Several rows of one key: the one that `version` sorts first, and after that the greatest by all columns.
    """
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(c).desc_nulls_last() for c in both.columns if c not in {*keys, "_v"}]
    return keep_first(both, keys, [F.desc("_v"), *version, *rest]).drop("_v")


#: What a scaling needs of a group, and the columns it makes of that.
Scaling = tuple[list[Column], Callable[[list[Column]], dict[str, Column]]]


def scaled(df: DataFrame, by: Sequence[str], *scalings: Scaling) -> DataFrame:
    """df with the columns of all scalings: one aggregate gives the constants of all of them, one join brings them back.

    Chained scalings would each read the table twice, and twice what the one before them reads. Groups with a null key
    keep their rows.
    """
    own = fresh(df, "_constant")
    names = [[f"{own}_{i}_{j}" for j in range(len(needs))] for i, (needs, _) in enumerate(scalings)]
    constants = [c.alias(n) for (needs, _), own_names in zip(scalings, names, strict=True) for c, n in zip(needs, own_names, strict=True)]
    rows = with_groups(df, df.groupBy(*by).agg(*constants), by)
    made: dict[str, Column] = {}
    for (_, make), own_names in zip(scalings, names, strict=True):
        made |= make([F.col(n) for n in own_names])
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], *[c.alias(n) for n, c in made.items()])


def z_of(x: str, out: str, least: float = 1e-12, constant: float | None = None) -> Scaling:
    v = finite(x)

    def make(c: list[Column]) -> dict[str, Column]:
        z = F.when(c[1] > least, (v - c[0]) / F.nullif(c[1], F.lit(0.0)))
        return {out: z.when(v.isNotNull(), F.lit(constant).cast("double"))}

    return [F.avg(v), F.stddev_pop(v)], make


def centred_of(x: str, out: str) -> Scaling:
    v = finite(x)
    return [F.avg(v)], lambda c: {out: v - c[0]}


def min_max_of(x: str, out: str, constant: float = 0.5, zero: str | None = None) -> Scaling:
    v = finite(x)

    def make(c: list[Column]) -> dict[str, Column]:
        at = lambda y: F.when(c[1] > c[0], (y - c[0]) / F.nullif(c[1] - c[0], F.lit(0.0)))
        return {out: at(v).when(v.isNotNull(), F.lit(constant))} | ({zero: at(F.lit(0.0))} if zero else {})

    return [F.min(v), F.max(v)], make


def share_of(x: str, out: str) -> Scaling:
    v = finite(x)
    return [F.sum(v)], lambda c: {out: ratio(v, c[0])}


def log_of(x: str, out: str, scale: float = 1e4) -> Scaling:
    v = finite(x)
    return [F.sum(v)], lambda c: {out: F.log1p(F.coalesce(ratio(v, c[0]), F.lit(0.0)) * F.lit(scale))}


def sd_level_of(x: str, out: str, k: float = 1.0) -> Scaling:
    v = finite(x)
    return [F.avg(v), F.stddev_pop(v)], lambda c: {out: F.when(v >= c[0] + k * c[1], "HIGH").when(v <= c[0] - k * c[1], "LOW").when(v.isNotNull(), "MID")}


def quartile_of(x: str, out: str) -> Scaling:
    v = finite(x)
    return [F.percentile(v, F.lit(0.25)), F.percentile(v, F.lit(0.75))], lambda c: {out: F.when(v >= c[1], "HIGH").when(v <= c[0], "LOW")}


def fallback_of(first: Column, second: Column, out: str = "mask", rule: str = "rule") -> Scaling:
    return [F.count_if(first)], lambda c: {rule: F.when(c[0] > 0, "primary").otherwise("fallback"), out: F.coalesce(F.when(c[0] > 0, first).otherwise(second), F.lit(False))}


def quantile_of(x: str, bins: int, out: str) -> Scaling:
    v = finite(x)

    def make(c: list[Column]) -> dict[str, Column]:
        return {out: F.when(v.isNotNull(), F.greatest(F.size(F.filter(c[0], lambda e: e < v)) - 1, F.lit(0)))}

    return [F.array_distinct(F.percentile(v, F.array(*[F.lit(i / bins) for i in range(bins + 1)])))], make


def z_score(df: DataFrame, by: Sequence[str], x: str, out: str, least: float = 1e-12, constant: float | None = None) -> DataFrame:
    """(x - mean) / population sd of the group; `constant` (NULL) where the sd is at most `least`. NaN and infinities count as NULL, here and below."""
    return scaled(df, by, z_of(x, out, least, constant))


def min_max(df: DataFrame, by: Sequence[str], x: str, out: str, constant: float = 0.5, zero: str | None = None) -> DataFrame:
    """Scaled to [0, 1] within the group; a constant group gets `constant`. `zero` names a column for the place of the raw 0 on that scale."""
    return scaled(df, by, min_max_of(x, out, constant, zero))


def share(df: DataFrame, by: Sequence[str], x: str, out: str) -> DataFrame:
    """x over the group's sum; NULL where the sum is 0."""
    return scaled(df, by, share_of(x, out))


def log_normalised(df: DataFrame, by: Sequence[str], x: str, out: str, scale: float = 1e4) -> DataFrame:
    """ln(1 + scale * share); 0 where the group's sum is 0."""
    return scaled(df, by, log_of(x, out, scale))


def sd_groups(df: DataFrame, by: Sequence[str], x: str, out: str, k: float = 1.0) -> DataFrame:
    """HIGH from mean + k sd on, LOW up to mean - k sd, else MID (population sd of the group)."""
    return scaled(df, by, sd_level_of(x, out, k))


def enough_on_both_sides(rows: DataFrame, by: Sequence[str], side: str, least: int) -> DataFrame:
    """Rows on the HIGH or LOW side, of groups with at least `least` on either. A group with values has one on either side of its quartiles."""
    rows = rows.where(F.col(side).isNotNull())
    if least <= 1:
        return rows
    n = rows.groupBy(*by).agg(F.count_if(F.col(side) == "HIGH").alias("_hi"), F.count_if(F.col(side) == "LOW").alias("_lo"))
    return with_groups(rows, n.where((F.col("_hi") >= least) & (F.col("_lo") >= least)).drop("_hi", "_lo"), by)


def quartile_split(df: DataFrame, by: Sequence[str], x: str, out: str, least: int = 15) -> DataFrame:
    """HIGH from the third quartile on, LOW up to the first; rows of groups with fewer than `least` on a side go."""
    return enough_on_both_sides(scaled(df, by, quartile_of(x, out)), by, out, least)


def fallback_mask(df: DataFrame, by: Sequence[str], first: Column, second: Column, out: str = "mask", rule: str = "rule") -> DataFrame:
    """The first mask; in groups where it holds nowhere, the second. `rule` says which one was used."""
    return scaled(df, by, fallback_of(first, second, out, rule))


def quantile_code(df: DataFrame, by: Sequence[str], x: str, bins: int, out: str) -> DataFrame:
    """0 .. bins - 1 by quantile edges (equal edges count once); the lowest value belongs to the first bin."""
    return scaled(df, by, quantile_of(x, bins, out))


def relative_gain(df: DataFrame, by: Sequence[str], order: str, x: str, out: str) -> DataFrame:
    """How much x fell since the row before, in per cent of that."""
    before = F.lag(x).over(over(by, order))
    return df.withColumn(out, ratio(before - F.col(x), before) * 100.0)


def log_elbow(df: DataFrame, by: Sequence[str], order: str, x: str) -> DataFrame:
    """The place with the largest second difference of ln(x); with fewer than three places the least x."""
    w = over(by, order)
    rows = df.withColumn("_l", F.ln(x)).withColumn("_d", F.lag("_l").over(w) - 2 * F.col("_l") + F.lead("_l").over(w))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(over(by)))
    score = F.when(F.col("_n") < 3, -F.col(x)).otherwise(F.col("_d"))
    return keep_first(rows.withColumn("_s", score).where("_s is not null"), by, [F.desc("_s"), F.col(order)]).select(*by, F.col(order).alias("elbow"))


def chord_elbow(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """The x whose point lies farthest from the chord between first and last point: x scaled to [0, 1], y over its first value.

    Up to two points: the first one.
    """
    w = over(by, x).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_n", F.count(F.lit(1)).over(w))
    x0, x1, y0 = F.first(x).over(w), F.last(x).over(w), F.first(y).over(w)
    rows = rows.withColumn("_x", ratio(F.col(x) - x0, x1 - x0)).withColumn("_y", ratio(y, y0))
    a0, b0, a1, b1 = F.first("_x").over(w), F.first("_y").over(w), F.last("_x").over(w), F.last("_y").over(w)
    far = F.when(F.col("_n") > 2, F.abs((b1 - b0) * F.col("_x") - (a1 - a0) * F.col("_y") + a1 * b0 - b1 * a0)).otherwise(0.0)
    return keep_first(rows.withColumn("_far", F.round(F.coalesce(far, F.lit(0.0)), 9)), by, [F.desc("_far"), F.col(x)]).select(*by, F.col(x).alias("elbow"))


def running_share(df: DataFrame, by: Sequence[str], order: Sequence[Column], x: str, out: str) -> DataFrame:
    """The running sum of x over the group's sum."""
    w = over(by, *order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, ratio(F.sum(x).over(w), F.sum(x).over(over(by))))


def relabel_by_median(df: DataFrame, by: Sequence[str], label: str, x: str, out: str) -> DataFrame:
    """Labels numbered from 0 in order of the median of x."""
    medians = df.groupBy(*by, label).agg(F.percentile(x, F.lit(0.5)).alias("_m"))
    codes = medians.withColumn(out, F.row_number().over(over(by, "_m", label)) - 1).drop("_m")
    return with_groups(df, codes, [*by, label])
