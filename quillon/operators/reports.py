"""Tables behind reports: summaries by group, funnels, classes, votes and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import finite, ratio

from .ranks import keep_first, over, top_n, with_groups
from .statistics import finite_columns


def wide(df: DataFrame, by: Sequence[str], key: str, values: Sequence, x: Column) -> DataFrame:
    """Pivot with an explicit list of values, so no job looks them up."""
    return df.groupBy(*by).pivot(key, list(values)).agg(x)


def long(df: DataFrame, by: Sequence[str], columns: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    return df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(by), list(columns), name, value)


def item_rows(df: DataFrame, keys: Sequence[str], text: str, sep: str = ";") -> DataFrame:
    """A list kept as text, as rows (item, rank from 1); blank items are left out and take no rank."""
    items = F.filter(F.transform(F.split(F.col(text), sep), lambda s: F.trim(s)), lambda s: s != "")
    return df.select(*keys, F.posexplode(items).alias("_at", "item")).select(*keys, "item", (F.col("_at") + 1).alias("rank"))


def digest(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """`label(n);..` by group, the most frequent first, then by name."""
    n = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct((-F.col("n")).alias("k"), F.col(label).cast("string").alias("l"))
    one = lambda e: F.concat(e["l"], F.lit("("), (-e["k"]).cast("string"), F.lit(")"))
    return n.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), one), ";").alias("digest"))


def joined_labels(df: DataFrame, by: Sequence[str], label: str, sep: str = ";") -> DataFrame:
    """The sorted different labels of a group as text."""
    return df.select(*by, label).distinct().groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(label)), sep).alias("labels"))


def dominant(df: DataFrame, by: Sequence[str], label: str, x: str) -> DataFrame:
    """The label with the largest mean value (a tie: the first by name), with that mean."""
    m = finite_columns(df, x).groupBy(*by, label).agg(F.avg(x).alias("mean")).where("mean is not null")
    return keep_first(m.withColumn("_k", F.round("mean", 9)), by, [F.desc("_k"), F.col(label)]).drop("_k")


def domain_means(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean of every column and the number of rows by group."""
    return finite_columns(df, *columns).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])


def top_contribution(df: DataFrame, by: Sequence[str], key: str, x: str, tops: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """The share of sum |x| that the N largest have, for each N."""
    rows = finite_columns(df, x).withColumn("_a", F.abs(x)).where("_a is not null")
    ranked = top_n(rows, by, [F.desc("_a"), F.col(key)], max(tops), "_r")
    head = ranked.groupBy(*by).agg(*[F.sum(F.when(F.col("_r") <= n, F.col("_a"))).alias(f"_top{n}") for n in tops])
    total = rows.groupBy(*by).agg(F.sum("_a").alias("_t"))
    return with_groups(head, total, by).select(*by, *[ratio(f"_top{n}", "_t").alias(f"top{n}") for n in tops])


def tail_summary(df: DataFrame, by: Sequence[str], order: str, key: str, x: str, fraction: float = 0.1) -> DataFrame:
    """n, mean and median of x in the first and the last round(n * fraction) rows (at least one) in the order of `order`."""
    rows = df.where(F.col(order).isNotNull())
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = with_groups(rows, n.withColumn("_k", F.greatest(F.lit(1), F.bround(F.col("_n") * fraction).cast("long"))), by)
    rows = rows.withColumn("_i", F.row_number().over(over(by, F.col(order), F.col(key))))
    ends = rows.withColumn("tail", F.explode(F.array_compact(F.array(F.when(F.col("_i") <= F.col("_k"), "low"), F.when(F.col("_i") > F.col("_n") - F.col("_k"), "high")))))
    return ends.groupBy(*by, "tail").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"))


def net_signs(df: DataFrame, keys: Sequence[str], sign: str) -> DataFrame:
    """One row per key with the sign of the sum of its signs; duplicates that cancel out go."""
    return df.groupBy(*keys).agg(F.signum(F.sum(F.signum(F.col(sign).cast("double")))).cast("int").alias("sign")).where("sign <> 0")


def member_audit(df: DataFrame, cell: Sequence[str]) -> DataFrame:
    """How many cells have one, two or more members."""
    n = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    return n.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("_n") == 1).alias("one"), F.count_if(F.col("_n") == 2).alias("two"), F.count_if(F.col("_n") > 2).alias("more"), F.max("_n").alias("largest"))


def robust_core(df: DataFrame, group: str, groups: DataFrame, keep: Column, up: Column) -> DataFrame:
    """Kept rows by group and pooled, for every group of a fixed dimension: up, down, majority and minority."""
    rows = df.where(keep).withColumn("_up", up)
    n = rows.groupingSets([[group], []], group).agg(F.when(F.grouping(group) == 1, "pooled").otherwise(F.col(group)).alias("_g"), F.count_if("_up").alias("up"), F.count_if(~F.col("_up")).alias("down")).drop(group)
    fixed = groups.select(F.col(group).alias("_g")).union(groups.sparkSession.createDataFrame([("pooled",)], "g string")).distinct()
    out = fixed.join(n, "_g", "left").na.fill(0, ["up", "down"])
    return out.select(F.col("_g").alias(group), "up", "down", (F.col("up") + F.col("down")).alias("total"), F.greatest("up", "down").alias("majority"), F.least("up", "down").alias("minority"))


def funnel(sources: Sequence[tuple[str, DataFrame]], group: str) -> DataFrame:
    """Rows of each source by group, wide: a column per source, 0 where a group has none."""
    tagged = None
    for name, df in sources:
        one = df.select(group, F.lit(name).alias("_s"))
        tagged = one if tagged is None else tagged.union(one)
    names = [name for name, _ in sources]
    return wide(tagged, [group], "_s", names, F.count(F.lit(1))).na.fill(0, names)


def coverage(df: DataFrame, group: str, order: Sequence[str], item: str) -> DataFrame:
    """Rows and different items of each group of a fixed order, with its place; groups without rows have 0."""
    fixed = df.sparkSession.createDataFrame([(g, i) for i, g in enumerate(order)], f"{group} string, place int")
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(item).alias("items"))
    return fixed.join(n, group, "left").na.fill(0, ["n", "items"])


def signal_classes(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with their class: shared, first_only or second_only."""
    a, b = first.select(*keys).distinct().withColumn("_a", F.lit(1)), second.select(*keys).distinct().withColumn("_b", F.lit(1))
    return a.join(b, list(keys), "full").withColumn("class", F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "shared").when(F.col("_a").isNotNull(), "first_only").otherwise("second_only")).drop("_a", "_b")


def symbol_tags(df: DataFrame, symbol: str, rules: Sequence[tuple[str, str]], other: str = "other") -> DataFrame:
    """All tags of a symbol (pattern rules in order of priority) and the primary one."""
    tags = F.array_compact(F.array(*[F.when(F.col(symbol).rlike(pattern), name) for name, pattern in rules]))
    return df.withColumn("tags", tags).withColumn("primary_tag", F.coalesce(F.get("tags", F.lit(0)), F.lit(other)))


def source_audit(sources: Sequence[tuple[str, DataFrame]], columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per source: missing columns, rows, repeated keys, and an order-free hash of the keys."""
    out = None
    for name, df in sources:
        missing = ";".join(c for c in columns if c not in df.columns)
        n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        mark = F.sum(F.conv(F.substr(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), F.lit(1), F.lit(8)), 16, 10).cast("long"))
        row = n.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count_if(F.col("_n") > 1).alias("repeated_keys"), F.coalesce(mark, F.lit(0)).alias("key_hash")).select(F.lit(name).alias("source"), F.lit(missing).alias("missing_columns"), "rows", "repeated_keys", "key_hash")
        out = row if out is None else out.union(row)
    return out


def paired_positions(df: DataFrame, by: Sequence[str], unit: Sequence[str], side: str, x: str) -> DataFrame:
    """Units with HIGH and LOW medians of x side by side, summed up: medians, how often HIGH is above, units."""
    m = finite_columns(df, x).groupBy(*by, *unit).agg(F.percentile(F.when(F.col(side) == "HIGH", F.col(x)), F.lit(0.5)).alias("high"), F.percentile(F.when(F.col(side) == "LOW", F.col(x)), F.lit(0.5)).alias("low")).where("high is not null and low is not null")
    d = F.col("high") - F.col("low")
    return m.groupBy(*by).agg(F.count(F.lit(1)).alias("units"), F.percentile("high", F.lit(0.5)).alias("high"), F.percentile("low", F.lit(0.5)).alias("low"), F.percentile(d, F.lit(0.5)).alias("difference"), F.count_if(d > 0).alias("higher"))


def rule_votes(df: DataFrame, key: str, text: str, terms: DataFrame, weight: str = "weight") -> DataFrame:
    """The rule with the highest score per key: the weights of its patterns found in the text (a tie: the earlier rule).

    terms: (rule, place, pattern, weight), a small dimension. Keys without a hit have no row.
    """
    hits = df.select(key, F.lower(F.col(text)).alias("_t")).crossJoin(terms).where(F.expr("_t rlike pattern"))
    score = hits.groupBy(key, "rule", "place").agg(F.sum(weight).alias("score"))
    return keep_first(score, [key], [F.desc("score"), F.col("place")]).drop("place")


def dense_labels(df: DataFrame, by: Sequence[str], label: str, out: str = "number") -> DataFrame:
    """Labels renumbered from 0 without gaps in the order of their number, their suffix kept: `12_a` becomes `0_a`."""
    number = F.regexp_extract(F.col(label), r"^(\d+)", 1).try_cast("long")
    codes = df.select(*by, number.alias("_k")).where("_k is not null").distinct().withColumn("_d", F.row_number().over(over(by, F.col("_k"))) - 1)
    rows = with_groups(df.withColumn("_k", number), codes, [*by, "_k"], "left")
    return rows.withColumn(out, F.concat(F.col("_d").cast("string"), F.regexp_extract(F.col(label), r"^\d+(.*)$", 1))).drop("_k", "_d")


def label_gaps(df: DataFrame, by: Sequence[str], number: str) -> DataFrame:
    """Numbers from 0 to the largest that a group lacks, as text."""
    g = df.groupBy(*by).agg(F.collect_set(F.col(number).cast("long")).alias("_s"), F.max(F.col(number).cast("long")).alias("_m"))
    return g.select(*by, F.array_join(F.array_sort(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("_m")), F.col("_s"))), ";").alias("gaps"))


def prediction_r2(df: DataFrame, by: Sequence[str], y: str, fitted: str) -> DataFrame:
    """1 - SSE / SST of predictions; NULL for a constant y."""
    rows = df.withColumns({"_y": finite(y), "_f": finite(fitted)}).where("_y is not null and _f is not null")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (1.0 - ratio(F.sum((F.col("_y") - F.col("_f")) ** 2), F.when(F.var_pop("_y") > 1e-24, F.var_pop("_y") * F.count(F.lit(1))))).alias("r2"))


def equation(df: DataFrame, by: Sequence[str], place: str, name: str, x: str, digits: int = 3) -> DataFrame:
    """`y = +0.100*a -0.200*b` of coefficient rows in their order."""
    term = F.concat(F.when(F.col(x) < 0, "-").otherwise("+"), F.format_string(f"%.{digits}f", F.abs(x)), F.lit("*"), F.col(name))
    rows = df.withColumn("_t", F.struct(F.col(place).alias("k"), term.alias("t")))
    return rows.groupBy(*by).agg(F.concat(F.lit("y = "), F.array_join(F.transform(F.array_sort(F.collect_list("_t")), lambda e: e["t"]), " ")).alias("equation"))


def fitted_values(df: DataFrame, fits: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """df with fitted = slope * x + intercept of its segment."""
    return with_groups(df, fits.select(*by, "slope", "intercept"), by).withColumn("fitted", F.col("slope") * F.col(x) + F.col("intercept"))


def effect_order(df: DataFrame, item: str, contrast: str, x: str, primary: str) -> DataFrame:
    """Items with the place that their effect in the primary contrast gives them (largest first; missing last)."""
    g = df.groupBy(item).agg(F.max(F.when(F.col(contrast) == primary, F.col(x))).alias("effect"))
    return g.withColumn("place", F.row_number().over(over([], F.col("effect").desc_nulls_last(), F.col(item))))


def direction_counts(df: DataFrame, by: Sequence[str], group: str, order: Sequence[str], x: str) -> DataFrame:
    """Positive and negative (as a negative number) effects by group of a fixed order."""
    n = df.groupBy(*by, group).agg(F.count_if(F.col(x) > 0).alias("up"), (-F.count_if(F.col(x) < 0)).alias("down"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col(group))
    return n.withColumn("place", place).where("place > 0")


def best_term(df: DataFrame, genes: str, term: str, p: str, sep: str = "/") -> DataFrame:
    """Gene and term of an enrichment table whose genes are a list, with the term of the least p for each gene marked."""
    rows = df.select(F.explode(F.split(F.col(genes), sep)).alias("gene"), F.col(term).alias("term"), F.col(p).alias("p"))
    return rows.withColumn("best", F.row_number().over(over(["gene"], F.col("p"), F.col("term"))) == 1)


def column_inventory(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: values, missing ones, different ones, least and greatest as doubles."""
    one = lambda c: F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("missing"), F.countDistinct(c).alias("different"), F.min(F.col(c).cast("string").try_cast("double")).alias("least"), F.max(F.col(c).cast("string").try_cast("double")).alias("greatest"))
    return df.agg(F.array(*map(one, columns)).alias("_r")).select(F.inline("_r"))


def class_identity(genes: DataFrame, terms: DataFrame, cls: str, n_genes: int = 12, n_terms: int = 5) -> DataFrame:
    """Per class its top genes (gene, score) and top terms (term, p) as text, and whether it has either."""
    top = lambda df, name, order, n: top_n(df, [cls], order, n, "_r").groupBy(cls).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(name).cast("string").alias("t")))), lambda e: e["t"]), ";").alias(f"{name}s"))
    g = top(genes, "gene", [F.desc("score"), F.col("gene")], n_genes)
    t = top(terms, "term", [F.col("p"), F.col("term")], n_terms)
    return g.join(t, cls, "full").withColumn("has_terms", F.col("terms").isNotNull())


def rolled_up(long: DataFrame, mapping: DataFrame, cluster: str, group: str, by: Sequence[str], x: str) -> DataFrame:
    """Cluster values summed up to groups, with the group's rank in `by` (largest first)."""
    s = long.join(mapping.select(cluster, group), cluster).groupBy(*by, group).agg(F.sum(x).alias("total"))
    return s.withColumn("rank", F.row_number().over(over(by, F.round("total", 9).desc(), F.col(group))))


def ranking_comparison(a: DataFrame, b: DataFrame, key: str, x: str) -> DataFrame:
    """Two rankings on their common keys: how many, correlation of the values, the largest difference."""
    both = a.select(key, F.col(x).cast("double").alias("_a")).join(b.select(key, F.col(x).cast("double").alias("_b")), key)
    r = F.when((F.var_pop("_a") > 1e-24) & (F.var_pop("_b") > 1e-24), F.covar_pop("_a", "_b") / F.sqrt(F.nullif(F.var_pop("_a") * F.var_pop("_b"), F.lit(0.0))))
    return both.agg(F.count(F.lit(1)).alias("common"), r.alias("r"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_difference"))


def selected_targets(df: DataFrame, rules: Sequence[tuple[Column, str, int]]) -> DataFrame:
    """Rows that a rule (condition, class, order) takes, with the first such rule's class and order."""
    found = F.coalesce(*[F.when(ok, F.struct(F.lit(name).alias("class"), F.lit(place).alias("place"))) for ok, name, place in rules])
    return df.withColumn("_f", found).where("_f is not null").select(*df.columns, "_f.class", "_f.place")


def quality_filter(long: DataFrame, by: Sequence[str], spot: str, gene: str, count: str, least_genes: int = 500, least_counts: int = 1000, most_mito: float = 20.0, least_spots: int = 3, mito: str = "MT-") -> DataFrame:
    """Rows of the spots that pass (genes found, total, per cent of mitochondrial counts), then of genes in enough of these spots."""
    c = F.col(count)
    s = long.where(c > 0).groupBy(*by, spot).agg(F.count(F.lit(1)).alias("genes"), F.sum(c).alias("total"), (100.0 * ratio(F.sum(F.when(F.col(gene).startswith(mito), c).otherwise(0)), F.sum(c))).alias("pct"))
    good = s.where((F.col("genes") >= least_genes) & (F.col("total") >= least_counts) & (F.col("pct") < most_mito)).select(*by, spot)
    rows = long.where(c > 0).join(good, [*by, spot], "left_semi")
    wide_enough = rows.groupBy(*by, gene).agg(F.countDistinct(spot).alias("_n")).where(F.col("_n") >= least_spots).select(*by, gene)
    return rows.join(wide_enough, [*by, gene], "left_semi")


def sample_flags(df: DataFrame, by: Sequence[str], least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """PASS or CHECK by the sample means of columns against their limits."""
    g = df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in {**least, **most}])
    ok = F.lit(True)
    for c, v in least.items():
        ok = ok & F.coalesce(F.col(c) >= v, F.lit(False))
    for c, v in most.items():
        ok = ok & F.coalesce(F.col(c) < v, F.lit(False))
    return g.withColumn("flag", F.when(ok, "PASS").otherwise("CHECK"))


def circularity(signature: DataFrame, markers: DataFrame, by: Sequence[str], gene: str) -> DataFrame:
    """How much of a signature are markers of each group: overlap, per cent of the signature, the genes."""
    s = signature.select(gene).distinct()
    hit = markers.select(*by, gene).distinct().join(s, gene, "left_semi")
    g = markers.select(*by).distinct().join(hit.groupBy(*by).agg(F.count(F.lit(1)).alias("overlap"), F.array_join(F.array_sort(F.collect_list(F.col(gene).cast("string"))), ";").alias("genes")), list(by), "left")
    g = g.na.fill(0, ["overlap"]).na.fill("", ["genes"]).crossJoin(s.agg(F.count(F.lit(1)).alias("size")))
    return g.withColumn("percent", 100.0 * ratio("overlap", "size"))


def spatial_blocks(df: DataFrame, by: Sequence[str], row: str, column: str, side: int, least: int, out: str = "block") -> DataFrame:
    """Block ids from quantile codes of row and column: the largest side up to `side` that gives at least `least` blocks with rows.

    The edges of all sides come from one aggregate, the codes of all sides from one join; if no side is enough, side 1.
    """
    from .ranks import fresh, quantile_of, scaled, settled

    own = fresh(df, "_block")
    sides = range(1, side + 1)
    codes = [quantile_of(c, n, f"{own}_{i}{n}") for n in sides for i, c in enumerate((row, column))]
    rows = scaled(df, by, *codes).withColumns({f"{own}_{n}": F.col(f"{own}_0{n}") * n + F.col(f"{own}_1{n}") for n in sides})
    rows = settled(rows.select(*df.columns, *[f"{own}_{n}" for n in sides]))
    n = rows.groupBy(*by).agg(*[F.countDistinct(f"{own}_{n}").alias(f"{own}_n{n}") for n in sides])
    use = F.coalesce(*[F.when(F.col(f"{own}_n{n}") >= least, n) for n in reversed(sides)], F.lit(1))
    rows = with_groups(rows, n.withColumn(f"{own}_use", use).select(*by, f"{own}_use"), by)
    block = F.coalesce(*[F.when(F.col(f"{own}_use") == n, F.col(f"{own}_{n}")) for n in sides])
    return rows.withColumn(out, block).select(*df.columns, out)


def two_model_summary(first: DataFrame, second: DataFrame, keys: Sequence[str], z: str) -> DataFrame:
    """Keys of two models with their class, whether directions agree, and Stouffer's z over the models that have them."""
    a, b = first.select(*keys, F.col(z).alias("_a")), second.select(*keys, F.col(z).alias("_b"))
    both = a.join(b, list(keys), "full")
    x, y = F.col("_a"), F.col("_b")
    cls = F.when(x.isNotNull() & y.isNotNull(), "shared").when(x.isNotNull(), "first_only").otherwise("second_only")
    n = F.when(x.isNotNull() & y.isNotNull(), 2.0).otherwise(1.0)
    return both.select(*keys, cls.alias("class"), (F.signum(x) == F.signum(y)).alias("agree"), ((F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))) / F.sqrt(n)).alias("z"))


def set_audit(genes: DataFrame, sets: DataFrame, name: str, gene: str, least: int) -> DataFrame:
    """Per set its size, how many genes are found, the share, the found ones as text, and whether that is enough to score."""
    s = sets.select(name, gene).distinct()
    found = s.join(genes.select(gene).distinct(), gene, "left_semi").groupBy(name).agg(F.count(F.lit(1)).alias("found"), F.array_join(F.array_sort(F.collect_list(F.col(gene).cast("string"))), ";").alias("genes"))
    x = s.groupBy(name).agg(F.count(F.lit(1)).alias("size")).join(found, name, "left").na.fill(0, ["found"]).na.fill("", ["genes"])
    return x.withColumn("percent", 100.0 * ratio("found", "size")).withColumn("scored", F.col("found") >= least)


def quality_covariates(long: DataFrame, by: Sequence[str], spot: str, gene: str, count: str, mito: str = "MT-", unique: bool = False) -> DataFrame:
    """Totals, genes found and the per cent of mitochondrial counts of every spot.

    unique says that a spot has each gene in one row at most: genes are then counted, not gathered once more.
    """
    c = F.col(count)
    if unique:
        return long.where(c > 0).groupBy(*by, spot).agg(F.sum(c).alias("total"), F.count(gene).alias("detected"), (100.0 * ratio(F.sum(F.when(F.col(gene).startswith(mito), c).otherwise(0)), F.sum(c))).alias("mito"))
    return long.where(c > 0).groupBy(*by, spot).agg(F.sum(c).alias("total"), F.countDistinct(gene).alias("detected"), (100.0 * ratio(F.sum(F.when(F.col(gene).startswith(mito), c).otherwise(0)), F.sum(c))).alias("mito"))


def log_ratio_basis(spark, tree: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> DataFrame:
    """(balance, part, weight) of a sequential binary partition: balances with their plus and minus parts."""
    rows = []
    for name, plus, minus in tree:
        r, s = len(plus), len(minus)
        rows += [(name, p, (s / (r * (r + s))) ** 0.5) for p in plus] + [(name, p, -((r / (s * (r + s))) ** 0.5)) for p in minus]
    return spark.createDataFrame(rows, "balance string, part string, weight double")


def balances(long: DataFrame, basis: DataFrame, by: Sequence[str], part: str, x: str) -> DataFrame:
    """All balances of compositions kept long: the sum of weight * ln(x); NULL where a part of a balance is missing or not positive."""
    rows = long.select(*by, F.col(part).alias("part"), F.when(F.col(x) > 0, F.ln(x)).alias("_l")).join(basis, "part")
    need = basis.groupBy("balance").agg(F.count(F.lit(1)).alias("_need"))
    g = rows.groupBy(*by, "balance").agg(F.sum(F.col("weight") * F.col("_l")).alias("_v"), F.count("_l").alias("_n"))
    return g.join(need, "balance").select(*by, "balance", F.when(F.col("_n") == F.col("_need"), F.col("_v")).alias("value"))
