"""Quality rules: learned decision lists over document statistics.

The labelled documents' statistics are cut into bins at quantiles of either class; how many documents of
either class fall into each combination of bins is counted over all labelled rows, apart for a grow and a
prune fold. Sequential covering on these counts grows threshold conjunctions for the bad class by information
gain, prunes them on the other fold, and stops when a rule isn't precise enough. The list becomes one Spark
CASE expression. Everything that touches rows is DataFrame operations; the driver holds the counts only, of
at most (CUTS + 1) ** len(FEATURES) combinations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SPACE = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEATED = 50, 50
#: Ratios that the rules may use, in thousandths of words or characters.
FEATURES = ("symbols", "dup_lines", "repeated", "upper", "word_length")
#: Thresholds of a feature: the four ends of either class and INNER quantiles between them.
INNER = 4
CUTS = 2 * (4 + INNER)
#: A rule's least precision on either fold, the least bad rows that it must catch, and the length of a list: the
#: covering stops at any of the three.
PRECISION, LEAST, MOST_RULES = 0.9, 5, 12


def statistics(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_upper of the text column.

    Names take the prefix. A null text counts as empty: all zero.
    """
    t = f"{prefix}t"
    less = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    rows = docs.withColumn(t, F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACE)))
    rows = rows.withColumn(f"{prefix}w", F.when(F.col(t) == "", F.array().cast("array<string>")).otherwise(F.split(t, SPLIT)))
    w, n = F.col(f"{prefix}w"), F.size(f"{prefix}w")
    # windows of three words by hash, sorted with their places: equal neighbours stand twice or more
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))))
    rows = rows.withColumn(f"{prefix}g", F.sort_array(windows))
    g = F.col(f"{prefix}g")
    twice = F.filter(g, lambda x, k: ((k > 0) & (F.get(g, k - 1)["h"] == x["h"])) | (F.get(g, k + 1)["h"] == x["h"]))
    rows = rows.withColumn(f"{prefix}p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    p = F.col(f"{prefix}p")
    covered = F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(x - a["last"], F.lit(3))).alias("n"), x.alias("last")), lambda a: a["n"])
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    rows = rows.withColumn(f"{prefix}l", lines)
    long = {
        "n_words": n, "word_chars": F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)), "n_symbols": less("[#*$%&|<>]"),
        "n_dup_lines": F.size(f"{prefix}l") - F.size(F.array_distinct(f"{prefix}l")), "n_repeat_words": F.coalesce(covered, F.lit(0)), "n_upper": less("[A-Z]"),
    }
    return rows.withColumns({prefix + k: v.cast("long") for k, v in long.items()}).drop(*[prefix + x for x in "twgpl"])


def ratios(prefix: str = "") -> dict[str, Column]:
    """The features, whole numbers: thousandths, so that thresholds are exact."""
    c = lambda x: F.col(prefix + x)
    part = lambda a, b: F.floor(1000 * c(a) / F.greatest(c(b), F.lit(1))).cast("long")
    return {"symbols": part("n_symbols", "n_words"), "dup_lines": part("n_dup_lines", "n_words"), "repeated": part("n_repeat_words", "n_words"), "upper": part("n_upper", "word_chars"), "word_length": part("word_chars", "n_words")}


def base_failed(prefix: str = "") -> Column:
    return (F.col(f"{prefix}n_words") < MIN_WORDS) | (100 * F.col(f"{prefix}n_repeat_words") > MAX_REPEATED * F.col(f"{prefix}n_words"))


@dataclass(frozen=True)
class Rule:
    """Rejects where every (feature, "<=" or ">", threshold) holds."""

    tests: tuple[tuple[str, str, int], ...]

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for feature, op, cut in self.tests:
            out = out & ((of[feature] <= cut) if op == "<=" else (of[feature] > cut))
        return out


def learn(rows: DataFrame) -> list[Rule]:
    """The decision list of labelled rows (the statistics' names, `bad` boolean, `fold` 0 to 2; 0 prunes).

    Rows that fail the base rules teach nothing: the list only judges what passes them. Without rows of both
    classes the list is empty.
    """
    of = ratios()
    data = rows.where(~base_failed()).select("bad", "fold", *[c.alias(f) for f, c in of.items()])
    at = [i / (INNER + 1) for i in range(1, INNER + 1)]
    spread = [0.0, 0.02, 0.98, 1.0, *at]
    found = data.groupBy("bad").agg(*[F.percentile_approx(f, spread, 10_000).alias(f) for f in FEATURES]).collect()
    if len(found) < 2:
        return []
    cuts = {f: _cut_points(*[r[f] for r in sorted(found, key=lambda r: r.bad)]) for f in FEATURES}
    bins = [sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)).alias(f) for f in FEATURES]
    grown = (F.col("fold") != 0).alias("grow")
    cells = [
        (tuple(r[f] for f in FEATURES), r.grow, r.bad_n, r.good_n)
        for r in data.select(grown, "bad", *bins).groupBy("grow", *FEATURES).agg(F.count_if("bad").alias("bad_n"), F.count_if(~F.col("bad")).alias("good_n")).collect()
    ]
    return [Rule(tuple((FEATURES[i], op, cuts[FEATURES[i]][b]) for i, op, b in tests)) for tests in cover(cells, [len(cuts[f]) for f in FEATURES])]


def _cut_points(good: list[int], bad: list[int]) -> list[int]:
    """At most CUTS thresholds: the ends and the inner quantiles of either class."""
    ends = [good[3], good[2], good[0] - 1, good[1] - 1, bad[0] - 1, bad[1] - 1, bad[2], bad[3]]
    return sorted({*ends, *good[4:], *bad[4:]})


class Counts:
    """Counted cells as arrays: bins of each cell, bad and good rows in it."""

    def __init__(self, cells, width: int):
        self.bins = np.array([c for c, _, _ in cells], np.int64).reshape(len(cells), width)
        self.bad, self.good = (np.array([x[k] for x in cells], np.int64) for k in (1, 2))

    def held(self, tests: list[tuple[int, str, int]]) -> np.ndarray:
        out = np.ones(len(self.bad), bool)
        for i, op, b in tests:
            out &= (self.bins[:, i] <= b) if op == "<=" else (self.bins[:, i] > b)
        return out

    def count(self, tests: list[tuple[int, str, int]]) -> tuple[int, int]:
        at = self.held(tests)
        return int(self.bad[at].sum()), int(self.good[at].sum())

    def up_to(self, at: np.ndarray, i: int, cuts: int) -> list[tuple[int, int]]:
        """Bad and good rows of the cells `at` up to each bin of feature i."""
        sums = [np.bincount(self.bins[at, i], x[at], cuts + 1).cumsum().astype(np.int64).tolist() for x in (self.bad, self.good)]
        return list(zip(*sums))

    def drop(self, tests: list[tuple[int, str, int]]) -> None:
        keep = ~self.held(tests)
        self.bins, self.bad, self.good = self.bins[keep], self.bad[keep], self.good[keep]


def cover(cells, cuts: list[int]) -> list[list[tuple[int, str, int]]]:
    """Sequential covering over counted cells (bins, grow fold, bad, good): tests are (feature, op, bin).

    A bin b of a feature lies above its thresholds 0 .. b - 1, so `bin <= b` is `value <= threshold b`.
    """
    grow = Counts([(c, p, n) for c, g, p, n in cells if g], len(cuts))
    prune = Counts([(c, p, n) for c, g, p, n in cells if not g], len(cuts))
    rules: list[list[tuple[int, str, int]]] = []
    while len(rules) < MOST_RULES:
        tests: list[tuple[int, str, int]] = []
        p, n = grow.count(tests)
        while n and p:
            best, gain, held = None, 1e-9, grow.held(tests)
            for i in range(len(cuts)):
                below = grow.up_to(held, i, cuts[i])
                for b in range(cuts[i]):
                    for op, q, m in (("<=", *below[b]), (">", p - below[b][0], n - below[b][1])):
                        if q and (g := q * (math.log2(q / (q + m)) - math.log2(p / (p + n)))) > gain:
                            best, gain = (i, op, b), g
            if best is None:
                break
            tests.append(best)
            p, n = grow.count(tests)
        if not tests:
            break
        worth = lambda t: (lambda p, n: (p - n) / (p + n) if p + n else -1)(*prune.count(t))
        while len(tests) > 1:
            shorter = max(([*tests[:k], *tests[k + 1 :]] for k in range(len(tests))), key=worth)
            if worth(shorter) < worth(tests):
                break
            tests = shorter
        p, n = prune.count(tests)
        q, m = grow.count(tests)
        if q + p < LEAST or q < PRECISION * (q + m) or p < PRECISION * (p + n):
            break
        rules.append(tests)
        grow.drop(tests)
        prune.drop(tests)
    return rules


def rule_column(rules: list[Rule], prefix: str = "") -> Column:
    """The number of the first rule that rejects, from 1; 0 if none does."""
    out, of = F.lit(0), ratios(prefix)
    for i in range(len(rules), 0, -1):
        out = F.when(rules[i - 1].column(of), i).otherwise(out)
    return out


def measure(rules: list[Rule], rows: DataFrame) -> DataFrame:
    """Per fold: labelled rows that pass the base, bad ones among them, rejected ones, and rejected bad ones."""
    hit = rule_column(rules) > 0
    return rows.where(~base_failed()).groupBy("fold").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), F.count_if(hit).alias("n_rejected"), F.count_if(hit & F.col("bad")).alias("n_rejected_bad"))


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """The statistics of labelled documents; a document with several labels is bad if one says so."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("label_id")).agg((F.min("quality") == 0).alias("bad"))
    return stats.join(marks, stats["doc_id"] == marks["label_id"]).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(3)))


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule.

    kept is false for base_failed, else false where a learned rule rejects (rule: its number, else 0). Null
    and empty texts have no words and fail the base. Labels may be missing or empty: then there are no
    rules. Rows come out as often as they come in; an empty table gives no rows; very long texts are read
    whole; other columns are not read, whatever their names.
    """
    stats, _ = materialise(statistics(docs.select("doc_id", F.col("text").cast("string").alias("text"))).drop("text"), "statistics")
    rules = learn(labelled(stats, labels.select("doc_id", "quality")))
    failed = base_failed()
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (rule_column(rules) == 0)).alias("kept"), rule_column(rules).alias("rule"),
    )
