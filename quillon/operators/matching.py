"""One-to-one assignment on one covariate, cut into pieces that can be solved apart."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import finite

from .ranks import Ranges, discard, over, settled, with_groups

#: Pieces that one call of the solver gets together.
PACK = 1000


def pieces(df: DataFrame, by: Sequence[str], few: str, order: Sequence[str]) -> DataFrame:
    """df with `piece`: some optimal assignment crosses no border between pieces; rows that no assignment needs are left out.

    few marks the side that is used up. With a row of it as +1 and any other as -1, let P be the running sum.
    Where P is the least so far, rows before the border can all be served there; where P is the greatest from here
    on, so can those behind it. A pair across such a border can be exchanged for pairs that stay on their sides at no
    cost. Rows are dealt by ranges, and each range passes on its sum and its extremes, so no task holds a group.
    """
    r = Ranges(df.withColumn("_v", F.when(F.col(few), 1).otherwise(-1).cast("long")), by, order)
    w = r.within()
    # _i tells equal rows apart; what comes later is seen from the end, for a frame that reaches to the end is read anew for every row
    rows = r.rows.withColumns({"_p": F.coalesce(F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_i": F.row_number().over(w)})
    w, back = over(r.part, "_i"), over(r.part, F.desc("_i"))
    sums = r.totals(rows, F.sum("_v").alias("_s"), F.min("_p").alias("_lo"), F.max("_p").alias("_hi"))
    sums = sums.withColumn("_start", F.coalesce(F.sum("_s").over(r.before()), F.lit(0)))
    least, most = F.min(F.col("_start") + F.col("_lo")).over(r.before()), F.max(F.col("_start") + F.greatest("_hi", "_s")).over(r.after())
    sums = sums.select(*r.part, "_start", least.alias("_least"), F.greatest(F.col("_start") + F.col("_s"), most).alias("_most"))
    rows = r.join(rows, sums)
    p, start = F.col("_start") + F.col("_p"), F.col("_start")
    so_far = F.least("_least", start + F.min("_p").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    later = F.greatest("_most", start + F.max("_p").over(back.rowsBetween(Window.unboundedPreceding, -1)))
    begins = (p == so_far) & (p >= later)
    # a row of the larger side with a border on either side of it serves nobody
    rows = settled(rows.select(*df.columns, *r.part, "_i", begins.cast("long").alias("_b"), (begins & ~F.col(few) & (later == p - 1)).alias("_idle")))
    # a border counts for its range first, as the running sum did
    counts = r.totals(rows, F.sum("_b").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(r.before()), F.lit(0))).drop("_n")
    numbered = r.join(rows, counts).withColumn("piece", F.col("_before") + F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    discard(r.rows)
    return numbered.where("not _idle").select(*df.columns, "piece")


class _Slopes:
    """Half of a convex piecewise linear function: (place, change of slope), the place nearest to the minimum on top."""

    def __init__(self, sign: int):
        self.sign, self.shift, self.heap = sign, 0, [(0, np.inf)]

    def top(self) -> int:
        return self.sign * self.heap[0][0] + self.shift

    def push(self, place: int, weight: float) -> None:
        heapq.heappush(self.heap, (self.sign * (place - self.shift), weight))

    def take(self, weight: float) -> list[tuple[int, float]]:
        """Off the top: slope changes of this weight in all."""
        out = []
        while weight > 0:
            key, have = self.heap[0]
            out.append((self.sign * key + self.shift, min(have, weight)))
            if have > weight:
                heapq.heapreplace(self.heap, (key, have - weight))
            else:
                heapq.heappop(self.heap)
            weight -= out[-1][1]
        return out


def used(x: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which rows of the larger side an assignment of least total |difference| uses; x ascends.

    The cost is the flow over each gap times the gap. The least cost so far is convex in the flow: a row of the
    smaller side moves it by one, one of the larger side may take one off, a gap adds |flow| times its
    length. Two heaps of slope changes carry it, so n rows take n log n steps; going back, the flow falls
    wherever it is left of the minimum. Equal costs leave a row unused.
    """
    left, right = _Slopes(-1), _Slopes(1)
    minimum = np.zeros(len(x), np.int64)
    for i in range(len(x)):
        gap = float(x[i] - x[i - 1]) if i else 0.0
        if gap > 0:
            for one, other in ((left, right), (right, left)):
                one.push(0, gap)
                for place, weight in one.take(gap):
                    other.push(place, weight)
        if few[i]:
            left.shift += 1
            right.shift += 1
        else:
            minimum[i] = left.top()
            left.shift -= 1
    out, flow = np.zeros(len(x), bool), 0
    for i in range(len(x) - 1, -1, -1):
        if few[i]:
            flow -= 1
        elif flow < minimum[i]:
            out[i] = True
            flow += 1
    return out


def optimal_pairs(df: DataFrame, by: Sequence[str], is_case: str, key: str, x: str) -> DataFrame:
    """A one-to-one assignment of cases to controls of the least total |difference of x| in each group, the smaller side used up.

    Rows with a null flag, a null key or a null, NaN or infinite x are on neither side; a group with a null key is
    a group; one that lacks a side gives no pairs. Among assignments of equal total any one is given. Groups are cut
    into pieces (see pieces); a piece's rows are solved in n log n steps.
    """
    rows = df.select(*[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)], F.col(is_case).cast("boolean").alias("_case"), F.col(key).alias("_key"), finite(x).alias("_x")).where("_case is not null and _key is not null and _x is not null")
    own = [f"_by_{i}" for i in range(len(by))]
    sides = rows.groupBy(*own).agg(F.count_if("_case").alias("_n1"), F.count_if(~F.col("_case")).alias("_n2"))
    rows = with_groups(rows, sides, own).where("_n1 > 0 and _n2 > 0").withColumn("_few", F.when(F.col("_n1") <= F.col("_n2"), F.col("_case")).otherwise(~F.col("_case"))).drop("_n1", "_n2")
    cut = pieces(rows, own, "_few", ["_x", "_key", "_case"])

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, piece in pdf.sort_values(["piece", "_x", "_key"], kind="stable").groupby("piece", sort=False):
            few = piece["_few"].to_numpy(bool)
            a, b = piece[few], piece[used(piece["_x"].to_numpy(), few)]
            case, control = (a, b) if len(a) and a["_case"].iloc[0] else (b, a)
            parts.append(pd.DataFrame({"case": case["_key"].to_numpy(), "control": control["_key"].to_numpy(), "x_case": case["_x"].to_numpy(), "x_control": control["_x"].to_numpy()}))
        out = pd.concat(parts)
        for i, c in reversed(list(enumerate(by))):
            out.insert(0, c, [pdf[f"_by_{i}"].iloc[0]] * len(out))
        return out

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[n]}" for c, n in zip(by, own, strict=True)], f"case {kinds['_key']}, control {kinds['_key']}, x_case double, x_control double"])
    return cut.withColumn("_pack", F.floor(F.col("piece") / PACK)).groupBy(*own, "_pack").applyInPandas(assign, schema)
