"""Whitening of embeddings by the leading eigenvectors of their covariance, which is never formed.

A pass over the rows turns a block Q of directions into the block V Q (V the covariance): every task adds up
Xc' (Xc Q) of its centred rows, and Spark adds up the tasks' blocks. After each pass QR and Rayleigh-Ritz give the
best k vectors in the span of the blocks so far, and their residuals V q - e q tell whether they are eigenvectors.
Plain subspace iteration would keep the last block only; on embeddings whose eigenvalues lie close together it gains
a few hundredths a pass. So the residuals extend the span, up to KEEP blocks; then it restarts from its best vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.linear import eigenvectors

from .vectors import as_vectors, quantised, rows_of, summed_cells, usable

#: Directions of one pass beyond the k asked for, blocks of a span, passes before it is an error.
EXTRA, KEEP, PASSES = 8, 8, 400
#: A residual of at most TOLERANCE times the largest eigenvalue certifies a vector; a variance of at most FLAT times the trace is none.
TOLERANCE, FLAT = 1e-13, 1e-12


@dataclass(frozen=True)
class Centre:
    """Exact sums of the fit list: n vectors, per-dimension sums, and the trace of V times n^2."""

    n: int
    sums: tuple[int, ...]
    spread: int

    @property
    def base(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """sums - n * base, from 0 to n - 1."""
        return np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n


def _x(values: np.ndarray, scale: int, shift: int) -> np.ndarray:
    return quantised(values, scale) + shift


def centre(df: DataFrame, vector_col: str, scale: int, shift: int) -> Centre | None:
    """Sums of all usable vectors of the most frequent length (of equally frequent ones, the longest)."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, n = np.unique(usable(batch.column(0))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(n, pa.int64())], ["d", "n"])

    vectors = df.select(as_vectors(df, vector_col).alias("v"))
    top = vectors.mapInArrow(lengths, "d long, n long").where("d > 0").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not top:
        return None
    d, n = top[0]

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(2 * d, np.int64)
        for batch in batches:
            x = quantised(rows_of(batch.column(0), d)[1], scale)
            total += np.concatenate([x.sum(0), (x * x).sum(0)])
            if len(x) and total.max() > 1 << 62:
                raise ValueError("the squares of one task's vectors do not fit into a long")
        return total

    cells = summed_cells(vectors, sums, "long")
    plain = [cells.get(j, 0) for j in range(d)]
    # a shift moves the sums, not the spread
    return Centre(n, tuple(s + n * shift for s in plain), sum(n * cells.get(d + j, 0) - s * s for j, s in enumerate(plain)))


def covariance_times(df: DataFrame, vector_col: str, at: Centre, q: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """V Q in one pass over the rows."""
    d, b = q.shape

    def block(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((d, b))
        for batch in batches:
            xc = at.centred(_x(rows_of(batch.column(0), d)[1], scale, shift))
            total += xc.T @ (xc @ q)
        return total

    cells = summed_cells(df.select(as_vectors(df, vector_col).alias("v")), block, "double")
    return np.array([cells.get(i, 0.0) for i in range(d * b)]).reshape(d, b) / at.n


def whiten(df: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """vec_id, component, n, deviation (exact, a decimal), whitened, explained, identity_error; a row for each vector and component.

    Rows whose vector is null, empty or holds null or non-finite entries are left out, and so are rows whose
    vector has another length than the most frequent one. Repeated rows count and return each time; a null id stays null.
    Components without variance can't be whitened and give no rows: one vector, or only equal ones, give an
    empty table, as an empty table does. Equal eigenvalues give any orthonormal vectors of their space, the same
    for all rows. Entries of 2^17 or more in size are an error (see vectors).
    """
    spark, schema = df.sparkSession, "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    at = centre(df, vector_col, scale, shift)
    if at is None or at.spread == 0:
        return spark.createDataFrame([], schema)
    d, trace = len(at.sums), at.spread / at.n**2
    e, q, _ = eigenvectors(lambda block: covariance_times(df, vector_col, at, block, scale, shift), d, components, components + EXTRA, KEEP, PASSES, TOLERANCE)
    real = e > FLAT * trace
    e, q = e[real], q[:, real]
    own = q / np.sqrt(e)
    # the whitened rows' covariance, from one more pass over the rows
    error = float(np.abs(own.T @ covariance_times(df, vector_col, at, own, scale, shift) - np.eye(len(e))).max())
    base, rest = at.base, at.rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = rows_of(batch.column(1), d)
            x = _x(values, scale, shift)
            small = x - base
            y = at.centred(x) @ own
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(e), pa.int32()), pa.array(y.ravel(), pa.float64()))
            # sum (n*x - S)^2 = n^2 sum small^2 - 2 n sum small*rest + sum rest^2, with rest = h * 2^20 + l, so nothing leaves a long
            parts = [(small * small).sum(1), (small * (rest >> 20)).sum(1), (small * (rest & 0xFFFFF)).sum(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), lists, *[pa.array(p, pa.int64()) for p in parts]], ["id", "y", "s2", "sh", "sl"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), as_vectors(df, vector_col).alias("v")).mapInArrow(run, "id long, y array<double>, s2 long, sh long, sl long")
    number = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cross = wide("sh") * number(1 << 20) + wide("sl")
    deviation = (number(at.n**2) * wide("s2") - number(2 * at.n) * cross + number(sum(int(r) ** 2 for r in rest))).cast("decimal(38,0)")
    share = F.element_at(F.array(*[F.lit(float(x / trace)) for x in e]), F.col("pos") + 1)
    return rows.select("id", deviation.alias("deviation"), F.posexplode("y").alias("pos", "whitened")).select(
        F.col("id").alias("vec_id"), (F.col("pos") + 1).alias("component"), F.lit(at.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error")
    )


def whitened_rows(df: DataFrame, components: int = 8, **options) -> DataFrame:
    """whiten() with deviation as a long, null where it is too large for one."""
    return whiten(df, components, **options).withColumn("deviation", F.expr("try_cast(deviation AS long)"))
