"""Centroid clustering of quantised vectors, once for each different vector.

Equal vectors are grouped with their multiplicity before anything else. Lloyd's rounds then run over the different
vectors alone: a task sends one weighted sum for each centroid and component, as exact integers. The last assignment
is joined back to the rows: vectors that many rows share (at most SHARED of them can have over 1/SHARED of all rows)
are broadcast, the others meet their rows in an exchange, where no vector has more than that share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialise
from .vectors import as_vectors, quantised, rows_of, summed_cells

#: A vector that holds over 1/SHARED of the rows is joined by broadcast; there are fewer than SHARED of these.
SHARED = 500


def quantised_rows(df: DataFrame, id_col: str, vector_col: str, dimension: int, scale: int = 1024) -> DataFrame:
    """id and q, the vector as integers floor(scale * x), for vectors of this dimension without null or non-finite entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = rows_of(batch.column(1), dimension)
            q = quantised(x, scale)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * dimension, pa.int32()), pa.array(q.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), lists], ["id", "q"])

    return df.select(F.col(id_col).cast("long").alias("id"), as_vectors(df, vector_col).alias("v")).mapInArrow(run, "id long, q array<long>")


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k smallest sha256("seed:id"), in that order; equal ids by their vectors. A null id is never chosen."""
    chosen = rows.where("id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), "q").select("q").limit(k).collect()
    return np.array([r.q for r in chosen], np.int64)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance), exactly; ties go to the smaller number.

    Entries are under 2^27 in size and differences under 2^28, so 64 squares stay within a long; more components
    are refused if they could overflow.
    """
    if q.shape[1] * (int(np.abs(q).max(initial=0)) + int(np.abs(centroids).max(initial=0))) ** 2 >= 1 << 63:
        raise ValueError("squared distances of these vectors do not fit into a long")
    d = (q * q).sum(1)[:, None] - 2 * (q @ centroids.T) + (centroids * centroids).sum(1)[None, :]
    at = d.argmin(1)
    return at, d[np.arange(len(q)), at]


def _q_of(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension)


def update(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the exact floor of the weighted mean; one without vectors stays."""
    k, d = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((k, d + 1), np.int64)
        for batch in batches:
            q, w = _q_of(batch.column(0), d), batch.column(1).to_numpy(zero_copy_only=False)
            if len(q) and int(np.abs(q).max()) * int(w.sum()) >= 1 << 62:
                raise ValueError("weighted sums of these vectors do not fit into a long")
            at, _ = nearest(q, centroids)
            np.add.at(total, at, np.concatenate([q * w[:, None], w[:, None]], axis=1))
        return total

    cells = summed_cells(distinct.select("q", "w"), sums, "long")
    count = [cells.get(c * (d + 1) + d, 0) for c in range(k)]
    return np.array([[cells.get(c * (d + 1) + j, 0) // count[c] for j in range(d)] if count[c] else centroids[c] for c in range(k)], np.int64)


def assign(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """q, w, cluster and distance of every different vector."""
    d = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, far = nearest(_q_of(batch.column(0), d), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int32()), pa.array(far, pa.int64())], ["q", "w", "cluster", "distance"])

    return distinct.select("q", "w").mapInArrow(run, "q array<long>, w long, cluster int, distance long")


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = 64, scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """(rows with cluster, distance, the cluster's and the whole inertia; the final centroids).

    Rows whose vector is null, has another dimension or holds null or non-finite entries are left out. A repeated row
    gives a row each time; a row without id is clustered but starts no centroid. With fewer than k vectors there are
    fewer centroids; an empty table gives an empty one. Entries of 2^17 or more in size are an error (see vectors).
    Rounds end early only where no centroid moves any more. Inertia is summed exactly; one beyond a long is null.
    """
    rows = quantised_rows(df, id_col, vector_col, dimension, scale)
    spark, schema = df.sparkSession, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long"
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        # ids may all be null: then nothing can start a centroid
        return spark.createDataFrame([], schema), np.zeros((0, dimension), np.int64)
    distinct, path = materialise(rows.groupBy("q").agg(F.count(F.lit(1)).alias("w")), "distinct")
    for _ in range(rounds):
        moved = update(distinct, centroids)
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    assigned, assigned_path = materialise(assign(distinct, centroids), "assigned")
    drop_path(spark, path)
    exact = F.sum(F.col("distance").cast("decimal(38,0)") * F.col("w").cast("decimal(20,0)"))
    per = {r.cluster: (int(r.s), r.n) for r in assigned.groupBy("cluster").agg(exact.alias("s"), F.sum("w").alias("n")).collect()}
    total, n = sum(s for s, _ in per.values()), sum(m for _, m in per.values())
    fits = lambda s: s if s < 1 << 63 else None
    inertia = spark.createDataFrame([(c, fits(s), fits(total)) for c, (s, _) in per.items()], "cluster int, cluster_inertia long, inertia long")
    found = assigned.where(F.col("w") * SHARED <= n), assigned.where(F.col("w") * SHARED > n)
    hot = F.broadcast(found[1].select("q", F.struct("cluster", "distance").alias("hot")))
    met = rows.join(hot, "q", "left")
    cold = met.where("hot is null").select("id", "q").join(found[0], "q").select("id", "cluster", "distance")
    out = met.where("hot is not null").select("id", "hot.*").unionByName(cold)
    return out.join(F.broadcast(inertia), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia"), centroids


def clustered(df: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, **options) -> DataFrame:
    """cluster() with the digest of each row's final centroid: sha256 of its components, in decimals joined by commas."""
    rows, centroids = cluster(df, k, rounds, seed, **options)
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    named = df.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select(*rows.columns, "centroid_sha256")


def clustered_sql(k: int = 8, rounds: int = 10, seed: int = 3, dimension: int = 64, scale: int = 1024) -> str:
    """The same rows in DuckDB's SQL, over all rows: no grouping of equal vectors, one block of CTEs a round."""
    ctes = [
        f"q AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings"
        f" WHERE embedding IS NOT NULL AND len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dimension})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, q) - 1 AS INTEGER) AS c, q FROM (SELECT sha256('{seed}:' || vec_id) AS h, q FROM q WHERE vec_id IS NOT NULL ORDER BY h, q LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        ctes.append(
            f"a{i} AS MATERIALIZED (SELECT r, vec_id, q, d.d AS distance, d.c AS cluster FROM (SELECT r, vec_id, q.q, min({{'d': CAST(list_sum(list_transform(list_zip(q.q, c{i}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'c': c}}) AS d FROM q CROSS JOIN c{i} GROUP BY 1, 2, 3))"
        )
        if i < rounds:
            ctes.append(f"s{i} AS MATERIALIZED (SELECT cluster, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM a{i}) GROUP BY 1, 2)")
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m, q) AS q FROM c{i} LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS m FROM s{i} GROUP BY 1) ON c = cluster)")
    return (
        f"WITH {', '.join(ctes)} SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,"
        f" sha256(list_aggregate(list_transform(c{rounds}.q, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c = cluster"
    )
