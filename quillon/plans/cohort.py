"""Bindings of the driver's tables to the concepts that the operators work on.

dataset and sample are region and nation; a measured spot is a line item; a program is a supplier with its
parts; a lattice is made from part keys; gene-set terms are the words of part types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The tables of a folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def samples(self) -> DataFrame:
        """n_nationkey, dataset, sample."""
        return self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("dataset"), F.col("n_name").alias("sample"))

    def spots(self) -> DataFrame:
        """Line items with dataset and sample of their supplier; spot = order key * 10 + line number."""
        d = lambda c, name: F.col(c).cast("double").alias(name)
        rows = self.lineitem.join(self.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(self.samples(), F.col("s_nationkey") == F.col("n_nationkey"))
        return rows.select("dataset", "sample", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("spot"), "l_suppkey", "l_partkey", d("l_extendedprice", "price"), d("l_quantity", "quantity"), d("l_discount", "discount"), d("l_tax", "tax"), "l_returnflag", "l_linestatus")

    def lattice(self, width: int = 40) -> DataFrame:
        """Parts on a hexagonal lattice in four samples: node, row, col, value."""
        k = F.col("p_partkey")
        return self.part.select(
            (k % 4).cast("int").alias("sample"), k.cast("long").alias("node"),
            F.floor(F.floor(k / 4) / width).cast("long").alias("row"), F.col("p_retailprice").cast("double").alias("value"),
            (2 * (F.floor(k / 4) % width) + F.floor(F.floor(k / 4) / width) % 2).cast("long").alias("col"),
        )

    def programs(self, top: int = 30) -> DataFrame:
        """The parts with the largest revenue of each supplier: program, gene, loading, rank."""
        from quillon.operators.ranks import top_n

        rev = self.lineitem.groupBy(F.col("l_suppkey").alias("program"), F.col("l_partkey").alias("gene")).agg(F.round(F.sum(F.col("l_extendedprice").cast("double")), 2).alias("loading"))
        return top_n(rev, ["program"], [F.desc("loading"), F.col("gene")], top)

    def terms(self) -> DataFrame:
        """term, gene: the words of a part's type."""
        return self.part.select(F.explode(F.split("p_type", " ")).alias("term"), F.col("p_partkey").alias("gene")).distinct()


#: The same bindings in DuckDB, to be put before a query.
SAMPLES_SQL = "samples AS (SELECT n_nationkey, r_name AS dataset, n_name AS sample FROM nation JOIN region ON n_regionkey = r_regionkey)"
SPOTS_SQL = SAMPLES_SQL + """, spots AS (SELECT dataset, sample, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS spot, l_suppkey, l_partkey,
  CAST(l_extendedprice AS DOUBLE) AS price, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax, l_returnflag, l_linestatus
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN samples ON s_nationkey = n_nationkey)"""
LATTICE_SQL = """lattice AS (SELECT CAST(p_partkey % 4 AS INTEGER) AS sample, CAST(p_partkey AS BIGINT) AS node, CAST(p_partkey // 4 // 40 AS BIGINT) AS "row",
  CAST(2 * (p_partkey // 4 % 40) + p_partkey // 4 // 40 % 2 AS BIGINT) AS col, CAST(p_retailprice AS DOUBLE) AS value FROM part),
  edges AS (SELECT a.sample, a.node AS src, b.node AS dst FROM lattice a JOIN (VALUES (0, -2), (0, 2), (-1, -1), (-1, 1), (1, -1), (1, 1)) o(r, c) ON true
  JOIN lattice b ON a.sample = b.sample AND b."row" = a."row" + o.r AND b.col = a.col + o.c)"""
PROGRAMS_SQL = """programs AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY program ORDER BY loading DESC, gene) AS INTEGER) AS rank FROM
  (SELECT l_suppkey AS program, l_partkey AS gene, round(sum(CAST(l_extendedprice AS DOUBLE)), 2) AS loading FROM lineitem GROUP BY 1, 2)) WHERE rank <= 30)"""
TERMS_SQL = "terms AS (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS term, p_partkey AS gene FROM part)"
