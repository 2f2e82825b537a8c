"""Queries of readers and sinks: a table goes out in a format and comes back through its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.ranks import settled
from quillon.sources import readers, sinks

from .cohort import Tables
from .registry import query, rounded


def _folder(t: Tables, name: str) -> str:
    """A fresh place below the checkpoint folder, which driver and executors share."""
    import uuid

    sc = t.spark.sparkContext
    if not sc.getCheckpointDir():
        settled(t.spark.range(1))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_mktsegment, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM customer")
def csv_round_trip(t: Tables) -> DataFrame:
    """CSV sink (gzipped) and reader with a schema."""
    path = _folder(t, "csv")
    x = t.customer.select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("double"))
    x.write.option("header", True).option("compression", "gzip").csv(path)
    return readers.delimited(t.spark, path, "c_custkey long, c_mktsegment string, c_acctbal double")


@query("SELECT 'terms' AS library, p_type AS term, CAST(p_partkey AS VARCHAR) AS gene FROM part")
def gmt_round_trip(t: Tables) -> DataFrame:
    """Gene sets written as GMT lines and read back."""
    path = _folder(t, "gmt")
    sets = t.part.groupBy("p_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: x.cast("string")), "\t").alias("g"))
    sets.select(F.concat_ws("\t", "p_type", F.lit("-"), "g", F.lit(" ")).alias("value")).write.text(path)
    return readers.gmt(t.spark, path).withColumn("library", F.lit("terms"))


@query("SELECT l_suppkey AS barcode, CAST(l_partkey % 50 AS VARCHAR) AS gene, CAST(sum(l_quantity) AS DOUBLE) AS count FROM lineitem WHERE l_suppkey % 3 = 1 GROUP BY 1, 2")
def matrix_round_trip(t: Tables) -> DataFrame:
    """A coordinate matrix with names and positions, a file for each thousand spots: read, named, cut to spots inside the tissue."""
    path = _folder(t, "mtx")
    m = t.lineitem.where("l_suppkey is not null").groupBy(F.col("l_suppkey").alias("c"), (F.col("l_partkey") % 50 + 1).alias("r")).agg(F.sum("l_quantity").cast("double").alias("v"))
    body = m.select(F.concat_ws(" ", "r", "c", "v").alias("value"), F.lit(2).alias("o"), F.floor(F.col("c") / 1000).alias("part"))
    head = t.spark.createDataFrame([("%%MatrixMarket matrix coordinate real general", 0), ("50 1000 0", 1)], "value string, o int")
    blocks = t.supplier.select(F.floor(F.col("s_suppkey") / 1000).alias("part")).union(t.lineitem.select(F.floor(F.col("l_suppkey") / 1000).alias("part"))).where("part is not null").distinct()
    # all rows of a block are in one task, so each file begins with its own heading
    lines = head.crossJoin(blocks).unionByName(body)
    lines.repartition("part").sortWithinPartitions("part", "o").select("value", "part").write.partitionBy("part").text(path)
    genes = t.spark.range(1, 51).select(F.col("id").alias("place"), (F.col("id") - 1).cast("string").alias("name"))
    spots = t.supplier.select(F.col("s_suppkey").alias("place"), F.col("s_suppkey").cast("string").alias("name"))
    flags = _folder(t, "positions")
    t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 1, 1).otherwise(0), F.lit(0), F.lit(0), F.lit(1.5), F.lit(2.5)).toDF("barcode", "in_tissue", "a", "b", "x", "y").write.option("header", True).csv(flags)
    counts = readers.named_matrix(readers.matrix_market(t.spark, path), genes, spots)
    return readers.in_tissue(counts, readers.positions(t.spark, flags)).select(F.col("barcode").cast("long").alias("barcode"), "gene", "count")


@query("SELECT n_name AS sample, r_name AS dataset, s_suppkey, round(CAST(s_acctbal AS DOUBLE), 2) AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def discovered_files(t: Tables) -> DataFrame:
    """A directory of dataset/sample files, found by its pattern, path parts as columns."""
    path = _folder(t, "tree")
    s = t.supplier.join(t.samples(), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("s_acctbal").cast("double").alias("x"), F.col("dataset").alias("d"), F.col("sample").alias("s"))
    s.write.partitionBy("d", "s").option("header", True).csv(path)
    x = readers.discovered(t.spark, f"{path}/*/*/*.csv", "s_suppkey long, x double", ("dataset", "sample", "file"))
    plain = lambda c: F.url_decode(F.regexp_replace(c, "^[ds]=", ""))
    return rounded(x.select(plain("sample").alias("sample"), plain("dataset").alias("dataset"), "s_suppkey", "x"), 2)


@query("SELECT 'customer' AS source, c_custkey AS id, c_mktsegment AS segment, NULL::VARCHAR AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, NULL, s_name FROM supplier")
def union_with_source(t: Tables) -> DataFrame:
    """Tables with different columns under one another, with provenance."""
    return readers.union_of({"customer": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), "supplier": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))}).select("source", "id", "segment", "name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_scanned_orders(t: Tables) -> DataFrame:
    keys = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return readers.semi_scan(t.orders.select("o_orderkey", "o_custkey"), keys, ["o_custkey"])


@query("SELECT 'w' AS name, p_type || '-' || p_partkey AS gene, round(CAST(p_retailprice AS DOUBLE), 2) AS weight FROM part")
def json_weights(t: Tables) -> DataFrame:
    """A JSON object of weights, read as rows."""
    path = _folder(t, "json")
    m = t.part.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("-", "p_type", "p_partkey"), F.col("p_retailprice").cast("double"))))).alias("value"))
    m.coalesce(1).write.text(path)
    return rounded(readers.json_maps(t.spark, path).withColumn("name", F.lit("w")), 2)


@query("SELECT CAST(count(*) AS BIGINT) AS rows, true AS same, true AS kept FROM nation")
def sink_audit(t: Tables) -> DataFrame:
    """Row count and order-free hash of what was written; a second write-if-missing changes nothing."""
    path = _folder(t, "audit")
    sinks.write_table(t.nation, path, if_missing=True)
    sinks.write_table(t.nation.limit(0), path, if_missing=True)
    back = sinks.content_audit(t.spark.read.parquet(path)).select("rows", F.col("sha256").alias("b"))
    own = sinks.content_audit(t.nation.repartition(3)).select(F.col("rows").alias("n"), F.col("sha256").alias("a"))
    return back.crossJoin(own).select("rows", (F.col("a") == F.col("b")).alias("same"), (F.col("rows") == F.col("n")).alias("kept"))
