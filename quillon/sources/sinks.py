"""Sinks and audits of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, kind: str = "parquet", if_missing: bool = False) -> str:
    """Writes parquet, csv (with header) or json; if_missing leaves what is already there."""
    writer = df.write.mode("ignore" if if_missing else "overwrite")
    if kind == "csv":
        writer = writer.option("header", True)
    writer.format(kind).save(path)
    return path


def content_audit(df: DataFrame) -> DataFrame:
    """rows and sha256: a hash of the rows' hashes that doesn't depend on their order.

    Row hashes are added up in 4 pieces of 32 bits, so repeated rows count and nothing is gathered.
    """
    text = F.concat_ws("", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in sorted(df.columns)])
    h = F.sha2(text, 256)
    piece = lambda i: F.sum(F.conv(F.substr(h, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long"))
    g = df.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(piece(i), F.lit(0)).alias(f"_{i}") for i in range(4)])
    return g.select("rows", F.sha2(F.concat_ws("|", "rows", *[f"_{i}" for i in range(4)]), 256).alias("sha256"))


def file_audit(spark, path: str) -> DataFrame:
    """file, bytes, lines and sha256 of every file below a path, lines without the header; a task holds one file's bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    text = F.decode("content", "UTF-8")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.greatest(lines - 1, F.lit(0)).cast("long").alias("lines"), F.sha2("content", 256).alias("sha256"))
