"""Readers. Paths may hold globs; what is read stays a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.scalars import finite

#: The columns of a positions file, in their order.
POSITIONS = "barcode string, in_tissue int, array_row int, array_col int, pxl_row double, pxl_col double"


def delimited(spark: SparkSession, path: str, schema: str | None = None, sep: str | None = None) -> DataFrame:
    """CSV or TSV with a header, gzipped or not; NaN and infinities of double columns become NULL.

    Without a schema all columns are text: nothing is read twice to guess types. sep follows the file's name.
    """
    sep = sep or ("\t" if path.removesuffix(".gz").endswith((".tsv", ".txt")) else ",")
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(*[finite(f"`{c}`").alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def positions(spark: SparkSession, path: str) -> DataFrame:
    """A positions file with or without a header: a first row whose flag isn't a number is the header."""
    text = ", ".join(f"{c.split()[0]} string" for c in POSITIONS.split(", "))
    rows = spark.read.schema(text).csv(path)
    typed = rows.select(*[F.col(n).try_cast(t).alias(n) for n, t in (c.split() for c in POSITIONS.split(", "))])
    return typed.where("in_tissue is not null")


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(row, column, value) triples of a coordinate file; comments and the size line are left out.

    The size line is the one that follows no other number line: its file's first. Triples keep their 1-based places.
    """
    lines = spark.read.text(path).where("not startswith(value, '%') and trim(value) <> ''")
    parts = F.split(F.trim("value"), r"\s+")
    at = lines.select(F.monotonically_increasing_id().alias("_i"), F.input_file_name().alias("_f"), parts.alias("p"))
    first = at.groupBy("_f").agg(F.min("_i").alias("_first"))
    body = at.join(first, "_f").where("_i > _first")
    return body.select(F.get("p", F.lit(0)).try_cast("long").alias("row"), F.get("p", F.lit(1)).try_cast("long").alias("column"), F.coalesce(F.get("p", F.lit(2)).try_cast("double"), F.lit(1.0)).alias("value"))


def named_matrix(triples: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(barcode, gene, count): triples with their names; rows and columns are (place, name)."""
    g = rows.select(F.col("place").alias("row"), F.col("name").alias("gene"))
    b = columns.select(F.col("place").alias("column"), F.col("name").alias("barcode"))
    return triples.join(g, "row").join(b, "column").select("barcode", "gene", F.col("value").alias("count"))


def in_tissue(counts: DataFrame, spots: DataFrame) -> DataFrame:
    """Counts of barcodes that have a position inside the tissue, with it."""
    return counts.join(spots.where("in_tissue = 1"), "barcode")


def json_maps(spark: SparkSession, path: str, key: str = "gene", value: str = "weight") -> DataFrame:
    """(name, key, value) of files with one JSON object each: {key: number}; the name is the file's."""
    docs = spark.read.option("wholetext", True).text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("name"), F.from_json("value", "map<string,double>").alias("m"))
    return docs.select("name", F.explode("m").alias(key, value)).withColumn(value, finite(value))


def json_sets(spark: SparkSession, path: str) -> DataFrame:
    """(term, gene) of JSON files: {term: [genes]}."""
    docs = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return docs.select(F.explode("m").alias("term", "_g")).select("term", F.explode("_g").alias("gene")).distinct()


def gmt(spark: SparkSession, path: str) -> DataFrame:
    """(library, term, gene) of GMT files: term, description, genes; repeated and blank genes once or not at all.

    A line is split once, before its genes become rows: what stands beside an explode is evaluated anew for every row.
    """
    parts = F.split("value", "\t")
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("library"), F.substring_index("value", "\t", 1).alias("term"), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))).alias("_genes"))
    rows = lines.select("library", "term", F.explode("_genes").alias("gene"))
    return rows.withColumn("gene", F.trim("gene")).where("gene <> '' and term <> ''").distinct()


def discovered(spark: SparkSession, pattern: str, schema: str, parts: Sequence[str]) -> DataFrame:
    """All files of a directory pattern with path components as columns.

    parts names the components from the right, the file's own name last: ("dataset", "sample", "file").
    """
    df = spark.read.schema(schema).option("header", True).csv(pattern)
    path = F.split(F.regexp_replace(F.input_file_name(), r"^[a-z0-9+]+:/*", "/"), "/")
    named = [F.regexp_replace(F.element_at(path, i - len(parts)), r"\.(csv|tsv)(\.gz)?$", "").alias(n) for i, n in enumerate(parts)]
    return df.select(*named, *df.columns)


def semi_scan(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of a large scan whose keys a smaller table holds; the scan stays split, whichever join Spark picks."""
    return rows.join(keys.select(*on).distinct(), list(on), "left_semi")


def union_of(parts: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """Tables under one another by column name, with where each row is from; missing columns are NULL."""
    out = None
    for name, df in parts.items():
        one = df.withColumn(source, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
