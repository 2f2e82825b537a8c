"""What the corpus operators share: reading tables, the shared folder, batches and materialised tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: with texts of 100 kB a batch stays near 50 MB.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local session gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, path.removeprefix("file://"), True)
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quillon/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes a table into the shared folder and reads it again: lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a superseded intermediate table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh_prefix(df: DataFrame, prefix: str) -> str:
    """The prefix with as many underscores before it as no column of df starts with (names ignore case)."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(prefix.lower()) for c in taken):
        prefix = "_" + prefix
    return prefix


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: Bits of a bitmap: 2**18 words of 64 bits, so what is broadcast is at most 4 MB of longs whatever the input.
BITMAP_BITS = 1 << 24


def split_by_bitmap(df: DataFrame, key: Column, some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among some's, rows whose key surely is not), without a shuffle of df.

    key is a long expression that both tables can compute. The bitmap lets a row through by chance if its bit is
    set by another key, so an exact join has to follow; it never holds a row back. With far more keys than bits
    every row comes out on the first side, as if there were no bitmap.
    """
    at = F.pmod(key, F.lit(BITMAP_BITS).cast("long"))
    bit = lambda x: (x.bitwiseAND(F.lit(63))).cast("int")
    own = fresh_prefix(df, "_bitmap_")
    words = some.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias(f"{own}word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("at")))).alias(f"{own}set"))
    placed = df.withColumn(f"{own}at", at).join(F.broadcast(words), F.shiftright(f"{own}at", 6) == F.col(f"{own}word"), "left")
    is_set = F.coalesce(F.call_function("shiftright", f"{own}set", bit(F.col(f"{own}at"))).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))
    return placed.where(is_set).select(*columns_of(df)), placed.where(~is_set).select(*columns_of(df))


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return run


_IN_USE: dict[str, Callable[[], object]] = {}


def use_caches(owner: str, forget: Callable[[], object]) -> None:
    """Says that this worker now works for owner; what it still holds for another operator is forgotten.

    Spark hands a Python worker from one stage to the next: without this a chain of operators holds the
    caches of all of them at once.
    """
    for other in [x for x in _IN_USE if x != owner]:
        _IN_USE.pop(other)()
    _IN_USE[owner] = forget


def ascii_lower(text: str) -> str:
    """A-Z in lower case and nothing else, so positions stay."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, whatever else the table has."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
