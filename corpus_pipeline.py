"""The corpus pipeline: quality rules, language ID, near duplicates, secret scans, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. Every stage but the last returns the columns of documents, whatever other columns there are
and whatever they are called: names of the stages' own never clash with them. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import langid, minhash, packing, quality, queries, secret_scan
from quillon.llm.common import columns_of, fresh_path, fresh_prefix, materialise, split_by_bitmap, table

#: A prediction with less agreement than this is no language: random letters and languages without a profile lie
#: below 0.25, clean prose of the learned languages above 0.3.
LEAST_SCORE = 0.28


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or a rule learned from the labels.

    A null or empty text has no words and goes; repeated rows are judged each for itself, so all stay or go.
    Without labels of both classes only the base rules count.
    """
    own = fresh_prefix(docs, "_quality_")
    marked, _ = materialise(quality.statistics(docs, prefix=own), "statistics")
    names = [c for c in marked.columns if c.startswith(own)]
    stats = marked.select("doc_id", *[F.col(c).alias(c.removeprefix(own)) for c in names])
    rules = quality.learn(quality.labelled(stats, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return marked.where(~quality.base_failed(own) & (quality.rule_column(rules, own) == 0)).drop(*names)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no learned language is found.

    A null text and one without letters have none; repeated rows stay or go together; a table without any
    language teaches none, so nothing stays.
    """
    text, own = F.col("text").cast("string"), fresh_prefix(docs, "_language")
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), text.alias("text")))
    marked = docs.withColumn(own, langid.predict(text, model))
    return marked.where((F.col(f"{own}.lang_pred") != langid.UNKNOWN) & (F.col(f"{own}.score") >= LEAST_SCORE)).drop(own)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8).

    A group's document is the one of the smallest doc_id (of a repeated id: of the smallest text hash, once).
    Documents without words are in no group and all stay. A null doc_id counts as larger than any other.
    """
    own = fresh_prefix(docs, "_near_")
    text, doc_id, key = F.col("text").cast("string"), F.col("doc_id").cast("long"), [own + x for x in ("none", "id", "mark")]
    named = lambda df, mark: df.withColumns(dict(zip(key, (doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), mark))))
    found = named(minhash.near_duplicates(docs, with_class=True).where("root is not null"), F.col("mark"))
    found, _ = materialise(found.groupBy(*key, "root").agg(F.max("kept").alias("kept"), F.count("*").alias("times")), "decisions")
    first = found.where("kept").groupBy("root").agg(F.min(F.struct(*key)).alias("key")).select("key.*")
    # only texts that may have to go, and repeated rows, are dealt out to meet the decisions
    open_keys = found.join(first.withColumn("stays", F.lit(True)), key, "left").where("stays is null or times > 1").select(*key)
    has_words = F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    may_go, stay = split_by_bitmap(named(docs.where(has_words), F.xxhash64(text)), F.xxhash64(*key), open_keys)
    chosen = may_go.dropDuplicates(key).join(first, key)
    return stay.select(*columns_of(docs)).unionByName(chosen.select(*columns_of(docs))).unionByName(docs.where(~has_words))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows. Every row stays; a null text stays null."""
    clean = docs.withColumn("text", secret_scan.redact_column(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; one row per piece (see packing.pack for nulls, repeats and long texts)."""
    return packing.pack(docs, queries._spec())


STAGES = [("quality rules", keep_quality), ("language id", keep_language), ("near duplicates", keep_one_of_each), ("secret scans", redact_secrets), ("packing", pack)]
#: Learned rules, profiles and packing are not SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = fresh_path(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
