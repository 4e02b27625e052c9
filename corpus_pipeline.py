"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return docs' columns, whatever their names.
Null and empty texts count as empty; empty tables give empty results; decisions are by row, so that ids may repeat or be null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftline.llm import bpe, exact_dedup, mixing, quality, simhash
from graftline.staging import stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier selects."""
    return quality.select_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _rows(docs: DataFrame) -> DataFrame:
    """row (all columns of docs, whatever their names), doc_id, text, id (doc_id as a number) and hash of the whole row; nulls count in it by their place."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.struct(*columns).alias("row"), "doc_id", "text", F.col("doc_id").cast("long").alias("id"), F.xxhash64(*columns, *[c.isNull() for c in columns]).alias("hash"))


def _one_of_each(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of each group of candidates(group, id, hash): that with the smallest id and hash, and one of its repetitions."""
    counts = candidates.groupBy("group", "id", "hash").agg(F.count("*").alias("n"))
    chosen = stage(counts.groupBy("group").agg(F.min(F.struct("id", "hash", "n")).alias("b")).select("b.*"), "chosen")

    def met(of: DataFrame) -> DataFrame:
        of = of.select(F.col("id").alias("kept_id"), F.col("hash").alias("kept_hash"))
        return rows.join(of, (F.col("hash") == F.col("kept_hash")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").select("row")

    once, repeated = met(chosen.filter("n = 1")), chosen.filter("n > 1")
    return (once if repeated.isEmpty() else once.unionByName(met(repeated).distinct())).select("row.*")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the largest doc_id; of rows with that id the one with the smallest hash, repeated rows once, null ids last."""
    rows = _rows(docs)
    kept = exact_dedup.dedup_corpus(docs).filter("kept").select(F.col("text_sha256").alias("group"), F.col("doc_id").alias("kept"))
    mine = rows.select(F.lower(F.hex(exact_dedup.text_digest("text"))).alias("group"), "id", "hash")
    return _one_of_each(rows, mine.join(kept, (mine["group"] == kept["group"]) & F.col("id").eqNullSafe(F.col("kept")), "left_semi"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component, one row with the smallest doc_id; of rows with that id the one with the smallest hash, repeated rows once, null ids last."""
    rows = _rows(docs)
    found = simhash.components(rows, carry=["hash"]).filter("doc_id <=> component_id")
    return _one_of_each(rows, found.select(F.col("root").alias("group"), F.col("doc_id").alias("id"), "hash"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture has them; rows without words have no place in it."""
    return mixing.realise(docs).select([F.col(f"`{c}`") for c in docs.columns])


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    return bpe.encode(docs, digests=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: Hashed models, SimHash and BPE are not for SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
