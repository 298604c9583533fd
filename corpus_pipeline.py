"""Corpus pipeline: language ID, exact dedup, near-dedup, secret scan, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.llm import exact_dedup, langid, near_dedup, packing, secrets
from larder.llm.common import discard, materialise, sized
from larder.llm.queries import PACK_TOKENIZER, tokenizer_path

#: No SQL: tokenizers, centroids and signatures are outside it; tests hold the stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model knows; those it rejects (also null texts and texts without a letter) go."""
    return langid.keep_known(docs, langid.train(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id stays; repeated rows of it become one.

    Rows without a doc_id stay only if no row with one has their text, and then once. The rows that go are few beside all
    rows, so those are taken out by their doc_id and digest; no text of other rows is hashed for that.
    """
    decided = materialise(exact_dedup.exact_dedup(docs, keep="largest"), "exact-decisions")
    rows = decided.filter("group_size > 1").groupBy("doc_id", F.col("text_sha256").alias("digest")).agg(F.max("kept").alias("stays"), F.count("*").alias("copies"))
    rows = materialise(rows.filter("not stays or copies > 1"), "exact-copies")  # null ids are grouped, too
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)

    def only(kind: str, which: str) -> DataFrame:
        keys = sized(rows.filter(which).select("doc_id", "digest"))
        # Not an equality of keys, so that only texts of rows whose doc_id is found are hashed.
        return docs.join(keys, docs["doc_id"].eqNullSafe(keys["doc_id"]) & F.coalesce(digest == keys["digest"], F.lit(False)), kind)

    kept = only("left_anti", "true")
    if rows.filter("stays").isEmpty():
        return kept
    return kept.unionByName(only("left_semi", "stays").dropDuplicates(["doc_id", "text"]))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    dropped = near_dedup.near_dedup(docs, k=5, percent=80).filter("not kept").select("doc_id").distinct()
    return docs.join(sized(materialise(dropped, "near-dropped")), "doc_id", "left_anti").select(*docs.columns)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked."""
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path(PACK_TOKENIZER))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("minhash_near_dedup", near), ("secret_scan", mask), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again; a result goes once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
