"""The corpus pipeline: five stages over ``documents``, each written and reread.

All stages work on whole texts of any length; an empty table stays empty, and columns
beside ``doc_id``, ``text`` and ``n_chars`` are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsela.llm.common import bound_batches, shared_path
from sparsela.llm.exact_dedup import deduplicated
from sparsela.llm.minhash import near_duplicates
from sparsela.llm.packing import best_fit_pack
from sparsela.llm.pii import redact
from sparsela.llm.quality import corpus_bands, good_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the compression bands are those of the
    documents labelled good. Null and empty texts have too few words and go. Rows are
    judged one by one: repeats share their fate, a null id is no reason to go."""
    return good_documents(docs, bands=corpus_bands(spark, docs, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null counts as empty) the row with the smallest id stays, of rows
    that repeat id and text one. A null id stays where its text has no other id."""
    return deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, similarity 0.8) the smallest id
    stays, with all rows of that id. Texts without words are near to nothing and stay, and
    so do documents with a null id."""
    kept = near_duplicates(docs).filter("kept and doc_id is not null").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    rows = named.filter("_id is not null").join(kept, F.col("_id") == F.col("_kept"), "left_semi")
    return rows.unionByName(named.filter("_id is null")).select("_row.*")


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; every row stays. Null and empty
    texts stay as they are, and so does n_chars where nothing was replaced."""
    return redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids, placed in sequences of 2048 tokens. A null or
    empty text is one piece of one id; repeated rows are packed each for itself; a null
    id is carried along."""
    return best_fit_pack(docs, with_ids=True)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("personal data", personal), ("packing", packed)]

#: SQL can express neither the compression bands nor the tokenizer; the stages
#: are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to shared storage and reread."""
    bound_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
