"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents. Documents of null
id are decided like others, by a key of their own.

1. quality: documents that the ordinal classifier rejects go.
2. near_dedup: of each group of near duplicates (shingles of five words, similarity 0.8) one stays.
3. decontamination: documents that hold ten words in a row of a benchmark item go.
4. pii: personal data is replaced by its kind in brackets, and n_chars follows.
5. packing: what is left is cut to token pieces and packed to sequences of 2048 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import grade_model, leakage, near_dup, packing, pii
from siftline.llm.storage import Scratch, with_keys


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratings = grade_model.graded(labels, F.col("quality"), F.col("toxic"))
    return grade_model.select_graded(docs, grade_model.fit_grades(docs, ratings))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed, key = with_keys(docs)
    return near_dup.drop_near_duplicates(keyed, id_col=key, k=5, percent=80).drop(key)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed, key = with_keys(docs)
    return leakage.drop_contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key, window=10).drop(key)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact_documents(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return clean.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), max_len=2048, end_id=0, by_word=True)
    return packing.pack(pieces, max_len=2048)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("packing", best_fit_packing),
]

#: The classifier, the packing and the near-duplicate groups have no SQL form: tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
