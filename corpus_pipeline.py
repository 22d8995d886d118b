"""The corpus pipeline: five operators of ``assayer.llm`` in a row over ``documents``.

``run`` applies the stages; each stage's result is written as Parquet into the
shared folder and read back as the next one's documents. All stages but the last
keep the columns of ``documents`` and drop rows:

1. quality: rows that the classifier rejects go (score under 0.3);
2. toxicity: rows that it rejects go (score of 0.7 or more);
3. exact dedup: of equal texts the largest doc_id stays;
4. near dedup: of a group of near copies (five-word shingles, similarity of 0.8
   or more) the smallest doc_id stays;
5. packing: what is left as token sequences.

The classifiers learn from the rows of ``labels`` whose documents the stage gets,
outside their held-out folds. ``ORACLE_SQL`` is None: classifiers and packing have
no SQL form; tests hold ``run`` against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import exact_dedup, near_copies, packing, quality, toxicity
from assayer.llm.labelled import fold
from assayer.llm.queries import tokenizer_path
from assayer.llm.workspace import materialise, ship

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels, fold(F.col("id"), 5) != 0), 0.3)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels, fold(F.col("id"), 3) != 1), 0.7)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
