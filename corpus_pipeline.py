"""From documents to packed training sequences in five stages, each over all rows that its predecessor kept.

All stages take empty tables (no rows come out) and documents with more columns, which they do not hand on; nulls may be in any column, and rows may repeat.
They have the session bound the batches that go to Python workers, which is planned when a stage's rows are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wirelake.llm import decontam, jaccard, langid, packing, quality
from wirelake.llm.queries import tokenizer_path
from wirelake.llm.storage import Scratch, bounded_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text with letters whose likeliest language has less than this score is in no known language.
LEAST_LANGUAGE_SCORE = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents predicted as 1, repeated rows as often as they come. Labels of all labelled documents are learned from.

    A null or empty text has no features and is kept or not by the model's bias alone; a row without doc_id is judged like others and not learned from.
    """
    bounded_batches(spark)
    weights = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return quality.score(docs.select(*COLUMNS), weights).where("predicted = 1").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model knows; null texts, texts without a letter and undecided ones go."""
    bounded_batches(spark)
    judged = langid.identify(docs.select(*COLUMNS), langid.fit(docs.select("doc_id", "text", "lang")))
    return judged.where((judged.lang_pred != "und") & (judged.lang_score >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that of the smallest doc_id; of rows that repeat it one stays. Null texts and those without words are in no group and stay."""
    bounded_batches(spark)
    return jaccard.keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter one. Null and empty texts hold none and stay, repeated rows are judged each."""
    bounded_batches(spark)
    return decontam.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens. A null or empty text is its end id alone; repeated rows are packed each."""
    bounded_batches(spark)
    return packing.pack(docs, packing.PackParams(tokenizer_path()))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: Trained models and tokenizers take part, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is a table in the shared folder, so that a lost executor costs no more than the stage that runs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
