"""The corpus pipeline: stages that each take and return documents, the last one packed pieces.

Every stage takes tables without rows, null, empty and very long texts, null
and repeated keys, and further columns of any name, which pass; a null text
stays null, and counts as an empty one.  Rows are told apart by doc_id and text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.llm.jaccard import near_dedup
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.packing import pack_documents
from tidemark.llm.samples import fold
from tidemark.llm.scratch import written
from tidemark.llm.suffix_dedup import suffix_dedup

FOLDS = 5
#: Texts of each label that the toxicity model is fitted on: fewer than by default, as the driver also holds the later stages' plans.
TOXICITY_SAMPLE = 1000


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars, where they have it, of the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def _unused(docs: DataFrame) -> str:
    """A name that no column of ``docs`` has."""
    return "_" + max(docs.columns, key=len)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity is below 0.5, by a model of the labels outside fold 0.

    Equal texts get equal scores; null, empty and blank ones that of no words.
    Null labels and keys teach nothing; without both labels nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.filter(fold(F.col("doc_id"), FOLDS) != 0), most=TOXICITY_SAMPLE)
    scored = toxicity.score_toxicity(docs.select("text", F.struct(*[docs[c] for c in docs.columns]).alias("_row")), model, name="_score")
    return scored.filter("_score < 0.5").select("_row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every later occurrence of three lines in a row is cut out; later is by doc_id (null last), then by line.

    Texts of fewer than three lines stay; rows of one doc_id and text are the same occurrence.
    """
    name = _unused(docs)
    return _counted(line_dedup(docs, name=name).drop(name))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles the smallest doc_id stays.

    A null doc_id stays only where a group has no other; texts without words are linked with nothing and stay.
    """
    return near_dedup(docs)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every string of 50 bytes that a smaller doc_id has too is cut out, with the characters it cuts in two.

    A null doc_id is larger than any other; rows of one doc_id don't count against each other.
    """
    name = _unused(docs)
    return _counted(suffix_dedup(docs, as_text=True, name=name).drop(name))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 1024; a null or empty text is its end token alone."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", drop_repeated_strings),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
