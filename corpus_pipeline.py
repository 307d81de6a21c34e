"""Corpus pipeline: quality classifier, quality rules, near-duplicate removal, packing.

Each stage takes the documents that the one before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.near_duplicates import first_of_each_class
from tidemark.llm.packing import pack
from tidemark.llm.quality_model import fit_quality, score_quality
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained classifier accepts, rows as they are.

    Null, empty and wordless texts are not accepted. Repeated rows are judged alike and all stay or go; nulls in other columns
    make no difference, and other columns than those of documents are dropped. An empty table stays empty.
    """
    return score_quality(docs.select(COLUMNS), fit_quality(docs)).where("accepted").select(COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep enough text under the line rules, without their failing lines.

    A text without a failing line stays as it is; of others the passing lines stay, and n_chars is counted anew. Null and
    empty texts have too few words and go. Repeated rows all stay or go. Long texts are read whole. An empty table stays
    empty.
    """
    kept = quality_rules(docs.select(COLUMNS)).where("kept")
    cut = F.col("clean_words") < F.col("n_words")
    text, size = F.when(cut, F.col("clean_text")).otherwise(F.col("text")), F.when(cut, F.length("clean_text")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", size.cast("bigint").alias("n_chars"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that with the smallest id.

    Of repeated rows one stays. Two different texts under one id are judged each by itself. Rows without an id or without a
    word have no class and all stay. An empty table stays empty.
    """
    return first_of_each_class(docs.select(COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and places; null and empty texts are the end id alone, repeated rows
    are packed as often as they come, and an empty table has no piece."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_classifier), ("quality rules", rules), ("near duplicates", deduplicate), ("packing", packing)]
#: SQL can express neither the classifier nor the packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
