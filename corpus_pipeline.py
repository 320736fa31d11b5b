"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads what it wrote.
A null text is treated as empty, and repeated rows are rows of their own until the near-duplicates go.
Columns of ``docs`` beyond those of documents are left out.  An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import byte_bpe, edit_lines, jaccard_groups, suffix_decontam, weak_quality
from weftgraph.llm.common import shared_folder
from weftgraph.llm.queries import table, tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents of good quality that are not toxic; repeated rows stay or go together."""
    return weak_quality.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("keep").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines that stand, exactly or nearly, in an earlier document out of the texts; every document stays, if empty."""
    cleaned = edit_lines.deduplicate_lines(docs.select(*COLUMNS))
    return cleaned.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word Jaccard of 0.8 or more) keep one row, that with the least id.

    SimHash links are verified and completed.  Null ids come last; texts without words are one group.
    """
    return jaccard_groups.one_of_each(docs.select(*COLUMNS), shingle=5, similarity=(4, 5), most=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the documents that the contamination rule finds; a text without words stays."""
    found = suffix_decontam.benchmark_matches(docs, table(spark, sf_dir, "benchmark"), window=13, keep=COLUMNS[1:])
    return found.where(~suffix_decontam.is_contaminated()).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and token ids of each document; an empty text has none."""
    import public_tokenizers

    return byte_bpe.encode_texts(docs, tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("encode", encode)]
#: The stages train a model, compare lines and texts within a distance, and merge byte pairs: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number + 1 == len(STAGES):
            return out
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
