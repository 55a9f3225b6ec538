"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstate.llm import common, decontaminate, jaccard, packing, substrings, toxicity

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity model, trained on the labelled ones, rejects."""
    model = toxicity.train(docs.select("doc_id", "text"), common.read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one of smallest id. Rows that repeat it
    in full go, too."""
    kept = jaccard.join(docs, SHINGLE_WORDS, SIMILAR_PERCENT).where("stays")
    if docs.groupBy("doc_id", F.xxhash64("text")).count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that a document of smaller id has, too. A document of which
    nothing is left goes; one that had no words to begin with stays."""
    out = substrings.dedup(docs).where("n_words = 0 or n_removed < n_words")
    cut = F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.when(cut, F.length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that have a window of a benchmark item."""
    return decontaminate.decontaminate(docs, common.read_table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences, each source at its share of the tokens in every window."""
    return packing.pack(docs, ranks=packing.default_ranks())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

ORACLE_SQL = None  # the toxicity model is trained, which SQL doesn't express


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
