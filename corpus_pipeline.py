"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but
the last return the columns of documents; ``run`` writes each stage's rows below the shared
folder and reads them back before the next one.

1. quality: documents whose calibrated probability of good quality is under 0.3 go.
2. near_duplicates: of documents linked by SimHash fingerprints that differ in at most 2
   bits, the one with the smallest doc_id stays.
3. repeated_passages: words in windows of 50 words that also start in a document with a
   smaller doc_id go; n_chars follows the text, and a document that loses all words goes.
4. decontaminate: documents that hold a benchmark passage go.
5. encode: byte-level BPE ids of each text, with digests of the ids and of the decoded bytes.

Nulls, ties, empty tables and long texts are handled as the operators' modules say. Of rows that
share a doc_id, stage 2 judges each text by itself. Columns beyond those of documents, whatever
their names, pass through stages 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.llm import bpe, decontaminate, quality, simhash, substring
from glosswork.llm.shared import cut

PASSAGE_WORDS = 50


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs).select(*docs.columns)


def strip_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring.stripped(docs, PASSAGE_WORDS).where("n_words = 0 OR n_removed < n_words")
    kept = F.col("kept")
    if "n_chars" in docs.columns:
        given, kind = kept.getField("n_chars"), dict(docs.dtypes)["n_chars"]
        kept = kept.withField("n_chars", F.when(F.col("n_removed") > 0, F.char_length(kept.getField("text")).cast(kind)).otherwise(given))
    return out.select(kept.alias("kept")).select(*[F.col("kept").getField(c).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", strip_passages),
    ("decontaminate", drop_leaks),
    ("encode", encode),
]

#: A trained classifier, fingerprints and merges are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
