"""A training corpus from raw documents, in five stages, each one operator of this subpackage.

toxicity         documents that the lexicon scores at its threshold or more go
near_duplicates  of documents alike (5-word shingles, similarity 0.8) the one of the smallest id stays
substring        passages of 50 words or more that an earlier document has are cut out; what is then empty goes
decontamination  documents with a benchmark's 10-word window go
bpe              texts become token ids, and the ids text again

Each stage takes all that its predecessor kept, and all but the last return every column of it under its own name, whatever
names these are; only the text, and with it n_chars, can change. Documents without an id stay in every stage but for
their own text: toxic or contaminated ones go. Repeated rows are copies: one stays. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, minhash, substring, toxicity
from .common import numbered, read_table, restored, written


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs)


def stage_substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring.without_passages(docs)
    if "n_chars" not in docs.columns:
        return cut
    at, text = docs.columns.index("n_chars"), docs.columns.index("text")
    return restored(numbered(cut).withColumn(f"c{at}", F.length(f"c{text}").cast(docs.schema.fields[at].dataType)), docs)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs).select("doc_id", F.col("decoded").alias("text"), "n_tokens", "ids")


STAGES = [
    ("toxicity", stage_toxicity),
    ("near_duplicates", stage_near_duplicates),
    ("substring", stage_substring),
    ("decontamination", stage_decontamination),
    ("bpe", stage_bpe),
]

#: No stage but the fourth can be said in SQL: the first and last depend on a learnt lexicon and a vocabulary file.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
