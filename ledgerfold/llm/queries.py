"""The queries of the numbered operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html_main, minhash, quality, repair, substring, toxicity, unigram, urls
from . import pipeline as corpus_pipeline
from .common import read_table, shared_dir


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(read_table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, threshold=0.85)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(read_table(spark, sf_dir, "documents"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(read_table(spark, sf_dir, "documents"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))


def op6_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ledgerfold/ids-{uuid.uuid4().hex}"
    repair.write_ids(read_table(spark, sf_dir, "documents"), path)
    return repair.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(read_table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.toxic(docs, lexicon).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "toxic_terms")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assess(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": pipeline,
} | {
    f.__name__: f for f in (op1_substring, op2_minhash, op3_bpe, op4_tokens, op5_urls, op6_repair, op7_decontaminate, op8_html, op9_toxicity, op10_quality)
}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {"op2_minhash": minhash.ORACLE, "op7_decontaminate": decontam.ORACLE}
