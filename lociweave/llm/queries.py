"""The registered queries of this subpackage, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.llm import decontam, hardneg, htmltext, imatch, langid, linededup, mixing, phrases, pii, sharding, simhash, sql, tokens, toxicity
from lociweave.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


#: The tokenizer's file, on every machine, and the id that ends a document.
VOCABULARY, END = public_tokenizers.path("word_bpe_49k.json"), 2


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digests(table(spark, sf_dir, "documents"), VOCABULARY, END)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates(table(spark, sf_dir, "documents"))


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assigned(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The setting that holds the secret key of pseudonyms, and the key of the registered query where it is unset.
KEY_SETTING, DEMONSTRATION_KEY = "spark.lociweave.pseudonyms.key", "pseudonyms"


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(KEY_SETTING, DEMONSTRATION_KEY))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hardneg.mined(rows, F.col("key") % 100 == 0)


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mix_sources, op2_token_files, op3_simhash_dedup, op4_rendezvous_shards, op5_language, op6_line_dedup, op7_benchmark_leaks, op8_pseudonyms, op9_toxicity, op10_imatch, op11_hard_negatives, op12_main_text, op13_phrases)}

ORACLE_SQL: dict[str, str] = {"op1_mix_sources": sql.OP1, "op4_rendezvous_shards": sql.OP4, "op7_benchmark_leaks": sql.OP7, "op11_hard_negatives": sql.OP11, "op13_phrases": sql.OP13}
