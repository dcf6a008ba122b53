"""A training corpus from ``documents``, in five stages, each of which works on all that the stage before kept.

1. language: documents without letters, and those far from every learned language, go;
2. near-duplicates: of each group of near copies (five-word shingles with a Jaccard index of 0.8 or more), one document stays;
3. leaks: documents that contain a benchmark item go;
4. mix: documents are taken or repeated so that each source comes near its target weight;
5. shards: every record gets its shard.

All but the last return the columns of ``documents``, whatever their names; others than doc_id, text, lang and source are not read.

Defined results: documents with a null or empty text, or without letters, go in the first stage; a null lang isn't learned from, and where
no document has one, none is rejected but those without letters; a null source is a source of its own; rows with a null doc_id are kept
apart by their text; of rows of one near-copy group that of the least doc_id stays (nulls last), of its least text digest, and of wholly
equal rows one; documents that the mix takes more than once are so many equal rows, with one shard; a column ``shard`` of the input is replaced;
an empty table, or an empty benchmark, is no error: no rows, or no document that goes. Texts are read whole, of any length. Each
stage's table is deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lociweave.llm import decontam, langid, mixing, nearcopies, sharding
from lociweave.llm.common import forget, saved, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.deduplicated(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.with_shard(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("leaks", leaks), ("mix", mix), ("shards", shards)]

#: The classifier and the near copies can't be expressed in SQL; tests/llm compares the stages, one after another, with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that all stages keep; what each returns is written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            forget(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
