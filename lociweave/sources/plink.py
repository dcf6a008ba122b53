"""PLINK 1 files: .fam, .bim and .bed (magic bytes, then for each site two bits a sample, low bits first)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.sources import ranges
from lociweave.sources.text import numbered

#: Fixed values of the format: its first bytes, and the two-bit codes of calls; 1 is missing.
MAGIC = bytes((0x6C, 0x1B, 0x01))
CODES = {"0/0": 0, "1/0": 2, "1/1": 3}
MISSING = 1


def samples(spark: SparkSession, path: str) -> DataFrame:
    """at, name: the second column of a .fam file, in order of its lines (a file of one line a sample)."""
    return numbered(spark, path).select(F.col("row").alias("at"), F.element_at(F.split(F.trim("value"), r"\s+"), 2).alias("name"))


def markers(spark: SparkSession, path: str) -> DataFrame:
    """at, contig, pos, first and second allele of a .bim file."""
    field = lambda i: F.element_at(F.split(F.trim("value"), r"\s+"), i)
    return numbered(spark, path).select(F.col("row").alias("at"), field(1).alias("contig"), field(4).cast("long").alias("pos"), field(5).alias("a1"), field(6).alias("a2"))


def sites(spark: SparkSession, path: str, n_samples: int, part: int = ranges.PART_BYTES) -> DataFrame:
    """site (numbered through all files in the order of their paths) and row, its bytes. Tasks read ranges of a file, of any size."""
    width = -(-n_samples // 4)
    held = ranges.files(spark, path)
    for uri, size in held:
        head = ranges.start_of(uri, len(MAGIC))
        if head is None:
            raise ValueError(f"{uri} is in a store that pyarrow can't read")
        if head != MAGIC:
            raise ValueError(f"{uri} is not a PLINK 1 .bed file")
        if (size - len(MAGIC)) % width:
            raise ValueError(f"{uri} doesn't hold whole sites of {n_samples} samples")
    found = ranges.records(spark, [(uri, size, len(MAGIC), width) for uri, size in held], part)
    before, n = [], 0
    for uri, size in held:
        before.append((uri, n))
        n += (size - len(MAGIC)) // width
    starts = F.broadcast(spark.createDataFrame(before, "path string, before long"))  # a row a file
    return found.join(starts, "path").select((F.col("before") + F.col("record")).alias("site"), F.col("content").alias("row"))


def _bytes(batches):
    for b in batches:
        for site, row in zip(b.column("site").to_pylist(), b.column("row")):
            values = np.frombuffer(row.as_buffer(), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), site)), pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values.astype(np.int32))], ["site", "block", "byte"])


def bed(spark: SparkSession, path: str, n_samples: int) -> DataFrame:
    """site (its number), block of four samples, byte."""
    return sites(spark, path, n_samples).mapInArrow(_bytes, "site long, block int, byte int")


def packed(calls: DataFrame) -> DataFrame:
    """(site_idx, sample_idx, gt) to (site_idx, block, byte); samples of a block without a call are missing."""
    code = F.coalesce(*[F.when(F.col("gt") == g, c) for g, c in CODES.items()], F.lit(MISSING))
    # All four missing is 01010101; each call adds its difference from missing.
    shift = F.pow(F.lit(4.0), (F.col("sample_idx") % 4).cast("double"))
    sums = calls.groupBy("site_idx", F.floor(F.col("sample_idx") / 4).alias("block")).agg((F.lit(85) + F.sum((code - MISSING) * shift)).cast("long").alias("byte"))
    return sums


def unpacked(blocks: DataFrame) -> DataFrame:
    """site_idx, sample_idx, code: all four samples of each byte."""
    each = blocks.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return each.select("site_idx", (F.col("block") * 4 + F.col("k")).alias("sample_idx"), F.call_function("shiftright", F.col("byte"), F.col("k") * 2).bitwiseAND(F.lit(3)).cast("int").alias("code"))


def one_hot(codes: DataFrame) -> DataFrame:
    """With likelihoods: 1 for the genotype called, 0 elsewhere, all 0 if missing."""
    return codes.withColumns({f"gl{g}": F.when(F.col("code") == c, 1.0).otherwise(0.0) for g, c in enumerate(CODES.values())})
