"""Cluster likelihoods in a binary file: three 32-bit integers (samples, clusters, sites), then for each sample and site the values of
all ordered pairs of clusters as 64-bit floats, little endian.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.sources import ranges


def _floats(batches):
    for b in batches:
        content = [np.frombuffer(x.as_buffer(), "<f8") for x in b.column("content")]
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("record"), pa.array(content, pa.list_(pa.float64()))], ["path", "record", "likely"])


def read(spark: SparkSession, path: str, part: int = ranges.PART_BYTES) -> DataFrame:
    """sample_idx, site, likely (of the ordered pairs, row by row). Tasks read ranges of a file, of any size."""
    held, sites = [], []
    for uri, size in ranges.files(spark, path):
        head = ranges.start_of(uri, 12)
        if head is None or len(head) < 12:
            raise ValueError(f"{uri} has no header, or is in a store that pyarrow can't read")
        n, c, m = np.frombuffer(head, "<i4").tolist()
        if size != 12 + n * m * c * c * 8:
            raise ValueError(f"{uri} doesn't hold {n} samples of {m} sites")
        held.append((uri, size, 12, c * c * 8))
        sites.append((uri, m))
    files = F.broadcast(spark.createDataFrame(sites, "path string, sites long"))  # a row a file
    found = ranges.records(spark, held, part).mapInArrow(_floats, "path string, record long, likely array<double>").join(files, "path")
    return found.select(F.floor(F.col("record") / F.col("sites")).alias("sample_idx"), (F.col("record") % F.col("sites")).alias("site"), "likely")
