"""Tables between steps: written to the folder that all executors share, so that lineage ends and lost executors do no harm."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a table may have by Spark's own estimate to be broadcast; beyond, Spark joins by shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes of an Arrow batch: rows may be megabytes.
BATCH_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or in local mode a temporary folder if that is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-steps-")
    sc.setCheckpointDir(own)
    return f"file://{own}"


#: For rows that may be megabytes: the writer looks at sizes after every few rows, and row groups are what a reader holds at once.
LARGE_ROWS = {"parquet.page.size.row.check.min": 4, "parquet.page.size.row.check.max": 64, "parquet.block.size": 8 << 20}


def settled(df: DataFrame, what: str, large_rows: bool = False) -> DataFrame:
    """``df`` written as Parquet and read back."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    if large_rows:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    df.write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def bucketed(df: DataFrame, what: str, buckets: int, by: list[str], order: list[str]) -> DataFrame:
    """``df`` written as a table of so many buckets by some columns, of a file each, in order, and read back: a join on these columns
    leaves its rows where they are."""
    spark, name = df.sparkSession, f"{what}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    dealt = df.repartition(buckets, *by).sortWithinPartitions(*order)
    dealt.write.options(**LARGE_ROWS).option("path", path).bucketBy(buckets, *by).sortBy(*order).saveAsTable(name)
    out = spark.table(name)
    out._settled_at, out._table = path, name
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete the files of settled tables that no later step reads."""
    for df in tables:
        if name := getattr(df, "_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path := getattr(df, "_settled_at", None):
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def bytes_of(df: DataFrame) -> int:
    """Spark's estimate of a table's size (a file's size, for what was read from files)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits(df: DataFrame, most: int | None = None) -> bool:
    """Whether a table's estimated size is within ``most`` bytes."""
    return bytes_of(df) <= (BROADCAST_BYTES if most is None else most)


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df``, marked for broadcast if it fits; else unmarked."""
    return F.broadcast(df) if fits(df, most) else df
