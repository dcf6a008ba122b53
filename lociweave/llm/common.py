"""What the operators share: reading tables, cutting lineage, checked broadcasts, Arrow slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: blank and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows, and bytes of its files, that a table may have to be broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20

#: Bytes of text that a Python task handles at once, besides a single longer text.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or in local mode a temporary one if that is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-tables-")
    sc.setCheckpointDir(own)
    return f"file://{own}"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a saved table that no later step reads."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._saved_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """A saved table, marked for broadcast if it has few rows and its files few bytes; else unmarked, so that Spark joins by shuffle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most and df.limit(rows + 1).count() <= rows else df


def hash60(text: Column) -> Column:
    """60 bits of a string's MD5 as a long from 0; other engines can compute it."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def record_key(key: str, text: str) -> Column:
    """A record's key as a string; rows whose key is null go by their text."""
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of names that no operator uses, and each column's new name; ``toDF(*docs.columns)`` gives the old ones back."""
    new = {c: f"column {i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*new.values()), new


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Texts may be long: have Arrow send at most so many bytes, or one row, at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def slices(batches, text: int | str, most: int = SLICE_BYTES, rows: int = 1 << 20) -> Iterator:
    """Arrow record batches cut so that each holds about ``most`` bytes of the column ``text``, or one row, and ``rows`` at most."""
    for batch in batches:
        sizes = batch.column(text).nbytes
        step = max(1, min(rows, int(batch.num_rows * most / max(1, sizes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
