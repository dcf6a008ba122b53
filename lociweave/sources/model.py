"""Saved models: a folder of Parquet tables. Impute: meta, sites, parameters, tiles; joint adds q and f."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.jobs import fixed, impute, joint
from lociweave.jobs.admix import State
from lociweave.jobs.tiles import blocks_of
from lociweave.session import BATCH_BYTES, LARGE_ROWS

TABLES = ("meta", "sites", "parameters", "tiles", "q", "f")


def saved(path: str, sites: DataFrame, parameters: DataFrame, tiles: DataFrame, clusters: int, ancestries: int = 0, grid: int = 1, state: State | None = None, hap: DataFrame | None = None) -> None:
    spark = sites.sparkSession
    spark.createDataFrame([(clusters, ancestries, grid, hap is not None)], "clusters int, ancestries int, grid int, hapsum boolean").write.parquet(f"{path}/meta")
    tables = {"sites": sites, "parameters": parameters, "tiles": tiles} | ({"q": state.q, "f": state.f} if state else {}) | ({"hap": hap} if hap is not None else {})
    for name, table in tables.items():
        table.write.options(**LARGE_ROWS).parquet(f"{path}/{name}")


def loaded(spark: SparkSession, path: str, joint_model: bool = False) -> dict[str, DataFrame]:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    model = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES[: None if joint_model else 4]}
    return model | ({"hap": spark.read.parquet(f"{path}/hap")} if model["meta"].first()["hapsum"] else {})


def described(model: dict[str, DataFrame]) -> dict:
    """Clusters, grid size, chunks, sites and samples of a saved model."""
    meta = model["meta"].first().asDict()
    samples = model["tiles"].select("block", F.size("samples").alias("n")).distinct().agg(F.sum("n")).first()[0] or 0
    return meta | {"chunks": model["parameters"].count(), "sites": model["sites"].count(), "samples": samples}


def cluster_posteriors(model: dict[str, DataFrame], chunk: int | None = None) -> DataFrame:
    """Of an impute model: each sample's probabilities of pairs of clusters at each site or grid, in all chunks or one."""
    only = (lambda d: d if chunk is None else d.where(F.col("chunk_id") == chunk))
    return fixed.states(only(model["tiles"]), only(model["parameters"]), model["meta"].first()["clusters"], blocks_of(model["tiles"]))


def site_posteriors(model: dict[str, DataFrame], chunk: int | None = None) -> DataFrame:
    """Genotype posteriors under a saved impute model."""
    only = (lambda d: d if chunk is None else d.where(F.col("chunk_id") == chunk))
    return impute.posteriors(only(model["tiles"]), only(model["parameters"]), model["meta"].first()["clusters"], blocks_of(model["tiles"]))


def joint_states(model: dict[str, DataFrame], chunk: int | None = None) -> DataFrame:
    """Probabilities of pairs of clusters, and of jumps to each cluster of each ancestry, under a saved joint model."""
    return joint.states(*_joint_inputs(model, chunk))


def joint_posteriors(model: dict[str, DataFrame], chunk: int | None = None) -> DataFrame:
    """Genotype posteriors and ancestries of sites under a saved joint model."""
    return joint.posteriors(*_joint_inputs(model, chunk))


def _joint_inputs(model: dict[str, DataFrame], chunk: int | None) -> tuple[DataFrame, DataFrame, State, joint.Options, DataFrame]:
    only = (lambda d: d if chunk is None else d.where(F.col("chunk_id") == chunk))
    meta = model["meta"].first()
    options = joint.Options(clusters=meta["clusters"], ancestries=meta["ancestries"])
    return only(model["tiles"]), only(model["parameters"]), State(model["q"], only(model["f"])), options, blocks_of(model["tiles"])
