"""The model under given parameters: what saved models are asked for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociweave.functions.numbers import frequency, stay
from lociweave.jobs import kernel
from lociweave.jobs.impute import model_of
from lociweave.jobs.tiles import by_chunk, each_site, lacking, lists, runs, summed, sums_row, supplied, unpacked, without_tile
from lociweave.operators.sites import distance
from lociweave.session import settled, small


def parameters(sites: DataFrame, clusters: int) -> DataFrame:
    """A row a chunk, with allele frequencies by rule, jumps by distance and equal cluster shares."""
    d = sites.withColumn("d", distance())
    row = F.struct("chunk_pos", F.col("d").cast("double").alias("d"), stay(F.col("d")).alias("er"), F.array(*[frequency(F.col("site_idx"), F.lit(c)) for c in range(clusters)]).alias("p"))
    kept = d.groupBy("chunk_id").agg(F.sort_array(F.collect_list(row)).alias("all"))
    n = F.size("all")
    return kept.select(
        "chunk_id", n.alias("sites"), F.sequence(F.lit(0), n - 1).alias("starts"), F.transform("all", lambda x: x["d"]).alias("distance"), F.transform("all", lambda x: x["er"]).alias("er"),
        F.array_repeat(F.lit(1.0 / clusters), n * clusters).alias("pi"), F.flatten(F.transform("all", lambda x: x["p"])).alias("p"),
    )


def states(tiles: DataFrame, model: DataFrame, clusters: int, blocks: DataFrame | None = None) -> DataFrame:
    """sample_idx, chunk_id, chunk_pos (of a grid, in grids) and the probability of each ordered pair of clusters, row by row, of every
    sample, with or without reads. ``blocks``: all blocks, where ``tiles`` are those of some chunks."""

    def run(batches):
        for b in batches:
            for chunk, rows in runs(b, clusters):
                samples, gamma = read_states(b, rows, clusters)
                gamma = kernel.pairs_of(clusters).whole(gamma).swapaxes(0, 1)
                n, s = gamma.shape[:2]
                yield pa.RecordBatch.from_arrays([*each_site(samples, chunk, s), lists(gamma.reshape(n * s, -1))], ["sample_idx", "chunk_id", "chunk_pos", "gamma"])

    found = supplied(tiles, [model]).mapInArrow(run, "sample_idx long, chunk_id int, chunk_pos int, gamma array<double>")
    return found.union(unread_rows(tiles, model, priors(model, clusters), "chunk_pos", "prior", blocks))


def unread_rows(tiles: DataFrame, model: DataFrame, each: DataFrame, place: str, value: str, blocks: DataFrame | None = None) -> DataFrame:
    """sample_idx, chunk_id, place and value for the samples of each chunk without a tile, from the values (chunk_id, place, value) that
    any of them has."""
    of_none = settled(each.groupBy("chunk_id").agg(F.collect_list(F.struct(place, value)).alias("_all")), "unread", large_rows=True)
    rest = without_tile(tiles, model, blocks).join(small(of_none), "chunk_id").select("chunk_id", "_all", F.explode("samples").alias("sample_idx"))
    return rest.select("sample_idx", "chunk_id", F.explode("_all").alias("_x")).select("sample_idx", "chunk_id", f"_x.{place}", f"_x.{value}")


def read_states(b: pa.RecordBatch, rows: range, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples of some tiles of a chunk, and their pair probabilities (G, n, P)."""
    starts, rates, pi, p = model_of(b, rows[0], clusters)
    samples, gl = unpacked(b, rows, len(p))
    return samples, kernel.passes(kernel.emission(gl, p, starts), rates, pi).gamma


def likeliest(tiles: DataFrame, model: DataFrame, clusters: int) -> DataFrame:
    """chunk_id, chunk_pos and how many of all samples have each unordered pair of clusters as their likeliest, by probabilities of one
    order to nine places; of equal ones the first counts."""
    pairs = len(kernel.pairs_of(clusters).a)

    def best(gamma: np.ndarray) -> np.ndarray:
        """Of (G, n, P), (G, P)."""
        at = np.argmax(np.floor(gamma * 1e9 + 0.5), 2)
        return (at[:, :, None] == np.arange(pairs)).sum(1).astype(float)

    def counted(b: pa.RecordBatch, rows: range) -> dict[str, np.ndarray]:
        return {"counts": best(read_states(b, rows, clusters)[1])}

    def unread(batches):
        for b in batches:
            for i, (chunk, n) in enumerate(zip(b.column("chunk_id").to_pylist(), b.column("lacking").to_pylist())):
                _, rates, pi, _ = model_of(b, i, clusters)
                yield sums_row(chunk, {"counts": n * best(kernel.pair_prior(rates, pi)[:, None])})

    schema = "chunk_id int, counts array<double>"
    found = supplied(tiles, [model]).mapInArrow(lambda batches: by_chunk(batches, clusters, counted), schema).union(lacking(tiles, model).mapInArrow(unread, schema))
    each = summed(found, "chunk_id", ["counts"]).withColumn("_at", F.sequence(F.lit(0), (F.size("counts") / pairs).cast("int") - 1))
    return each.select("chunk_id", F.posexplode(pieces("counts", "_at", pairs)).alias("chunk_pos", "counts")).withColumn("counts", F.col("counts").cast("array<long>"))


def logliks(tiles: DataFrame, model: DataFrame, clusters: int) -> DataFrame:
    """sample_idx, chunk_id, loglik of every sample and chunk."""

    def run(batches):
        for b in batches:
            for chunk, rows in runs(b, clusters):
                starts, rates, pi, p = model_of(b, rows[0], clusters)
                samples, gl = unpacked(b, rows, len(p))
                _, scale = kernel.forward(kernel.emission(gl, p, starts), rates, pi)
                yield pa.RecordBatch.from_arrays([pa.array(samples), pa.array(np.full(len(samples), chunk, np.int32)), pa.array(-np.log(scale).sum(0))], ["sample_idx", "chunk_id", "loglik"])

    def unread(batches):
        for b in batches:
            loglik = [kernel.unread_loglik(n, len(starts), clusters) for n, starts in zip(b.column("sites").to_pylist(), b.column("starts"))]
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array(loglik, pa.float64())], ["chunk_id", "loglik"])

    found = supplied(tiles, [model]).mapInArrow(run, "sample_idx long, chunk_id int, loglik double")
    of_none = settled(model.select("chunk_id", "sites", "starts").mapInArrow(unread, "chunk_id int, loglik double"), "unread")
    return found.union(without_tile(tiles, model).join(small(of_none), "chunk_id").select(F.explode("samples").alias("sample_idx"), "chunk_id", "loglik"))


def priors(model: DataFrame, clusters: int) -> DataFrame:
    """chunk_id, chunk_pos and the probability of each ordered pair of clusters before any data."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                _, rates, pi, _ = model_of(b, i, clusters)
                pair = kernel.pairs_of(clusters).whole(kernel.pair_prior(rates, pi))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pi), b.column("chunk_id")[i].as_py(), np.int32)), pa.array(np.arange(len(pi), dtype=np.int32)), lists(pair.reshape(len(pi), -1))], ["chunk_id", "chunk_pos", "prior"])

    return model.mapInArrow(run, "chunk_id int, chunk_pos int, prior array<double>")


def by_grid(model: DataFrame, clusters: int) -> DataFrame:
    """A row a grid: chunk_id, grid_id, its first site, the three transition rates and the clusters' shares."""
    at = F.arrays_zip(F.col("starts"), F.col("er"), pieces("pi", "starts", clusters).alias("pi"))
    each = model.select("chunk_id", F.posexplode(at).alias("grid_id", "x"))
    er = F.col("x.er")
    return each.select("chunk_id", "grid_id", F.col("x.starts").alias("start"), F.array(er * er, er * (1.0 - er), (1.0 - er) * (1.0 - er)).alias("rates"), F.col("x.pi").alias("pi"))


def by_site(model: DataFrame, clusters: int) -> DataFrame:
    """A row a site: chunk_id, chunk_pos and the clusters' allele frequencies."""
    places = F.sequence(F.lit(0), F.col("sites") - 1)
    return model.withColumn("_at", places).select("chunk_id", F.posexplode(pieces("p", "_at", clusters)).alias("chunk_pos", "p"))


def pieces(values: str, counted: str, size: int):
    """``values`` cut to arrays of ``size``, one for each element of ``counted``."""
    return F.transform(F.sequence(F.lit(0), F.size(counted) - 1), lambda i: F.slice(values, i * size + 1, size))


def with_given(model: DataFrame, chunks: DataFrame, given: DataFrame, column: str) -> DataFrame:
    """``model`` with the array ``column`` taken from rows of a matrix (row, values), one a site in the order of all sites."""
    order = chunks.select("chunk_id", "chunk_pos", F.col("site_idx").alias("row"))
    rows = order.join(given, "row").groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("chunk_pos", "values"))).alias("all"))
    new = rows.select("chunk_id", F.flatten(F.transform("all", lambda x: x["values"])).alias("_given"))
    return model.join(new, "chunk_id", "left").withColumn(column, F.coalesce("_given", column)).drop("_given")


def with_given_rates(model: DataFrame, given: DataFrame) -> DataFrame:
    """``model``, a settled table, with no-jump probabilities from rows of a matrix of the three rates, one a grid in the order of all
    grids."""
    sizes = model.select("chunk_id", F.size("starts").alias("n"))
    starts = sizes.select("chunk_id", (F.sum("n").over(W.orderBy("chunk_id")) - F.col("n")).alias("before"))  # a row a chunk
    rows = model.select("chunk_id", F.posexplode("starts").alias("grid_id", "_")).join(starts, "chunk_id").select("chunk_id", "grid_id", (F.col("before") + F.col("grid_id")).alias("row"))
    new = rows.join(given, "row").groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("grid_id", F.sqrt(F.element_at("values", 1)).alias("er")))).alias("all"))
    return model.join(new, "chunk_id", "left").withColumn("er", F.coalesce(F.transform("all", lambda x: x["er"]), "er")).drop("all")


def shares_of(hap: DataFrame, clusters: int) -> DataFrame:
    """A row a grid: chunk_id, grid_id, hapfreq, how much each cluster is used; sums to 1."""
    grids = F.transform(F.sequence(F.lit(0), (F.size("hap") / clusters).cast("int") - 1), lambda i: F.slice("hap", i * clusters + 1, clusters))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return hap.select("chunk_id", F.posexplode(grids).alias("grid_id", "x")).withColumn("hapfreq", F.transform("x", lambda v: v / total)).drop("x")


def products(values: str):
    """All products of two elements of an array, row by row."""
    return F.flatten(F.transform(values, lambda a: F.transform(values, lambda b: a * b)))
