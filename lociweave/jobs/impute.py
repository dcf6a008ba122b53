"""Imputation: EM over the haplotype-cluster model, one Spark job a pass.

Each pass joins tiles with their chunk's parameters (one row a chunk), runs the kernel, and adds the statistics up by chunk in each
task, so that what is written is at most a row a chunk and task, and one for the samples without reads at the chunk; the rows of a
chunk are then added up to make the next parameters, which are written before the next pass reads them, while what the pass read is
deleted. Only the log-likelihood comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.functions.numbers import LEAST_JUMP, LEAST_RATE, MEGABASE, MOST_RATE, POPULATION
from lociweave.jobs import kernel
from lociweave.jobs.tiles import arrays_of, by_chunk, each_site, flat, lacking, runs, summed, sums_row, supplied, unpacked, without_tile
from lociweave.session import forget, settled, small

PARAMETERS = "chunk_id int, sites int, starts array<int>, distance array<double>, er array<double>, pi array<double>, p array<double>"
STATISTICS = "chunk_id int, loglik double, samples double, ref array<double>, alt array<double>, jump array<double>, hap array<double>"


@dataclass
class Options:
    clusters: int = 10
    passes: int = 40
    grid: int = 1
    seed: int = 1
    tol: float = 1e-6
    fixed: frozenset = field(default_factory=frozenset)  # of "er", "p", "pi"
    refill: int = 0  # 0: never; 1: to the least frequency; 2: from the most used other cluster; 3: from a random one


def start(sites: DataFrame, options: Options) -> DataFrame:
    """A row of parameters a chunk: uniform cluster shares, jumps by distance, random allele frequencies from seed and chunk."""
    kept = sites.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("chunk_pos", "pos"))).alias("all")).select("chunk_id", F.transform("all", lambda x: x["pos"]).alias("pos"))

    def run(batches):
        for b in batches:
            rows = {c: [] for c in ("starts", "distance", "er", "pi", "p")}
            counts = []
            for i in range(b.num_rows):
                chunk, pos = b.column("chunk_id")[i].as_py(), flat(b.column("pos"), i)
                starts = np.arange(0, len(pos), options.grid)
                middle = pos[starts + np.diff(np.append(starts, len(pos))) // 2]
                d = np.diff(middle, prepend=middle[:1]).astype(float)
                er = np.clip(np.exp(-d / MEGABASE), 1 - np.exp(-LEAST_JUMP), np.exp(-LEAST_JUMP))
                p = np.random.default_rng([options.seed, chunk]).uniform(1e-4, 1 - 1e-4, (len(pos), options.clusters))
                counts.append(len(pos))
                for c, v in zip(rows, (starts, d, er, np.full((len(starts), options.clusters), 1 / options.clusters), p)):
                    rows[c].append(v)
            starts = pa.array(rows.pop("starts"), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array(counts, pa.int32()), starts, *arrays_of(rows)], ["chunk_id", "sites", "starts", *rows])

    return kept.mapInArrow(run, PARAMETERS)


def model_of(b: pa.RecordBatch, i: int, clusters: int):
    """starts, rates, pi, p of a row."""
    er = flat(b.column("er"), i)
    return flat(b.column("starts"), i), kernel.rates_of(er), flat(b.column("pi"), i).reshape(-1, clusters), flat(b.column("p"), i).reshape(-1, clusters)


def expected(tiles: DataFrame, parameters: DataFrame, clusters: int) -> DataFrame:
    """Statistics of all samples, a row a chunk and task, and one a chunk for those without a tile."""

    def counted(b: pa.RecordBatch, rows: range) -> dict[str, np.ndarray]:
        starts, rates, pi, p = model_of(b, rows[0], clusters)
        samples, gl = unpacked(b, rows, len(p))
        loglik, sums = kernel.impute_counts(gl, p, starts, rates, pi)
        return {"loglik": loglik.sum(), "samples": float(len(samples))} | sums

    def unread(batches):
        for b in batches:
            for i, (chunk, n) in enumerate(zip(b.column("chunk_id").to_pylist(), b.column("lacking").to_pylist())):
                starts, rates, pi, p = model_of(b, i, clusters)
                loglik, sums = kernel.unread_counts(p, starts, rates, pi)
                yield sums_row(chunk, {"loglik": n * loglik, "samples": float(n)} | {c: n * x for c, x in sums.items()})

    found = supplied(tiles, [parameters]).mapInArrow(lambda batches: by_chunk(batches, clusters, counted), STATISTICS)
    return found.union(lacking(tiles, parameters).mapInArrow(unread, STATISTICS))


def refilled(p: np.ndarray, hap: np.ndarray, starts: np.ndarray, how: int, tol: float, seed: list) -> np.ndarray:
    """Allele frequencies with those of hardly used clusters replaced, cluster by cluster, so that later ones see earlier changes."""
    p, share, rng = p.copy(), hap / hap.sum(1, keepdims=True), np.random.default_rng(seed)
    clusters = p.shape[1]
    of = kernel.expand(starts, len(p))
    for c in range(clusters):
        for g in np.flatnonzero(share[:, c] < min(1 / (10 * clusters), 0.01)):
            at, others = of == g, np.where(np.arange(clusters) == c, -1.0, share[g])
            if how == 1:
                p[at, c] = tol
            else:
                chosen = int(np.argmax(others)) if how == 2 else int(rng.choice(clusters, p=share[g]))
                p[at, c] = p[at, chosen]
    return p


def bounded(er: np.ndarray, d: np.ndarray, clusters: int) -> np.ndarray:
    generations = 4 * POPULATION / clusters
    return np.clip(er, np.exp(-generations * MOST_RATE * d / 1e8), np.exp(-generations * LEAST_RATE * d / 1e8))


def simplex(x: np.ndarray, tol: float) -> np.ndarray:
    """Clamped, then divided by the sum over the last axis."""
    x = np.clip(x, tol, 1 - tol)
    return x / x.sum(-1, keepdims=True)


def maximised(parameters: DataFrame, statistics: DataFrame, options: Options, turn: int) -> DataFrame:
    """The next parameters of every chunk that has statistics; others stay."""
    sums = summed(statistics, "chunk_id", ["ref", "alt", "jump", "hap", "samples"])
    fills = options.refill if turn > 4 and turn < options.passes / 4 and turn % 4 == 1 else 0

    def run(batches):
        for b in batches:
            out = {c: [] for c in ("er", "pi", "p")}
            for i in range(b.num_rows):
                er, pi, p = flat(b.column("er"), i), flat(b.column("pi"), i).reshape(-1, options.clusters), flat(b.column("p"), i).reshape(-1, options.clusters)
                if b.column("jump")[i].is_valid:
                    ref, alt, jump, hap = (flat(b.column(c), i).reshape(-1, options.clusters) for c in ("ref", "alt", "jump", "hap"))
                    if "p" not in options.fixed:
                        if not (ref + alt > 0).all():
                            raise ValueError("a cluster has no alleles at a site")
                        p = np.clip(alt / (ref + alt), options.tol, 1 - options.tol)
                    if "er" not in options.fixed:
                        er = bounded(1 - jump.sum(1) / b.column("samples")[i].as_py(), flat(b.column("distance"), i), options.clusters)
                    if "pi" not in options.fixed:
                        pi = simplex(jump / jump.sum(1, keepdims=True), options.tol)
                    if fills:
                        p = refilled(p, hap, flat(b.column("starts"), i), fills, options.tol, [options.seed, turn, b.column("chunk_id")[i].as_py()])
                for c, v in zip(out, (er, pi, p)):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("chunk_id", "sites", "starts", "distance")), *arrays_of(out)], ["chunk_id", "sites", "starts", "distance", *out])

    return parameters.join(sums, "chunk_id", "left").mapInArrow(run, PARAMETERS)


def posteriors(tiles: DataFrame, parameters: DataFrame, clusters: int, blocks: DataFrame | None = None) -> DataFrame:
    """sample_idx, chunk_id, chunk_pos, gp0, gp1, gp2 of every sample and site, with or without reads. ``blocks``: all blocks, where
    ``tiles`` are those of some chunks."""

    def run(batches):
        for b in batches:
            for chunk, rows in runs(b, clusters):
                samples, gp = read_posteriors(b, rows, clusters)
                yield pa.RecordBatch.from_arrays([*each_site(samples, chunk, gp.shape[1]), *(pa.array(gp[:, :, g].ravel()) for g in range(3))], ["sample_idx", "chunk_id", "chunk_pos", "gp0", "gp1", "gp2"])

    found = supplied(tiles, [parameters]).mapInArrow(run, "sample_idx long, chunk_id int, chunk_pos int, gp0 double, gp1 double, gp2 double")
    of_none = settled(unread_posteriors(parameters, clusters), "unread", large_rows=True)
    at = F.posexplode(F.arrays_zip("gp0", "gp1", "gp2")).alias("chunk_pos", "x")
    rest = without_tile(tiles, parameters, blocks).join(small(of_none), "chunk_id")
    rest = rest.select("chunk_id", "gp0", "gp1", "gp2", F.explode("samples").alias("sample_idx")).select("sample_idx", "chunk_id", at)
    return found.union(rest.select("sample_idx", "chunk_id", "chunk_pos", *[F.col(f"x.gp{g}").alias(f"gp{g}") for g in range(3)]))


def read_posteriors(b: pa.RecordBatch, rows: range, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples of some tiles of a chunk, and their genotype posteriors (n, S, 3)."""
    starts, rates, pi, p = model_of(b, rows[0], clusters)
    samples, gl = unpacked(b, rows, len(p))
    gamma = kernel.passes(kernel.emission(gl, p, starts), rates, pi).gamma
    return samples, kernel.posteriors(gl, p, gamma, starts)


def unread_posteriors(parameters: DataFrame, clusters: int) -> DataFrame:
    """chunk_id, and the genotype posteriors of a sample without reads as arrays gp0, gp1, gp2 over the chunk's sites."""

    def run(batches):
        for b in batches:
            gp = [kernel.unread_posteriors(p, starts, rates, pi).T for starts, rates, pi, p in (model_of(b, i, clusters) for i in range(b.num_rows))]
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), *arrays_of({f"gp{g}": [x[g] for x in gp] for g in range(3)})], ["chunk_id", "gp0", "gp1", "gp2"])

    return parameters.mapInArrow(run, "chunk_id int, gp0 array<double>, gp1 array<double>, gp2 array<double>")


def site_moments(tiles: DataFrame, parameters: DataFrame, clusters: int) -> DataFrame:
    """chunk_id, chunk_pos, and the sums over all samples of the dosage and of the spread of the allele count (doses, spreads)."""

    def of(gp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dose = gp[..., 1] + 2 * gp[..., 2]
        return dose, gp[..., 1] + 4 * gp[..., 2] - dose * dose

    def counted(b: pa.RecordBatch, rows: range) -> dict[str, np.ndarray]:
        doses, spreads = of(read_posteriors(b, rows, clusters)[1])
        return {"doses": doses.sum(0), "spreads": spreads.sum(0)}

    def unread(batches):
        for b in batches:
            for i, (chunk, n) in enumerate(zip(b.column("chunk_id").to_pylist(), b.column("lacking").to_pylist())):
                starts, rates, pi, p = model_of(b, i, clusters)
                dose, spread = of(kernel.unread_posteriors(p, starts, rates, pi))
                yield sums_row(chunk, {"doses": n * dose, "spreads": n * spread})

    schema = "chunk_id int, doses array<double>, spreads array<double>"
    found = supplied(tiles, [parameters]).mapInArrow(lambda batches: by_chunk(batches, clusters, counted), schema).union(lacking(tiles, parameters).mapInArrow(unread, schema))
    sums = summed(found, "chunk_id", ["doses", "spreads"])
    return sums.select("chunk_id", F.posexplode(F.arrays_zip("doses", "spreads")).alias("chunk_pos", "x")).select("chunk_id", "chunk_pos", "x.doses", "x.spreads")


def used_haplotypes(tiles: DataFrame, parameters: DataFrame, clusters: int) -> DataFrame:
    """(chunk_id, hap): expected haplotypes in each cluster at each grid, over samples."""
    found = settled(expected(tiles, parameters, clusters), "impute-statistics", large_rows=True)
    return summed(found, "chunk_id", ["hap"])


def fit(tiles: DataFrame, sites: DataFrame, options: Options, parameters: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[float]]:
    """(parameters that the last pass used, parameters after it, log-likelihood of each pass). ``tiles`` is a settled table."""
    now, history = settled(parameters if parameters is not None else start(sites, options), "impute-parameters"), []
    used = None
    for turn in range(options.passes + 1):
        found = settled(expected(tiles, now, options.clusters), "impute-statistics", large_rows=True)
        history.append(found.agg(F.sum("loglik")).first()[0])
        forget(used)
        used, now = now, settled(maximised(now, found, options, turn), "impute-parameters")
        forget(found)
    return used, now, history
