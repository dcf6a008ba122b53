"""Samples without reads at a chunk: they have no tile there, and count all the same."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.jobs import admix, fixed, impute, joint, kernel
from lociweave.jobs import tiles as tiles_
from lociweave.operators.sites import chunked
from lociweave.queries import ORACLE_SQL, QUERIES
from lociweave.session import settled

SF = "/root/testdata/sf0.001"
KEYS = {"part": ["p_partkey"], "supplier": ["s_suppkey"], "lineitem": ["l_partkey", "l_suppkey"]}


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Three copies of the tables with shifted keys: a copy's samples have no reads at the others' sites; one more sample has none at all."""
    folder, con = tmp_path_factory.mktemp("copies"), duckdb.connect()
    size = {"part": 200, "supplier": 10}
    for table, keys in KEYS.items():
        new = ", ".join(f"({k} + i * {size['part' if 'part' in k else 'supplier']})::BIGINT AS {k}" for k in keys)
        more = f" UNION ALL SELECT * REPLACE (30::BIGINT AS s_suppkey) FROM '{SF}/supplier.parquet' WHERE s_suppkey = 0" if table == "supplier" else ""
        con.sql(f"COPY (SELECT * EXCLUDE (i) REPLACE ({new}) FROM range(3) r(i), '{SF}/{table}.parquet'{more}) TO '{folder}/{table}.parquet'")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return str(folder), con


NAMES = ["forward_loglik", "state_posteriors", "top_cluster_pair", "em_statistics", "genotype_posteriors", "cluster_likelihoods", "admix_shares", "admix_frequencies", "impute_em", "joint_em", "joint_parameters", "admix_squarem", "aligned_runs"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, copies, monkeypatch, name):
    monkeypatch.setattr(tiles_, "TILE_SAMPLES", 4)
    folder, con = copies
    got = QUERIES[name](spark, folder).toPandas()
    want = con.sql(ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    a, b = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    for c in columns:
        assert (a[c] == b[c]).all(), (c, a[a[c] != b[c]].head(), b[a[c] != b[c]].head())


def test_more_tiles_than_buckets_may_be(spark):
    """Tables of tiles keep to Spark's bound on buckets, and only pairs of a chunk and a block with reads are tiles."""
    sites = settled(chunked(spark.range(400).select(F.lit("c").alias("contig"), F.col("id").alias("site_idx"), (F.col("id") * 900).alias("pos")), 4), "sites")
    third = F.lit(0.2).cast("double")
    cells = spark.range(400).select(F.col("id").alias("site_idx"), F.floor(F.col("id") / 8).alias("sample_idx"), third.alias("gl0"), third.alias("gl1"), F.lit(0.6).cast("double").alias("gl2"))
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", 8)
    try:
        held = tiles_.settle(tiles_.tiles(cells, sites, 4, 4, samples=spark.range(60).withColumnRenamed("id", "sample_idx")))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
    assert held.where(F.size("cells") > 0).count() == 100 and held.where(F.size("cells") == 0).select("block").distinct().count() == held.count() - 100 == 10
    model = settled(fixed.parameters(sites.where("site_idx >= 0"), 2), "model")
    assert fixed.logliks(held, model, 2).select("sample_idx", "chunk_id").distinct().count() == fixed.logliks(held, model, 2).count() == 6000


def test_closed_forms():
    """What is found once for samples without reads, against the recursion."""
    rng = np.random.default_rng(5)
    s, c, k, n = 11, 3, 2, 4
    p, er = rng.uniform(0.05, 0.95, (s, c)), np.append(0.999, rng.uniform(0.3, 0.99, s - 1))
    gl = np.full((n, s, 3), 1 / 3)
    for starts in (np.arange(s), np.arange(0, s, 3)):
        g = len(starts)
        pi, rates = rng.dirichlet(np.ones(c), g), kernel.rates_of(er[:g])
        loglik, want = kernel.impute_counts(gl, p, starts, rates, pi)
        one, got = kernel.unread_counts(p, starts, rates, pi)
        np.testing.assert_allclose(loglik, one, rtol=1e-12)
        for name, x in want.items():
            np.testing.assert_allclose(n * got[name], x, rtol=1e-10)
        gamma = kernel.passes(kernel.emission(gl, p, starts), rates, pi).gamma
        np.testing.assert_allclose(kernel.posteriors(gl, p, gamma, starts), np.broadcast_to(kernel.unread_posteriors(p, starts, rates, pi), (n, s, 3)), rtol=1e-10)
    q, f = rng.dirichlet(np.ones(k), n), rng.dirichlet(np.ones(c), (k, s))
    want = kernel.joint_counts(gl, p, kernel.rates_of(er), q, f)
    ref, alt, counts = kernel.unread_joint(p, kernel.rates_of(er), f, q.sum(0), q.T @ q)
    for a, b in ((ref, want.ref), (alt, want.alt), (counts, want.counts), (s * q, want.own), (np.full(n, kernel.unread_loglik(s, s, c)), want.loglik)):
        np.testing.assert_allclose(a, b, rtol=1e-10)


@pytest.fixture(scope="module")
def sparse(spark):
    """Cells of twelve samples at six chunks, most of which a block of three has no reads at; as tiles, and as tiles of all pairs."""
    rng = np.random.default_rng(8)
    sites = settled(chunked(spark.createDataFrame([("1", s, 1000 * (s + 1)) for s in range(60)], "contig string, site_idx long, pos long"), 10), "sites")
    rows = [(s, i, *map(float, rng.dirichlet(np.ones(3)))) for i in range(11) for s in range(60) if (s // 10 + i // 3) % 3 == 0 and rng.random() < 0.6]
    cells = spark.createDataFrame(rows, "site_idx long, sample_idx long, gl0 double, gl1 double, gl2 double")
    held = tiles_.settle(tiles_.tiles(cells, sites, 10, 30, samples=spark.range(12).withColumnRenamed("id", "sample_idx")))
    return held, settled(tiles_.whole(held, sites.select("chunk_id").distinct()), "whole"), sites


def values(df) -> np.ndarray:
    rows = sorted(df.collect(), key=lambda r: (r["sample_idx"], r["chunk_id"], r[2]))
    return np.array([np.concatenate([np.ravel(x) for x in r]) for r in rows])


@pytest.mark.parametrize("prior", ["pairs", "used", "least"])
def test_as_if_every_pair_were_a_tile(sparse, prior):
    held, every, sites = sparse
    assert held.count() < every.count() == 24
    parameters = settled(impute.start(sites, impute.Options(clusters=3, grid=2 if prior == "used" else 1, seed=3)), "start")
    used = settled(impute.used_haplotypes(every, parameters, 3), "hap") if prior == "used" else None
    options = admix.Options(clusters=3, ancestries=2, seed=2, least_prior=0.1 if prior == "least" else 0.0)
    runs = []
    for tiles in (held, every):
        evidence = admix.Evidence(tiles, parameters, 3, used)
        state, loglik = admix.step(evidence, admix.start(evidence.blocks(), options), options)
        f = np.array([r["f"] for r in state.f.orderBy("chunk_id").collect()])
        runs.append([[loglik], f, np.array([r["q"] for r in admix.shares(state, 2).orderBy("sample_idx").collect()]), values(admix.likelihoods(evidence)), values(impute.posteriors(tiles, parameters, 3)), values(fixed.states(tiles, parameters, 3))])
        if prior == "pairs":
            two = joint.Options(clusters=3, ancestries=2, seed=2)
            begin = joint.start(tiles, sites, two)
            runs[-1] += [values(joint.posteriors(tiles, *begin, two)), values(joint.states(tiles, *begin, two))]
    for a, b in zip(*runs):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-12)
