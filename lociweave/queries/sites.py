"""Queries over the ordered dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave import fixtures
from lociweave.functions.numbers import bounded_stay, rounded, stay, transitions
from lociweave.operators import intervals, sites
from lociweave.queries.registry import CELLS, MARKERS, RATES, SITES, query, r
from lociweave.session import read


@query(f"WITH {SITES} SELECT contig, site_idx, pos, chunk_id, chunk_pos FROM sites")
def chunk_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.sites(spark, sf_dir)


@query(f"WITH {MARKERS} SELECT contig, site_idx, pos, CAST((row_number() OVER (PARTITION BY contig ORDER BY site_idx) - 1) // 70 AS INTEGER) AS chunk_in_contig, CAST((row_number() OVER (PARTITION BY contig ORDER BY site_idx) - 1) % 70 AS INTEGER) AS chunk_pos FROM markers")
def chunk_rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.rebalanced(fixtures.markers(spark, sf_dir), 70)


@query(f"WITH {SITES} SELECT chunk_id, count(*) AS n_sites FROM sites WHERE chunk_id % 3 <> 0 GROUP BY chunk_id")
def chunk_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.thinned(fixtures.sites(spark, sf_dir), 3).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_sites"))


@query(f"WITH {SITES} SELECT chunk_id, chunk_pos, pos, d FROM spaced")
def site_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.sites(spark, sf_dir).select("chunk_id", "chunk_pos", "pos", sites.distance().alias("d"))


@query(f"WITH {SITES} SELECT chunk_id, chunk_pos, (chunk_pos % 4 = 0 OR chunk_pos % 4 = 3 OR chunk_pos = max(chunk_pos) OVER (PARTITION BY chunk_id)) AS flag FROM sites")
def grid_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.sites(spark, sf_dir).select("chunk_id", "chunk_pos", sites.grid_flags(fixtures.GRID).alias("flag"))


_GRIDS = """
grids AS (
  SELECT chunk_id, CAST(chunk_pos // 4 AS INTEGER) AS grid_id, min(chunk_pos) AS start, max(chunk_pos) AS "end", count(*) AS n_sites, list(pos ORDER BY pos) AS positions FROM sites GROUP BY 1, 2)"""


@query(f'WITH {SITES}, {_GRIDS} SELECT chunk_id, grid_id, start, "end", n_sites, positions[1] AS first_pos, positions[-1] AS last_pos FROM grids')
def grid_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sites.grids(fixtures.sites(spark, sf_dir), fixtures.GRID)
    return found.select("chunk_id", "grid_id", "start", "end", "n_sites", F.element_at("positions", 1).alias("first_pos"), F.element_at("positions", -1).alias("last_pos"))


@query(f"WITH {SITES}, {_GRIDS}, middles AS (SELECT chunk_id, grid_id, positions[n_sites // 2 + 1] AS middle FROM grids) SELECT chunk_id, grid_id, middle, coalesce(middle - lag(middle) OVER (PARTITION BY chunk_id ORDER BY grid_id), 0) AS d FROM middles")
def grid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.grids(fixtures.sites(spark, sf_dir), fixtures.GRID).select("chunk_id", "grid_id", "middle", sites.grid_distance().alias("d"))


@query(f"""WITH {SITES}, {RATES}, flagged AS (SELECT *, sqrt(r2) < 0.00095::DOUBLE AS flag FROM rates),
begun AS (SELECT *, CASE WHEN flag AND coalesce(lag(flag) OVER (PARTITION BY chunk_id ORDER BY chunk_pos), false) THEN 0 ELSE 1 END AS begins FROM flagged)
SELECT chunk_id, chunk_pos, flag, CAST(sum(begins) OVER (PARTITION BY chunk_id ORDER BY chunk_pos) - 1 AS INTEGER) AS island FROM begun""")
def site_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fixtures.sites(spark, sf_dir).withColumn("er", stay(sites.distance())).withColumn("r2", transitions(F.col("er"))[2])
    return sites.islands(held, sites.rate_flags(F.col("r2"), 0.00095)).select("chunk_id", "chunk_pos", "flag", "island")


@query(f"""WITH {SITES}, {RATES} SELECT chunk_id, chunk_pos, {r('er', 9)} AS er, {r('r0', 9)} AS r0, {r('r1', 9)} AS r1, {r('r2', 9)} AS r2,
{r('least(greatest(er, exp(-(4.0::DOUBLE * 20000 / 10 * 100) * d::DOUBLE / 1e8::DOUBLE)), exp(-(4.0::DOUBLE * 20000 / 10 * 0.1::DOUBLE) * d::DOUBLE / 1e8::DOUBLE))', 9)} AS bounded FROM rates""")
def transition_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fixtures.sites(spark, sf_dir).withColumn("d", sites.distance()).withColumn("er", stay(F.col("d")))
    held = held.select("chunk_id", "chunk_pos", "er", *transitions(F.col("er")), bounded_stay(F.col("er"), F.col("d"), 10).alias("bounded"))
    return held.select("chunk_id", "chunk_pos", *[rounded(F.col(c), 9).alias(c) for c in ("er", "r0", "r1", "r2", "bounded")])


_REGIONS = "regions AS (SELECT c_custkey AS region_id, 'c' || CAST(c_custkey % 4 AS VARCHAR) AS contig, CAST(c_custkey * 337 % 2000000 AS BIGINT) AS beg, CAST(c_custkey * 337 % 2000000 + c_custkey % 50 * 400 AS BIGINT) AS \"end\" FROM customer)"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    beg = key * 337 % 2_000_000
    return read(spark, sf_dir, "customer").select(key.alias("region_id"), F.concat(F.lit("c"), (key % 4).cast("string")).alias("contig"), beg.alias("beg"), (beg + key % 50 * 400).alias("end"))


@query(f'WITH {MARKERS}, {_REGIONS} SELECT region_id, site_idx, pos, beg, "end" FROM regions JOIN markers ON markers.contig = regions.contig AND pos BETWEEN beg AND "end"')
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlaps(fixtures.markers(spark, sf_dir), regions(spark, sf_dir)).select("region_id", "site_idx", "pos", "beg", "end")


@query(f"""WITH {_REGIONS}, begun AS (SELECT *, CASE WHEN beg <= max("end") OVER (PARTITION BY contig ORDER BY beg, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS begins FROM regions),
grouped AS (SELECT *, sum(begins) OVER (PARTITION BY contig ORDER BY beg, "end") AS g FROM begun)
SELECT contig, min(beg) AS beg, max("end") AS "end", count(*) AS n FROM grouped GROUP BY contig, g""")
def region_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merged(regions(spark, sf_dir))


@query(f"WITH {MARKERS} SELECT contig, site_idx, pos FROM markers WHERE contig = 'c0' AND pos BETWEEN 50000 AND 300000")
def region_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.markers(spark, sf_dir).where((F.col("contig") == "c0") & F.col("pos").between(50_000, 300_000))


@query(f"""WITH {CELLS}, {MARKERS}, sides AS (SELECT contig, pos, s_nationkey < 12 AS first, n FROM cells JOIN markers USING (site_idx) JOIN supplier ON s_suppkey = sample_idx WHERE a > 0),
a AS (SELECT contig, pos, sum(n)::BIGINT AS a FROM sides WHERE first GROUP BY ALL), b AS (SELECT contig, pos, sum(n)::BIGINT AS b FROM sides WHERE NOT first GROUP BY ALL)
SELECT contig, pos, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL OUTER JOIN b USING (contig, pos)""")
def synced_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternate-carrying depth of two groups of samples, side by side."""
    nations = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample_idx"), (F.col("s_nationkey") < 12).alias("first"))
    sides = fixtures.cells(spark, sf_dir).where("a > 0").join(fixtures.markers(spark, sf_dir), "site_idx").join(nations, "sample_idx")
    one = lambda c: sides.where(c).groupBy("contig", "pos").agg(F.sum("n").alias("value"))
    return intervals.synced(one("first"), one("NOT first")).na.fill(0)
