"""Registered queries: name, Spark query over (spark, sf_dir), and DuckDB SQL with the same rows where SQL can express it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def r(x: str, places: int = 6) -> str:
    """The same rounding as functions.numbers.rounded."""
    return f"(floor(({x}) * 1e{places}::DOUBLE + 0.5::DOUBLE) / 1e{places}::DOUBLE)"


def text(x: str, places: int) -> str:
    """The same decimals as sources.text.decimal."""
    whole = f"CAST(floor(({x}) * 1e{places}::DOUBLE + 0.5::DOUBLE) AS BIGINT)"
    return f"({whole} // {10**places} || '.' || lpad(CAST({whole} % {10**places} AS VARCHAR), {places}, '0'))"


MARKERS = """
markers AS (
  SELECT 'c' || CAST(p_partkey // 500 AS VARCHAR) AS contig, p_partkey AS site_idx, CAST(1000 * (p_partkey + 1) + 7 * p_size AS BIGINT) AS pos FROM part)"""

SITES = f"""{MARKERS},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY contig ORDER BY site_idx) - 1 AS rank, min(site_idx) OVER (PARTITION BY contig) AS first FROM markers),
contigs AS (
  SELECT contig, first, (count(*) + 119) // 120 AS chunks FROM ranked GROUP BY contig, first),
starts AS (
  SELECT contig, CAST(sum(chunks) OVER (ORDER BY first) AS BIGINT) - chunks AS start FROM contigs),
sites AS (
  SELECT contig, site_idx, pos, CAST(start + rank // 120 AS INTEGER) AS chunk_id, CAST(rank % 120 AS INTEGER) AS chunk_pos FROM ranked JOIN starts USING (contig)),
spaced AS (
  SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY chunk_id ORDER BY chunk_pos), 0) AS d FROM sites)"""

CELLS = """
reads AS (
  SELECT l_partkey AS site_idx, l_suppkey AS sample_idx, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS a FROM lineitem GROUP BY ALL),
raw AS (
  SELECT *, pow(0.99::DOUBLE, n - a) * pow(0.01::DOUBLE, a) AS u0, pow(0.5::DOUBLE, n) AS u1, pow(0.01::DOUBLE, n - a) * pow(0.99::DOUBLE, a) AS u2 FROM reads),
cells AS (
  SELECT site_idx, sample_idx, n, a, u0 / (u0 + u1 + u2) AS gl0, u1 / (u0 + u1 + u2) AS gl1, u2 / (u0 + u1 + u2) AS gl2 FROM raw)"""


def freq(site: str, cluster: str) -> str:
    return f"((({site} * 31 + {cluster} * 17) % 89 + 5)::DOUBLE / 100::DOUBLE)"


#: No-jump probability and its square, mixed and double-jump forms.
RATES = """
jumpy AS (
  SELECT *, least(greatest(exp(-d::DOUBLE / 1e6::DOUBLE), 1 - exp(-1e-9::DOUBLE)), exp(-1e-9::DOUBLE)) AS er FROM spaced),
rates AS (
  SELECT *, er * er AS r0, er * (1 - er) AS r1, (1 - er) * (1 - er) AS r2 FROM jumpy)"""
