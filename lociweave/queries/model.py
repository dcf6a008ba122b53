"""Queries over the haplotype-cluster model: recursions and EM statistics with two clusters and parameters by rule, whose SQL is
a recursive query, and the fitted models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave import fixtures
from lociweave.functions.numbers import rounded
from lociweave.jobs import admix, fixed, impute, joint
from lociweave.jobs.tiles import outline, settle, summed, tiles
from lociweave.operators import calls, labels
from lociweave.queries.registry import CELLS, RATES, SITES, freq, query, r
from lociweave.session import settled

C = 2
#: Emissions of all sites of a chunk for every sample, with or without reads.
_EMIT = f"""
seqs AS (SELECT s_suppkey AS sample_idx, chunk_id FROM supplier CROSS JOIN (SELECT DISTINCT chunk_id FROM sites)),
params AS (SELECT *, {freq('site_idx', '0')} AS pa, {freq('site_idx', '1')} AS pb FROM rates),
dense AS (SELECT q.sample_idx, p.chunk_id, p.chunk_pos AS pl, r0, r1, r2, pa, pb, coalesce(gl0, 1 / 3::DOUBLE) AS g0, coalesce(gl1, 1 / 3::DOUBLE) AS g1, coalesce(gl2, 1 / 3::DOUBLE) AS g2
  FROM seqs q JOIN params p USING (chunk_id) LEFT JOIN cells c ON c.site_idx = p.site_idx AND c.sample_idx = q.sample_idx),
em AS (SELECT *, greatest(g0 * (1 - pa) * (1 - pa) + g1 * 2 * pa * (1 - pa) + g2 * pa * pa, 1e-10::DOUBLE) AS eaa,
  greatest(g0 * (1 - pa) * (1 - pb) + g1 * (pa * (1 - pb) + (1 - pa) * pb) + g2 * pa * pb, 1e-10::DOUBLE) AS eab,
  greatest(g0 * (1 - pb) * (1 - pb) + g1 * 2 * pb * (1 - pb) + g2 * pb * pb, 1e-10::DOUBLE) AS ebb FROM dense)"""

#: State ab stands for both orders, which are alike. Cluster shares are a half.
_FORWARD = """
fwd AS (
  SELECT sample_idx, chunk_id, pl, eaa / (eaa + 2 * eab + ebb) AS aa, eab / (eaa + 2 * eab + ebb) AS ab, ebb / (eaa + 2 * eab + ebb) AS bb, ln((eaa + 2 * eab + ebb) / 4) AS ll, 4 / (eaa + 2 * eab + ebb) AS cs FROM em WHERE pl = 0
  UNION ALL
  SELECT sample_idx, chunk_id, pl, xaa / (xaa + 2 * xab + xbb), xab / (xaa + 2 * xab + xbb), xbb / (xaa + 2 * xab + xbb), ll + ln(xaa + 2 * xab + xbb), 1 / (xaa + 2 * xab + xbb)
  FROM (SELECT e.sample_idx, e.chunk_id, e.pl, f.ll,
      eaa * (r0 * aa + r1 * (aa + ab) + r2 / 4) AS xaa,
      eab * (r0 * ab + r1 * ((aa + ab) + (ab + bb)) / 2 + r2 / 4) AS xab,
      ebb * (r0 * bb + r1 * (ab + bb) + r2 / 4) AS xbb
    FROM fwd f JOIN em e ON e.sample_idx = f.sample_idx AND e.chunk_id = f.chunk_id AND e.pl = f.pl + 1))"""

_BACKWARD = """
lasts AS (SELECT chunk_id, max(chunk_pos) AS last FROM sites GROUP BY chunk_id),
scaled AS (SELECT em.*, cs FROM em JOIN (SELECT sample_idx AS s, chunk_id AS c, pl AS a, cs FROM fwd) ON s = sample_idx AND c = chunk_id AND a = pl),
bwd AS (
  SELECT sample_idx, chunk_id, last AS pl, 1::DOUBLE AS aa, 1::DOUBLE AS ab, 1::DOUBLE AS bb FROM seqs JOIN lasts USING (chunk_id)
  UNION ALL
  SELECT sample_idx, chunk_id, pl - 1,
    cs * (r0 * xaa + r1 * (xaa + xab) + r2 * (xaa + 2 * xab + xbb) / 4),
    cs * (r0 * xab + r1 * ((xaa + xab) / 2 + (xab + xbb) / 2) + r2 * (xaa + 2 * xab + xbb) / 4),
    cs * (r0 * xbb + r1 * (xab + xbb) + r2 * (xaa + 2 * xab + xbb) / 4)
  FROM (SELECT e.sample_idx, e.chunk_id, e.pl, e.cs, r0, r1, r2, eaa * b.aa AS xaa, eab * b.ab AS xab, ebb * b.bb AS xbb
    FROM bwd b JOIN scaled e ON e.sample_idx = b.sample_idx AND e.chunk_id = b.chunk_id AND e.pl = b.pl WHERE e.pl > 0)),
gam AS (
  SELECT e.*, f.aa * b.aa AS gaa, f.ab * b.ab AS gab, f.bb * b.bb AS gbb, b.aa AS baa, b.ab AS bab, b.bb AS bbb,
    lag(f.aa) OVER w AS paa, lag(f.ab) OVER w AS pab, lag(f.bb) OVER w AS pbb
  FROM scaled e JOIN fwd f ON f.sample_idx = e.sample_idx AND f.chunk_id = e.chunk_id AND f.pl = e.pl JOIN bwd b ON b.sample_idx = e.sample_idx AND b.chunk_id = e.chunk_id AND b.pl = e.pl
  WINDOW w AS (PARTITION BY e.sample_idx, e.chunk_id ORDER BY e.pl))"""

_BASE = f"WITH RECURSIVE {SITES}, {RATES}, {CELLS}, {_EMIT}, {_FORWARD}"
_FULL = f"{_BASE}, {_BACKWARD}"


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Settled tiles, sites and parameters by rule."""
    sites = settled(fixtures.sites(spark, sf_dir), "sites")
    held = settle(tiles(fixtures.cells(spark, sf_dir), sites, fixtures.CHUNK, samples=fixtures.samples(spark, sf_dir)))
    return held, sites, settled(fixed.parameters(sites, C), "parameters")


@query(f"{_BASE} SELECT sample_idx, chunk_id, {r('-ll', 5)} AS cost FROM (SELECT *, max(pl) OVER (PARTITION BY chunk_id) AS last FROM fwd) WHERE pl = last")
def forward_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minus log-likelihood of every sample and chunk."""
    held, _, model = inputs(spark, sf_dir)
    return fixed.logliks(held, model, C).select("sample_idx", "chunk_id", rounded(-F.col("loglik"), 5).alias("cost"))


@query(f"{_FULL} SELECT sample_idx, chunk_id, pl AS chunk_pos, {r('gaa')} AS aa, {r('2 * gab')} AS ab, {r('gbb')} AS bb FROM gam")
def state_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, _, model = inputs(spark, sf_dir)
    g = lambda i: F.element_at("gamma", i)
    return fixed.states(held, model, C).select("sample_idx", "chunk_id", "chunk_pos", rounded(g(1), 6).alias("aa"), rounded(g(2) + g(3), 6).alias("ab"), rounded(g(4), 6).alias("bb"))


@query(f"{_FULL} SELECT chunk_id, pl AS chunk_pos, count_if(gaa >= gab AND gaa >= gbb)::BIGINT AS n_aa, count_if(gab > gaa AND gab >= gbb)::BIGINT AS n_ab, count_if(gbb > gaa AND gbb > gab)::BIGINT AS n_bb FROM (SELECT chunk_id, pl, {r('gaa', 9)} AS gaa, {r('gab', 9)} AS gab, {r('gbb', 9)} AS gbb FROM gam) GROUP BY ALL")
def top_cluster_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many samples have each pair of clusters as their likeliest."""
    held, _, model = inputs(spark, sf_dir)
    return fixed.likeliest(held, model, C).select("chunk_id", "chunk_pos", *[F.element_at("counts", i + 1).alias(f"n_{x}") for i, x in enumerate(("aa", "ab", "bb"))])


_PRIOR = """
prior AS (
  SELECT chunk_id, chunk_pos AS pl, 0.25::DOUBLE AS aa, 0.25::DOUBLE AS ab, 0.25::DOUBLE AS bb FROM rates WHERE chunk_pos = 0
  UNION ALL
  SELECT p.chunk_id, chunk_pos, r0 * aa + r1 * (aa + ab) + r2 / 4, r0 * ab + r1 * ((aa + ab) + (ab + bb)) / 2 + r2 / 4, r0 * bb + r1 * (ab + bb) + r2 / 4
  FROM prior p JOIN rates s ON s.chunk_id = p.chunk_id AND s.chunk_pos = p.pl + 1)"""


@query(f"WITH RECURSIVE {SITES}, {RATES}, {_PRIOR} SELECT chunk_id, pl AS chunk_pos, {r('aa', 9)} AS aa, {r('2 * ab', 9)} AS ab, {r('bb', 9)} AS bb FROM prior")
def cluster_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = settled(fixed.parameters(fixtures.sites(spark, sf_dir), C), "parameters")
    p = lambda i: F.element_at("prior", i)
    return fixed.priors(model, C).select("chunk_id", "chunk_pos", rounded(p(1), 9).alias("aa"), rounded(p(2) + p(3), 9).alias("ab"), rounded(p(4), 9).alias("bb"))


_COUNTS = """
counts AS (
  SELECT chunk_id, pl, count(*) AS n, any_value(pa) AS pa, any_value(pb) AS pb,
    sum(gaa + gab) AS ha, sum(gbb + gab) AS hb,
    sum(gaa / eaa * (1 - pa) * (g0 * (1 - pa) + g1 * pa) + gab / eab * (1 - pa) * (g0 * (1 - pb) + g1 * pb)) AS refa,
    sum(gab / eab * (1 - pb) * (g0 * (1 - pa) + g1 * pa) + gbb / ebb * (1 - pb) * (g0 * (1 - pb) + g1 * pb)) AS refb,
    sum(gaa / eaa * pa * (g1 * (1 - pa) + g2 * pa) + gab / eab * pa * (g1 * (1 - pb) + g2 * pb)) AS alta,
    sum(gab / eab * pb * (g1 * (1 - pa) + g2 * pa) + gbb / ebb * pb * (g1 * (1 - pb) + g2 * pb)) AS altb,
    sum(CASE WHEN pl = 0 THEN gaa + gab ELSE cs / 2 * ((r1 * (paa + pab) + r2 / 2) * eaa * baa + (r1 * (pab + pbb) + r2 / 2) * eab * bab) END) AS ja,
    sum(CASE WHEN pl = 0 THEN gbb + gab ELSE cs / 2 * ((r1 * (paa + pab) + r2 / 2) * eab * bab + (r1 * (pab + pbb) + r2 / 2) * ebb * bbb) END) AS jb
  FROM gam GROUP BY chunk_id, pl)"""


@query(f"{_FULL}, {_COUNTS} SELECT chunk_id, pl AS chunk_pos, n, {r('ha', 5)} AS hap_a, {r('hb', 5)} AS hap_b, {r('ja', 5)} AS jump_a, {r('jb', 5)} AS jump_b, {r('alta / (refa + alta)', 5)} AS p_a, {r('altb / (refb + altb)', 5)} AS p_b, {r('ja / (ja + jb)', 5)} AS pi_a, {r('1 - (ja + jb) / n', 5)} AS stay FROM counts")
def em_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected haplotypes and jumps of every site, and the parameters that maximise them."""
    held, _, model = inputs(spark, sf_dir)
    found = settled(impute.expected(held, model, C), "statistics")
    sums = summed(found, "chunk_id", ["ref", "alt", "jump", "hap", "samples"])
    pairs = lambda c: F.transform(F.sequence(F.lit(0), (F.size("hap") / C).cast("int") - 1), lambda i: F.slice(c, i * C + 1, C))
    at = F.posexplode(F.arrays_zip(*[pairs(c).alias(c) for c in ("ref", "alt", "jump", "hap")])).alias("chunk_pos", "x")
    x = lambda c, i: F.element_at(F.col(f"x.{c}"), i + 1)
    jumps = x("jump", 0) + x("jump", 1)
    return sums.select("chunk_id", "samples", at).select(
        "chunk_id", "chunk_pos", F.col("samples").cast("long").alias("n"), *[rounded(x(c, i), 5).alias(f"{c}_{n}") for c in ("hap", "jump") for i, n in enumerate("ab")],
        *[rounded(x("alt", i) / (x("ref", i) + x("alt", i)), 5).alias(f"p_{n}") for i, n in enumerate("ab")], rounded(x("jump", 0) / jumps, 5).alias("pi_a"), rounded(1 - jumps / F.col("samples"), 5).alias("stay"),
    )


_GP = """
gps AS (
  SELECT sample_idx, chunk_id, pl, waa * (1 - pa) * (1 - pa) * g0 + 2 * wab * (1 - pa) * (1 - pb) * g0 + wbb * (1 - pb) * (1 - pb) * g0 AS x0,
    waa * 2 * pa * (1 - pa) * g1 + 2 * wab * (pa * (1 - pb) + (1 - pa) * pb) * g1 + wbb * 2 * pb * (1 - pb) * g1 AS x1,
    waa * pa * pa * g2 + 2 * wab * pa * pb * g2 + wbb * pb * pb * g2 AS x2
  FROM (SELECT *, gaa / eaa AS waa, gab / eab AS wab, gbb / ebb AS wbb FROM gam))"""


@query(f"{_FULL}, {_GP} SELECT sample_idx, chunk_id, pl AS chunk_pos, {r('x0 / (x0 + x1 + x2)')} AS gp0, {r('x1 / (x0 + x1 + x2)')} AS gp1, {r('x2 / (x0 + x1 + x2)')} AS gp2 FROM gps")
def genotype_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, _, model = inputs(spark, sf_dir)
    found = impute.posteriors(held, model, C)
    return found.withColumns({f"gp{g}": rounded(F.col(f"gp{g}"), 6) for g in range(3)})


_ADMIX = f"""{_FULL}, {_PRIOR},
raw_likely AS (SELECT g.sample_idx, g.chunk_id, g.pl, gaa / p.aa AS xaa, gab / p.ab AS xab, gbb / p.bb AS xbb FROM gam g JOIN prior p ON p.chunk_id = g.chunk_id AND p.pl = g.pl),
likely AS (SELECT sample_idx, chunk_id, pl, xaa / (xaa + 2 * xab + xbb) AS laa, xab / (xaa + 2 * xab + xbb) AS lab, xbb / (xaa + 2 * xab + xbb) AS lbb FROM raw_likely),
qs AS (SELECT s_suppkey AS sample_idx, k, CASE k WHEN 0 THEN (s_suppkey % 7 + 1)::DOUBLE / 9 ELSE 1 - (s_suppkey % 7 + 1)::DOUBLE / 9 END AS q FROM supplier, range(2) r(k)),
fs AS (SELECT chunk_id, chunk_pos AS pl, k, z, CASE z WHEN 0 THEN ((chunk_pos * 13 + k * 41) % 83 + 5)::DOUBLE / 100 ELSE 1 - ((chunk_pos * 13 + k * 41) % 83 + 5)::DOUBLE / 100 END AS f FROM sites, range(2) a(k), range(2) b(z)),
half AS (SELECT sample_idx, chunk_id, pl, k, z, q * f AS w FROM qs JOIN seqs USING (sample_idx) JOIN fs USING (chunk_id, k)),
four AS (SELECT l.sample_idx, l.chunk_id, l.pl, a.k AS k1, a.z AS z1, b.k AS k2, b.z AS z2, a.w * b.w * CASE a.z + b.z WHEN 0 THEN laa WHEN 1 THEN lab ELSE lbb END AS w
  FROM likely l JOIN half a USING (sample_idx, chunk_id, pl) JOIN half b USING (sample_idx, chunk_id, pl)),
totals AS (SELECT sample_idx, chunk_id, pl, sum(w) AS total FROM four GROUP BY ALL)"""


def state_by_rule(rows: DataFrame) -> admix.State:
    """Two ancestries' shares and frequencies by rule, for rows (chunk_id, block, samples, grids) as of ``outline``."""
    members = rows.where(F.col("block").isNotNull()).select("block", "samples")
    share = lambda s: (s % 7 + 1).cast("double") / 9.0
    q = members.withColumn("q", F.flatten(F.transform("samples", lambda s: F.array(share(s), 1.0 - share(s)))))
    first = lambda k: lambda i: ((i * 13 + k * 41) % 83 + 5).cast("double") / 100.0
    one = lambda k: F.flatten(F.transform(F.sequence(F.lit(0), F.col("grids") - 1), lambda i: F.array(first(k)(i), 1.0 - first(k)(i))))
    f = rows.where(F.col("chunk_id").isNotNull()).select("chunk_id", "grids").withColumn("f", F.concat(one(0), one(1)))
    return admix.State(settled(q, "q"), settled(f, "f"))


def admix_inputs(spark: SparkSession, sf_dir: str) -> tuple[admix.Evidence, admix.State, admix.Options]:
    """Evidence of two clusters, and a state by rule."""
    held, _, model = inputs(spark, sf_dir)
    evidence = admix.Evidence(held, model, C)
    return evidence, state_by_rule(evidence.blocks()), admix.Options(clusters=C, ancestries=2)


@query(f"""{_FULL}, {_PRIOR}, raw_likely AS (SELECT g.sample_idx, g.chunk_id, g.pl, gaa / p.aa AS xaa, gab / p.ab AS xab, gbb / p.bb AS xbb FROM gam g JOIN prior p ON p.chunk_id = g.chunk_id AND p.pl = g.pl)
SELECT sample_idx, chunk_id, pl AS grid_id, {r('xaa / (xaa + 2 * xab + xbb)')} AS aa, {r('xab / (xaa + 2 * xab + xbb)')} AS ab, {r('xbb / (xaa + 2 * xab + xbb)')} AS bb FROM raw_likely""")
def cluster_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence, _, _ = admix_inputs(spark, sf_dir)
    x = lambda i: rounded(F.element_at("likely", i), 6)
    return admix.likelihoods(evidence).select("sample_idx", "chunk_id", "grid_id", x(1).alias("aa"), x(2).alias("ab"), x(4).alias("bb"))


@query(f"""{_ADMIX}, lls AS (SELECT sample_idx, sum(ln(total)) AS ll, count(*) AS g FROM totals GROUP BY sample_idx),
owns AS (SELECT sample_idx, sum((CASE k1 WHEN 0 THEN w ELSE 0 END + CASE k2 WHEN 0 THEN w ELSE 0 END) / total) AS own FROM four JOIN totals USING (sample_idx, chunk_id, pl) GROUP BY sample_idx)
SELECT sample_idx, {r('own / (2 * g)')} AS q0, {r('1 - own / (2 * g)')} AS q1 FROM lls JOIN owns USING (sample_idx)""")
def admix_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestry shares after one pass; the SQL is the four-way form, the query the factorised one."""
    evidence, state, options = admix_inputs(spark, sf_dir)
    new, _ = admix.step(evidence, state, options)
    return admix.shares(new, 2).select("sample_idx", *[rounded(F.element_at("q", k + 1), 6).alias(f"q{k}") for k in range(2)])


@query(f"""{_ADMIX}, parts AS (SELECT chunk_id, pl, k1 AS k, z1 AS z, w / total AS w FROM four JOIN totals USING (sample_idx, chunk_id, pl) UNION ALL SELECT chunk_id, pl, k2, z2, w / total FROM four JOIN totals USING (sample_idx, chunk_id, pl)),
sums AS (SELECT chunk_id, pl, k, z, sum(w) AS w FROM parts GROUP BY ALL), ratios AS (SELECT *, w / sum(w) OVER (PARTITION BY chunk_id, pl, k) AS f FROM sums)
SELECT chunk_id, pl AS chunk_pos, CAST(k AS INTEGER) AS k, {r('f')} AS f0 FROM ratios WHERE z = 0""")
def admix_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster frequencies of ancestries after one pass."""
    evidence, state, options = admix_inputs(spark, sf_dir)
    new, _ = admix.step(evidence, state, options)
    each = new.f.select("chunk_id", "grids", F.posexplode("f").alias("i", "f"))
    place = F.floor(F.col("i") / C)
    return each.where(F.col("i") % C == 0).select("chunk_id", (place % F.col("grids")).cast("int").alias("chunk_pos"), F.floor(place / F.col("grids")).cast("int").alias("k"), rounded(F.col("f"), 6).alias("f0"))


def _pass(i: int, frequencies: str, mixed: str) -> str:
    """Forward and backward recursions with given parameters, then counts, as relations numbered ``i``.

    ``frequencies`` (chunk_id, pl, pa, pb, er) has the parameters; ``mixed`` (sample_idx, chunk_id, pl, ha, hb) each sample's
    cluster shares.
    """
    return f"""
em{i} AS MATERIALIZED (SELECT d.sample_idx, d.chunk_id, d.pl, g0, g1, g2, f.pa, f.pb, f.er * f.er AS r0, f.er * (1 - f.er) AS r1, (1 - f.er) * (1 - f.er) AS r2, ha, hb,
  greatest(g0 * (1 - f.pa) * (1 - f.pa) + g1 * 2 * f.pa * (1 - f.pa) + g2 * f.pa * f.pa, 1e-10::DOUBLE) AS eaa,
  greatest(g0 * (1 - f.pa) * (1 - f.pb) + g1 * (f.pa * (1 - f.pb) + (1 - f.pa) * f.pb) + g2 * f.pa * f.pb, 1e-10::DOUBLE) AS eab,
  greatest(g0 * (1 - f.pb) * (1 - f.pb) + g1 * 2 * f.pb * (1 - f.pb) + g2 * f.pb * f.pb, 1e-10::DOUBLE) AS ebb
  FROM dense d JOIN {frequencies} f ON f.chunk_id = d.chunk_id AND f.pl = d.pl JOIN {mixed} m ON m.sample_idx = d.sample_idx AND m.chunk_id = d.chunk_id AND m.pl = d.pl),
fwd{i} AS (
  SELECT sample_idx, chunk_id, pl, xaa / t AS aa, xab / t AS ab, xbb / t AS bb, ln(t) AS ll, 1 / t AS cs FROM (
    SELECT *, xaa + 2 * xab + xbb AS t FROM (SELECT sample_idx, chunk_id, pl, eaa * ha * ha AS xaa, eab * ha * hb AS xab, ebb * hb * hb AS xbb FROM em{i} WHERE pl = 0))
  UNION ALL
  SELECT sample_idx, chunk_id, pl, xaa / t, xab / t, xbb / t, ll + ln(t), 1 / t FROM (
    SELECT *, xaa + 2 * xab + xbb AS t FROM (SELECT e.sample_idx, e.chunk_id, e.pl, f.ll,
      eaa * (r0 * aa + 2 * ha * (r1 * (aa + ab) + r2 / 2 * ha)) AS xaa,
      eab * (r0 * ab + ha * (r1 * (ab + bb) + r2 / 2 * hb) + hb * (r1 * (aa + ab) + r2 / 2 * ha)) AS xab,
      ebb * (r0 * bb + 2 * hb * (r1 * (ab + bb) + r2 / 2 * hb)) AS xbb
      FROM fwd{i} f JOIN em{i} e ON e.sample_idx = f.sample_idx AND e.chunk_id = f.chunk_id AND e.pl = f.pl + 1))),
scaled{i} AS MATERIALIZED (SELECT e.*, f.aa AS faa, f.ab AS fab, f.bb AS fbb, ll, cs FROM em{i} e JOIN fwd{i} f ON f.sample_idx = e.sample_idx AND f.chunk_id = e.chunk_id AND f.pl = e.pl),
bwd{i} AS (
  SELECT sample_idx, chunk_id, last AS pl, 1::DOUBLE AS aa, 1::DOUBLE AS ab, 1::DOUBLE AS bb FROM seqs JOIN lasts USING (chunk_id)
  UNION ALL
  SELECT sample_idx, chunk_id, pl - 1, r0 * xaa + 2 * r1 * xa + r2 * (xa * ha + xb * hb), r0 * xab + r1 * (xa + xb) + r2 * (xa * ha + xb * hb), r0 * xbb + 2 * r1 * xb + r2 * (xa * ha + xb * hb)
  FROM (SELECT *, xaa * ha + xab * hb AS xa, xab * ha + xbb * hb AS xb FROM (
    SELECT e.sample_idx, e.chunk_id, e.pl, r0, r1, r2, ha, hb, cs * eaa * b.aa AS xaa, cs * eab * b.ab AS xab, cs * ebb * b.bb AS xbb
    FROM bwd{i} b JOIN scaled{i} e ON e.sample_idx = b.sample_idx AND e.chunk_id = b.chunk_id AND e.pl = b.pl WHERE e.pl > 0))),
gam{i} AS MATERIALIZED (
  SELECT e.*, faa * b.aa AS gaa, fab * b.ab AS gab, fbb * b.bb AS gbb, cs * eaa * b.aa AS xaa, cs * eab * b.ab AS xab, cs * ebb * b.bb AS xbb, lag(faa) OVER w AS paa, lag(fab) OVER w AS pab, lag(fbb) OVER w AS pbb
  FROM scaled{i} e JOIN bwd{i} b ON b.sample_idx = e.sample_idx AND b.chunk_id = e.chunk_id AND b.pl = e.pl WINDOW w AS (PARTITION BY e.sample_idx, e.chunk_id ORDER BY e.pl)),
jumped{i} AS MATERIALIZED (
  SELECT *, CASE WHEN pl = 0 THEN gaa + gab ELSE (r1 * (paa + pab) + r2 * ha) * xaa + (r1 * (pab + pbb) + r2 * hb) * xab END AS ja,
    CASE WHEN pl = 0 THEN gab + gbb ELSE (r1 * (paa + pab) + r2 * ha) * xab + (r1 * (pab + pbb) + r2 * hb) * xbb END AS jb,
    CASE WHEN pl = 0 THEN 0 ELSE r0 * (xaa * paa + 2 * xab * pab + xbb * pbb) + r1 * (xaa * (paa + pab) * ha + xab * ((paa + pab) * hb + (pab + pbb) * ha) + xbb * (pab + pbb) * hb) END AS stayed FROM gam{i}),
counts{i} AS MATERIALIZED (
  SELECT chunk_id, pl, n, {', '.join(f"alt{c} / (ref{c} + alt{c}) AS p{c}" for c in 'ab')}, ja, jb FROM (
    SELECT chunk_id, pl, count(*) AS n, sum(ja * CASE WHEN pl = 0 THEN 1 ELSE ha END) AS ja, sum(jb * CASE WHEN pl = 0 THEN 1 ELSE hb END) AS jb,
      sum(gaa / eaa * (1 - pa) * (g0 * (1 - pa) + g1 * pa) + gab / eab * (1 - pa) * (g0 * (1 - pb) + g1 * pb)) AS refa,
      sum(gab / eab * (1 - pb) * (g0 * (1 - pa) + g1 * pa) + gbb / ebb * (1 - pb) * (g0 * (1 - pb) + g1 * pb)) AS refb,
      sum(gaa / eaa * pa * (g1 * (1 - pa) + g2 * pa) + gab / eab * pa * (g1 * (1 - pb) + g2 * pb)) AS alta,
      sum(gab / eab * pb * (g1 * (1 - pa) + g2 * pa) + gbb / ebb * pb * (g1 * (1 - pb) + g2 * pb)) AS altb
    FROM jumped{i} GROUP BY chunk_id, pl)),
next{i} AS MATERIALIZED (
  SELECT chunk_id, pl, {', '.join(f"least(greatest(p{c}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p{c}" for c in 'ab')},
    least(greatest(1 - (ja + jb) / n, exp(-4e6::DOUBLE * d / 1e8::DOUBLE)), exp(-4e3::DOUBLE * d / 1e8::DOUBLE)) AS er,
    least(greatest(ja / (ja + jb), 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS pia
  FROM counts{i} JOIN (SELECT chunk_id, chunk_pos AS pl, d::DOUBLE AS d FROM spaced) USING (chunk_id, pl))"""


#: Cells of all samples, the parameters by rule, and even cluster shares.
_RULE = f"""WITH RECURSIVE {SITES}, {RATES}, {CELLS}, {_EMIT},
lasts AS (SELECT chunk_id, max(chunk_pos) AS last FROM sites GROUP BY chunk_id),
rule AS (SELECT chunk_id, chunk_pos AS pl, pa, pb, er FROM params),
even AS (SELECT sample_idx, chunk_id, pl, 0.5::DOUBLE AS ha, 0.5::DOUBLE AS hb FROM dense)"""


@query(f"""{_RULE}, {_pass(0, 'rule', 'even')}, even1 AS (SELECT sample_idx, chunk_id, pl, pia AS ha, 1 - pia AS hb FROM next0 JOIN seqs USING (chunk_id)), {_pass(1, 'next0', 'even1')},
gps AS (SELECT chunk_id, pl, x1 / (x0 + x1 + x2) AS gp1, x2 / (x0 + x1 + x2) AS gp2 FROM (
  SELECT chunk_id, pl, gaa / eaa * (1 - pa) * (1 - pa) * g0 + 2 * gab / eab * (1 - pa) * (1 - pb) * g0 + gbb / ebb * (1 - pb) * (1 - pb) * g0 AS x0,
    gaa / eaa * 2 * pa * (1 - pa) * g1 + 2 * gab / eab * (pa * (1 - pb) + (1 - pa) * pb) * g1 + gbb / ebb * 2 * pb * (1 - pb) * g1 AS x1,
    gaa / eaa * pa * pa * g2 + 2 * gab / eab * pa * pb * g2 + gbb / ebb * pb * pb * g2 AS x2 FROM gam1)),
eafs AS (SELECT chunk_id, pl, count(*) AS n, sum(gp1 + 2 * gp2) / (2 * count(*)) AS f, sum(gp1 + 4 * gp2 - (gp1 + 2 * gp2) * (gp1 + 2 * gp2)) AS spread FROM gps GROUP BY ALL)
SELECT site_idx, n, {r('f')} AS eaf, CASE WHEN {r('f', 2)} <= 0 OR {r('f', 2)} >= 1 THEN 1::DOUBLE ELSE {r('greatest(0::DOUBLE, least(1::DOUBLE, 1 - spread / (2::DOUBLE * n * f * (1 - f))))', 3)} END AS info
FROM eafs JOIN (SELECT site_idx, chunk_id, chunk_pos AS pl FROM sites) USING (chunk_id, pl)""")
def impute_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EAF and INFO of every site after a pass of EM with two clusters from parameters by rule."""
    held, sites, model = inputs(spark, sf_dir)
    used, _, _ = impute.fit(held, sites, impute.Options(clusters=C, passes=1), model)
    sums = impute.site_moments(held, used, C).join(sites.select("site_idx", "chunk_id", "chunk_pos"), ["chunk_id", "chunk_pos"])
    return calls.scores_of(sums, fixtures.samples(spark, sf_dir).count())


#: Shares and frequencies by rule, as of the admixture queries.
_QF = """
qs AS (SELECT s_suppkey AS sample_idx, (s_suppkey % 7 + 1)::DOUBLE / 9 AS q FROM supplier),
fs AS (SELECT chunk_id, chunk_pos AS pl, ((chunk_pos * 13) % 83 + 5)::DOUBLE / 100 AS f0, ((chunk_pos * 13 + 41) % 83 + 5)::DOUBLE / 100 AS f1 FROM sites)"""


@query(f"""{_RULE}, {_QF}, mixed AS (SELECT sample_idx, chunk_id, pl, q * f0 + (1 - q) * f1 AS ha, 1 - q * f0 - (1 - q) * f1 AS hb FROM qs JOIN seqs USING (sample_idx) JOIN fs USING (chunk_id)), {_pass(0, 'rule', 'mixed')},
own AS (SELECT sample_idx, CASE WHEN j.pl = 0 THEN q ELSE q * (f0 * ja + (1 - f0) * jb + stayed) END AS y0, CASE WHEN j.pl = 0 THEN 1 - q ELSE (1 - q) * (f1 * ja + (1 - f1) * jb + stayed) END AS y1
  FROM jumped0 j JOIN qs USING (sample_idx) JOIN fs f ON f.chunk_id = j.chunk_id AND f.pl = j.pl),
new AS (SELECT sample_idx, sum(y0) / sum(y0 + y1) AS q FROM own GROUP BY sample_idx)
SELECT sample_idx, {r('least(greatest(q, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)')} AS q0, {r('1 - least(greatest(q, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)')} AS q1 FROM new""")
def joint_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestry shares of every sample after a pass of the joint model from parameters by rule."""
    _, state, _ = joint_pass(spark, sf_dir)
    return admix.shares(state, 2).select("sample_idx", *[rounded(F.element_at("q", k + 1), 6).alias(f"q{k}") for k in range(2)])


@query(f"""{_RULE}, {_QF}, mixed AS (SELECT sample_idx, chunk_id, pl, q * f0 + (1 - q) * f1 AS ha, 1 - q * f0 - (1 - q) * f1 AS hb FROM qs JOIN seqs USING (sample_idx) JOIN fs USING (chunk_id)), {_pass(0, 'rule', 'mixed')},
sums AS (SELECT j.chunk_id, j.pl, {', '.join(f"sum({w} * j{c} * CASE WHEN j.pl = 0 THEN 1 ELSE {f} END) AS z{k}{c}" for k, w in ((0, 'q'), (1, '(1 - q)')) for c, f in (('a', f'f{k}'), ('b', f'(1 - f{k})')))}, count(*) AS n
  FROM jumped0 j JOIN qs USING (sample_idx) JOIN fs f ON f.chunk_id = j.chunk_id AND f.pl = j.pl GROUP BY j.chunk_id, j.pl)
SELECT chunk_id, pl AS chunk_pos, {r('z0a / (z0a + z0b)', 5)} AS f0, {r('z1a / (z1a + z1b)', 5)} AS f1, {r('pa', 5)} AS pa, {r('pb', 5)} AS pb,
  {r('least(greatest(1 - (z0a + z0b + z1a + z1b) / n, exp(-4e6::DOUBLE * d / 1e8::DOUBLE)), exp(-4e3::DOUBLE * d / 1e8::DOUBLE))', 5)} AS stay
FROM sums JOIN (SELECT chunk_id, pl, pa, pb FROM counts0) USING (chunk_id, pl) JOIN (SELECT chunk_id, chunk_pos AS pl, d::DOUBLE AS d FROM spaced) USING (chunk_id, pl)""")
def joint_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster frequencies of ancestries, allele frequencies and no-jump probabilities after the same pass."""
    parameters, state, _ = joint_pass(spark, sf_dir)
    f = admix.by_grid(state, 2, C).withColumnRenamed("grid_id", "chunk_pos")
    p = fixed.by_site(parameters, C)
    er = parameters.select("chunk_id", F.posexplode("er").alias("chunk_pos", "er"))
    at = lambda c, i: rounded(F.element_at(c, i), 5)
    return f.join(p, ["chunk_id", "chunk_pos"]).join(er, ["chunk_id", "chunk_pos"]).select("chunk_id", "chunk_pos", at("f", 1).alias("f0"), at("f", 3).alias("f1"), at("p", 1).alias("pa"), at("p", 2).alias("pb"), rounded(F.col("er"), 5).alias("stay"))


def joint_pass(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, admix.State, list[float]]:
    held, sites, model = inputs(spark, sf_dir)
    state = state_by_rule(outline(held, model.select("chunk_id", F.col("sites").alias("grids"))))
    return joint.fit(held, sites, joint.Options(clusters=C, ancestries=2, passes=1), (model, state))


def _admix_steps(i: int) -> str:
    """State i (q{i}: share of the first ancestry; f{i}: first cluster's frequency in each) to log-likelihood and state i + 1.

    Of a pair of haplotypes, ancestries and clusters are summed over all four ways.
    """
    term = lambda k, a, m, b: f"q{k} * f{k}{a} * q{m} * f{m}{b} * l{''.join(sorted(a + b))}"
    ways = [(k, a, m, b) for k in "01" for a in "ab" for m in "01" for b in "ab"]
    of = lambda k, a: " + ".join(term(*w) for w in ways for side in (0, 2) if w[side : side + 2] == (k, a))
    return f"""
cells{i} AS MATERIALIZED (SELECT sample_idx, chunk_id, pl, laa, lab, lbb, q AS q0, 1 - q AS q1, f0 AS f0a, 1 - f0 AS f0b, f1 AS f1a, 1 - f1 AS f1b FROM likely JOIN q{i} USING (sample_idx) JOIN f{i} USING (chunk_id, pl)),
parts{i} AS MATERIALIZED (SELECT sample_idx, chunk_id, pl, {' + '.join(term(*w) for w in ways)} AS total, {', '.join(f"({of(k, a)}) AS w{k}{a}" for k in '01' for a in 'ab')} FROM cells{i}),
ll{i} AS MATERIALIZED (SELECT sum(ln(total)) AS ll FROM parts{i}),
q{i + 1} AS MATERIALIZED (SELECT sample_idx, {_held('sum((w0a + w0b) / total) / (2 * count(*))')} AS q FROM parts{i} GROUP BY sample_idx),
f{i + 1} AS MATERIALIZED (SELECT chunk_id, pl, {', '.join(_held(f"sum(w{k}a / total) / sum((w{k}a + w{k}b) / total)") + f" AS f{k}" for k in '01')} FROM parts{i} GROUP BY chunk_id, pl)"""


def _held(x: str) -> str:
    """One of two shares, clamped; as the other is clamped alike, they still sum to 1."""
    return f"least(greatest({x}, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE)"


_LIKELY = """
raw_likely AS (SELECT g.sample_idx, g.chunk_id, g.pl, gaa / p.aa AS xaa, gab / p.ab AS xab, gbb / p.bb AS xbb FROM gam g JOIN prior p ON p.chunk_id = g.chunk_id AND p.pl = g.pl),
likely AS MATERIALIZED (SELECT sample_idx, chunk_id, pl, xaa / (xaa + 2 * xab + xbb) AS laa, xab / (xaa + 2 * xab + xbb) AS lab, xbb / (xaa + 2 * xab + xbb) AS lbb FROM raw_likely)"""

_far = lambda x: f"least(greatest(a.{x} + 2 * len * (b.{x} - a.{x}) + len * len * (c.{x} - 2 * b.{x} + a.{x}), 1e-9::DOUBLE), 1 - 1e-9::DOUBLE)"
#: The other of two shares, extrapolated alike, sums to 1 with it before clamping, so clamping both leaves their sum.
_SQUAREM = f"""{_FULL}, {_PRIOR}, {_LIKELY}, {_QF.replace('qs AS', 'q0 AS MATERIALIZED').replace('fs AS', 'f0 AS MATERIALIZED')}, {_admix_steps(0)}, {_admix_steps(1)},
moves AS (SELECT 2 * sum((b.q - a.q) * (b.q - a.q)) AS first, 2 * sum((c.q - 2 * b.q + a.q) * (c.q - 2 * b.q + a.q)) AS second FROM q0 a JOIN q1 b USING (sample_idx) JOIN q2 c USING (sample_idx)
  UNION ALL SELECT 2 * sum((b.f0 - a.f0) * (b.f0 - a.f0) + (b.f1 - a.f1) * (b.f1 - a.f1)), 2 * sum((c.f0 - 2 * b.f0 + a.f0) * (c.f0 - 2 * b.f0 + a.f0) + (c.f1 - 2 * b.f1 + a.f1) * (c.f1 - 2 * b.f1 + a.f1))
  FROM f0 a JOIN f1 b USING (chunk_id, pl) JOIN f2 c USING (chunk_id, pl)),
lens AS MATERIALIZED (SELECT least(4::DOUBLE, greatest(1::DOUBLE, sqrt(sum(first) / sum(second)))) AS len FROM moves),
q7 AS MATERIALIZED (SELECT a.sample_idx, {_far('q')} AS q FROM q0 a JOIN q1 b USING (sample_idx) JOIN q2 c USING (sample_idx) CROSS JOIN lens),
f7 AS MATERIALIZED (SELECT a.chunk_id, a.pl, {_far('f0')} AS f0, {_far('f1')} AS f1 FROM f0 a JOIN f1 b USING (chunk_id, pl) JOIN f2 c USING (chunk_id, pl) CROSS JOIN lens),
{_admix_steps(7)}, {_admix_steps(2)}"""


@query(f"""{_SQUAREM}, chosen AS (SELECT sample_idx, CASE WHEN ll2.ll > ll7.ll + 0.1::DOUBLE THEN q3.q ELSE q8.q END AS q FROM q3 JOIN q8 USING (sample_idx) CROSS JOIN ll2 CROSS JOIN ll7)
SELECT sample_idx, {r('q', 5)} AS q0, {r('1 - q', 5)} AS q1 FROM chosen""")
def admix_squarem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestry shares of every sample after a cycle of accelerated EM from a state by rule."""
    evidence, state, options = admix_inputs(spark, sf_dir)
    options.passes = 3
    state, _ = admix.fit(evidence, options, state)
    return admix.shares(state, 2).select("sample_idx", *[rounded(F.element_at("q", k + 1), 5).alias(f"q{k}") for k in range(2)])


@query(f"""{_FULL}, {_PRIOR}, {_LIKELY}, {_QF.replace('qs AS', 'q0 AS MATERIALIZED').replace('fs AS', 'f0 AS MATERIALIZED')}, {_admix_steps(0)},
q4 AS MATERIALIZED (SELECT sample_idx, 1 - q AS q FROM q0), f4 AS MATERIALIZED (SELECT chunk_id, pl, f1 AS f0, least(greatest(f0, 0.1::DOUBLE), 0.9::DOUBLE) AS f1 FROM f0), {_admix_steps(4)},
pairs AS (SELECT sample_idx, a.q AS x, b.q AS y FROM q1 a JOIN q5 b USING (sample_idx)),
costs AS (SELECT sum(x * ln(x / y) + (1 - x) * ln((1 - x) / (1 - y))) AS same, sum(x * ln(x / (1 - y)) + (1 - x) * ln((1 - x) / y)) AS other FROM pairs)
SELECT sample_idx, {r('x')} AS first, {r('CASE WHEN other < same THEN 1 - y ELSE y END')} AS second FROM pairs CROSS JOIN costs""")
def aligned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ancestry's share in two runs whose starts have the ancestries the other way round, aligned."""
    evidence, state, options = admix_inputs(spark, sf_dir)
    options.passes, options.accelerate = 1, False
    half = F.floor(F.size("f") / 2).cast("int")
    held = F.transform(F.slice("f", F.lit(1), half), lambda x: F.least(F.greatest(x, F.lit(0.1)), F.lit(0.9)))
    back = lambda x: F.transform(x, lambda v, i: F.element_at(x, (i + F.when(i % 2 == 0, 2).otherwise(0)).cast("int")))
    other = admix.State(state.q.withColumn("q", back(F.col("q"))), state.f.withColumn("f", F.concat(F.slice("f", half + 1, half), held)))
    runs = [settled(admix.shares(admix.fit(evidence, options, s)[0], 2), "run") for s in (state, other)]
    a, b = labels.aligned(runs)
    first = lambda q, name: q.select("sample_idx", rounded(F.element_at("q", 1), 6).alias(name))
    return first(a, "first").join(first(b, "second"), "sample_idx")


@query()
def impute_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imputed sites after EM from a random start with grids of four sites: EAF and INFO of each, from whole data."""
    held, sites, _ = inputs(spark, sf_dir)
    options = impute.Options(clusters=6, passes=4, grid=fixtures.GRID, refill=2)
    used, _, _ = impute.fit(held, sites, options)
    sums = impute.site_moments(held, used, options.clusters).join(sites.select("site_idx", "chunk_id", "chunk_pos"), ["chunk_id", "chunk_pos"])
    return calls.scores_of(sums, fixtures.samples(spark, sf_dir).count())


@query()
def admix_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestry shares of every sample by accelerated EM from a random start, from cluster likelihoods of a fitted model."""
    held, sites, _ = inputs(spark, sf_dir)
    _, model, _ = impute.fit(held, sites, impute.Options(clusters=4, passes=2, grid=fixtures.GRID))
    state, _ = admix.fit(admix.Evidence(held, model, 4), admix.Options(clusters=4, ancestries=3, passes=3))
    return admix.shares(state, 3)


@query()
def joint_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestry shares of every sample by the joint model from a random start."""
    held, sites, _ = inputs(spark, sf_dir)
    _, state, _ = joint.fit(held, sites, joint.Options(clusters=4, ancestries=3, passes=3))
    return admix.shares(state, 3)
