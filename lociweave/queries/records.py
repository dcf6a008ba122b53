"""Queries over whole records: alleles removed with their tags, files paired, intervals and region lists."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave import fixtures
from lociweave.functions import alleles, special, variants
from lociweave.functions.numbers import rounded
from lociweave.operators import intervals, pairing, sweep
from lociweave.queries.registry import MARKERS, query, r
from lociweave.queries.variants import _RECORDS, records
from lociweave.session import read, settled, shared_folder
from lociweave.sources import clustered, fasta, regions, vcf

#: Lines that tell which tags go by allele.
TAGS = ['##INFO=<ID=AF,Number=A,Type=Float,Description="Frequencies">', '##INFO=<ID=DEP,Number=R,Type=Integer,Description="Depths">', '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">', '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Depths">', '##FORMAT=<ID=PL,Number=G,Type=Integer,Description="Likelihoods">']


def _listed(n: Column, value) -> Column:
    """Values of 0 to n - 1, joined by commas."""
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: value(i).cast("string")), ",")


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two diploid and one haploid sample with tags a value an allele or genotype."""
    key, n = F.col("p_partkey"), F.col("n")
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 3 + 2).cast("int").alias("n"))
    a, b = key % n, F.floor(key / 3) % n
    info = F.concat(F.lit("AF="), F.array_join(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.lit("0."), ((key + i) % 10).cast("string"))), ","), F.lit(";DEP="), _listed(n, lambda i: (key * 3 + i) % 50), F.lit(";DP="), F.col("p_size").cast("string"))
    pairs = F.shiftright(n * (n + 1), 1)
    sample = lambda gt, depth, likely: F.create_map(F.lit("GT"), gt, F.lit("AD"), depth, F.lit("PL"), likely)
    likely = _listed(pairs, lambda g: (key * 7 + g * g) % 99)
    samples = F.array(
        sample(F.concat_ws("/", a.cast("string"), b.cast("string")), _listed(n, lambda i: (key + 3 * i) % 50), likely),
        sample(F.concat(b.cast("string"), F.lit("|.")), _listed(n, lambda i: (key + 4 * i) % 50), F.when(key % 5 == 0, ".").otherwise(likely)),
        sample((key % 2).cast("string"), F.lit("."), _listed(n, lambda i: (key + 5 * i) % 60)),
    )
    return rows.select(key.alias("site_idx"), F.slice(F.array(F.lit("C"), F.lit("G"), F.lit("T")), F.lit(1), n - 1).alias("alts"), info.alias("info"), samples.alias("samples"))


@query("""WITH rows AS (SELECT p_partkey AS k, p_size, CAST(p_partkey % 3 + 2 AS BIGINT) AS n FROM part),
used AS (SELECT *, k % n AS a, k // 3 % n AS b, list_filter(range(0, n), lambda i: i = 0 OR i = k % n OR i = k // 3 % n OR i = k % 2) AS keep FROM rows),
places AS (SELECT *, list_filter(keep, lambda i: i > 0) AS alive, flatten(list_transform(keep, lambda y: list_transform(list_filter(keep, lambda x: x <= y), lambda x: y * (y + 1) // 2 + x))) AS pairs FROM used)
SELECT k AS site_idx, CASE WHEN len(alive) = 0 THEN '.' ELSE array_to_string(list_transform(alive, lambda i: ['C', 'G', 'T'][i]), ',') END AS alts,
CASE WHEN len(alive) = 0 THEN '' ELSE 'AF=' || array_to_string(list_transform(alive, lambda i: '0.' || (k + i) % 10), ',') || ';' END || 'DEP=' || array_to_string(list_transform(keep, lambda i: (k * 3 + i) % 50), ',') || ';DP=' || p_size AS info,
(list_position(keep, a) - 1) || '/' || (list_position(keep, b) - 1) || ':' || array_to_string(list_transform(keep, lambda i: (k + 3 * i) % 50), ',') || ':' || array_to_string(list_transform(pairs, lambda g: (k * 7 + g * g) % 99), ',') AS one,
(list_position(keep, b) - 1) || '|.:' || array_to_string(list_transform(keep, lambda i: (k + 4 * i) % 50), ',') || ':' || CASE WHEN k % 5 = 0 THEN '.' ELSE array_to_string(list_transform(pairs, lambda g: (k * 7 + g * g) % 99), ',') END AS two,
(list_position(keep, k % 2) - 1) || ':.:' || array_to_string(list_transform(keep, lambda i: (k + 5 * i) % 60), ',') AS three FROM places""")
def allele_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without the alternate alleles that no sample has, with their tags by allele and genotype cut."""
    header = vcf.parsed_header(spark.createDataFrame([(x,) for x in TAGS], "value string"))
    rows = tagged(spark, sf_dir)
    gts = variants.format_values(F.col("samples"), "GT")
    cut = alleles.without(rows, alleles.unused(gts, F.col("alts")), alleles.numbers_of(header))
    text = lambda i: F.concat_ws(":", *[F.element_at(F.element_at("samples", i), F.lit(t)) for t in ("GT", "AD", "PL")])
    return cut.select("site_idx", F.array_join("alts", ",").alias("alts"), "info", text(1).alias("one"), text(2).alias("two"), text(3).alias("three"))


@query(f"""WITH {_RECORDS}, placed AS (SELECT site_idx // 4 AS pos, site_idx, ref, alts FROM records),
filed AS (SELECT f AS file, site_idx * 2 + d AS record, pos, ref, list_sort(alts) AS alts FROM placed, range(0, 3) x(f), range(0, 2) y(d) WHERE (site_idx + f) % 3 > 0 AND (d = 0 OR f = 1 AND site_idx % 5 = 0)),
nth AS (SELECT *, row_number() OVER (PARTITION BY file, pos, ref, alts ORDER BY record) AS copy FROM filed),
sets AS (SELECT *, string_agg(file || ':' || record, ' ') OVER (PARTITION BY pos, ref, alts, copy ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS members FROM nth)
SELECT pos, CAST(file AS INTEGER) AS file, record, members FROM sets""")
def record_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files' records, some of them twice in one file, paired by their exact alleles: each record once, with those of its set."""
    rows = records(spark, sf_dir).select(F.lit("c").alias("contig"), F.floor(F.col("site_idx") / 4).alias("pos"), "site_idx", "ref", "alts")
    files = []
    for f in range(3):
        own = rows.where((F.col("site_idx") + f) % 3 > 0).withColumn("record", F.col("site_idx") * 2)
        if f == 1:
            own = own.unionByName(own.where("site_idx % 5 = 0").withColumn("record", F.col("record") + 1))
        files.append(own.withColumn("alts", F.when(F.col("site_idx") % 2 == 0, F.reverse("alts")).otherwise(F.col("alts"))) if f == 2 else own)
    found = pairing.paired(files)
    names = found.groupBy("pos", "set").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "record"))), lambda x: F.concat_ws(":", x["file"], x["record"])), " ").alias("members"))
    return found.join(names, ["pos", "set"]).select("pos", "file", "record", "members")


_SPANS = f"""{MARKERS}, a AS (SELECT contig, site_idx, pos AS beg, pos + CASE WHEN site_idx % 97 = 0 THEN 600000 WHEN site_idx % 10 = 0 THEN 40000 ELSE site_idx % 50 * 30 END AS "end" FROM markers),
b AS (SELECT contig, site_idx, pos - 500 AS beg, pos - 500 + CASE WHEN site_idx % 101 = 0 THEN 500000 ELSE site_idx % 13 * 300 - 300 END AS "end" FROM markers WHERE site_idx % 3 = 0)"""


@query(f'WITH {_SPANS} SELECT a.contig, a.site_idx AS a, b.site_idx AS b FROM a JOIN b ON a.contig = b.contig AND a.beg <= b."end" AND b.beg <= a."end" WHERE b.beg <= b."end"')
def interval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of intervals that overlap, among short, long and chromosome-wide ones, some of them empty."""
    at = F.col("site_idx")
    rows = fixtures.markers(spark, sf_dir)
    wide = F.when(at % 97 == 0, 600_000).when(at % 10 == 0, 40_000).otherwise(at % 50 * 30)
    a = rows.select("contig", "site_idx", F.col("pos").alias("beg"), (F.col("pos") + wide).alias("end"))
    beg = F.col("pos") - 500
    b = rows.where(at % 3 == 0).select("contig", "site_idx", beg.alias("beg"), (beg + F.when(at % 101 == 0, 500_000).otherwise(at % 13 * 300 - 300)).alias("end"))
    return intervals.overlapping(a, b, 1024).select("contig", F.col("site_idx").alias("a"), F.col("site_idx_b").alias("b"))


_LAST = regions.LAST


@query(f"""WITH {MARKERS}, kinds AS (SELECT unnest(['bed', 'tab', 'reg']) AS kind)
SELECT kind, contig, CASE WHEN site_idx % 7 = 0 THEN 1 WHEN kind = 'bed' THEN pos + 1 ELSE pos END::BIGINT AS beg,
CASE WHEN site_idx % 7 = 0 THEN {_LAST} WHEN kind = 'bed' THEN pos + site_idx % 100 WHEN site_idx % 4 = 1 THEN pos WHEN kind = 'reg' AND site_idx % 4 = 2 THEN {_LAST} ELSE pos + site_idx % 100 END::BIGINT AS "end"
FROM markers, kinds WHERE site_idx % 11 > 0""")
def region_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region lists in three formats, with comments, blank lines, contigs alone and regions without an end."""
    at, pos, contig = F.col("site_idx"), F.col("pos"), F.col("contig")
    rows = fixtures.markers(spark, sf_dir)
    end = pos + at % 100
    text = lambda c: c.cast("string")
    lines = {
        "bed": F.concat_ws("\t", contig, text(pos), text(end), F.lit("name")),
        "tab": F.when(at % 4 == 1, F.concat_ws(" ", contig, text(pos))).otherwise(F.concat_ws("\t", contig, text(pos), text(end))),
        "reg": F.when(at % 4 == 1, F.concat(contig, F.lit(":"), F.format_number(pos, 0))).when(at % 4 == 2, F.concat(contig, F.lit(":"), text(pos), F.lit("-"))).otherwise(F.concat(contig, F.lit(":"), text(pos), F.lit("-"), text(end))),
    }
    out = []
    for kind, line in lines.items():
        value = F.when(at % 11 == 0, F.when(at % 2 == 0, F.concat(F.lit("# "), line)).otherwise("  ")).when(at % 7 == 0, contig).otherwise(F.concat(F.lit(" "), line))
        out.append(regions.parsed(rows.select(value.alias("value")), kind).select(F.lit(kind).alias("kind"), "contig", "beg", "end"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""WITH rows AS (SELECT p_partkey AS k, p_size, p_partkey % 20 + 1 AS s, (p_size % 40)::DOUBLE / 2 AS z, p_partkey % 15 + 1 AS a, p_size % 15 + 1 AS b, (p_partkey % 99 + 1)::DOUBLE / 100 AS x, (p_partkey % 61 - 30)::DOUBLE / 10 AS e FROM part)
SELECT k AS site_idx, {r('lgamma(s + z / 7)')} AS lgamma,
{r('CASE WHEN z = 0 THEN 1 ELSE exp(-z) * list_sum(list_transform(range(0, s), lambda i: exp(i * ln(z) - lgamma(i + 1)))) END')} AS gammaq,
{r('CASE WHEN z = 0 THEN 0 ELSE 1 - exp(-z) * list_sum(list_transform(range(0, s), lambda i: exp(i * ln(z) - lgamma(i + 1)))) END')} AS gammap,
{r('list_sum(list_transform(range(a, a + b), lambda j: exp(lgamma(a + b) - lgamma(j + 1) - lgamma(a + b - j) + j * ln(x) + (a + b - 1 - j) * ln(1 - x))))')} AS betai,
{r("1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 80), lambda i: CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END * e * exp(CASE WHEN e = 0 THEN 0 ELSE i * ln(e * e) END - lgamma(i + 1)) / (2 * i + 1)))")} AS erfc FROM rows""")
def special_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gamma, incomplete gamma and beta, and error functions, against sums that are exact for whole parameters."""
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = read(spark, sf_dir, "part").select(key.alias("site_idx"), (key % 20 + 1).alias("s"), ((size % 40) / 2.0).alias("z"), (key % 15 + 1).alias("a"), (size % 15 + 1).alias("b"), ((key % 99 + 1) / 100.0).alias("x"), ((key % 61 - 30) / 10.0).alias("e"))
    s, z, a, b, x, e = (F.col(c) for c in ("s", "z", "a", "b", "x", "e"))
    found = {"lgamma": special.lgamma(s + z / 7), "gammaq": special.gammaq(s, z), "gammap": special.gammap(s, z), "betai": special.betai(a, b, x), "erfc": special.erfc(e)}
    return rows.select("site_idx", *[rounded(v, 6).alias(name) for name, v in found.items()])


@query(f"""WITH {_RECORDS}, {MARKERS}, rows AS (SELECT contig, pos, p_size, contains(info, 'SVTYPE') AS sv FROM records JOIN markers USING (site_idx))
SELECT contig, pos, CAST(sum(p_size) OVER w AS BIGINT) AS depth_before, CAST(max(p_size) OVER v AS INTEGER) AS most_after, last_value(CASE WHEN sv THEN pos END IGNORE NULLS) OVER w AS sv_before, last_value(CASE WHEN sv THEN pos END IGNORE NULLS) OVER v AS sv_after FROM rows
WINDOW w AS (PARTITION BY contig ORDER BY pos ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY contig ORDER BY pos DESC ROWS UNBOUNDED PRECEDING)""")
def two_way_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth so far, the greatest depth still to come, and the nearest structural variants on both sides of each record."""
    rows = records(spark, sf_dir).join(fixtures.markers(spark, sf_dir), "site_idx").select("contig", "pos", variants.tag(F.col("info"), "DP").cast("int").alias("depth"), variants.is_sv(F.col("info")).alias("sv"))
    at = F.when(F.col("sv"), F.col("pos"))
    found = sweep.swept(rows, ["contig"], "pos", [], {"depth_before": (F.col("depth").cast("long"), "sum"), "sv_before": (at, "last")}, {"most_after": (F.col("depth"), "max"), "sv_after": (at, "last")}, span=50_000)
    return found.drop("depth", "sv")


@query(f"""WITH {_RECORDS}, {MARKERS}, rows AS (SELECT contig, pos, pos + CASE WHEN site_idx % 50 = 0 THEN 20000 ELSE len(ref) END - 1 AS "end", site_idx FROM records JOIN markers USING (site_idx)),
wanted AS (SELECT * FROM (VALUES ('c0', 50000, 52000), ('c1', 700000, 730000), ('c0', 1, 999), ('none', 1, 5)) x(name, beg, fin))
SELECT name || ':' || beg AS region, contig, pos, "end", site_idx FROM rows JOIN wanted ON contig = name AND pos <= fin AND "end" >= beg""")
def clustered_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a table in the order of positions, read by its bounds."""
    rows = records(spark, sf_dir).join(fixtures.markers(spark, sf_dir), "site_idx")
    rows = rows.select("contig", "pos", (F.col("pos") + F.when(F.col("site_idx") % 50 == 0, 20_000).otherwise(F.length("ref")) - 1).alias("end"), "site_idx")
    path = f"{shared_folder(spark)}/clustered-{uuid.uuid4().hex}"
    clustered.write(rows, path, 8)
    wanted = [("c0", 50_000, 52_000), ("c1", 700_000, 730_000), ("c0", 1, 999), ("none", 1, 5)]
    found = [clustered.region(spark, path, *w).select(F.lit(f"{w[0]}:{w[1]}").alias("region"), "contig", "pos", "end", "site_idx") for w in wanted]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


#: Files of unlike headers and sample orders: (samples, whether DP is described).
_FILES = [["s0", "s1", "s2"], ["s2", "s0"], ["s3", "s1"]]


@query(f"""WITH {_RECORDS}, {MARKERS}, rows AS (SELECT *, site_idx % 3 AS f FROM records JOIN markers USING (site_idx))
SELECT contig, pos, 'f' || f AS file, CASE f WHEN 0 THEN gts[1] WHEN 1 THEN gts[2] ELSE '-' END || ' ' || CASE f WHEN 1 THEN '-' ELSE gts[2] END || ' ' ||
CASE f WHEN 0 THEN '0/0' WHEN 1 THEN gts[1] ELSE '-' END || ' ' || CASE f WHEN 2 THEN gts[1] ELSE '-' END AS gts, info FROM rows""")
def files_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three files with unlike samples and tags, written as text, read as one table."""
    rows = records(spark, sf_dir).join(fixtures.markers(spark, sf_dir), "site_idx")
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    for i, names in enumerate(_FILES):
        gts = [F.element_at("gts", 1), F.element_at("gts", 2), F.lit("0/0")][: len(names)]
        samples = F.array(*[F.create_map(F.lit("GT"), g) for g in gts])
        own = rows.where(F.col("site_idx") % 3 == i).select("contig", "pos", F.lit(None).cast("string").alias("id"), "ref", "alts", F.lit(None).cast("double").alias("qual"), F.lit(None).cast("string").alias("filter"), "info", samples.alias("samples"))
        head = ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', *[f'##INFO=<ID=X{i},Number=1,Type=Integer,Description="of file {i}">']]
        vcf.written(vcf.record_lines(own).coalesce(1), ["c0"], names, f"{path}/f{i}", head)
    merged, _, _ = vcf.read_all(spark, f"{path}/f*")
    gts = F.array_join(F.transform("samples", lambda s: F.coalesce(F.try_element_at(s, F.lit("GT")), F.lit("-"))), " ")
    return settled(merged.select("contig", "pos", F.regexp_extract("path", r"/(f\d)/[^/]*$", 1).alias("file"), gts.alias("gts"), "info"), "files-merged")


@query(f"""WITH {MARKERS}, bases AS (SELECT contig, string_agg(substr('ACGTTGCAAC', CAST(site_idx % 8 + 1 AS BIGINT), 3), '' ORDER BY site_idx) AS s FROM markers GROUP BY contig),
wanted AS (SELECT contig, site_idx, site_idx % 500 * 3 - 5 AS beg, site_idx % 500 * 3 + site_idx % 40 AS fin FROM markers)
SELECT contig, site_idx, CASE WHEN fin < 1 THEN NULL ELSE s[greatest(beg, 1):fin] END AS bases, coalesce(fin >= 1 AND s[greatest(beg, 1):greatest(beg, 1)] <> 'A', FALSE) AS departs FROM wanted JOIN bases USING (contig)""")
def fasta_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions across lines of a FASTA text, and whether their first base departs from one given."""
    rows = fixtures.markers(spark, sf_dir).select("contig", "site_idx")
    cut = lambda: F.substring(F.lit("ACGTTGCAAC"), (F.col("site_idx") % 8 + 1).cast("int"), F.lit(3))
    lines = rows.select((F.col("site_idx") * 2 + 1).alias("row"), cut().alias("value")).unionByName(rows.where(F.col("site_idx") % 500 == 0).select((F.col("site_idx") * 2).alias("row"), F.concat(F.lit(">"), F.col("contig"), F.lit(" of the fixture")).alias("value")))
    index = settled(fasta.indexed(lines, 300), "fasta")
    at = F.col("site_idx") % 500 * 3
    wanted = rows.select("contig", "site_idx", (at - 5).alias("beg"), (at + F.col("site_idx") % 40).alias("end"))
    found = fasta.regions(index, wanted)
    return found.select("contig", "site_idx", "bases", F.coalesce(F.left("bases", F.lit(1)) != "A", F.lit(False)).alias("departs"))
