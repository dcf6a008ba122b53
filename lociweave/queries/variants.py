"""Queries over variant records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave import fixtures
from lociweave.functions import filters, special
from lociweave.functions import variants as v
from lociweave.functions.numbers import rounded
from lociweave.operators import intervals
from lociweave.queries.registry import CELLS, MARKERS, query, r
from lociweave.session import read
from lociweave.sources import vcf

#: Records by rule, so that each kind occurs: (ref, alts, INFO suffix) by key modulo 8.
KINDS = [("A", ["C"], ""), ("A", ["AT"], ""), ("ACG", ["A"], ""), ("A", ["C", "G"], ""), ("G", ["."], ""), ("AC", ["GT"], ""), ("T", ["<DEL>"], ";SVTYPE=DEL"), ("A", ["C", "AT"], "")]


def _pick(key: Column, values: list) -> Column:
    return F.element_at(F.array(*values), (key % len(values) + 1).cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_idx, ref, alts, info, gts of every part."""
    key = F.col("p_partkey")
    info = F.concat(F.lit("DP="), F.col("p_size").cast("string"), F.lit(";AF=0."), (key % 10).cast("string"), _pick(key, [F.lit(k[2]) for k in KINDS]))
    gts = F.array(_pick(key, [F.lit(g) for g in ("0/0", "0/1", "1|1", "./.", "0|1")]), _pick(key, [F.lit(g) for g in ("1/1", "0/0", "./1")]))
    return read(spark, sf_dir, "part").select(key.alias("site_idx"), _pick(key, [F.lit(k[0]) for k in KINDS]).alias("ref"), _pick(key, [F.array(*map(F.lit, k[1])) for k in KINDS]).alias("alts"), info.alias("info"), gts.alias("gts"))


def _case(values: list[str]) -> str:
    return f"CASE p_partkey % {len(values)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(values)) + " END"


_RECORDS = f"""records AS (SELECT p_partkey AS site_idx, {_case([repr(k[0]) for k in KINDS])} AS ref, {_case([repr(k[1]) for k in KINDS])} AS alts,
  'DP=' || p_size || ';AF=0.' || p_partkey % 10 || {_case([repr(k[2]) for k in KINDS])} AS info, p_size,
  [{_case(["'0/0'", "'0/1'", "'1|1'", "'./.'", "'0|1'"])}, {_case(["'1/1'", "'0/0'", "'./1'"])}] AS gts FROM part)"""


@query(f"""WITH {_RECORDS} SELECT site_idx, contains(info, 'SVTYPE=') AS sv, NOT contains(info, 'SVTYPE=') AND (len(ref) > 1 OR len(list_filter(alts, lambda a: a = '.' OR len(a) <> len(ref))) > 0) AS indel,
len(alts) > 1 AS multi, len(alts) > 1 AND len(ref) = 1 AND len(list_filter(alts, lambda a: len(a) <> 1)) = 0 AS multi_snp, len(alts) = 1 AND len(ref) = 1 AND alts[1] IN ('A', 'C', 'G', 'T') AS snp,
len(list_filter(alts, lambda a: NOT starts_with(a, '<') AND len(a) > len(ref))) > 0 AS has_ins, len(list_filter(alts, lambda a: a <> '.' AND NOT starts_with(a, '<') AND len(a) < len(ref))) > 0 AS has_del,
len(list_filter(alts, lambda a: NOT starts_with(a, '<') AND len(a) > 1 AND len(a) = len(ref))) > 0 AS has_mnp, NOT contains(gts[1] || gts[2], '.') AS complete FROM records""")
def variant_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, alts, info = F.col("ref"), F.col("alts"), F.col("info")
    return records(spark, sf_dir).select(
        "site_idx", v.is_sv(info).alias("sv"), v.is_indel(ref, alts, info).alias("indel"), v.is_multiallelic(alts).alias("multi"), v.is_multiallelic_snp(ref, alts).alias("multi_snp"), v.is_snp(ref, alts).alias("snp"),
        v.has_kind(ref, alts, "INS").alias("has_ins"), v.has_kind(ref, alts, "DEL").alias("has_del"), v.has_kind(ref, alts, "MNP").alias("has_mnp"), v.none_missing(F.col("gts")).alias("complete"),
    )


@query(f"""WITH {_RECORDS} SELECT site_idx, CAST(p_size AS INTEGER) AS depth, 'AF=0.' || site_idx % 10 || ';DP=' || (p_size + 1) || CASE WHEN contains(info, 'SVTYPE=') THEN ';SVTYPE=DEL' ELSE '' END AS raised,
CASE gts[1] WHEN '0/0' THEN 0 WHEN '0/1' THEN 1 WHEN '0|1' THEN 1 WHEN '1|1' THEN 2 ELSE -9 END AS dosage FROM records""")
def variant_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INFO tags read and set, and the first genotype's dosage."""
    rows = records(spark, sf_dir).withColumn("depth", v.tag(F.col("info"), "DP").cast("int"))
    return rows.select("site_idx", "depth", v.with_tag(F.col("info"), "DP", (F.col("depth") + 1).cast("string")).alias("raised"), F.coalesce(v.dosage(F.element_at("gts", 1)), F.lit(-9)).alias("dosage"))


@query(f"WITH {_RECORDS} SELECT site_idx, ref, alts[1] AS alt FROM records WHERE p_size >= 20 AND site_idx % 10 < 5 AND len(alts) = 1")
def record_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by an expression over their tags."""
    info = F.col("info")
    typed = records(spark, sf_dir).withColumns({"DP": v.tag(info, "DP").cast("int"), "AF": v.tag(info, "AF").cast("double"), "N_ALT": F.size("alts")})
    return filters.filtered(typed, "DP >= 20 && AF < 0.5 && N_ALT == 1").select("site_idx", "ref", F.element_at("alts", 1).alias("alt"))


@query(f"WITH {_RECORDS} SELECT site_idx, sqrt(p_size::DOUBLE) > 4 AND NOT contains(info, 'SVTYPE') OR ref LIKE 'AC%' AS kept FROM records")
def filter_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions, regular expressions and missing tags in an expression."""
    info = F.col("info")
    typed = records(spark, sf_dir).withColumns({"DP": v.tag(info, "DP").cast("int"), "SVTYPE": F.coalesce(v.tag(info, "SVTYPE"), F.lit("")), "REF": F.col("ref")})
    return typed.select("site_idx", filters.condition('sqrt(DP) > 4 && !(SVTYPE != "") || REF =~ "^AC"', typed).alias("kept"))


#: Expressions, and in SQL what each is: whether it is true, or its value.
EXPRESSIONS = {
    "precedence": ("DP + 2 * 3 % 4 - 1 >= 20 || DP == 3 && N_ALT == 2", "(p_size + 1 >= 20 OR p_size = 3) AND len(alts) = 2"),
    "bits": ("DP & 6 ^ 3 | 8 == 15", "xor(p_size & 6, 3) | 8 = 15"),
    "undefined": ("SVTYPE == \"DEL\" && DP > 10 || N_ALT > 1", "CASE WHEN len(alts) > 1 THEN TRUE ELSE contains(info, 'SVTYPE') AND p_size > 10 END"),
    "negated": ("!(SVTYPE == \"DEL\" && DP < 0)", "TRUE"),
    "exists": ("exists(SVTYPE) || !exists(QUAL) && DP % 2 == 1", "(contains(info, 'SVTYPE') OR p_size % 3 = 0) AND p_size % 2 = 1"),
    "default": ("default(QUAL, -1) < 0 || QUAL / 0 > 1e9", "p_size % 3 = 0 OR p_size <> 10"),
    "lists": ("max(AD) >= 30 || min(AD) > avg(AD) - 1", "greatest(p_size, site_idx % 7) >= 30 OR least(p_size, site_idx % 7) > (p_size + site_idx % 7) / 2.0::DOUBLE - 1"),
    "patterns": ("INFO =~ \"DP=\\d[05];\" || INFO !~ \"AF=0\\.[0-7]\"", "regexp_matches(info, 'DP=\\d[05];') OR NOT regexp_matches(info, 'AF=0\\.[0-7]')"),
    "texts": ("REF < \"B\" && length(REF) != 1 || REF == 1", "ref < 'B' AND len(ref) <> 1"),
    "functions": ("pow(sqrt(DP), 2) - exp(log(DP)) < 0.5 && log(QUAL) > 2", "p_size % 3 <> 0 AND p_size <> 10 AND ln(greatest(1, p_size - 10)::DOUBLE) > 2 AND p_size > 10"),
}


@query(f"WITH {_RECORDS} SELECT site_idx, " + ", ".join(f"{sql} AS {name}" for name, (_, sql) in EXPRESSIONS.items()) + " FROM records")
def filter_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten filter expressions over typed tags, with lists and undefined values."""
    info = F.col("info")
    depth = v.tag(info, "DP").cast("int")
    typed = records(spark, sf_dir).withColumns({
        "DP": depth, "SVTYPE": v.tag(info, "SVTYPE"), "REF": F.col("ref"), "INFO": info, "N_ALT": F.size("alts"),
        "QUAL": F.when(depth % 3 != 0, depth - 10), "AD": F.array(depth.cast("long"), F.col("site_idx") % 7),
    })
    return typed.select("site_idx", *[filters.condition(text, typed).alias(name) for name, (text, _) in EXPRESSIONS.items()])


#: Alternate alleles that stand for themselves, one of which every fourth record has.
SPECIAL = ["*", ".", "<DEL>", "<X>", "<NON_REF>", "<*>", "X", "[1:5[A", "A]1:5]"]
_REFS, _ALTS = "ACGTACGGTAcc", "ACGGTACCGTAC"


@query(f"""WITH alleles AS (SELECT p_partkey AS site_idx, substr('{_REFS}', CAST(p_partkey % 7 + 1 AS BIGINT), CAST(p_size % 4 + 1 AS BIGINT)) AS ref,
CASE WHEN p_partkey % 4 = 0 THEN {SPECIAL}[CAST(p_partkey // 4 % {len(SPECIAL)} + 1 AS BIGINT)] ELSE substr('{_ALTS}', CAST(p_partkey % 7 + p_partkey % 2 + 1 AS BIGINT), CAST(p_size // 4 % 5 + 1 AS BIGINT)) END AS alt FROM part),
begun AS (SELECT *, upper(ref) AS u, upper(alt) AS w, list_max(list_filter(range(0, least(len(ref), len(alt)) + 1), lambda k: upper(ref)[1:k] = upper(alt)[1:k])) AS p FROM alleles),
rests AS (SELECT *, u[p + 1:] AS r, w[p + 1:] AS a FROM begun), ended AS (SELECT *, list_max(list_filter(range(0, least(len(r), len(a))), lambda k: right(r, k) = right(a, k))) AS s FROM rests),
cut AS (SELECT *, len(r) - s AS m, len(a) - s AS n, right(r, s + 1) = right(a, s + 1) AS alike FROM ended)
SELECT site_idx, ref, alt, CASE WHEN alt = '*' THEN 'OVERLAP' WHEN alt IN ('.', '<*>', '<X>', '<NON_REF>') THEN 'REF' WHEN alt = 'X' AND len(ref) = 1 THEN 'REF' WHEN alt[1] = '<' THEN 'OTHER' WHEN alt[1] IN ('[', ']') THEN 'BND'
WHEN r = '' AND a = '' THEN 'REF' WHEN r = '' THEN CASE WHEN a[1] IN ('[', ']') THEN 'BND' ELSE 'INS' END WHEN a = '' THEN 'DEL' WHEN m = 1 AND n = 1 THEN 'SNP'
WHEN n = 1 THEN CASE WHEN alike THEN 'DEL' ELSE 'OTHER' END WHEN m = 1 THEN CASE WHEN alike THEN 'INS' ELSE 'OTHER' END WHEN m = n THEN 'MNP' ELSE 'OTHER' END AS kind FROM cut""")
def allele_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What alternate alleles are, beside references that share bases with them, in either case."""
    key, size = F.col("p_partkey"), F.col("p_size")
    ref = F.substring(F.lit(_REFS), (key % 7 + 1).cast("int"), size % 4 + 1)
    special = F.element_at(F.array(*map(F.lit, SPECIAL)), (F.floor(key / 4) % len(SPECIAL) + 1).cast("int"))
    alt = F.when(key % 4 == 0, special).otherwise(F.substring(F.lit(_ALTS), (key % 7 + key % 2 + 1).cast("int"), F.floor(size / 4).cast("int") % 5 + 1))
    rows = read(spark, sf_dir, "part").select(key.alias("site_idx"), ref.alias("ref"), alt.alias("alt"))
    return rows.withColumn("kind", v.allele_kind(F.col("ref"), F.col("alt")))


@query(f"""WITH {_RECORDS}, firsts AS (SELECT site_idx, alts, gts, gts[1] AS g, list_transform(string_split_regex(gts[1], '[/|]'), lambda x: TRY_CAST(x AS INTEGER)) AS a FROM records)
SELECT site_idx, coalesce(a[1], -9) AS first, coalesce(a[2], -9) AS second, len(a)::INTEGER AS ploidy, NOT contains(g, '/') AS phased,
coalesce(CAST(a[2] AS VARCHAR), '.') || '|' || coalesce(CAST(a[1] AS VARCHAR), '.') AS swapped FROM firsts""")
def genotype_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allele numbers, ploidy and phase of the first sample, and its genotype written anew, phased and with its alleles exchanged."""
    g = F.element_at("gts", 1)
    a = v.alleles(g)
    at = lambda i: F.element_at(a, i)
    return records(spark, sf_dir).select("site_idx", F.coalesce(at(1), F.lit(-9)).alias("first"), F.coalesce(at(2), F.lit(-9)).alias("second"), v.ploidy(g).alias("ploidy"), v.phased(g).alias("phased"), v.genotype(F.reverse(a), F.lit(True)).alias("swapped"))


@query(f"""WITH {_RECORDS} SELECT site_idx, gts[1] || ':' || p_size AS one, gts[2] || ':' || (p_size + 1) AS two, gts[1] AS gt, CAST(p_size AS DOUBLE) AS depth, gts[2] AS bare FROM records""")
def format_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FORMAT tags of samples set, read and removed."""
    rows = records(spark, sf_dir)
    samples = F.transform("gts", lambda g: F.create_map(F.lit("GT"), g))
    depths = F.array(v.tag(F.col("info"), "DP"), (v.tag(F.col("info"), "DP").cast("int") + 1).cast("string"))
    rows = rows.withColumn("samples", v.with_format(samples, "DP", depths))
    text = lambda i: F.concat_ws(":", F.element_at(F.element_at("samples", i), "GT"), F.element_at(F.element_at("samples", i), "DP"))
    depth = F.element_at(v.numbers(F.element_at(v.format_values(F.col("samples"), "DP"), 1)), 1)
    bare = F.array_join(F.map_values(F.element_at(v.without_format(F.col("samples"), "DP"), 2)), ":")
    return rows.select("site_idx", text(1).alias("one"), text(2).alias("two"), F.element_at(v.format_values(F.col("samples"), "GT"), 1).alias("gt"), depth.alias("depth"), bare.alias("bare"))


@query(f"""WITH {_RECORDS}, {MARKERS} SELECT site_idx, contig, pos - 1 AS start, pos + len(ref) - 1 AS "end", CASE WHEN len(alts) = 1 THEN alts[1] ELSE ref END AS new_ref, CASE WHEN len(alts) = 1 THEN ref ELSE array_to_string(alts, ',') END AS new_alts,
'DP=' || p_size || CASE WHEN contains(info, 'SVTYPE') THEN ';SVTYPE=DEL' ELSE '' END AS info, 'AF=0.' || site_idx % 10 || ';DB;DP=' || p_size || CASE WHEN contains(info, 'SVTYPE') THEN ';SVTYPE=DEL' ELSE '' END AS flagged FROM records JOIN markers USING (site_idx)""")
def record_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's extent, its two alleles exchanged, an INFO tag removed and a flag set."""
    rows = records(spark, sf_dir).join(fixtures.markers(spark, sf_dir), "site_idx")
    ref, alts = v.swapped(F.col("ref"), F.col("alts"))
    return rows.select(
        "site_idx", "contig", v.start(F.col("pos")).alias("start"), v.end(F.col("pos"), F.col("ref"), F.col("info")).alias("end"), ref.alias("new_ref"), F.array_join(alts, ",").alias("new_alts"),
        v.without_tag(F.col("info"), "AF").alias("info"), v.with_tag(F.col("info"), "DB", F.lit(None).cast("string")).alias("flagged"),
    )


@query(f"""WITH {_RECORDS}, counted AS (SELECT *, string_split_regex(array_to_string(gts, '/'), '[/|]') AS every FROM records),
counts AS (SELECT *, list_transform(range(0, len(alts) + 1), lambda i: len(list_filter(every, lambda x: x = CAST(i AS VARCHAR)))) AS n FROM counted)
SELECT site_idx, CAST(n[1] AS INTEGER) AS ref_count, CAST(list_sum(n) - n[1] AS INTEGER) AS alt_count, array_to_string(list_filter(alts, lambda a, i: n[i + 1] > 0), ',') AS used, gts[1] AS first FROM counts""")
def allele_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allele counts over the samples, and the alternate alleles that are left without those that no sample has."""
    rows = records(spark, sf_dir)
    n = v.allele_counts(F.col("gts"), F.col("alts"))
    alts, gts = v.trimmed(F.col("gts"), F.col("alts"))
    return rows.select("site_idx", F.element_at(n, 1).alias("ref_count"), F.aggregate(F.slice(n, 2, F.size("alts")), F.lit(0), lambda a, x: a + x).alias("alt_count"), F.array_join(alts, ",").alias("used"), F.element_at(gts, 1).alias("first"))


_TWO = f"""{_RECORDS}, {MARKERS}, a AS (SELECT contig, pos, ref, alts FROM records JOIN markers USING (site_idx) WHERE p_size % 3 > 0),
b AS (SELECT contig, pos, ref, CASE WHEN site_idx % 5 = 0 THEN ['T'] ELSE alts END AS alts FROM records JOIN markers USING (site_idx) WHERE p_size % 4 > 0)"""


@query(f"""WITH {_TWO}, exact AS (SELECT coalesce(a.pos, b.pos) AS pos, coalesce(a.contig, b.contig) AS contig, a.ref IS NOT NULL AS in_a, b.ref IS NOT NULL AS in_b FROM a FULL OUTER JOIN b ON a.contig = b.contig AND a.pos = b.pos AND a.ref = b.ref AND list_sort(a.alts) = list_sort(b.alts)),
shared AS (SELECT coalesce(a.pos, b.pos) AS pos, coalesce(a.contig, b.contig) AS contig, a.ref IS NOT NULL AS in_a, b.ref IS NOT NULL AS in_b FROM a FULL OUTER JOIN b ON a.contig = b.contig AND a.pos = b.pos AND a.ref = b.ref AND list_has_any(a.alts, b.alts))
SELECT 'exact' AS rule, contig, pos, in_a, in_b FROM exact UNION ALL SELECT 'some', contig, pos, in_a, in_b FROM shared""")
def allele_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files' records paired by their alleles under two rules."""
    rows = records(spark, sf_dir).join(fixtures.markers(spark, sf_dir), "site_idx").withColumn("size", v.tag(F.col("info"), "DP").cast("int"))
    a = rows.where("size % 3 > 0").select("contig", "pos", "ref", "alts")
    b = rows.where("size % 4 > 0").select("contig", "pos", "ref", F.when(F.col("site_idx") % 5 == 0, F.array(F.lit("T"))).otherwise(F.col("alts")).alias("alts"))
    one = lambda rule: intervals.paired(a, b, rule).select(F.lit(rule).alias("rule"), "contig", "pos", F.col("ref").isNotNull().alias("in_a"), F.col("ref_b").isNotNull().alias("in_b"))
    return one("exact").union(one("some"))


@query(f"""WITH {CELLS}, sides AS (SELECT site_idx, sum(CASE WHEN s_nationkey < 12 THEN a ELSE 0 END)::BIGINT AS a, sum(CASE WHEN s_nationkey < 12 THEN n - a ELSE 0 END)::BIGINT AS b, sum(CASE WHEN s_nationkey < 12 THEN 0 ELSE a END)::BIGINT AS c, sum(CASE WHEN s_nationkey < 12 THEN 0 ELSE n - a END)::BIGINT AS d
  FROM cells JOIN supplier ON s_suppkey = sample_idx GROUP BY site_idx),
tables AS (SELECT site_idx, a, x, -(lgamma(x + 1) + lgamma(a + b - x + 1) + lgamma(a + c - x + 1) + lgamma(d - a + x + 1)) AS w FROM sides, LATERAL (SELECT unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x)),
scaled AS (SELECT *, exp(w - max(w) OVER (PARTITION BY site_idx)) AS p FROM tables), owns AS (SELECT site_idx, max(p) AS own FROM scaled WHERE x = a GROUP BY site_idx)
SELECT site_idx, {r('least(1::DOUBLE, sum(CASE WHEN p <= own * (1 + 1e-9::DOUBLE) THEN p ELSE 0 END) / sum(p))', 5)} AS p FROM scaled JOIN owns USING (site_idx) GROUP BY site_idx""")
def fisher_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two groups of samples differ in alternate reads, at each site."""
    nations = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample_idx"), (F.col("s_nationkey") < 12).alias("first"))
    cells = fixtures.cells(spark, sf_dir).join(nations, "sample_idx")
    total = lambda own, x: F.sum(F.when(F.col("first") if own else ~F.col("first"), x).otherwise(0))
    sums = cells.groupBy("site_idx").agg(*[total(own, x).alias(c) for c, own, x in (("a", True, F.col("a")), ("b", True, F.col("n") - F.col("a")), ("c", False, F.col("a")), ("d", False, F.col("n") - F.col("a")))])
    return sums.select("site_idx", rounded(special.fisher(*[F.col(c) for c in "abcd"])["two_sided"], 5).alias("p"))


@query(f"""WITH {MARKERS}, lengths AS (SELECT contig, max(pos) AS length FROM markers GROUP BY contig)
SELECT '##contig=<ID=' || contig || ',length=' || length || '>' AS line, 'contig' AS kind, contig AS id, length::BIGINT AS length, NULL::VARCHAR AS type, NULL::VARCHAR AS description FROM lengths WHERE contig <> 'c0'
UNION ALL SELECT '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, all reads">', 'INFO', 'DP', NULL, 'Integer', 'Depth, all reads' UNION ALL SELECT '##fileformat=VCFv4.2', 'fileformat', 'VCFv4.2', NULL, NULL, NULL""")
def vcf_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header from the markers' contigs, with lines added and removed, as text and as parsed from it."""
    contigs = fixtures.markers(spark, sf_dir).groupBy("contig").agg(F.max("pos").alias("n"))
    rows = contigs.select(F.lit("contig").alias("kind"), F.col("contig").alias("id"), F.create_map(F.lit("length"), F.col("n").cast("string")).alias("fields"))
    rows = vcf.with_line(vcf.with_line(rows, "INFO", "DP", {"Number": "1", "Type": "Integer", "Description": "Depth, all reads"}), "fileformat", "VCFv4.2")
    lines = vcf.header_lines(vcf.without_line(rows, "contig", "c0"))
    field = lambda k: F.try_element_at("fields", F.lit(k))
    parsed = vcf.parsed_header(lines)
    again = vcf.header_lines(parsed.withColumn("_k", F.lit(0)))
    both = parsed.withColumn("line", F.concat(F.lit("##"), F.col("kind"), F.lit("="), F.when(F.size("fields") > 0, F.concat(F.lit("<ID="), F.col("id"))).otherwise(F.col("id"))))
    whole = again.withColumn("start", F.regexp_extract("value", "^(##[^=]+=(?:<ID=[^,>]*|.*))", 1))
    return both.join(whole, F.col("line") == F.col("start")).select(F.col("value").alias("line"), "kind", "id", field("length").cast("long").alias("length"), field("Type").alias("type"), field("Description").alias("description"))
