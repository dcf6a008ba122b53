from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from lociweave.functions import filters, variants
from lociweave.operators import calls, intervals, labels, likelihoods, sites
from lociweave.sources import beagle, plink, vcf


@pytest.fixture
def nine(spark):
    rows = [("A", i, i + 1) for i in range(5)] + [("B_x", 5 + i, i + 1) for i in range(4)]
    return spark.createDataFrame(rows, "contig string, site_idx long, pos long")


def test_chunks_of_two_contigs(nine):
    found = sites.chunked(nine, 3)
    assert [r["count"] for r in found.groupBy("chunk_id").count().orderBy("chunk_id").collect()] == [3, 2, 3, 1]
    assert found.count() == 9


@pytest.mark.parametrize("size", [1, 100, 87, 107])
def test_chunk_sizes(spark, size):
    rows = spark.range(1000).select(F.when(F.col("id") < 400, "4").otherwise("5").alias("contig"), F.col("id").alias("site_idx"), (F.col("id") * 10).alias("pos"))
    counts = [r["count"] for r in sites.chunked(rows, size).groupBy("chunk_id").count().orderBy("chunk_id").collect()]
    assert counts == [min(size, n - i) for n in (400, 600) for i in range(0, n, size)]


@pytest.mark.parametrize(("n", "size", "want"), [(9, 4, [(0, 3), (4, 7), (8, 8)]), (10, 4, [(0, 3), (4, 7), (8, 9)]), (9, 3, [(0, 2), (3, 5), (6, 8)]), (1, 4, [(0, 0)])])
def test_grids(spark, n, size, want):
    rows = spark.range(n).select(F.lit("c").alias("contig"), F.col("id").alias("site_idx"), (F.col("id") + 1).alias("pos"))
    found = sites.grids(sites.chunked(rows, 100), size).orderBy("grid_id").collect()
    assert [(r["start"], r["end"]) for r in found] == want
    flags = [r["f"] for r in sites.chunked(rows, 100).select("chunk_pos", sites.grid_flags(size).alias("f")).orderBy("chunk_pos").collect()]
    assert [i for i, f in enumerate(flags) if f] == sorted({i for pair in want for i in pair})


def test_beagle_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([("c_1", 10, 0, 0.5, 0.25, 0.25), ("c_1", 10, 1, 1.0, 0.0, 0.0), ("c_1", 25, 1, 0.0, 0.125, 0.875)], "contig string, pos long, sample_idx long, gl0 double, gl1 double, gl2 double")
    path = str(tmp_path / "gl")
    beagle.written(cells, ["x", "y"], path)
    assert beagle.header(spark, path) == ["x", "y"]
    back = {(r["contig"], r["pos"], r["sample_idx"]): (r["gl0"], r["gl1"], r["gl2"]) for r in beagle.cells(beagle.lines(spark, path)).collect()}
    assert back[("c_1", 10, 0)] == (0.5, 0.25, 0.25) and back[("c_1", 25, 0)] == (0.333333,) * 3 and len(back) == 4


def test_beagle_header_needs_triples(spark, tmp_path):
    with gzip.open(tmp_path / "bad.gz", "wt") as f:
        f.write("marker\ta\tb\tx\tx\n")
    with pytest.raises(ValueError, match="three columns"):
        beagle.header(spark, str(tmp_path / "bad.gz"))


def test_plink(spark, tmp_path):
    (tmp_path / "x.fam").write_text("f a 0 0 0 0\nf b 0 0 0 0\nf c 0 0 0 0\nf d 0 0 0 0\nf e 0 0 0 0\n")
    (tmp_path / "x.bim").write_text("1\trs1\t0\t100\tA\tG\n1\trs2\t0\t200\tC\tT\n")
    (tmp_path / "x.bed").write_bytes(plink.MAGIC + bytes([0x1B, 0x00, 0xE4, 0x03]))
    assert [r["name"] for r in plink.samples(spark, str(tmp_path / "x.fam")).orderBy("at").collect()] == list("abcde")
    assert [(r["contig"], r["pos"], r["a1"]) for r in plink.markers(spark, str(tmp_path / "x.bim")).orderBy("at").collect()] == [("1", 100, "A"), ("1", 200, "C")]
    blocks = plink.bed(spark, str(tmp_path / "x.bed"), 5)
    codes = plink.one_hot(plink.unpacked(blocks.withColumnRenamed("site", "site_idx"))).where("sample_idx < 5").orderBy("site_idx", "sample_idx").collect()
    assert [r["code"] for r in codes] == [3, 2, 1, 0, 0, 0, 1, 2, 3, 3]
    assert [(r["gl0"], r["gl1"], r["gl2"]) for r in codes[:4]] == [(0, 0, 1), (0, 1, 0), (0, 0, 0), (1, 0, 0)]
    (tmp_path / "y.bed").write_bytes(b"abc\x00")
    with pytest.raises(Exception, match="not a PLINK"):
        plink.bed(spark, str(tmp_path / "y.bed"), 4).collect()


def test_vcf_round_trip(spark, tmp_path):
    called = calls.called(spark.createDataFrame([(0, 0, 0.9, 0.1, 0.0), (0, 1, 0.0, 0.2, 0.8), (1, 1, 0.5, 0.5, 0.0)], "site_idx long, sample_idx long, gp0 double, gp1 double, gp2 double"))
    markers = spark.createDataFrame([(0, "c1", 7, "A", "C"), (1, "c1", 9, "G", "T")], "site_idx long, contig string, pos long, ref string, alt string")
    path = str(tmp_path / "v")
    vcf.written(vcf.lines(called, calls.site_scores(called, 2), markers, 2), ["c1"], ["s0", "s1"], path)
    rows = vcf.read(spark, path).orderBy("pos").collect()
    assert [(r["contig"], r["pos"], r["ref"], r["alts"]) for r in rows] == [("c1", 7, "A", ["C"]), ("c1", 9, "G", ["T"])]
    assert [s["GT"] for s in rows[0]["samples"]] == ["0/0", "1/1"] and [s["GT"] for s in rows[1]["samples"]] == ["./.", "1/0"]
    assert rows[0]["samples"][1]["GP"] == "0.000,0.200,0.800" and float(rows[0]["samples"][1]["DS"]) == 1.8


def test_phred(spark):
    r = spark.createDataFrame([("0,10,20",)], "pl string").select(vcf.phred_likelihoods(F.col("pl")).alias("x")).first()["x"]
    assert abs(sum(r) - 1) < 1e-12 and abs(r[0] / r[1] - 10) < 1e-9


def test_site_scores(spark):
    same = calls.called(spark.createDataFrame([(0, i, 1.0, 0.0, 0.0) for i in range(4)], "site_idx long, sample_idx long, gp0 double, gp1 double, gp2 double"))
    r = calls.site_scores(same, 4).first()
    assert (r["eaf"], r["info"]) == (0.0, 1.0)


def test_allele_frequency_em_finds_the_truth(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for s, af in enumerate((0.1, 0.5, 0.8)):
        for i, g in enumerate(rng.binomial(2, af, 600)):
            gl = np.full(3, 0.02)
            gl[g] = 0.96
            rows.append((s, i, *map(float, gl)))
    cells = spark.createDataFrame(rows, "site_idx long, sample_idx long, gl0 double, gl1 double, gl2 double")
    found = {r["site_idx"]: r["af"] for r in likelihoods.allele_frequencies(cells, 50, 600, enough=1e-5).collect()}
    assert all(abs(found[s] - af) < 0.04 for s, af in enumerate((0.1, 0.5, 0.8)))


def test_samples_without_rows_count_in_site_scores(spark):
    """Cells of a sample without reads, written out, give what ``absent`` gives."""
    af = spark.createDataFrame([(0, 0.3), (1, 0.6)], "site_idx long, af double")
    some = spark.createDataFrame([(0, 0, 0.9, 0.1, 0.0), (0, 1, 0.0, 0.2, 0.8)], "site_idx long, sample_idx long, gp0 double, gp1 double, gp2 double")
    absent = calls.without_reads(af)
    rest = absent.crossJoin(spark.range(5).withColumnRenamed("id", "sample_idx")).join(some.select("site_idx", "sample_idx"), ["site_idx", "sample_idx"], "left_anti")
    whole = some.union(rest.select(*some.columns))
    got, want = (sorted(map(tuple, x.collect())) for x in (calls.site_scores(some, 5, absent), calls.site_scores(whole, 5)))
    assert got == want and [r[1] for r in got] == [5, 5]


def test_duplicate_positions_are_sites_of_their_own(spark, tmp_path):
    from lociweave import cli

    (tmp_path / "gl").write_text("marker a b x x x y y y\nc_5 A G 1 0 0 0.2 0.6 0.2\nc_5 A T 0 0 1 0.333333 0.333333 0.333333\nc_9 A T 0 1 0 0 0 1\n")
    found, held, names = cli.inputs(spark, str(tmp_path / "gl"), 2)
    assert [(r["pos"], r["alt"], r["chunk_id"], r["chunk_pos"]) for r in found.orderBy("site_idx").collect()] == [(5, "G", 0, 0), (5, "T", 0, 1), (9, "T", 1, 0)]
    tiles = held.orderBy("chunk_id").collect()
    assert names == ["x", "y"] and [r["samples"] for r in tiles] == [[0, 1], [0, 1]] and [len(r["cells"]) for r in tiles] == [3, 2]


@pytest.mark.parametrize("span", [1 << 20, 7])
def test_ranks_and_merges_over_spans(spark, span):
    rows = [("A" if i % 3 else "B", (i * 37) % 200, i) for i in range(150)]
    got = sites.ranked(spark.createDataFrame(rows, "g string, x long, i long"), "g", "x", ("i",), span).collect()
    for g in "AB":
        assert [(r["x"], r["i"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == sorted((x, i) for h, x, i in rows if h == g)
        assert sorted(r["rank"] for r in got if r["g"] == g) == list(range(sum(h == g for h, *_ in rows)))
    regions = [("c" + str(i % 2), (i * 53) % 900, (i * 53) % 900 + i % 9) for i in range(120)]
    want = []
    for contig in ("c0", "c1"):
        for _, beg, end in sorted(x for x in regions if x[0] == contig):
            if want and want[-1][0] == contig and beg <= want[-1][2] + 1:
                want[-1][2:] = [max(end, want[-1][2]), want[-1][3] + 1]
            else:
                want.append([contig, beg, end, 1])
    found = intervals.merged(spark.createDataFrame(regions, "contig string, beg long, end long"), span).collect()
    assert sorted((r["contig"], r["beg"], r["end"], r["n"]) for r in found) == sorted(map(tuple, want))


def test_numbered_lines(spark, tmp_path):
    from lociweave.sources import text

    for i in range(3):
        (tmp_path / f"part-{i}").write_text("".join(f"{i}.{j}\n\n" for j in range(50)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 64)
    try:
        got = [r["value"] for r in text.numbered(spark, str(tmp_path)).orderBy("row").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"{i}.{j}" for i in range(3) for j in range(50)]


def test_header_of_a_file(spark, tmp_path):
    vcf.written(spark.createDataFrame([("c1\t1",)], "value string"), ["c1"], ["s0", "s 1"], str(tmp_path / "v"))
    found = {(r["kind"], r["id"]): r["fields"] for r in vcf.header(spark, str(tmp_path / "v")).collect()}
    assert found[("FORMAT", "GP")] == {"Number": "3", "Type": "Float", "Description": "Genotype posteriors"} and found[("contig", "c1")] == {} and ("fileformat", "VCFv4.1") in found
    assert vcf.samples(spark, str(tmp_path / "v")) == ["s0", "s 1"]


def test_expressions(spark):
    rows = spark.createDataFrame([(1, "PASS", None), (25, "q10", "x"), (30, "PASS", "it's")], "DP int, FILTER string, ANN string")
    keep = lambda text: [r["DP"] for r in rows.where(filters.condition(text, rows)).orderBy("DP").collect()]
    assert keep('DP >= 20 && (FILTER == "PASS" || ANN == "x")') == [25, 30]
    assert keep('!(FILTER != "PASS")') == [1, 30] and keep("""ANN == "it's" """) == [30] and keep('ANN !~ "^x"') == [30] and keep('FILTER == "a && b"') == []


def test_haplike(spark, tmp_path):
    import numpy as np

    from lociweave.sources import haplike

    values = np.random.default_rng(1).random((2, 3, 4))
    (tmp_path / "x.bin").write_bytes(np.array([2, 2, 3], "<i4").tobytes() + values.astype("<f8").tobytes())
    got = haplike.read(spark, str(tmp_path / "x.bin")).orderBy("sample_idx", "site").collect()
    assert np.array([r["likely"] for r in got]).tolist() == values.reshape(6, 4).tolist()


def test_intervals(spark):
    regions = spark.createDataFrame([("c", 1, 40_000, "a"), ("c", 40_001, 50_000, "b"), ("c", 60_000, 60_000, "d"), ("e", 5, 6, "x")], "contig string, beg long, end long, name string")
    points = spark.createDataFrame([("c", p) for p in (1, 40_000, 40_001, 59_999, 60_000)] + [("e", 7)], "contig string, pos long")
    assert {(r["pos"], r["name"]) for r in intervals.overlaps(points, regions, 1000).collect()} == {(1, "a"), (40_000, "a"), (40_001, "b"), (60_000, "d")}
    assert {(r["contig"], r["beg"], r["end"], r["n"]) for r in intervals.merged(regions).collect()} == {("c", 1, 50_000, 2), ("c", 60_000, 60_000, 1), ("e", 5, 6, 1)}


def test_labels_align(spark):
    rows = [(0, [0.7, 0.2, 0.1]), (1, [0.1, 0.8, 0.1]), (2, [0.2, 0.2, 0.6])]
    a = spark.createDataFrame(rows, "sample_idx long, q array<double>")
    b = spark.createDataFrame([(i, [q[2], q[0], q[1]]) for i, q in rows], a.schema)
    x, y = labels.aligned([a, b])
    assert sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))
    assert labels.aligned([a]) == [a]


def test_variant_kinds(spark):
    rows = [("A", ["C"]), ("A", ["<*>"]), ("AC", ["*"]), ("G", ["G]17:198982]"]), ("AC", ["A", "ACC"]), ("AC", ["GT", "AT", "ac", "TCC", "GAC", "<NON_REF>", "<DEL>", "ACTT"]), ("TCC", ["TC", "GC", "GA"])]
    got = spark.createDataFrame(rows, "ref string, alts array<string>").select(F.transform("alts", lambda a: variants.allele_kind(F.col("ref"), a)).alias("k")).collect()
    assert [r["k"] for r in got] == [["SNP"], ["REF"], ["OVERLAP"], ["BND"], ["DEL", "INS"], ["MNP", "SNP", "REF", "OTHER", "INS", "REF", "OTHER", "INS"], ["DEL", "OTHER", "OTHER"]]


def test_labels_that_do_not_settle_are_an_error(spark):
    a = spark.createDataFrame([(0, [0.7, 0.3])], "sample_idx long, q array<double>")
    with pytest.raises(RuntimeError, match="settled"):
        labels.aligned([a, a], rounds=1)


def test_repeated_tags(spark):
    r = spark.createDataFrame([("DP=1;DB;DP=2;X=a=b;;DB",)], "info string").select(variants.tags(F.col("info")).alias("m"), variants.with_tag(F.col("info"), "DP", F.lit("7")).alias("t")).first()
    assert r["m"] == {"DP": "1", "DB": None, "X": "a=b"} and r["t"] == "DB;DP=7;X=a=b"


UNDEFINED, NAN = None, float("nan")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 + 2 * 3 - 4 / 2", 5.0), ("-7 % 3", -1.0), ("7.9 % 3.9", 1.0), ("5 % 0", UNDEFINED), ("1 / 0 > 1e300", 1.0), ("-1 / 0 < 0", 1.0), ("0 / 0", UNDEFINED), ("6 & 3 | 8 ^ 1", 11.0), ("~5", -6.0), ("!5", 0.0), ("!0", 1.0), ("!!0.5", 1.0),
        ("3 > 2 == 1", 1.0), ("1 == 0 == 0", 1.0), ("3 > 2 > 1", 1.0), ("1 > 2 > 1", 0.0), ("1 || 0 && 0", 0.0), ("0 && 0 || 1", 1.0), ("n && 0", UNDEFINED), ("!(n && 0)", 1.0), ("n || 1", 1.0), ("n || 0", UNDEFINED), ("!n", 1.0), ("!s", 0.0), ("n + 1", UNDEFINED), ("n == n", UNDEFINED),
        ("exists(n)", 0.0), ("exists(s)", 1.0), ("default(n, 4) + 1", 5.0), ('default(t, "x") == "x"', 1.0), ("exists(f)", 0.0), ("f || 1", 1.0), ("b && i == 3", 1.0),
        (r's == "a\"b"', 0.0), (r'"a\"b" =~ "^a.b$"', 1.0), (r'"x=7" =~ "x=\d"', 1.0), (r'"a\tb" == "a\\tb"', 0.0), (r'"a\tb" =~ "a\sb"', 1.0), ('t =~ "x"', UNDEFINED), ('s != 1', 1.0), ("s == 1", 0.0), ("s < 1", 0.0), ('s < "z"', 1.0), ('s == "" || ""', 1.0),
        ("min(l)", 1.0), ("max(l)", 4.0), ("avg(l)", 2.5), ("length(l)", 3.0), ("avg(e)", 0.0), ("min(e)", UNDEFINED), ("max(u)", UNDEFINED), ("length(s)", 3.0), ("log(0) < 0", 1.0), ("log(-1)", UNDEFINED), ("sqrt(-1)", UNDEFINED), ("sqrt(i + 1)", 2.0), ("pow(2, 10)", 1024.0), ("pow(n, 0)", UNDEFINED), ("exp(0)", 1.0),
        ("(1 + 2) * .5e1", 15.0), ("a.b", 9.0),
    ],
)
def test_filter_values(spark, text, want):
    schema = "n double, f double, i int, b boolean, s string, t string, l array<int>, e array<double>, u array<int>, `a.b` long"
    rows = spark.createDataFrame([(None, NAN, 3, True, "abc", None, [1, None, 4], [], None, 9)], schema)
    assert rows.select(filters.value(text, rows).alias("x")).first()["x"] == want
    assert rows.where(filters.condition(text, rows)).count() == bool(want)


@pytest.mark.parametrize("text", ["", "1 +", "(1", "1 2", "nope", "nope(1)", "min(1)", "length(1)", 's + 1', 's =~ 1', "l == 1", "pow(1)", '"open', "1 & s", "--1", "max(s)", "exists ()", "a.b = 1", "d > 1"])
def test_filter_errors(spark, text):
    rows = spark.createDataFrame([], "n double, s string, l array<int>, `a.b` long, d date")
    with pytest.raises(filters.FilterError):
        filters.condition(text, rows)
