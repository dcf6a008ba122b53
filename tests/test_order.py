"""Sweeps, clustered tables, FASTA regions and merged headers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociweave.operators import sweep
from lociweave.sources import clustered, fasta, vcf


@pytest.mark.parametrize("span", [1, 7, 50, 1 << 20])
@pytest.mark.parametrize("inclusive", [True, False])
def test_sweeps_equal_one_window(spark, span, inclusive):
    rng = random.Random(span)
    rows = [(rng.choice([None, "a", "b"]), rng.randrange(-40, 200), i, rng.choice([None, *range(9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, x long, i long, v long")
    hows = {"sum": F.sum("v"), "min": F.min("v"), "max": F.max("v"), "last": F.last("v", ignorenulls=True)}
    got = sweep.swept(df, ["g"], "x", ["i"], {f"f_{h}": (F.col("v"), h) for h in hows}, {f"b_{h}": (F.col("v"), h) for h in hows}, span, inclusive)
    ahead = W.partitionBy("g").orderBy("x", "i").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    back = W.partitionBy("g").orderBy(F.desc("x"), F.desc("i")).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    want = df.select("*", *[f.over(ahead).alias(f"f_{h}") for h, f in hows.items()], *[f.over(back).alias(f"b_{h}") for h, f in hows.items()])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def scanned(df) -> int:
    """Rows that Parquet's reader hands on, before they are filtered."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if "Scan" in p.nodeName():
            total += p.metrics().apply("numOutputRows").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return total


def test_a_region_reads_few_rows(spark, tmp_path):
    n = 200_000
    rows = spark.range(n).select(F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("contig"), (F.col("id") * 7 % n).alias("pos"), "id")
    rows = rows.withColumn("end", F.col("pos") + F.when(F.col("id") % 50_000 == 7, 30_000).otherwise(F.col("id") % 5))
    path = str(tmp_path / "t")
    clustered.write(rows, path, 6, group_bytes=1 << 18, page_rows=1000)
    whole = spark.read.parquet(f"{path}/rows")
    assert clustered.count(spark, path) == n and clustered.count(spark, path, "c1") == whole.where("contig = 'c1'").count() and clustered.count(spark, path, "no") == 0
    for contig, beg, end in (("c1", 50_000, 50_200), ("c0", 0, 10), ("c2", 199_990, 10**9), ("c1", 70_000, 70_000), ("no", 1, 5)):
        got = clustered.region(spark, path, contig, beg, end)
        want = whole.where((F.col("contig") == contig) & (F.col("pos") <= end) & (F.col("end") >= beg))
        assert sorted(map(tuple, got.select("contig", "pos", "end", "id").collect())) == sorted(map(tuple, want.select("contig", "pos", "end", "id").collect()))
    region = clustered.region(spark, path, "c1", 50_000, 50_200)
    assert len(clustered.files(spark, path, "c1", 50_000, 50_200)) <= 3 and region.count() > 50
    assert scanned(clustered.region(spark, path, "c1", 50_000, 50_200).select("pos")) < n // 4
    # Where no long row reaches over, a region's reader gets few pages.
    assert scanned(clustered.region(spark, path, "c0", 0, 10).select("pos")) <= 8000


@pytest.mark.parametrize("span", [1, 3, 1 << 16])
def test_fasta(spark, tmp_path, span):
    rng = random.Random(span)
    texts = {f"c{i}": "".join(rng.choice("ACGTN") for _ in range(n)) for i, n in enumerate((1, 240, 0, 61, 500))}
    lines = ["stray", ""]
    for name, bases in texts.items():
        lines += [f">{name} described", *(bases[i : i + w] for w in [rng.choice([1, 7, 60])] for i in range(0, len(bases), w)), ""]
    path = tmp_path / "x.fa"
    path.write_text("\n".join(lines))
    index = fasta.read(spark, str(path)) if span > 3 else fasta.indexed(spark.createDataFrame([(i, x) for i, x in enumerate(lines) if x], "row long, value string"), span)
    assert {r["contig"]: r["length"] for r in fasta.lengths(index).collect()} == {k: len(v) for k, v in texts.items() if v}
    wanted = [(c, b, b + w, i) for i, (c, b, w) in enumerate((c, b, w) for c in texts for b in (-5, 1, 2, 59, 60, 61, 239, 240, 241, 500) for w in (-1, 0, 1, 60, 1000))]
    got = fasta.regions(index, spark.createDataFrame(wanted, "contig string, beg long, end long, i long")).collect()
    assert len(got) == len(wanted)
    for r in got:
        assert (r["bases"] or "") == texts[r["contig"]][max(0, r["beg"] - 1) : max(0, r["end"])]


HEAD = "##fileformat=VCFv4.{v}\n##contig=<ID=c{length}>\n##INFO=<ID=DP,Number=1,Type={kind},Description=\"{text}\">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{names}\n"


def file(path, names, records, v=1, length="", kind="Integer", text="Depth"):
    path.write_text(HEAD.format(v=v, length=length, kind=kind, text=text, names="\t".join(names)) + "".join(f"c\t{pos}\t.\tA\tC\t.\tPASS\tDP=1\tGT\t" + "\t".join(gts) + "\n" for pos, gts in records))


def test_files_of_unlike_headers(spark, tmp_path):
    file(tmp_path / "a.vcf", ["x", "y"], [(1, ["0/0", "0/1"])], v=2, text="of a")
    file(tmp_path / "b.vcf", ["z", "x"], [(2, ["1/1", "./."]), (1, ["0|1", "1|1"])], v=3, length=",length=90", text="of b")
    rows, header, names = vcf.read_all(spark, str(tmp_path))
    assert [r["name"] for r in names.orderBy("sample").collect()] == ["x", "y", "z"]
    found = {(r["path"][-5], r["pos"]): [s and s["GT"] for s in r["samples"]] for r in rows.collect()}
    assert found == {("a", 1): ["0/0", "0/1", None], ("b", 2): ["./.", None, "1/1"], ("b", 1): ["1|1", None, "0|1"]}
    lines = {(r["kind"], r["id"]): r["fields"] for r in header.collect()}
    assert lines[("fileformat", "VCFv4.3")] == {} and lines[("contig", "c")] == {"length": "90"} and lines[("INFO", "DP")]["Description"] == "of a" and len(lines) == 3


@pytest.mark.parametrize(("change", "said"), [({"kind": "Float"}, "Type of INFO/DP: Float, Integer"), ({"length": ",length=7"}, "length of contig/c")])
def test_headers_that_clash(spark, tmp_path, change, said):
    file(tmp_path / "a.vcf", ["x"], [], length=",length=5")
    file(tmp_path / "b.vcf", ["x"], [], **{"length": ",length=5"} | change)
    with pytest.raises(Exception, match=said):
        vcf.read_all(spark, str(tmp_path))[1].collect()
    file(tmp_path / "b.vcf", ["x", "x"], [], length=",length=5")
    with pytest.raises(Exception, match="named twice"):
        vcf.read_all(spark, str(tmp_path))[2].collect()


def test_records_back_to_text(spark, tmp_path):
    body = "c\t5\trs1\tA\tC,G\t29.5\tPASS\tDP=3;DB\tGT:AD:PL\t0/1:1,2,3:0,1,2,3,4,5\t./.\t1|2:.:5,4,3,2,1,0\nc\t6\t.\tAT\tA\t30\t.\t.\tGT\t0/0\t0/1\t.\nc\t7\t.\tA\t.\t.\tq10;s50\tDP=1\tGT:DP\t0:3\t1\t0:.\n"
    (tmp_path / "x.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\n" + body)
    rows = vcf.read(spark, str(tmp_path / "x.vcf"))
    want = body.replace("0:.\n", "0\n").splitlines()
    assert [r["value"] for r in vcf.record_lines(rows, "pos").orderBy("pos").collect()] == want
    vcf.written(vcf.record_lines(rows), ["c"], ["a", "b", "c"], str(tmp_path / "out"))
    assert [r["value"] for r in vcf.record_lines(vcf.read(spark, str(tmp_path / "out")), "pos").orderBy("pos").collect()] == want
