from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lociweave import cli
from lociweave.sources import matrix, model, plink, vcf
from lociweave.streaming import pileup


def plink_files(folder, n=6, m=30):
    rng = np.random.default_rng(4)
    (folder / "x.fam").write_text("".join(f"f s{i} 0 0 0 0\n" for i in range(n)))
    (folder / "x.bim").write_text("".join(f"chr_{1 + i // 20}\trs{i}\t0\t{100 * (i + 1)}\tA\tG\n" for i in range(m)))
    codes = rng.choice([0, 2, 3, 1], (m, -(-n // 4) * 4), p=[0.4, 0.3, 0.2, 0.1])
    rows = [bytes(sum(int(c) << 2 * j for j, c in enumerate(r[k : k + 4])) for k in range(0, len(r), 4)) for r in codes]
    (folder / "x.bed").write_bytes(plink.MAGIC + b"".join(rows))
    return codes[:, :n]


def run(spark, *words):
    cli.run(spark, cli.parser().parse_args([str(w) for w in words]))


def test_files_through_all_jobs(spark, tmp_path):
    codes = plink_files(tmp_path)
    run(spark, "convert", "--input", tmp_path / "x", "--out", tmp_path / "gl")
    run(spark, "impute", "--input", tmp_path / "gl", "--out", tmp_path / "imp", "--clusters", 3, "--passes", 2, "--chunk", 8, "--text")
    text = lambda name: [list(map(float, r["value"].split())) for r in spark.read.text(str(tmp_path / "imp" / name)).collect()]
    assert len(text("recomb")) == len(text("pi")) == len(text("p")) == 30
    assert all(abs(r[0] + 2 * r[1] + r[2] - 1) < 1e-5 for r in text("recomb")) and all(abs(sum(x) - 1) < 1e-5 for x in text("pi"))
    (tmp_path / "p").write_text("\n".join(" ".join(map(str, x)) for x in text("p")))
    run(spark, "impute", "--input", tmp_path / "gl", "--out", tmp_path / "again", "--clusters", 3, "--passes", 0, "--chunk", 8, "--fixed", "p", "--pfile", tmp_path / "p", "--text")
    again = [list(map(float, r["value"].split())) for r in spark.read.text(str(tmp_path / "again/p")).collect()]
    assert again == text("p")
    rows = vcf.read(spark, str(tmp_path / "imp/vcf")).orderBy("contig", "pos").collect()
    assert len(rows) == 30 and rows[0]["contig"] == "chr_1" and len(rows[0]["samples"]) == 6
    run(spark, "impute", "--input", tmp_path / "gl", "--out", tmp_path / "few", "--clusters", 3, "--passes", 2, "--chunk", 8, "--least-info", "0.9")
    few = {(r["contig"], r["pos"]) for r in vcf.read(spark, str(tmp_path / "few/vcf")).collect()}
    low = {(r["contig"], r["pos"]) for r in rows if float(r["info"].split("=")[1].split(";")[0]) < 0.9}
    listed = {(x[0], int(x[1])) for x in (r["value"].split("\t") for r in spark.read.text(str(tmp_path / "few/vcf.left-out")).collect())}
    assert low == listed and few == {(r["contig"], r["pos"]) for r in rows} - low and low
    gt = {0: "0/0", 2: "1/0", 3: "1/1"}
    same = [(gt[c], s["GT"]) for r, own in zip(rows, codes) for c, s in zip(own, r["samples"]) if c != 1]
    assert sum(a == b for a, b in same) / len(same) > 0.95
    saved = model.loaded(spark, str(tmp_path / "imp/model"))
    about = model.described(saved)
    assert (about["clusters"], about["sites"], about["samples"], about["chunks"]) == (3, 30, 6, 5)
    assert len(rows[0]["samples"]) == 6 and all(s["GP"] for r in rows for s in r["samples"])
    gamma = model.cluster_posteriors(saved, 2).collect()
    assert gamma and all(abs(sum(r["gamma"]) - 1) < 1e-9 and r["chunk_id"] == 2 for r in gamma)
    run(spark, "admix", "--model", tmp_path / "imp/model", "--out", tmp_path / "adm", "--ancestries", 2, "--passes", 2, "--plain", "--write-f", "--constrain")
    q = [list(map(float, r["value"].split())) for r in spark.read.text(str(tmp_path / "adm/Q")).collect()]
    assert len(q) == 6 and all(abs(sum(x) - 1) < 1e-6 for x in q)
    (tmp_path / "p2").write_text("0.25 0.25\n" * 30)
    (tmp_path / "pops").write_text("east\nwest\n" * 3)
    run(spark, "joint", "--input", tmp_path / "gl", "--out", tmp_path / "joint", "--clusters", 2, "--ancestries", 2, "--passes", 2, "--chunk", 20, "--vcf")
    assert all(abs(sum(x) - 2) < 1e-4 for x in [list(map(float, r["value"].split())) for r in spark.read.text(str(tmp_path / "adm/F")).collect()])
    (tmp_path / "q0").write_text("".join(f"{0.1 * (i + 1)} {1 - 0.1 * (i + 1)}\n" for i in range(6)))
    run(spark, "joint", "--input", tmp_path / "gl", "--out", tmp_path / "kept", "--clusters", 2, "--ancestries", 2, "--passes", 1, "--chunk", 0, "--qfile", tmp_path / "q0", "--pfile", tmp_path / "p2", "--fixed", "q", "p", "er", "f", "--write-f")
    kept = [list(map(float, r["value"].split())) for r in spark.read.text(str(tmp_path / "kept/Q")).collect()]
    assert np.allclose(kept, [[0.1 * (i + 1), 1 - 0.1 * (i + 1)] for i in range(6)], atol=1e-6)
    assert np.allclose([list(map(float, r["value"].split())) for r in spark.read.text(str(tmp_path / "kept/P")).collect()], 0.25)
    run(spark, "align", "--q", tmp_path / "q0", tmp_path / "kept/Q", "--populations", tmp_path / "pops", "--out", tmp_path / "aligned")
    assert spark.read.parquet(str(tmp_path / "aligned/order")).count() == 6
    run(spark, "impute", "--input", tmp_path / "gl", "--out", tmp_path / "hap", "--clusters", 2, "--passes", 1, "--chunk", 20, "--grid", 3, "--write-hapsum", "--text")
    ae = [list(map(float, r["value"].split())) for r in spark.read.text(str(tmp_path / "hap/ae")).collect()]
    assert len(ae) == 11 and all(abs(sum(x) - 1) < 1e-5 for x in ae)
    run(spark, "impute", "--input", tmp_path / "gl", "--out", tmp_path / "rates", "--clusters", 2, "--passes", 0, "--chunk", 20, "--grid", 3, "--fixed", "er", "--rfile", tmp_path / "hap/recomb", "--text")
    same = [[r["value"] for r in spark.read.text(str(tmp_path / x / "recomb")).collect()] for x in ("hap", "rates")]
    assert np.allclose([list(map(float, x.split())) for x in same[0]], [list(map(float, x.split())) for x in same[1]], atol=1e-5)
    run(spark, "admix", "--model", tmp_path / "hap/model", "--out", tmp_path / "adm2", "--ancestries", 2, "--passes", 3, "--qfile", tmp_path / "q0", "--fixed", "q")
    assert np.allclose([list(map(float, r["value"].split())) for r in spark.read.text(str(tmp_path / "adm2/Q")).collect()], kept, atol=1e-6)
    states = model.joint_states(model.loaded(spark, str(tmp_path / "joint/model"), True), 0).collect()
    assert states and all(abs(sum(r["gamma"]) - 1) < 1e-9 and len(r["jumps"]) == 4 and sum(r["jumps"]) < 1 + 1e-9 for r in states)
    both = model.loaded(spark, str(tmp_path / "joint/model"), True)
    found = model.joint_posteriors(both, 0).collect()
    assert found and all(abs(sum(r["ancestry"]) - 1) < 1e-6 for r in found)
    assert vcf.read(spark, str(tmp_path / "joint/vcf")).count() == 30


def test_matrix(spark, tmp_path):
    (tmp_path / "q").write_text("0.25 0.75\n1 oops\n")
    assert [(r["row"], r["values"]) for r in matrix.read(spark, str(tmp_path / "q")).orderBy("row").collect()] == [(0, [0.25, 0.75]), (1, [1.0, 0.0])]
    matrix.written(matrix.read(spark, str(tmp_path / "q")), ["row"], "values", str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["0.250000 0.750000", "1.000000 0.000000"]


def test_stream_counts_as_the_table_does(spark, tmp_path):
    reads = spark.range(400).select((F.col("id") % 7).alias("site_idx"), (F.col("id") % 3).alias("sample_idx"), (F.col("id") % 5 == 0).alias("alternate"))
    for i in range(3):
        reads.where(F.col("site_idx") % 3 == i).coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    last = {}

    def keep(df, number):
        last.update({(r["site_idx"], r["sample_idx"]): (r["n"], r["a"]) for r in df.collect()})

    query = pileup.started(stream, str(tmp_path / "state"), keep)
    query.processAllAvailable()
    query.stop()
    assert last == {(r["site_idx"], r["sample_idx"]): (r["n"], r["a"]) for r in pileup.counted(reads).collect()}
