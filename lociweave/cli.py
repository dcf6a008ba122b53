"""spark-submit lociweave/cli.py impute|admix|joint|convert|align ...: the jobs on files, each leaving tables and text in a folder."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociweave.jobs import admix, convert, fixed, impute, joint
from lociweave.jobs.tiles import settle, tiles
from lociweave.operators import calls, labels
from lociweave.operators.sites import chunked, ranked
from lociweave.session import fits, settled
from lociweave.sources import beagle, matrix, model, vcf

#: Sites in a chunk if a contig is to be one.
WHOLE = 1 << 31


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    subs = p.add_subparsers(dest="command", required=True)
    for name in ("impute", "joint"):
        s = subs.add_parser(name)
        s.add_argument("--input", required=True, help="genotype-likelihood text")
        s.add_argument("--out", required=True)
        s.add_argument("--clusters", type=int, default=10)
        s.add_argument("--passes", type=int, default=40)
        s.add_argument("--chunk", type=int, default=10_000, help="sites in a chunk; 0: a contig is a chunk")
        s.add_argument("--seed", type=int, default=999)
        s.add_argument("--pfile", help="start point: a row of cluster allele frequencies a site")
        if name == "impute":
            s.add_argument("--fixed", nargs="*", default=[], choices=["er", "p", "pi"])
            s.add_argument("--grid", type=int, default=1)
            s.add_argument("--least-info", type=float, default=0.0, help="leave out sites of a lower INFO, and list them")
            s.add_argument("--refill", type=int, default=2, choices=range(4))
            s.add_argument("--rfile", help="start point: a row of the three transition rates a grid")
            s.add_argument("--write-hapsum", action="store_true", help="keep how much clusters are used, which admix then takes as their prior")
            s.add_argument("--text", action="store_true", help="also write recomb, pi, p, hapfreq and ae as text")
        else:
            s.add_argument("--fixed", nargs="*", default=[], choices=["er", "p", "q", "f"])
            s.add_argument("--ancestries", type=int, default=3)
            s.add_argument("--accelerate", action="store_true")
            s.add_argument("--qfile", help="start point: a row of ancestry shares a sample")
            s.add_argument("--vcf", action="store_true")
            s.add_argument("--write-f", action="store_true")
    s = subs.add_parser("admix")
    s.add_argument("--model", required=True, help="folder that impute wrote")
    s.add_argument("--out", required=True)
    s.add_argument("--ancestries", type=int, default=2)
    s.add_argument("--passes", type=int, default=2000)
    s.add_argument("--seed", type=int, default=999)
    s.add_argument("--enough", type=float, default=1e-2)
    s.add_argument("--least-prior", type=float, default=0.0)
    s.add_argument("--plain", action="store_true", help="no acceleration")
    s.add_argument("--fixed", nargs="*", default=[], choices=["q", "f"])
    s.add_argument("--constrain", action="store_true", help="frequencies are at least those of the clusters")
    s.add_argument("--qfile", help="start point: a row of ancestry shares a sample")
    s.add_argument("--write-f", action="store_true")
    s = subs.add_parser("convert")
    s.add_argument("--input", required=True, help="prefix of .bed, .bim and .fam")
    s.add_argument("--out", required=True)
    s = subs.add_parser("align")
    s.add_argument("--q", nargs="+", required=True, help="ancestry shares of several runs, a row a sample")
    s.add_argument("--populations", required=True, help="a population a line, one for each sample")
    s.add_argument("--out", required=True)
    return p


def inputs(spark: SparkSession, path: str, chunk: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Sites, tiles and sample names of a genotype-likelihood file. Sites count from 0 within and over contigs, by position, then
    line. All samples of the header have a place in every tile."""
    rows, names = settled(beagle.lines(spark, path), "lines", large_rows=True), beagle.header(spark, path)
    contigs = rows.groupBy("contig").agg(F.count(F.lit(1)).alias("n"))
    starts = contigs.select("contig", (F.sum("n").over(W.orderBy("contig")) - F.col("n")).alias("start"))
    placed = ranked(rows.select("line", "contig", "pos", "ref", "alt"), "contig", "pos", ("line",)).join(starts, "contig")
    markers = settled(placed.select("line", "contig", "pos", "ref", "alt", (F.col("start") + F.col("rank")).alias("site_idx")), "markers")
    cells = beagle.cells(rows).select("line", "sample_idx", "gl0", "gl1", "gl2").join(markers.select("line", "site_idx"), "line").drop("line")
    known = cells.where(~((F.abs(F.col("gl0") - F.col("gl1")) < 1e-6) & (F.abs(F.col("gl1") - F.col("gl2")) < 1e-6)))
    sites = settled(chunked(markers.drop("line"), chunk or WHOLE), "sites")
    longest = sites.groupBy("chunk_id").count().agg(F.max("count")).first()[0] or 1
    samples = spark.range(len(names)).withColumnRenamed("id", "sample_idx")
    return sites, settle(tiles(known, sites, longest, samples=samples)), names


def write_vcf(posteriors: DataFrame, sites: DataFrame, names: list[str], path: str, least_info: float = 0.0) -> None:
    """Sites whose INFO is less than ``least_info`` aren't written, but listed beside the file."""
    gp = settled(posteriors.join(sites.select("site_idx", "chunk_id", "chunk_pos"), ["chunk_id", "chunk_pos"]), "posteriors")
    contigs = [r["contig"] for r in sites.select("contig").distinct().orderBy("contig").collect()]
    scores = settled(calls.site_scores(gp, len(names)), "scores")
    if least_info > 0:
        low = scores.where(F.col("info") < least_info).join(sites.select("site_idx", "contig", "pos"), "site_idx")
        low.orderBy("contig", "pos", "site_idx").select(F.concat_ws("\t", "contig", "pos", "info").alias("value")).write.text(f"{path}.left-out")
    vcf.written(vcf.lines(calls.called(gp), scores.where(F.col("info") >= least_info), sites, len(names)), contigs, names, path)


def run_impute(spark: SparkSession, args: argparse.Namespace) -> None:
    sites, held, names = inputs(spark, args.input, args.chunk)
    options = impute.Options(clusters=args.clusters, passes=args.passes, grid=args.grid, seed=args.seed, refill=args.refill, fixed=frozenset(args.fixed))
    start = impute.start(sites, options)
    if args.pfile:
        start = fixed.with_given(start, sites, matrix.read(spark, args.pfile), "p")
    if args.rfile:
        start = fixed.with_given_rates(settled(start, "start"), matrix.read(spark, args.rfile))
    used, after, _ = impute.fit(held, sites, options, start)
    write_vcf(impute.posteriors(held, used, args.clusters), sites, names, f"{args.out}/vcf", args.least_info)
    hap = settled(impute.used_haplotypes(held, used, args.clusters), "hap") if args.write_hapsum or args.text else None
    model.saved(f"{args.out}/model", sites, after, held, args.clusters, grid=args.grid, hap=hap if args.write_hapsum else None)
    if args.text:
        grids = settled(fixed.by_grid(after, args.clusters), "grids")
        order = ["chunk_id", "grid_id"]
        matrix.written(grids, order, "rates", f"{args.out}/recomb")
        matrix.written(grids, order, "pi", f"{args.out}/pi")
        matrix.written(fixed.by_site(after, args.clusters), ["chunk_id", "chunk_pos"], "p", f"{args.out}/p")
        shares = fixed.shares_of(hap, args.clusters)
        matrix.written(shares, order, "hapfreq", f"{args.out}/hapfreq")
        prior = shares.withColumn("prior", fixed.products("hapfreq")) if args.write_hapsum else fixed.priors(after, args.clusters).withColumnRenamed("chunk_pos", "grid_id")
        matrix.written(prior, order, "prior", f"{args.out}/ae")


def run_joint(spark: SparkSession, args: argparse.Namespace) -> None:
    sites, held, names = inputs(spark, args.input, args.chunk)
    keep = {f"keep_{x}": True for x in args.fixed}
    options = joint.Options(clusters=args.clusters, ancestries=args.ancestries, passes=args.passes, seed=args.seed, accelerate=args.accelerate, **keep)
    parameters, state = joint.start(held, sites, options)
    if args.pfile:
        parameters = fixed.with_given(parameters, sites, matrix.read(spark, args.pfile), "p")
    if args.qfile:
        state.q = admix.given_shares(held, matrix.read(spark, args.qfile), options)
    parameters, state, _ = joint.fit(held, sites, options, (parameters, state))
    matrix.written(admix.shares(state, args.ancestries), ["sample_idx"], "q", f"{args.out}/Q", 10)
    matrix.written(fixed.by_site(parameters, args.clusters), ["chunk_id", "chunk_pos"], "p", f"{args.out}/P")
    if args.write_f:
        matrix.written(admix.by_grid(state, args.ancestries, args.clusters), ["chunk_id", "grid_id"], "f", f"{args.out}/F")
    model.saved(f"{args.out}/model", sites, parameters, held, args.clusters, args.ancestries, state=state)
    if args.vcf:
        write_vcf(joint.posteriors(held, parameters, state, options), sites, names, f"{args.out}/vcf")


def run_admix(spark: SparkSession, args: argparse.Namespace) -> None:
    saved = model.loaded(spark, args.model)
    clusters = saved["meta"].first()["clusters"]
    keep = {f"keep_{x}": True for x in args.fixed}
    options = admix.Options(clusters=clusters, ancestries=args.ancestries, passes=args.passes, seed=args.seed, enough=args.enough, accelerate=not args.plain, least_prior=args.least_prior, constrain=args.constrain, **keep)
    held = saved["tiles"] if fits(saved["parameters"]) else settle(saved["tiles"])
    evidence = admix.Evidence(held, saved["parameters"], clusters, saved.get("hap"))
    state = admix.start(evidence.blocks(), options)
    if args.qfile:
        state.q = admix.given_shares(saved["tiles"], matrix.read(spark, args.qfile), options)
    floor = admix.floors(saved["parameters"], clusters, args.ancestries) if args.constrain else None
    state, _ = admix.fit(evidence, options, state, floor)
    matrix.written(admix.shares(state, args.ancestries), ["sample_idx"], "q", f"{args.out}/Q", 10)
    if args.write_f:
        matrix.written(admix.by_grid(state, args.ancestries, clusters), ["chunk_id", "grid_id"], "f", f"{args.out}/F")


def run_align(spark: SparkSession, args: argparse.Namespace) -> None:
    """Runs with their ancestries in one order, and the samples of each population in the order of its first ancestry."""
    runs = labels.aligned([settled(matrix.read(spark, q).select(F.col("row").alias("sample_idx"), F.col("values").alias("q")), "q") for q in args.q])
    for i, q in enumerate(runs):
        matrix.written(q, ["sample_idx"], "q", f"{args.out}/Q{i}", 10)
    shares = runs[0].join(matrix.labels(spark, args.populations).withColumnRenamed("row", "sample_idx"), "sample_idx")
    labels.ordered_within(shares.select("population", "sample_idx", F.element_at("q", 1).alias("share"))).write.parquet(f"{args.out}/order")


def run_convert(spark: SparkSession, args: argparse.Namespace) -> None:
    convert.plink_to_beagle(spark, args.input, args.out)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    {"impute": run_impute, "joint": run_joint, "admix": run_admix, "align": run_align, "convert": run_convert}[args.command](spark, args)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(SparkSession.builder.appName(f"lociweave {args.command}").getOrCreate(), args)


if __name__ == "__main__":
    main()
