"""Pairing of files, intervals, region lists and allele removal against brute force and small cases."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lociweave.functions import alleles
from lociweave.operators import intervals, pairing
from lociweave.sources import regions


def sets(spark, files, rules):
    """Sets of (file, record) of files of (pos, ref, alts) lists."""
    dfs = [spark.createDataFrame([("c", pos, i, ref, alts.split(",")) for i, (pos, ref, alts) in enumerate(f)], "contig string, pos long, record long, ref string, alts array<string>") for f in files]
    found = {}
    for r in pairing.paired(dfs, rules).collect():
        found.setdefault((r["pos"], r["set"]), set()).add((r["file"], r["record"]))
    return {frozenset(v) for v in found.values()}


@pytest.mark.parametrize(
    ("rules", "want"),
    [
        (("exact",), [{(0, 0), (1, 1)}, {(0, 1)}, {(1, 0)}, {(2, 0)}, {(2, 1)}, {(2, 2)}]),
        (("some",), [{(0, 0), (1, 1), (2, 0)}, {(0, 1)}, {(1, 0)}, {(2, 1)}, {(2, 2)}]),
        (("snps",), [{(0, 0), (1, 1), (2, 0)}, {(0, 1)}, {(1, 0)}, {(2, 1)}, {(2, 2)}]),
        (("indels",), [{(0, 0), (1, 1), (2, 0)}, {(0, 1), (1, 0), (2, 1)}, {(2, 2)}]),
    ],
)
def test_rules(spark, rules, want):
    """SNPs of which some share an allele, unlike indels, and a record without alternate alleles."""
    files = [[(5, "A", "C,G"), (5, "A", "AT")], [(5, "A", "ATT"), (5, "A", "G,C")], [(5, "A", "G"), (5, "AC", "A"), (5, "A", ".")]]
    assert sets(spark, files, rules) == {frozenset(x) for x in want}


def test_any_and_ref_rules(spark):
    files = [[(5, "A", "C")], [(5, "A", ".")], [(5, "A", "AT")]]
    assert sets(spark, files, ("snp_ref",)) == {frozenset({(0, 0), (1, 0)}), frozenset({(2, 0)})}
    assert sets(spark, files, ("indel_ref",)) == {frozenset({(0, 0)}), frozenset({(1, 0), (2, 0)})}
    assert sets(spark, files, ("any",)) == {frozenset({(0, 0), (1, 0), (2, 0)})}
    with pytest.raises(ValueError):
        pairing.paired([], ("most",))


def test_copies_and_symbolic_ends(spark):
    same = [(5, "A", "C")]
    assert sets(spark, [same * 3, same * 2, same], ("exact",)) == {frozenset({(0, 0), (1, 0), (2, 0)}), frozenset({(0, 1), (1, 1)}), frozenset({(0, 2)})}
    schema = "contig string, pos long, record long, ref string, alts array<string>, end long"
    a, b = (spark.createDataFrame([("c", 5, 0, "A", ["<DEL>"], x), ("c", 5, 1, "A", ["<DEL>"], y)], schema) for x, y in ((90, 70), (70, 80)))
    found = {(r["set"], r["file"], r["record"]) for r in pairing.paired([a, b]).collect()}
    assert len({s for s, *_ in found}) == 3 and next(s for s, f, r in found if (f, r) == (0, 1)) == next(s for s, f, r in found if (f, r) == (1, 0))


@pytest.mark.parametrize("rules", [("exact",), ("some",), ("snps",), ("indels", "snps"), ("any",), ("snps", "snp_ref")])
def test_sets_hold_each_record_once_and_fit(spark, rules):
    rng = random.Random(len(rules))
    pool = [("A", "C"), ("A", "G"), ("A", "C,G"), ("A", "G,C"), ("A", "AT"), ("AT", "A"), ("A", "ATT,C"), ("A", "."), ("AC", "GT"), ("A", "<DEL>"), ("A", "*")]
    files = [[(rng.randrange(12), *rng.choice(pool)) for _ in range(40)] for _ in range(4)]
    got = sets(spark, files, rules)
    assert sorted(x for s in got for x in s) == [(f, i) for f in range(4) for i in range(40)]
    at = lambda x: files[x[0]][x[1]]
    for s in got:
        assert len({f for f, _ in s}) == len(s) and len({at(x)[0] for x in s}) == 1
        if rules == ("exact",):
            assert len({(at(x)[1], *sorted(at(x)[2].split(","))) for x in s}) == 1
        if rules == ("some",):
            # Every member shares an allele with another.
            assert all(any(at(x)[1:] == at(y)[1:] or at(x)[1] == at(y)[1] and set(at(x)[2].split(",")) & set(at(y)[2].split(",")) for y in s if y != x) for x in s if len(s) > 1)
    if rules == ("any",):
        for pos in range(12):
            n = [sum(r[0] == pos for r in f) for f in files]
            assert sum(at(next(iter(s)))[0] == pos for s in got) == max(n)  # as few sets as the fullest file has records


@pytest.mark.parametrize("width", [1, 16, 1024])
def test_overlaps_match_brute_force(spark, width):
    rng = random.Random(width)

    def some(n):
        out = []
        for i in range(n):
            beg = rng.randrange(1, 50_000)
            out.append((rng.choice("cd"), beg, beg + rng.choice([-5, 0, 1, 10, width, width - 1, 300, 5000, 40_000, 10**9]), i))
        return out + [("c", 1, 10**10, n), ("c", 5, 5, n + 1), ("c", 5, 5, n + 2), ("only", 1, 2, n + 3)]

    a, b = some(120), some(90)
    dfs = [spark.createDataFrame(x, "contig string, beg long, end long, i long") for x in (a, b)]
    got = sorted((r["i"], r["i_b"]) for r in intervals.overlapping(*dfs, width).collect())
    want = sorted((i, j) for c, s, e, i in a for d, t, u, j in b if c == d and s <= e and t <= u and s <= u and t <= e)
    assert got == want and set(intervals.overlapping(*dfs, width).columns) == {"contig", "beg", "end", "i", "beg_b", "end_b", "i_b"}
    none = dfs[0].limit(0)
    assert intervals.overlapping(none, dfs[1]).count() == intervals.overlapping(dfs[0], none).count() == 0


@pytest.mark.parametrize(
    ("kind", "line", "want"),
    [
        ("bed", "c 0 5", (1, 5)), ("bed", "c\t9\t10\tx", (10, 10)), ("bed", "c", (1, regions.LAST)), ("bed", "c 5", None), ("bed", "c x 5", None), ("tab", "c 5", (5, 5)), ("tab", "c 5 9 x", (5, 9)), ("tab", "c 5 x", (5, 5)), ("tab", "c 0", None), ("tab", "c 5 0", None),
        ("vcf", "c 5 rs1 A", (5, 5)), ("vcf", "c 5 9", (5, 5)), ("reg", "c", (1, regions.LAST)), ("reg", "c:5", (5, 5)), ("reg", "c:5-", (5, regions.LAST)), ("reg", "c:1,000-2,000", (1000, 2000)), ("reg", "c:0-5", None), ("reg", "c:x", None),
    ],
)
def test_region_lines(spark, kind, line, want):
    lines = spark.createDataFrame([(line,), ("# c 1 2",), (" ",)], "value string")
    if want is None:
        with pytest.raises(Exception, match="not a"):
            regions.parsed(lines, kind).collect()
    else:
        assert [tuple(r) for r in regions.parsed(lines, kind).collect()] == [("c", *want)]


def test_region_files(spark, tmp_path):
    (tmp_path / "x.bed").write_text("#h\nc 0 5\n\nd\t7\t9\n")
    assert sorted(map(tuple, regions.read(spark, str(tmp_path / "x.bed"), "bed").collect())) == [("c", 1, 5), ("d", 8, 9)]


NUMBERS = {("INFO", "AF"): "A", ("INFO", "G"): "G", ("FORMAT", "PL"): "G", ("FORMAT", "AD"): "R", ("FORMAT", "FA"): "A"}
RECORD = "alts array<string>, info string, samples array<map<string,string>>"


def cut(spark, alts, info, samples, remove):
    rows = spark.createDataFrame([(alts, info, samples)], RECORD)
    return alleles.without(rows, F.array(*[F.lit(i) for i in remove]).cast("array<int>"), NUMBERS).first()


def test_alleles_leave_with_their_values(spark):
    samples = [{"GT": "0/2", "PL": "0,1,2,3,4,5,6,7,8,9", "AD": "1,2,3,4", "FA": "a,b,c"}, {"GT": "3|1", "PL": ".", "AD": ".", "FA": ".,x,."}, {"GT": "3", "PL": "5,6,7,8", "AD": "1,2,3,4"}]
    r = cut(spark, ["C", "G", "T"], "DB;AF=.1,.2,.3;DP=3", samples, [1, 3])
    assert r["alts"] == ["G"] and r["info"] == "AF=.2;DB;DP=3"
    assert r["samples"] == [{"GT": "0/1", "PL": "0,3,5", "AD": "1,3", "FA": "b"}, {"GT": ".|.", "PL": ".", "AD": ".", "FA": "x"}, {"GT": ".", "PL": "5,7", "AD": "1,3"}]
    r = cut(spark, ["C", "G", "T"], "AF=.1,.2,.3", samples, [1, 2, 3])
    assert r["alts"] == ["."] and r["info"] == "." and r["samples"][0] == {"GT": "0/.", "PL": "0", "AD": "1"}
    r = cut(spark, ["C", "G", "T"], "AF=.1,.2", samples, [])
    assert r["info"] == "AF=.1,.2" and r["samples"] == samples


@pytest.mark.parametrize(("n", "remove"), [(n, list(r)) for n in (1, 2, 4) for k in range(1, n + 1) for r in combinations(range(1, n + 1), k)])
def test_genotype_order(spark, n, remove):
    """Each genotype's value is named after it, so those that stay are named after what stays."""
    order = [(a, b) for b in range(n + 1) for a in range(b + 1)]
    values = ",".join(f"{a}/{b}" for a, b in order)
    r = cut(spark, list("CGTAC")[:n], f"G={values}", [{"PL": values}], remove)
    want = ",".join(f"{a}/{b}" for a, b in order if a not in remove and b not in remove)
    assert r["samples"][0]["PL"] == want and r["info"] == f"G={want}"


@pytest.mark.parametrize(("info", "sample", "tag"), [("AF=1", {"AD": "1,2,3"}, "INFO/AF"), ("G=1,2,3", {}, "INFO/G"), (".", {"AD": "1,2"}, "FORMAT/AD"), (".", {"PL": "1,2,3,4"}, "FORMAT/PL")])
def test_wrong_counts_are_errors(spark, info, sample, tag):
    with pytest.raises(Exception, match=tag):
        cut(spark, ["C", "G"], info, [sample], [1])
