"""Records of any number of files at one position, side by side where they are of the same variant, each record once.

A file's records at a position are variants by their alleles; equal ones in different files are one, the second of a file's equal records
is a variant of its own. Sets of variants grow greedily: the set with most records takes the one that fits it best, if any fits, or else
is complete. Sets that share a file don't fit. How well others do is told by the rules:

``exact``: only the same alleles, in any order. Otherwise those with an alternate allele in common fit best, then, as far as the
rules name them, ``snps`` (SNPs and MNPs with each other), ``indels``, ``snp_ref`` and ``indel_ref`` (with records without alternate
alleles), ``any``. All variants of two sets must fit, unless one of them is the same. Of sets that fit alike that with more records is
taken, then the first by file and record.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.functions.variants import allele_kind

RULES = ("exact", "some", "snps", "indels", "any", "snp_ref", "indel_ref")
#: What a record is, as bits, by the kinds of its alternate alleles.
REF, SNP, INDEL, OTHER = 1, 2, 4, 8
_BITS = {"SNP": SNP, "MNP": SNP, "INS": INDEL, "DEL": INDEL, "OTHER": OTHER}


def scores(rules: Iterable[str]) -> dict[tuple[int, int], int]:
    """How well two kinds of records fit, by their bits; 0 if not at all."""
    rules = set(rules)
    if rules - set(RULES):
        raise ValueError(f"rules are {RULES}")
    least = 1 if "any" in rules else 0
    if least:
        rules |= {"snps", "indels", "snp_ref", "indel_ref"}
    named = {"snps": (SNP, SNP, 3), "indels": (INDEL, INDEL, 3), "snp_ref": (SNP, REF, 2), "indel_ref": (INDEL, REF, 2)}
    one = {}
    for a, b, s in (named[r] for r in rules if r in named):
        one[a, b] = one[b, a] = s
    bits = lambda x: [b for b in (REF, SNP, INDEL, OTHER) if x & b]
    # With "any", records of several kinds fit as those of unlike kinds do.
    mixed = lambda a, b: least or max((one.get((i, j), 0) for i in bits(a) for j in bits(b)), default=0)
    return {(a, b): one.get((a, b)) or mixed(a, b) for a in range(16) for b in range(16)}


class Variant:
    """Records of different files with the same alleles."""

    def __init__(self, alleles: list[str], kind: int):
        self.alleles, self.kind, self.records = alleles, kind, []

    def fits(self, other: Variant, score: dict[tuple[int, int], int], exact: bool) -> float:
        same = self.kind == other.kind and self.alleles == other.alleles
        if exact:
            return math.inf if same or self.kind == other.kind and sorted(x.lower() for x in self.alleles) == sorted(x.lower() for x in other.alleles) else -1
        if same or self.kind & other.kind and {x.lower() for x in self.alleles} & {x.lower() for x in other.alleles}:
            return math.inf
        return score[self.kind, other.kind]


def matched(records: list[dict], rules: Iterable[str]) -> list[list[int]]:
    """Sets of records' numbers. Records are in order of file; each has file, alleles (REF>ALT) and kind."""
    score, exact = scores(rules), "exact" in rules
    found: dict[tuple, Variant] = {}
    copies: dict[tuple, int] = {}
    for i, r in enumerate(records):
        alleles = tuple(r["alleles"])
        copy = copies[r["file"], alleles] = copies.get((r["file"], alleles), -1) + 1
        found.setdefault((alleles, copy), Variant(list(alleles), r["kind"])).records.append(i)
    sets = [[v] for v in found.values()]
    held = lambda s: [i for v in s for i in v.records]
    files = lambda s: {records[i]["file"] for i in held(s)}

    def fit(a: list[Variant], b: list[Variant]) -> float:
        worst = math.inf
        for x in a:
            for y in b:
                s = x.fits(y, score, exact)
                if s == math.inf:
                    return s
                if s == 0:
                    return 0
                worst = min(worst, s)
        return 0 if worst < 0 else worst

    out = []
    while sets:
        lead = max(range(len(sets)), key=lambda i: (len(held(sets[i])), -i))
        own = files(sets[lead])
        rivals = [(fit(sets[lead], s), len(held(s)), -i) for i, s in enumerate(sets) if i != lead and not own & files(s)]
        # All whose alleles are the same fit alike; the first of them is taken.
        best = max(((s, 0 if s == math.inf else n, i) for s, n, i in rivals), default=(0, 0, 0))
        if best[0] <= 0:
            out.append(sorted(held(sets.pop(lead))))
            continue
        low, high = sorted((lead, -best[2]))
        sets[low] = sets[low] + sets[high]
        del sets[high]
    return out


def paired(files: list[DataFrame], rules: Iterable[str] = ("exact",)) -> DataFrame:
    """contig, pos, set (numbered from 0 at each position), file (its number), record: each record of the files (contig, pos, record, ref,
    alts, and if they have it end) once. A position's records are one row while they are paired."""
    rules = tuple(rules)
    scores(rules)
    rows = []
    for i, f in enumerate(files):
        end = F.col("end").cast("string") if "end" in f.columns else F.lit(None).cast("string")
        rows.append(f.select("contig", "pos", F.lit(i).alias("file"), F.col("record").cast("long").alias("record"), "ref", "alts", end.alias("end")))
    every = rows[0]
    for f in rows[1:]:
        every = every.unionByName(f)
    # A symbolic allele's end tells events of one start apart.
    named = F.transform("alts", lambda a: F.concat(F.col("ref"), F.lit(">"), a, F.when(a.startswith("<") & F.col("end").isNotNull(), F.concat(F.lit("/"), F.col("end"))).otherwise("")))
    kinds = F.transform("alts", lambda a: allele_kind(F.col("ref"), a))
    bit = F.aggregate(kinds, F.lit(0), lambda x, k: x.bitwiseOR(F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in _BITS.items() for v in kv]), k), F.lit(0))))
    kind = F.when(F.forall(kinds, lambda k: k == "REF"), REF).otherwise(bit)
    every = every.select("contig", "pos", F.struct("file", "record", named.alias("alleles"), kind.alias("kind")).alias("x"))
    places = every.groupBy("contig", "pos").agg(F.sort_array(F.collect_list("x")).alias("x"))

    def pair(batches):
        for b in batches:
            contigs, positions, held = (b.column(i).to_pylist() for i in range(3))
            out = []
            for contig, pos, records in zip(contigs, positions, held):
                for n, members in enumerate(matched(records, rules)):
                    out += [(contig, pos, n, records[i]["file"], records[i]["record"]) for i in members]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["contig", "pos", "set", "file", "record"])

    return places.select("contig", F.col("pos").cast("long").alias("pos"), "x").mapInArrow(pair, "contig string, pos long, set int, file int, record long")
