"""Predicates and tags of variant records: ref STRING, alts ARRAY<STRING>, info STRING."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
BASES = ["A", "C", "G", "T"]


def tags(info: Column) -> Column:
    """INFO as a map; flags have a null value. Of a name that occurs more than once, the first counts."""
    name = lambda x: F.substring_index(x, "=", 1)
    value = lambda x: F.when(F.contains(x, F.lit("=")), F.substring(x, F.length(name(x)) + 2, F.length(x)))
    joined = lambda found, x: F.when((x == "") | F.map_contains_key(found, name(x)), found).otherwise(F.map_concat(found, F.create_map(name(x), value(x))))
    return F.aggregate(F.split(info, ";"), F.create_map().cast("map<string,string>"), joined)


def tag(info: Column, name: str) -> Column:
    return F.try_element_at(tags(info), F.lit(name))


def joined(pairs: Column) -> Column:
    """A map of tags as INFO, in order of name; a flag is its name alone."""
    text = F.array_join(F.transform(F.array_sort(F.map_entries(pairs)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return F.when(text == "", ".").otherwise(text)


def with_tag(info: Column, name: str, value: Column) -> Column:
    """INFO with one tag set; a null value sets a flag."""
    return joined(F.map_concat(F.map_filter(tags(info), lambda k, _: ~k.isin(name, ".")), F.create_map(F.lit(name), value)))


def without_tag(info: Column, name: str) -> Column:
    return joined(F.map_filter(tags(info), lambda k, _: ~k.isin(name, ".")))


def numbers(value: Column) -> Column:
    """A tag's value as an array of numbers; "." is null."""
    return F.transform(F.split(value, ","), lambda x: x.try_cast("double"))


def is_sv(info: Column) -> Column:
    return tag(info, "SVTYPE").isNotNull()


def is_indel(ref: Column, alts: Column, info: Column) -> Column:
    return ~is_sv(info) & ((F.length(ref) > 1) | F.exists(alts, lambda a: (a == ".") | (F.length(a) != F.length(ref))))


def is_multiallelic(alts: Column) -> Column:
    return F.size(alts) > 1


def is_multiallelic_snp(ref: Column, alts: Column) -> Column:
    return (F.size(alts) > 1) & (F.length(ref) == 1) & F.forall(alts, lambda a: F.length(a) == 1)


def is_snp(ref: Column, alts: Column) -> Column:
    return (F.size(alts) == 1) & (F.length(ref) == 1) & F.element_at(alts, 1).isin(*BASES)


def _shared(a: Column, b: Column, end: str, most: Column) -> Column:
    """How many characters, at most so many, two strings share at their start (``left``) or end (``right``)."""
    cut = getattr(F, end)
    return F.array_max(F.filter(F.sequence(F.lit(0), most), lambda k: cut(a, k) == cut(b, k)))


def allele_kind(ref: Column, alt: Column) -> Column:
    """What one alternate allele is: REF, SNP, MNP, INS, DEL, OVERLAP, BND or OTHER.

    Bases that both alleles begin with don't count, nor those that both end with, of which one stays; case doesn't matter. What is left is
    an insertion or a deletion only if one of them is then empty, or ends alike; other changes of unlike length are OTHER, as are symbolic
    alleles but those that stand for any other allele.
    """
    r, a = F.upper(ref), F.upper(alt)
    begun = _shared(r, a, "left", F.least(F.length(r), F.length(a)))
    r, a = F.substring(r, begun + 1, F.length(r)), F.substring(a, begun + 1, F.length(a))
    ended = _shared(r, a, "right", F.least(F.length(r), F.length(a)) - 1)
    old, new, alike = F.length(r) - ended, F.length(a) - ended, F.right(r, ended + 1) == F.right(a, ended + 1)
    changed = (
        F.when((old == 1) & (new == 1), "SNP").when(new == 1, F.when(alike, "DEL").otherwise("OTHER")).when(old == 1, F.when(alike, "INS").otherwise("OTHER")).when(old == new, "MNP").otherwise("OTHER")
    )
    return (
        F.when(alt == "*", "OVERLAP").when(alt.isin(".", "<*>", "<X>", "<NON_REF>") | (alt == "X") & (F.length(ref) == 1), "REF").when(alt.startswith("<"), "OTHER").when(alt.rlike(r"^[\[\]]"), "BND")
        .when((r == "") & (a == ""), "REF").when(r == "", F.when(a.rlike(r"^[\[\]]"), "BND").otherwise("INS")).when(a == "", "DEL").otherwise(changed)
    )


def has_kind(ref: Column, alts: Column, kind: str) -> Column:
    return F.exists(alts, lambda a: allele_kind(ref, a) == kind)


def none_missing(gts: Column) -> Column:
    """Whether every genotype (such as 0/1 or 0|1) has all its alleles."""
    return F.forall(gts, lambda g: g.isNotNull() & ~F.contains(g, F.lit(".")))


def alleles(gt: Column) -> Column:
    """A genotype's allele numbers, null where missing."""
    return F.transform(F.split(gt, r"[/|]"), lambda a: a.try_cast("int"))


def ploidy(gt: Column) -> Column:
    return F.size(F.split(gt, r"[/|]"))


def phased(gt: Column) -> Column:
    """Whether no alleles are joined by a slash."""
    return ~F.contains(gt, F.lit("/"))


def genotype(numbers: Column, is_phased: Column) -> Column:
    """Allele numbers (null: missing) as a genotype."""
    text = F.transform(numbers, lambda a: F.coalesce(a.cast("string"), F.lit(".")))
    return F.when(is_phased, F.array_join(text, "|")).otherwise(F.array_join(text, "/"))


def dosage(gt: Column) -> Column:
    """Alternate alleles in a genotype, null if one is missing."""
    found = alleles(gt)
    return F.when(F.forall(found, lambda a: a.isNotNull()), F.size(F.filter(found, lambda a: a > 0)))


def with_format(samples: Column, name: str, values: Column) -> Column:
    """Samples' maps of FORMAT tags with one tag set, from an array of a value each."""
    return F.zip_with(samples, values, lambda s, v: F.map_concat(F.map_filter(s, lambda k, _: k != name), F.create_map(F.lit(name), v)))


def without_format(samples: Column, name: str) -> Column:
    return F.transform(samples, lambda s: F.map_filter(s, lambda k, _: k != name))


def format_values(samples: Column, name: str) -> Column:
    """One FORMAT tag of every sample, null where a sample has none."""
    return F.transform(samples, lambda s: F.try_element_at(s, F.lit(name)))


def start(pos: Column) -> Column:
    """The first position, from 0."""
    return pos - 1


def end(pos: Column, ref: Column, info: Column) -> Column:
    """The last position, from 1: INFO's END if it has one, else that of REF."""
    return F.coalesce(tag(info, "END").try_cast("long"), pos + F.length(ref) - 1)


def allele_counts(gts: Column, alts: Column) -> Column:
    """How often the genotypes have each allele, REF first."""
    every = F.flatten(F.transform(gts, alleles))
    return F.transform(F.sequence(F.lit(0), F.size(alts)), lambda i: F.size(F.filter(every, lambda a: a == i)))


def trimmed(gts: Column, alts: Column) -> tuple[Column, Column]:
    """(alts, gts) without the alternate alleles that no genotype has, the others numbered anew."""
    counts = allele_counts(gts, alts)
    used = F.filter(F.sequence(F.lit(1), F.size(alts)), lambda i: F.element_at(counts, i + 1) > 0)
    renumbered = lambda a: F.when(a > 0, F.array_position(used, a).cast("int")).otherwise(a)
    return F.transform(used, lambda i: F.element_at(alts, i)), F.transform(gts, lambda g: genotype(F.transform(alleles(g), renumbered), phased(g)))


def swapped(ref: Column, alts: Column) -> tuple[Column, Column]:
    """(ref, alts) of a record of two alleles the other way round; others stay."""
    two = F.size(alts) == 1
    return F.when(two, F.element_at(alts, 1)).otherwise(ref), F.when(two, F.array(ref)).otherwise(alts)
