"""Records without some of their alternate alleles: tags with a value an allele or a genotype lose the values of those removed.

Which tags these are is told by their Number in the header: A (a value an alternate allele), R (an allele) or G (a genotype: of diploid
samples in the order 0/0, 0/1, 1/1, 0/2, ...; of haploid samples as R). A missing value (".") stays; another count of values is an
error, named with its tag. A tag without a value left is removed. In genotypes, alleles are numbered anew and removed ones are
missing; each keeps its separator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.functions import variants

PER_ALLELE = ("A", "R", "G")


def numbers_of(header: DataFrame) -> dict[tuple[str, str], str]:
    """(INFO or FORMAT, tag) and its Number, of the tags of a parsed header with a value an allele or genotype."""
    number = F.try_element_at("fields", F.lit("Number"))
    rows = header.where(F.col("kind").isin("INFO", "FORMAT") & number.isin(*PER_ALLELE)).select("kind", "id", number.alias("number")).collect()  # a row a tag
    return {(r["kind"], r["id"]): r["number"] for r in rows}


def left(alts: Column, remove: Column) -> Column:
    """The numbers of the alleles that stay, REF's 0 first; ``remove`` has those of alternate alleles."""
    every = F.sequence(F.lit(0), F.size(alts))
    return F.filter(every, lambda i: (i == 0) | ~F.array_contains(remove, i))


def genotypes_of(keep: Column) -> Column:
    """The places, from 0, that diploid genotypes of the alleles ``keep`` have among those of all alleles."""
    own = lambda b: F.transform(F.filter(keep, lambda a: a <= b), lambda a: F.shiftright(b * (b + 1), 1) + a)
    return F.flatten(F.transform(keep, own))


def places(number: str, keep: Column) -> Column:
    """The places, from 0, of the values that stay of a tag with this Number."""
    return {"A": F.transform(F.filter(keep, lambda i: i > 0), lambda i: i - 1), "R": keep, "G": genotypes_of(keep)}[number]


def subset(values: Column, number: str, alleles: Column, at: Column, keep: Column, tag: str, haploid: bool = False) -> Column:
    """The values (an array, of so many alleles with REF) at the places ``at``, as an array."""
    taken = lambda at: F.transform(at, lambda i: F.element_at(values, i + 1))
    expected = {"A": alleles - 1, "R": alleles, "G": F.shiftright(alleles * (alleles + 1), 1)}[number]
    wrong = F.raise_error(F.concat(F.lit(f"{tag} has another count of values than Number={number} says: "), F.size(values).cast("string"))).cast("array<string>")
    found = F.when((F.size(values) == 1) & (F.element_at(values, 1) == "."), values).when(F.size(values) == expected, taken(at))
    if number == "G" and haploid:
        found = found.when(F.size(values) == alleles, taken(keep))
    return F.when(values.isNotNull(), found.otherwise(wrong))


def renumbered(gt: Column, keep: Column) -> Column:
    """A genotype whose alleles are numbered by their places in ``keep``."""
    parts = F.regexp_extract_all(gt, F.lit(r"([/|]?[^/|]+)"), 1)

    def anew(part: Column) -> Column:
        allele = F.regexp_extract(part, r"([^/|]+)$", 1).try_cast("int")
        place = F.array_position(keep, allele)
        return F.concat(F.regexp_extract(part, r"^([/|]?)", 1), F.when(place > 0, (place - 1).cast("string")).otherwise("."))

    return F.array_join(F.transform(parts, anew), "")


def without(rows: DataFrame, remove: Column, numbers: dict[tuple[str, str], str]) -> DataFrame:
    """Records (alts, info, samples: a map of FORMAT tags each, ...) without the alternate alleles numbered in ``remove``; others, and
    records that lose none, stay as they are."""
    # Computed once a record, and under names that no column of a record has: within lambdas a name would mean the new column.
    held = rows.select("*", left(F.col("alts"), remove).alias("_keep"))
    held = held.select("*", (F.size("alts") + 1).alias("_n"), *[places(number, F.col("_keep")).alias(f"_at_{number}") for number in PER_ALLELE])
    n, keep = F.col("_n"), F.col("_keep")
    untouched = F.size(keep) == n
    text = lambda values: F.when(F.size(values) > 0, F.array_join(values, ","))
    per = {kind: {tag: number for (k, tag), number in numbers.items() if k == kind} for kind in ("INFO", "FORMAT")}

    def cut(kind: str, name: Column, value: Column) -> Column:
        out = F.when(F.lit(False), value)
        for tag, number in per[kind].items():
            out = out.when((name == tag) & value.isNotNull(), text(subset(F.split(value, ","), number, n, F.col(f"_at_{number}"), keep, f"{kind}/{tag}", kind == "FORMAT")))
        if kind == "FORMAT":
            out = out.when(name == "GT", renumbered(value, keep))
        return out.otherwise(value)

    def kept_tags(kind: str, tags: Column) -> Column:
        """A map of tags; those that lose all their values leave it, those that had none stay."""
        new = F.transform_values(tags, lambda k, v: F.struct(v.alias("old"), cut(kind, k, v).alias("new")))
        return F.transform_values(F.map_filter(new, lambda _, v: v["new"].isNotNull() | v["old"].isNull()), lambda _, v: v["new"])

    info = F.when(untouched | (F.col("info") == "."), F.col("info")).otherwise(variants.joined(kept_tags("INFO", variants.tags(F.col("info")))))
    samples = F.when(untouched, F.col("samples")).otherwise(F.transform("samples", lambda s: kept_tags("FORMAT", s)))
    kept = F.transform(F.filter(keep, lambda i: i > 0), lambda i: F.element_at("alts", i))
    new = {"info": info, "samples": samples, "alts": F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(".")))}
    found = held.select("*", *[c.alias(f"_new_{name}") for name, c in new.items()])
    return found.select(*[F.col(f"_new_{c}" if c in new else f"`{c}`").alias(c) for c in rows.columns])


def unused(gts: Column, alts: Column) -> Column:
    """The numbers of the alternate alleles that no genotype has."""
    counts = variants.allele_counts(gts, alts)
    return F.filter(F.sequence(F.lit(1), F.size(alts)), lambda i: F.element_at(counts, i + 1) == 0)
