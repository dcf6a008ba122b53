"""Region lists as text: contig, beg, end (from 1, ends included) of BED (from 0, end left out), tab (from 1, end optional) and
``contig:beg-end`` lines. Blank lines and those that begin with # don't count; a contig alone is all of it; other lines are errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.sources import text

#: The end of a region that has none.
LAST = (1 << 31) - 2
FORMATS = ("bed", "tab", "vcf", "reg")


def _number(value: Column) -> Column:
    """A number with or without commas between thousands, else null."""
    return F.when(value.rlike(r"^\d[\d,]*$"), F.regexp_replace(value, ",", "").cast("long"))


def parsed(lines: DataFrame, kind: str) -> DataFrame:
    """contig, beg, end of (value) lines."""
    if kind not in FORMATS:
        raise ValueError(f"formats are {FORMATS}")
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    rows = lines.select(line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    bad = F.raise_error(F.concat(F.lit(f"not a {kind} line: "), F.col("line"))).cast("long")
    if kind == "reg":
        cut = r"^([^:]+)(?::([\d,]+)(-?)([\d,]*))?$"
        contig, beg, dash, end = (F.regexp_extract("line", cut, i) for i in (1, 2, 3, 4))
        whole = beg == ""
        first = F.when((contig == "") | (_number(beg) == 0) | (_number(end) == 0), bad).otherwise(_number(beg))
        return rows.select(contig.alias("contig"), F.when(whole & (contig != ""), 1).otherwise(first).alias("beg"), F.when(whole, LAST).when(end != "", _number(end)).when(dash == "-", LAST).otherwise(_number(beg)).cast("long").alias("end"))
    f = F.split("line", " ")
    beg, end = (_number(F.coalesce(F.try_element_at(f, F.lit(i)), F.lit(""))) for i in (2, 3))
    alone = F.size(f) == 1
    if kind == "bed":
        first, last = F.when(beg.isNull() | end.isNull(), bad).otherwise(beg + 1), end
    else:
        first = F.when(beg.isNull() | (beg == 0) | ((end == 0) & F.lit(kind == "tab")), bad).otherwise(beg)
        last = F.coalesce(end, beg) if kind == "tab" else beg
    return rows.select(F.element_at(f, 1).alias("contig"), F.when(alone, 1).otherwise(first).alias("beg"), F.when(alone, LAST).otherwise(last).cast("long").alias("end"))


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return parsed(text.lines(spark, path), kind)
