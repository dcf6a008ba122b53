"""Running values over an order, forwards and backwards, without a window over a whole group: within spans of positions, with what the
spans before (or after) carry over, which is a row a span."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How values run: what joins two of them is associative, so that a span's rows become one.
HOWS = ("sum", "min", "max", "last")
SPAN = 1 << 20


def _run(value: str, how: str, window) -> Column:
    return {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how](value).over(window)


def _joined(before: Column, own: Column, how: str) -> Column:
    if how == "sum":
        return F.coalesce(before + own, before, own)
    return {"min": F.least, "max": F.greatest, "last": lambda b, o: F.coalesce(o, b)}[how](before, own)


def swept(rows: DataFrame, group: list[str], position: str, ties: list[str], forward: dict[str, tuple[Column, str]], backward: dict[str, tuple[Column, str]] | None = None, span: int = SPAN, inclusive: bool = True) -> DataFrame:
    """``rows`` with running columns, over each group in the order of ``position`` and then ``ties``, which together tell rows apart.

    Each column is (value, how): the sum, least, greatest or last value that isn't null from the group's first row (of ``forward``) or
    last row (``backward``) to the row itself, or with ``inclusive`` false to the one before it. A group's span of positions is sorted in
    one task, and the spans of a group meet as a row each.
    """
    wanted = [(name, *spec, False) for name, spec in forward.items()] + [(name, *spec, True) for name, spec in (backward or {}).items()]
    for _, _, how, _ in wanted:
        if how not in HOWS:
            raise ValueError(f"values run by {HOWS}")
    placed = rows.withColumns({"_span": F.floor(F.col(position) / span), **{f"_v{i}": value for i, (_, value, _, _) in enumerate(wanted)}})
    keys = [*group, "_span"]
    order = {back: [F.desc(c) if back else F.asc(c) for c in (position, *ties)] for back in (False, True)}
    within = {back: W.partitionBy(*keys).orderBy(*order[back]).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1) for back in (False, True)}
    spans = {back: W.partitionBy(*group).orderBy(F.desc("_span") if back else F.asc("_span")).rowsBetween(W.unboundedPreceding, -1) for back in (False, True)}
    # A span's value as a whole: its last one is the last in the order of the run.
    place = F.struct(position, *ties)
    whole = {
        "sum": lambda c, back: F.sum(c), "min": lambda c, back: F.min(c), "max": lambda c, back: F.max(c),
        "last": lambda c, back: (F.min_by if back else F.max_by)(c, F.when(F.col(c).isNotNull(), place)),
    }
    ends = placed.groupBy(*keys).agg(*[whole[how](f"_v{i}", back).alias(f"_w{i}") for i, (_, _, how, back) in enumerate(wanted)])
    before = ends.select(*keys, *[_run(f"_w{i}", how, spans[back]).alias(f"_b{i}") for i, (_, _, how, back) in enumerate(wanted)])
    run = placed.select("*", *[_run(f"_v{i}", how, within[back]).alias(f"_r{i}") for i, (_, _, how, back) in enumerate(wanted)])
    named = before.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`_of_{k}`")) for k in keys]
    out = run.join(named, reduce(lambda x, y: x & y, same), "left")
    return out.select(*rows.columns, *[_joined(F.col(f"_b{i}"), F.col(f"_r{i}"), how).alias(name) for i, (name, _, how, _) in enumerate(wanted)])
