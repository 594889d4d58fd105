"""Exact interpolated quantiles of large columns, by rounds that narrow an interval around each wanted rank.

A round summarises the values inside every open interval (a mergeable sketch of bounded size), which gives two values
that enclose the wanted rank closely; a second pass counts what lies below, on and between them. The counts are exact,
so an enclosure that misses its rank is noticed and the search goes on beside it. Values that tie with a bound end the
search at once. An interval of at most ``LIMIT`` values is sorted and its element read off. All columns and ranks share
each pass: two passes up to about ``LIMIT * ACCURACY / 6`` rows, two more for every further factor of ``ACCURACY / 6``.
No task and no driver holds more than sketches and ``LIMIT`` values for each rank.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.sources.staging import stage

#: A sketch's ranks are off by at most this part of the values in it.
ACCURACY = 10_000
#: Values that one interval may hold when it is sorted.
LIMIT = 100_000


@dataclass
class _Rank:
    """The search for the value at one 0-based rank: it lies in (low, high), above ``below`` values, among ``inside``."""

    column: str
    rank: int
    inside: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    value: float | None = None
    found: bool = False

    @property
    def x(self) -> Column:
        return F.col(f"`{self.column}`")

    @property
    def within(self) -> Column:
        inside = self.x.isNotNull()
        if self.low is not None:
            inside &= self.x > self.low
        if self.high is not None:
            inside &= self.x < self.high
        return inside

    @property
    def share(self) -> float:
        return (self.rank - self.below + 0.5) / self.inside

    def small(self, accuracy: int, limit: int) -> bool:
        """Whether two sketched values around the rank can have at most ``limit`` others between them."""
        return self.inside <= limit or 6 * self.inside <= limit * accuracy


def _around(x: Column, shares: Sequence[float], accuracy: int) -> Column:
    near = [min(max(s + d, 0.0), 1.0) for s in shares for d in (-2 / accuracy, 2 / accuracy)]
    return F.percentile_approx(x, [float(s) for s in near], accuracy)


def _round(table: DataFrame, ranks: Sequence[_Rank], bounds: Sequence[tuple[float, float]], accuracy: int, limit: int) -> None:
    """One counting pass: every rank is found or gets a smaller interval."""
    exprs = []
    for r, (low, high) in zip(ranks, bounds, strict=True):
        between = r.within & (r.x > low) & (r.x < high)
        counts = [F.count_if(c) for c in (r.within & (r.x < low), r.within & (r.x == low), between, r.within & (r.x == high))]
        if r.small(accuracy, limit):
            place = F.lit(r.rank - r.below) - counts[0] - counts[1]
            picked = F.get(F.sort_array(F.collect_list(F.when(between, r.x))), F.when(place >= 0, place).cast("int"))
        else:
            picked = F.lit(None).cast("double")
        exprs.append(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(counts)], picked.alias("picked")).alias(f"r{len(exprs)}"))
    for r, (low, high), (less, on_low, between, on_high, picked) in zip(ranks, bounds, table.agg(*exprs).first(), strict=True):
        at = r.rank - r.below
        if at < less:
            r.high, r.inside = low, less
        elif at < less + on_low:
            r.value, r.found = low, True
        elif at < less + on_low + between:
            r.value, r.found = picked, picked is not None
            r.low, r.high, r.below, r.inside = low, high, r.below + less + on_low, between
        elif high != low and at < less + on_low + between + on_high:
            r.value, r.found = high, True
        else:
            over = less + on_low + between + (on_high if high != low else 0)
            r.low, r.below, r.inside = high, r.below + over, r.inside - over


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]], accuracy: int = ACCURACY, limit: int = LIMIT) -> dict[str, list[float | None]]:
    """The quantiles of each column at the given shares, nulls left out; all null for a column without values.

    NaN counts as greater than all numbers. ``df`` is read once; its columns are staged as doubles.
    """
    names = {c: f"c{i}" for i, c in enumerate(wanted)}
    table = stage(df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in names.items()]), "quantiles")
    wide = [f for c, n in names.items() for f in (F.count(n), _around(F.col(n), wanted[c], accuracy))]
    first = table.agg(*[e.alias(f"e{i}") for i, e in enumerate(wide)]).first()
    ranks: dict[tuple[str, int], _Rank] = {}
    bounds: dict[tuple[str, int], tuple[float, float]] = {}
    places: dict[str, list[Fraction]] = {}
    for i, (c, n) in enumerate(names.items()):
        count, near = first[2 * i], first[2 * i + 1]
        places[c] = [Fraction(p) * (count - 1) for p in wanted[c]] if count else []
        for j, place in enumerate(places[c]):
            for rank in {math.floor(place), math.ceil(place)}:
                ranks[n, rank] = _Rank(n, rank, count)
                bounds[n, rank] = near[2 * j], near[2 * j + 1]
    while open_ := [k for k, r in ranks.items() if not r.found]:
        if missing := [k for k in open_ if k not in bounds]:
            sketches = [_around(F.when(ranks[k].within, ranks[k].x), [ranks[k].share], accuracy) for k in missing]
            found = table.agg(*[e.alias(f"e{i}") for i, e in enumerate(sketches)]).first()
            bounds |= {k: tuple(pair) for k, pair in zip(missing, found, strict=True)}
        _round(table, [ranks[k] for k in open_], [bounds.pop(k) for k in open_], accuracy, limit)
    return {c: [_between(ranks, names[c], p) for p in places[c]] or [None] * len(wanted[c]) for c in names}


def _between(ranks: Mapping[tuple[str, int], _Rank], name: str, place: Fraction) -> float:
    low, high = math.floor(place), math.ceil(place)
    a, b = ranks[name, low].value, ranks[name, high].value
    return a if a == b or low == high else float(high - place) * a + float(place - low) * b


def quantile_rows(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> DataFrame:
    """``column, q``: an array of quantiles for each column."""
    rows = list(exact_quantiles(df, wanted).items())
    return df.sparkSession.createDataFrame(rows, "column string, q array<double>")
