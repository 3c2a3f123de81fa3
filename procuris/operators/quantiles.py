"""Exact quantiles of large tables by selection in several passes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct values of a bracket that come to the driver; splitters for each quantile; steps of the sketch that proposes them.
FEW, SPLITTERS, ACCURACY = 20_000, 9, 10_000


@dataclass
class Search:
    """One order statistic of a column: the rank sought (from 0), and the closed bracket of values that holds it, `below` rows under it."""

    column: str
    rank: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    value: float | None = None

    def inside(self) -> Column:
        """Rows whose value may be the one sought."""
        c = F.col(self.column)
        out = c.isNotNull()
        return out & (c >= F.lit(self.low)) & (c <= F.lit(self.high)) if self.low is not None else out


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], few: int = FEW) -> dict[str, list[float | None]]:
    """For each column its quantiles by linear interpolation, as F.percentile gives them; None for a column without a value.

    No task holds a column's values. All columns go through the same passes: a sketch proposes splitters around each
    sought rank inside its bracket, an exact count of the rows under each splitter keeps the one gap that holds the
    rank, and so on until few distinct values are left, which are counted and fetched. A pass makes a bracket some
    thousand times smaller; ties cannot stop it, as a splitter that equals the value ends the search. NaN counts as
    the largest value. df is read once a pass, so save what is dear.
    """
    names = list(wanted)
    typed = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)))
    sizes = typed.agg(*(F.count(f"c{i}") for i in range(len(names)))).first()
    ranks = {}
    for i, c in enumerate(names):
        for q in wanted[c]:
            h = q * (sizes[i] - 1)
            for r in {int(h), min(int(h) + 1, sizes[i] - 1)} if sizes[i] else ():
                ranks.setdefault((i, r), Search(f"c{i}", r))
    open_ = list(ranks.values())
    while open_:
        # how many distinct values there are, at most `few` of which may come
        number = typed.agg(*(F.approx_count_distinct(F.when(s.inside(), F.col(s.column))) for s in open_)).first()
        near = [s for s, n in zip(open_, number) if n <= few]
        if near:
            counts: dict = {}  # ranks of one bracket share its values
            for s in near:
                bracket = (s.column, s.low, s.high)
                if bracket not in counts:
                    counts[bracket] = sorted((tuple(r) for r in typed.filter(s.inside()).groupBy(s.column).count().collect()), key=lambda r: (math.isnan(r[0]), r[0]))
                upto = s.below
                for value, n in counts[bracket]:
                    upto += n
                    if s.rank < upto:
                        s.value = value
                        break
            open_ = [s for s in open_ if s.value is None]
            continue
        size = typed.agg(*(F.count_if(s.inside()) for s in open_)).first()
        steps = [[min(1.0, max(0.0, (s.rank - s.below) / n + (k - SPLITTERS // 2) * 2 / ACCURACY)) for k in range(SPLITTERS)] for s, n in zip(open_, size)]
        found = typed.agg(*(F.percentile_approx(F.when(s.inside(), F.col(s.column)), [0.0, *step, 1.0], ACCURACY) for s, step in zip(open_, steps))).first()
        cuts = [sorted(set(x)) for x in found]
        under = typed.agg(*(F.count_if(s.inside() & (F.col(s.column) < F.lit(c))) for s, own in zip(open_, cuts) for c in own), *(F.count_if(F.col(s.column) == F.lit(c)) for s, own in zip(open_, cuts) for c in own)).first()
        total, at = len(under) // 2, 0
        for s, own in zip(open_, cuts):
            less, same = under[at:at + len(own)], under[total + at:total + at + len(own)]
            at += len(own)
            begin, target = s.below, s.rank - s.below
            for c, n, m in zip(own, less, same):
                if n <= target < n + m:
                    s.value = c
                if n <= target:
                    s.low, s.below = c, begin + n
            s.high = next((c for c, n in zip(own, less) if n > target), own[-1])
        open_ = [s for s in open_ if s.value is None]

    def quantile(i: int, q: float) -> float | None:
        if not sizes[i]:
            return None
        h = q * (sizes[i] - 1)
        low, high = ranks[i, int(h)].value, ranks[i, min(int(h) + 1, sizes[i] - 1)].value
        # as the engine does it, so that equal data give equal bits
        return low if low == high or h == int(h) else (int(h) + 1 - h) * low + (h - int(h)) * high

    return {c: [quantile(i, q) for q in wanted[c]] for i, c in enumerate(names)}


def with_quantiles(df: DataFrame, **wanted: tuple[str, float]) -> DataFrame:
    """df with columns of exact quantiles of its columns: name=(column, quantile). Names that df has already stay as they are."""
    new = {n: w for n, w in wanted.items() if n not in df.columns}
    if not new:
        return df
    columns: dict[str, list[float]] = {}
    for c, q in new.values():
        columns.setdefault(c, []).append(q)
    found = exact_quantiles(df, columns)
    return df.withColumns({n: F.lit(found[c][columns[c].index(q)]).cast("double") for n, (c, q) in new.items()})


def grouped_quantiles(df: DataFrame, group: str, column: str, wanted: dict[str, float], most: int = 1000) -> DataFrame:
    """(group, ...): exact quantiles of a column for each of at most `most` groups, by name; null for a group without a value.

    A group's values are a column of their own, so that a group of any size goes through the same passes.
    """
    names = [r[0] for r in df.select(group).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"over {most} groups: their percentiles fit into tasks, take F.percentile")
    own = df.select(*(F.when(F.col(group).eqNullSafe(F.lit(g)), F.col(column).cast("double")).alias(f"g{i}") for i, g in enumerate(names)))
    found = exact_quantiles(own, {f"g{i}": list(wanted.values()) for i in range(len(names))}) if names else {}
    kind = df.select(group).schema.fields[0].dataType.simpleString()
    return df.sparkSession.createDataFrame([(g, *found[f"g{i}"]) for i, g in enumerate(names)], ", ".join([f"{group} {kind}", *(f"{n} double" for n in wanted)]))
