"""Exact discrete quantiles without collecting or sorting a column.

1. One scan builds a mergeable rank sketch (KLL) per group and column.  Its quantiles some
   multiples of the sketch's rank error beside the wanted rank bracket the value.
2. While a bracket still holds too many rows, a pass counts the rows below it and sketches the
   rows inside: the next bracket is about a fiftieth as wide.  Only groups the data model bounds
   are allowed, so a pass gives the driver a few numbers.
3. The last, lazy pass counts the rows below the bracket and sorts the few inside.

A table of ten million rows a group takes one scan and the last pass; 4e11 rows take two more.
An input whose columns take at most ``SMALL`` bytes is aggregated at once by Spark's own exact
quantile, which holds the distinct values of a group: the same result for less fixed cost.
The sketch's error is a matter of chance (about 1e-20 for the width taken); a bracket that
missed its rank would fail the query, not give another value.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Size of the sketch; its normalised rank error is below 2.3 / SKETCH ** 0.9 with 99 % chance,
# and a bracket takes four times that to either side.
SKETCH = 4096
# Rows of one bracket that the last pass may sort.
INSIDE = 100_000
# Quantiles that a narrowing pass looks up in its sketch.
GRID = 256
# Bytes of the columns (the optimizer's estimate) up to which one aggregate holds their values.
SMALL = 16 << 20
# Columns whose distinct values the data model bounds (four data sets, three types).
FIXED_GROUPS = frozenset(("dataset_id", "dataset_type"))


def attach_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Columns of ``right`` (one row per group) next to ``left``, NULL keys alike."""
    names = [c for c in right.columns if c not in keys]
    other = right.withColumnsRenamed({k: f"_group_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(other[f"_group_{k}"])
    return left.join(other, same, how).select(*[left[c] for c in left.columns], *names)


def known(column: str) -> Column:
    """The value as a double; NaN is no value."""
    c = F.col(column).cast("double")
    return F.when(~F.isnan(c), c)


@dataclass
class Bracket:
    """Values from ``lo`` to ``hi`` (none bounds nothing) hold the row of this rank."""

    group: tuple
    rank: int  # from 1, among all known rows of the group
    rows: int  # known rows inside, or an estimate
    lo: float | None = None
    hi: float | None = None

    def inside(self, value: Column) -> Column:
        if self.lo is None:
            return value.isNotNull()
        return value.between(F.lit(self.lo), F.lit(self.hi))

    def point(self) -> bool:
        return self.lo is not None and self.lo == self.hi


def _same_group(keys: Sequence[str], group: tuple) -> Column:
    ok = F.lit(True)
    for k, v in zip(keys, group, strict=True):
        ok = ok & F.col(k).eqNullSafe(F.lit(v))
    return ok


def _by_group(keys: Sequence[str], brackets: Sequence[Bracket], of) -> Column:
    """``of(bracket)`` of the row's group (NULL for a group without a bracket)."""
    out = F.when(F.lit(False), of(Bracket((), 1, 0, 0.0, 0.0)))
    for b in brackets:
        out = out.when(_same_group(keys, b.group), of(b))
    return out


def _narrowed(df: DataFrame, keys: list[str], wanted: Mapping[str, tuple[str, float]], found: dict[str, list[Bracket]],
              sketch: int) -> dict[str, list[Bracket]]:
    """The brackets after one more pass over the rows."""
    margin = 4 * 2.3 / sketch ** 0.9
    aggs = []
    for i, (name, (c, _)) in enumerate(wanted.items()):
        inside = _by_group(keys, found[name], lambda b, c=c: b.inside(known(c)))
        below = _by_group(keys, found[name], lambda b, c=c: F.lit(False) if b.lo is None else known(c) < F.lit(b.lo))
        aggs += [F.count_if(below).alias(f"b{i}"), F.count_if(inside).alias(f"n{i}"),
                 F.kll_sketch_agg_double(F.when(inside, known(c)), sketch).alias(f"s{i}")]
    sketches = df.groupBy(*keys).agg(*aggs)
    # The ends' ranks inside the brackets are known only with the counts, so a grid of quantiles
    # comes here and the next wider grid points are taken.
    grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    rows = sketches.select(*keys, *[x for i in range(len(wanted)) for x in (
        f"b{i}", f"n{i}", F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", grid)).alias(f"g{i}"))]).collect()
    out: dict[str, list[Bracket]] = {}
    for i, name in enumerate(wanted):
        ranks = {b.group: b.rank for b in found[name]}
        out[name] = []
        for r in rows:
            group, n = tuple(r[k] for k in keys), r[f"n{i}"]
            if group not in ranks or not n:
                continue
            place = (ranks[group] - r[f"b{i}"]) / n
            lo = max(0, math.floor((place - margin) * GRID))
            hi = min(GRID, math.ceil((place + margin) * GRID))
            out[name].append(Bracket(group, ranks[group], int((hi - lo) / GRID * n) + 1, r[f"g{i}"][lo], r[f"g{i}"][hi]))
    return out


def exact_quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]],
                    sketch: int = SKETCH, inside: int = INSIDE, small: int = SMALL) -> DataFrame:
    """Per group of ``keys``, for every ``name: (column, q)`` the smallest value whose share
    of the known rows (neither NULL nor NaN) up to it is at least ``q`` (discrete quantile);
    NULL without values.

    ``keys`` must be among the columns that the data model bounds.  The scans that narrow the
    brackets run when this is called; the result is lazy."""
    keys = list(keys)
    if not FIXED_GROUPS.issuperset(keys):
        raise ValueError(f"quantiles by {keys}: only groups by {sorted(FIXED_GROUPS)} are bounded")
    rows = df.select(*keys, *sorted({c for c, _ in wanted.values()}))
    if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= small:
        types = dict(rows.dtypes)
        return rows.groupBy(*keys).agg(*[
            F.expr(f"percentile_disc({float(q)}D) WITHIN GROUP (ORDER BY nullif(CAST(`{c}` AS DOUBLE), double('NaN')))")
            .cast(types[c]).alias(name) for name, (c, q) in wanted.items()])
    found = _first(df, keys, wanted, sketch)
    while any(b.rows > inside and not b.point() for bs in found.values() for b in bs):
        before = {(name, b.group): (b.lo, b.hi) for name, bs in found.items() for b in bs}
        found = _narrowed(df, keys, wanted, found, sketch)
        if before == {(name, b.group): (b.lo, b.hi) for name, bs in found.items() for b in bs}:
            break  # as narrow as the values allow
    aggs, values = [], []
    for i, (name, (c, _)) in enumerate(wanted.items()):
        bs = found[name]
        below = _by_group(keys, bs, lambda b, c=c: known(c) < F.lit(b.lo))
        held = _by_group(keys, bs, lambda b, c=c: F.lit(False) if b.point() else b.inside(known(c)))
        aggs += [F.count_if(below).alias(f"_below{i}"), F.collect_list(F.when(held, F.col(c))).alias(f"_list{i}"),
                 F.min(F.when(_by_group(keys, bs, lambda b, c=c: known(c) == F.lit(b.lo)), F.col(c))).alias(f"_lo{i}")]
        rank, point, some = (_by_group(keys, bs, of) for of in (
            lambda b: F.lit(b.rank), lambda b: F.lit(b.point()), lambda b: F.lit(True)))
        place = rank - F.lit(1) - F.col(f"_below{i}")
        exact = F.when(point, F.col(f"_lo{i}")).otherwise(F.get(F.sort_array(f"_list{i}"), place.cast("int")))
        values.append(F.when(some & exact.isNull(), F.raise_error(F.lit("a bracket misses its rank"))).otherwise(exact).alias(name))
    return df.groupBy(*keys).agg(*aggs).select(*keys, *values)


def _first(df: DataFrame, keys: list[str], wanted: Mapping[str, tuple[str, float]], sketch: int) -> dict[str, list[Bracket]]:
    """Brackets from one sketch per group and column."""
    margin = 4 * 2.3 / sketch ** 0.9
    columns = sorted({c for c, _ in wanted.values()})
    aggs = [x for i, c in enumerate(columns) for x in (F.count(known(c)).alias(f"n{i}"), F.kll_sketch_agg_double(known(c), sketch).alias(f"s{i}"))]
    ends = []
    for j, (c, q) in enumerate(wanted.values()):
        i = columns.index(c)
        for side, at in (("lo", max(0.0, q - margin)), ("hi", min(1.0, q + margin))):
            ends.append(F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", F.lit(at))).alias(f"{side}{j}"))
        ends.append(F.greatest(F.ceil(F.col(f"n{i}") * F.lit(q)), F.lit(1)).alias(f"rank{j}"))
        ends.append(F.col(f"n{i}").alias(f"all{j}"))
    rows = df.groupBy(*keys).agg(*aggs).select(*keys, *ends).collect()
    return {name: [Bracket(tuple(r[k] for k in keys), r[f"rank{j}"], int(2 * margin * r[f"all{j}"]) + 1, r[f"lo{j}"], r[f"hi{j}"])
                   for r in rows if r[f"all{j}"]] for j, name in enumerate(wanted)}
