"""Means that do not depend on the order of the rows.

A sum of doubles changes in its last digits with the order in which partial sums arrive, so a
mean on a decimal tie could be rounded either way from run to run.  Here a value is cut at a
fixed grid into three whole numbers, whose sums are exact in any order: ``floor(x * 2**10)``, the
rest of it in units of ``2**-34``, and the rest of that in units of ``2**-58`` (all 53 bits of
values from a 32nd on).  The mean is the same double bit for bit, whatever the splits, the
retries and the number of tasks, and as near to the exact mean as doubles allow.

Values of 2**20 and more, infinite values and NaN are summed as doubles in the third sum (values
above 1e290 as infinite).  The exact sums hold ``2**53 / |x|`` rows a group (9e12 rows of values
below 1,000); beyond that Spark's integer sum fails, it does not wrap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def with_parts(df: DataFrame, keep: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``keep`` and the double ``columns``, each of these with its parts ``_h_, _m_, _l_<column>``:
    whole numbers of 2**-10, of 2**-34 and of 2**-58.  All scaling is by powers of two, so exact."""
    head = [f"`{k}`" for k in keep] + [f"`{c}`" for c in columns]
    step = df.selectExpr(*head, *[f"CASE WHEN abs(`{c}`) < 1048576 THEN floor(`{c}` * 1024) END AS `_h_{c}`" for c in columns])
    step = step.selectExpr(*head, *[x for c in columns for x in (
        f"`_h_{c}`", f"(`{c}` * 1024 - `_h_{c}`) * 16777216 AS `_r_{c}`")])
    return step.selectExpr(*head, *[x for c in columns for x in (
        f"`_h_{c}`", f"floor(`_r_{c}`) AS `_m_{c}`",
        f"CASE WHEN `_h_{c}` IS NULL THEN `{c}` * 288230376151711744D "  # 2**58
        f"ELSE rint((`_r_{c}` - floor(`_r_{c}`)) * 16777216) END AS `_l_{c}`")])


# Fields of partial state a mean takes.
FIELDS = 4


def mean_text(column: str) -> str:
    """SQL text of the mean of a column of ``with_parts``; NULL without values."""
    high, mid, low = (f"coalesce(sum(`_{x}_{column}`), 0)" for x in "hml")
    return f"try_divide(({high} + ({mid} + {low} / 16777216D) / 16777216D) / 1024D, count(`{column}`))"
