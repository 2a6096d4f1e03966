"""Null-safe arithmetic and formatting helpers (all built-in, code-generated expressions).

Spark 4 runs with ANSI mode on: ``1/0`` and ``corr`` on a constant column raise.  The
reference's engines return NULL (Hive) or NaN (pandas) instead, so every division and
correlation here goes through ``try_divide``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL when b is 0 or NULL."""
    return F.try_divide(col_(a), col_(b))


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation as an aggregate; NULL when either column is constant."""
    a, b = col_(a), col_(b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def coef_variation(c: str | Column) -> Column:
    """stddev_pop / mean as an aggregate; NULL for a zero mean."""
    return F.try_divide(F.stddev_pop(col_(c)), F.avg(col_(c)))


def half_even(c: str | Column, digits: int = 0) -> Column:
    """Round half to even (document store ``$round``, Python ``round``)."""
    return F.bround(col_(c), digits)


def half_up(c: str | Column, digits: int = 0) -> Column:
    """Round half away from zero (warehouse ``ROUND``)."""
    return F.round(col_(c), digits)


def number_text(c: str | Column) -> Column:
    """Text of a rounded number; whole numbers print without a fraction ("5", "0.6")."""
    c = col_(c)
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def condition_key(op1: str = "op_setting_1", op2: str = "op_setting_2",
                  op3: str = "op_setting_3") -> Column:
    """Operating-condition label ``round(op1,0)-round(op2,1)-round(op3,0)`` (half even)."""
    return F.concat_ws(
        "-",
        number_text(half_even(op1, 0)),
        number_text(half_even(op2, 1)),
        number_text(half_even(op3, 0)),
    )


def cycle_bucket(c: str | Column = "time_cycles", width: int = 25) -> Column:
    """Start of the integer tumbling window of ``width`` cycles, as bigint."""
    return (F.floor(col_(c) / width) * width).cast("bigint")


def lifecycle_stage(c: str | Column = "time_cycles", early: int = 50, mid: int = 100) -> Column:
    c = col_(c)
    return F.when(c < early, F.lit("Early")).when(c < mid, F.lit("Mid")).otherwise(F.lit("Late"))


def round_columns(df: DataFrame, columns: Iterable[str] | None, digits: int | None, guard: int = 0) -> DataFrame:
    """Round the given double columns (presentation / comparison precision, half up).

    With ``guard``, first to that many digits more: a value that only the last bits of a double
    keep off a decimal tie is then rounded like the tie.

    One ``selectExpr`` call with SQL text: a projection over many columns costs one
    round trip to the JVM instead of several per column.
    """
    if digits is None or columns is None:
        return df
    cols = set(columns)

    def shown(name: str) -> str:
        return f"ROUND(`{name}`, {int(digits) + guard})" if guard else f"`{name}`"

    exprs = [f"ROUND({shown(f.name)}, {int(digits)}) AS `{f.name}`"
             if f.name in cols and f.dataType.typeName() in ("double", "float")
             else f"`{f.name}`" for f in df.schema.fields]
    return df.selectExpr(*exprs)
