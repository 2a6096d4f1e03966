"""Small shared pieces of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.functions.safe import round_columns


def subset(readings: DataFrame, dataset_id: str | None = None,
           dataset_type: str | None = None) -> DataFrame:
    """``R(ds, type)``: equality filters on the partition columns (pruned at the scan)."""
    df = readings
    if dataset_id is not None:
        df = df.where(F.col("dataset_id") == dataset_id)
    if dataset_type is not None:
        df = df.where(F.col("dataset_type") == dataset_type)
    return df


def finish(df: DataFrame, order: Sequence[Column | str] | None = None, limit: int | None = None,
           digits: int | None = None, round_cols: Sequence[str] | None = None, guard: int = 0) -> DataFrame:
    """Round aggregate columns (optional), then impose a total order and an optional top-k.

    Rounding happens before ordering so that values equal at the shown precision are ordered
    by the tie-break columns, whichever order the engine summed in.
    """
    if digits is not None and round_cols:
        df = round_columns(df, round_cols, digits, guard)
    if order:
        df = df.orderBy(*order)
    if limit is not None:
        df = df.limit(limit)
    return df
