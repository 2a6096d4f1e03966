"""Attaching one-row results (global statistics, thresholds) without a join.

Every other join strategy is left to AQE, which picks broadcast or shuffle joins from
measured sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row result (global statistics, thresholds) to every row.

    No join: the one-row frame becomes a scalar subquery (one struct value), computed once
    and reused wherever it is referenced.  Spark fails the query if it returns more than
    one row, so the size bound is enforced, not assumed.
    """
    cols = one_row.columns
    value = one_row.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_v")).scalar()
    return df.select("*", *[value.getField(c).alias(c) for c in cols])
