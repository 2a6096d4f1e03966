"""Per-series (per engine unit) helpers that stay correct and balanced under key skew.

A plain ``Window.partitionBy(unit)`` sends every row of a unit to one task.  If one unit
held a third of the table, that task would sort a third of the data alone.  The helpers
below never do that:

* per-series scalars (max cycle, first value) are built with a grouped aggregate, which
  Spark computes partially on the map side, and joined back on the series key with a
  null-safe left join: no row is lost, and its keys force an exchange of the aggregate, so
  both sides are bare shuffles whose skewed partitions AQE can split;
* row numbers of whole series are computed per block of a coarse order column
  (``block_row_number``);
* first-k / last-k rows are reduced inside each input split before the shuffle: a window
  sees at most ``2 * k`` rows per split that holds the series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_series_aggregates(df: DataFrame, key: Sequence[str], *aggs: Column) -> DataFrame:
    """Add per-series aggregate columns to every row of the series (no window).

    Every row of ``df`` is kept: rows with a NULL key form a series like any other.  The
    join strategy is left to AQE: broadcast when the aggregate's measured size allows it,
    else a shuffle join with skewed partitions split.
    """
    per_series = df.groupBy(*key).agg(*aggs)
    names = [c for c in per_series.columns if c not in key]
    right = per_series.select(*[F.col(k).alias(f"_series_{k}") for k in key], *names)
    same = F.lit(True)
    for k in key:
        same = same & df[k].eqNullSafe(right[f"_series_{k}"])
    return df.join(right, same, "left").select(*[df[c] for c in df.columns], *names)


def first_by(value: str, order: str) -> Column:
    """Value of the first row by ``order`` as an aggregate; a NULL order comes first, as in
    ``FIRST_VALUE(value) OVER (ORDER BY order)``."""
    return F.min_by(value, F.struct(F.col(order).isNotNull(), F.col(order)))


def _ends_of_split(key: list[str], order: list[str], k_max: int):
    """The Arrow function that passes on the first and last ``k_max`` rows of every series of
    its input split, with ``_rows`` on the first of them: the series' rows in the split.

    What it holds are the ends of the series seen so far and the rows since the last cut."""

    def cut(rows: pa.Table) -> pa.Table:
        columns = {c: rows.column(c).to_pandas() for c in [*key, *order]}
        frame = pd.DataFrame(columns).sort_values([*key, *order], kind="stable", na_position="first")
        series = frame.groupby(key, dropna=False, sort=False)
        rank, back = series.cumcount(), series.cumcount(ascending=False)
        frame["_rows"] = rows.column("_rows").to_pandas()
        total = series["_rows"].transform("sum")
        ends = ((rank < k_max) | (back < k_max)).to_numpy()
        counts = total.where(rank == 0, 0)[ends]
        kept = rows.take(pa.array(frame.index[ends].to_numpy()))
        return kept.set_column(kept.schema.get_field_index("_rows"), "_rows", pa.array(counts, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows, last = 0, 0
        for batch in batches:
            one = pa.array(np.ones(batch.num_rows, np.int64))
            held.append(pa.Table.from_batches([batch]).append_column("_rows", one))
            rows += batch.num_rows
            if rows > 2 * last + 100_000:  # twice what the last cut left: cuts cost a constant share
                held = [cut(pa.concat_tables(held))]
                rows = last = held[0].num_rows
        if held and rows:
            yield from cut(pa.concat_tables(held)).combine_chunks().to_batches()

    return run


def first_last_candidates(df: DataFrame, key: Sequence[str], order: Sequence[str], k_max: int = 10) -> DataFrame:
    """Rows that are among the first or last ``k_max`` of their series by ``order``.

    Adds ``asc_rank`` (1 = first row of the series), ``desc_rank`` (1 = last row) and
    ``series_rows`` (rows in the whole series).  Ranks are exact for ranks <= k_max, and
    ``order`` must be unique within a series.  Every series with at most ``k_max`` rows is
    returned whole.

    Each task first reduces its input split, so at most ``2 * k_max`` rows of a series and
    split are shuffled; every one of the series' first and last rows is among them, so ranks
    among the survivors are the true ranks up to ``k_max`` from either end."""
    key, order = list(key), list(order)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    ends = df.mapInArrow(_ends_of_split(key, order, k_max), f"{types}, _rows long")
    whole = Window.partitionBy(*key)
    return (
        ends
        .withColumn("asc_rank", F.row_number().over(whole.orderBy(*[F.col(c).asc() for c in order])))
        .withColumn("_nc", F.count(F.lit(1)).over(whole))
        .withColumn("desc_rank", F.col("_nc") - F.col("asc_rank") + 1)
        .withColumn("series_rows", F.sum("_rows").over(whole))
        .drop("_rows", "_nc")
    )


def block_row_number(df: DataFrame, key: Sequence[str], order: Sequence[str],
                     block: str | Column, name: str = "row_number",
                     partitions: int | None = None) -> DataFrame:
    """``row_number()`` over ``partitionBy(key).orderBy(order)`` without sorting a whole
    series in one task.  Rows with a NULL in the key are left out; those with a NULL block come
    first in their series and take numbers, but are left out of the result.

    ``block`` must be a coarse column that never decreases along ``order`` (for instance the
    year of its first, date-like column).  Rows are counted per (series, block); a window over
    that small count table gives each block's offset (rows of the series in earlier blocks).
    Every offset travels with its block's rows as one more row ahead of them, so the rows are
    shuffled once and joined with nothing: a row's number is its rank inside the block plus the
    offset at the block's head.  The largest sort is one block of one series.

    The result lies in ``partitions`` ranges (by default the shuffle-partition setting) of
    (key, block), sorted by key, block and order."""
    key, order = list(key), list(order)
    b = F.col(block) if isinstance(block, str) else block
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    df = df.withColumn("_blk", b).where(known)
    counts = df.groupBy(*key, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        *key, "_blk",
        F.coalesce(F.sum("_n").over(
            Window.partitionBy(*key).orderBy("_blk")
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.lit(False).alias("_row")).where(F.col("_blk").isNotNull())
    rows = df.where(F.col("_blk").isNotNull()).withColumn("_off", F.lit(None).cast("bigint")).withColumn("_row", F.lit(True))
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = rows.unionByName(offsets, allowMissingColumns=True).repartitionByRange(n, *key, "_blk")
    inside = Window.partitionBy(*key, "_blk").orderBy("_row", *order)  # the offset's row first
    head = F.first("_off").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (both.withColumn("_local", F.row_number().over(inside) - 1).withColumn("_off", head).where("_row")
            .withColumn(name, F.col("_off") + F.col("_local")).drop("_blk", "_local", "_off", "_row"))
