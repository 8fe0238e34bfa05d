"""Running totals that survive a hot key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Running:
    """Totals of ``amounts`` along each key, by output name."""
    keys: Sequence[str]
    amounts: Mapping[str, Column]


def running_totals(df: DataFrame, order: Sequence[str], bucket: Column,
                   *totals: Running) -> DataFrame:
    """Add, per key, the running sum of each amount up to and including the row.

    A plain window would sort all rows of a key in one task. Here rows are
    windowed within (key, bucket) only, and the total of earlier buckets is
    added, so one key may hold most of the table. ``bucket`` must not decrease
    along ``order`` (an hour of the upload time, a range of the sequence
    number); no two rows of a key may tie on ``order``.
    """
    rows = df.withColumn("_bucket", bucket)
    amounts = {n: c for t in totals for n, c in t.amounts.items()}
    rows = rows.withColumns({f"_add_{n}": c for n, c in amounts.items()})
    out = rows
    for i, t in enumerate(totals):
        offsets = _earlier_buckets(rows, t, i)
        match = F.col("_bucket").eqNullSafe(F.col(f"_bucket_{i}"))
        for j, key in enumerate(t.keys):
            match = match & F.col(key).eqNullSafe(F.col(f"_key_{i}_{j}"))
        within = Window.partitionBy(*t.keys, "_bucket").orderBy(*order).rowsBetween(
            Window.unboundedPreceding, 0)
        local = out.withColumns({n: F.sum(f"_add_{n}").over(within) for n in t.amounts})
        out = local.join(offsets, match).withColumns(
            {n: F.col(n) + F.col(f"_before_{n}") for n in t.amounts})
    return out.select(*df.columns, *amounts)


def _earlier_buckets(rows: DataFrame, t: Running, i: int) -> DataFrame:
    """Per key and bucket, the total of the buckets before it: few rows per key."""
    sums = rows.groupBy(*t.keys, "_bucket").agg(
        *[F.sum(f"_add_{n}").alias(f"_sum_{n}") for n in t.amounts])
    before = Window.partitionBy(*t.keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    return sums.select(
        *[F.col(key).alias(f"_key_{i}_{j}") for j, key in enumerate(t.keys)],
        F.col("_bucket").alias(f"_bucket_{i}"),
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_before_{n}")
          for n in t.amounts])
