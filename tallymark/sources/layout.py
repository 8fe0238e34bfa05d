"""Tables laid out so that row-group statistics skip most of a file.

Rows are ordered along a space-filling curve over several columns: each column is
cut into bins of about equally many rows, and the bits of its bin number are
interleaved with those of the others. Rows close in every column then lie in the same
row groups, so a filter on any of the columns (a date preset, a status, a payer) reads
few of them. One sort over one column could serve only that column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.sources.writers import ROW_GROUP_BYTES, write_parquet

BIN_BITS = 6
TEXT_BYTES = 6
ACCURACY = 2_000  # of the quantiles that part the bins


def order_number(df: DataFrame, name: str) -> Column:
    """A number that rises with the column; of texts, their first bytes."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return c.cast("double")
    if isinstance(kind, T.NumericType):
        return F.when(~F.isnan(c.cast("double")), c.cast("double"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(c).cast("double")
    start = F.hex(F.substring(c.cast("string").cast("binary"), 1, TEXT_BYTES))
    return F.conv(F.rpad(start, 2 * TEXT_BYTES, "0"), 16, 10).cast("double")


def _bin(c: Column, splits: Sequence[float]) -> Column:
    """How many of ``splits`` are not above the number; 0 for null."""
    known = F.array(*[F.lit(s) for s in splits]).cast("array<double>")
    return F.when(c.isNotNull(), F.size(F.filter(known, lambda s: s <= c))).otherwise(0).cast("bigint")


def curve_key(df: DataFrame, names: Sequence[str], bits: int = BIN_BITS) -> Column:
    """Place of a row along the curve, nulls first; one aggregation finds the bins of all columns."""
    numbers = [order_number(df, n) for n in names]
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(c, shares, ACCURACY).alias(f"s{i}") for i, c in enumerate(numbers)]).first()
    key = F.lit(0).cast("bigint")
    for i, c in enumerate(numbers):
        splits = sorted(set(found[f"s{i}"] or []))
        place = _bin(c, splits)
        for bit in range(bits):
            one = F.shiftright(place, bit).bitwiseAND(F.lit(1))
            key = key + F.shiftleft(one, bit * len(names) + i)
    return key


def write_clustered(df: DataFrame, path: str, names: Sequence[str], files: int | None = None,
                    row_group_bytes: int = ROW_GROUP_BYTES, mode: str = "errorifexists") -> None:
    """Parquet ordered along the curve over ``names``.

    Ranges of the curve go to the files; rows of one place are dealt by a hash, so
    that a value of very many rows fills several files.
    """
    if not names or BIN_BITS * len(names) > 60:
        raise ValueError("one to ten columns")
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    keyed = df.select("*", curve_key(df, names).alias("_curve"), F.xxhash64(*plain).alias("_mix"))
    order = ["_curve", "_mix"]
    parted = keyed.repartitionByRange(files, *order) if files else keyed.repartitionByRange(*order)
    write_parquet(parted.sortWithinPartitions("_curve", *[F.col(f"`{n}`") for n in names]).drop(*order), path,
                  mode, row_group_bytes=row_group_bytes)
