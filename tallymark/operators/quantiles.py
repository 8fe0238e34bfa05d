"""Exact medians of many columns in bounded memory.

Sorting a whole column, or hashing all its distinct values, would end in one
task. Instead the two middle ranks are bracketed by histograms: each round
counts values per bin, combined per task, and keeps the bin the ranks fall in.
Only the last bracket, at most ``limit`` rows of a column, is ordered. The
driver sees bin counts only, ``bins`` per column and round.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ORDERED_ROWS = 50_000
BINS = 4096


@dataclass
class _Bracket:
    count: int          # values of the column
    lo: float
    hi: float
    below: int          # values under lo
    inside: int         # values in [lo, hi]
    found: float | None = None

    @property
    def ranks(self) -> tuple[int, int]:
        return (self.count - 1) // 2, self.count // 2

    def narrow(self, bins: list) -> None:
        """Move to the bin holding the middle ranks, given sorted bin counts."""
        first, second = self.ranks
        before, low_end = self.below, None
        for b in bins:
            after = before + b["n"]
            if low_end is None and first < after:
                if second < after:
                    self.lo, self.hi, self.below, self.inside = b["lo"], b["hi"], before, b["n"]
                    break
                low_end = b["hi"]
            elif low_end is not None and second < after:
                self.found = (low_end + b["lo"]) / 2
                break
            before = after
        if self.lo == self.hi:
            self.found = self.lo


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    long = values.unpivot([], [F.col(f"`{c}`") for c in columns], "column_name", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def _spans(df: DataFrame, columns: Sequence[str]) -> dict[str, _Bracket]:
    """Count and range of each column that has values, in one aggregation."""
    aggregates = []
    for i, name in enumerate(columns):
        x = F.col(f"`{name}`").cast("double")
        x = F.when(~F.isnan(x), x)
        aggregates += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*aggregates).first()
    out = {}
    for i, name in enumerate(columns):
        n, lo, hi = row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]
        if n:
            out[name] = _Bracket(n, lo, hi, 0, n, lo if lo == hi else None)
    return out


def _in_brackets(brackets: dict[str, _Bracket]) -> Column:
    keep = F.lit(False)
    for name, b in brackets.items():
        keep = keep | ((F.col("column_name") == name) & F.col("value").between(b.lo, b.hi))
    return keep


def _per_column(brackets: dict[str, _Bracket], value) -> Column:
    out = F.lit(None)
    for name, b in brackets.items():
        out = F.when(F.col("column_name") == name, F.lit(value(b))).otherwise(out)
    return out


def _histogram(long: DataFrame, wide: dict[str, _Bracket], bins: int) -> dict[str, list]:
    lo = _per_column(wide, lambda b: b.lo)
    # Halves keep the width finite for ranges close to the largest double.
    width = _per_column(wide, lambda b: b.hi / 2 - b.lo / 2)
    place = F.least(F.floor((F.col("value") / 2 - lo / 2) / width * bins), F.lit(bins - 1))
    rows = (long.filter(_in_brackets(wide))
            .groupBy("column_name", place.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"),
                 F.max("value").alias("hi"))
            .collect())
    found: dict[str, list] = {name: [] for name in wide}
    for r in rows:
        found[r["column_name"]].append(r)
    return {name: sorted(rs, key=lambda r: r["bin"]) for name, rs in found.items()}


def exact_medians(df: DataFrame, columns: Sequence[str], limit: int = MAX_ORDERED_ROWS,
                  bins: int = BINS) -> DataFrame:
    """(column_name, median): the middle value, or the mean of the middle two."""
    long = _long(df, columns)
    brackets = _spans(df, columns)
    while True:
        wide = {name: b for name, b in brackets.items() if b.found is None and b.inside > limit}
        if not wide:
            break
        for name, counts in _histogram(long, wide, bins).items():
            wide[name].narrow(counts)

    spark = df.sparkSession
    known = [(name, b.found) for name, b in brackets.items() if b.found is not None]
    known += [(name, None) for name in columns if name not in brackets]
    settled = spark.createDataFrame(known, "column_name string, median double")
    open_ = {name: b for name, b in brackets.items() if b.found is None}
    if not open_:
        return settled
    counts = long.filter(_in_brackets(open_)).groupBy("column_name", "value").agg(
        F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("column_name").orderBy("value")
                           .rowsBetween(Window.unboundedPreceding, 0))
    first = _per_column(open_, lambda b: b.ranks[0] - b.below)
    second = _per_column(open_, lambda b: b.ranks[1] - b.below)
    upto_, before = F.col("upto"), F.col("upto") - F.col("n")
    middle = counts.withColumn("upto", upto).filter(
        ((before <= first) & (first < upto_)) | ((before <= second) & (second < upto_)))
    ordered = middle.groupBy("column_name").agg(
        ((F.min("value") + F.max("value")) / 2).alias("median"))
    return settled.unionByName(ordered)
