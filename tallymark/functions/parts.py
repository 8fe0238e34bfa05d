"""Sums that can be stored per group and added up again.

A part is a value summed over rows. The rows it counts are picked by two
conditions: ``where`` looks at the row's own columns, ``dated`` only at the date
that a stored table is grouped by, so it can still be asked of stored sums. Sums
are stored exactly; ``finish`` turns the sum of all groups into what is shown.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_double(total: Column) -> Column:
    return F.coalesce(total.cast("double"), F.lit(0.0))


def _as_count(total: Column) -> Column:
    return F.coalesce(total.cast("bigint"), F.lit(0).cast("bigint"))


@dataclass(frozen=True)
class Part:
    value: Column
    where: Column | None = None
    dated: Column | None = None
    finish: Callable[[Column], Column] = _as_double
    counts: bool = False

    def direct(self) -> Column:
        """The aggregate over rows."""
        value = self.value
        for condition in (self.where, self.dated):
            value = value if condition is None else F.when(condition, value)
        return self.finish(F.count(value) if self.counts else F.sum(value))

    def stored(self) -> Column:
        """The exact aggregate over rows, to be kept per group."""
        value = self.value if self.where is None else F.when(self.where, self.value)
        return F.count(value) if self.counts else F.sum(value)

    def merged(self, name: str) -> Column:
        """The aggregate over stored groups, kept under ``name``."""
        kept = F.col(name)
        return self.finish(F.sum(kept if self.dated is None else F.when(self.dated, kept)))


def amount(c: Column, where: Column | None = None, dated: Column | None = None) -> Part:
    """Sum as double, 0.0 over no rows."""
    return Part(c, where, dated)


def positive(c: Column, where: Column | None = None, dated: Column | None = None) -> Part:
    """Sum of the positive values."""
    return Part(F.greatest(c, F.lit(0)), where, dated)


def tally(where: Column | None = None, dated: Column | None = None) -> Part:
    """Number of rows."""
    return Part(F.lit(1), where, dated, _as_count, counts=True)


def whole_amount(c: Column) -> Part:
    """Sum as a whole number."""
    return Part(c, finish=_as_count)


def exact(c: Column, where: Column | None = None, dated: Column | None = None) -> Part:
    """Sum in the column's own kind, 0 over no rows."""
    return Part(c, where, dated, lambda total: F.coalesce(total, F.lit(0)))
