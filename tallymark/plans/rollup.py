"""One stored table of sums from which the whole deck is made.

Every report adds up a few sums over a range of one date. The rollup keeps these
sums for every value of each such date (service day, created day, billing day and
so on). There is one aggregation per date, combined per task before the shuffle, and
each reads only that date and what it adds up, so that most columns of the
encounters are read once; the reports then read nothing but the rollup. One
aggregation over all dates would update every sum once per row and date, which
took three times as long. Sums are exact and conditions on dates
(ages, "to today", the latest month) are asked of the stored dates, so one rollup
serves reports of any day, and rollups of two halves of a table merge into that of
the whole. Its size is that of the dates (times, where dates have them) and of the
distinct denial texts, not that of the encounters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.exprs import Encounters, MissingColumns
from tallymark.functions.parts import Part
from tallymark.operators import denials as D
from tallymark.operators import metrics as M
from tallymark.plans import reports as R
from tallymark.session import stage_table

KEYS = {"kind": "int", "ts": "timestamp_ntz", "year": "int", "quarter": "int", "text": "string", "state": "string"}


@dataclass(frozen=True)
class Slice:
    """What a report reads: sums by one date, by further keys, over some of the rows."""

    date: str | None
    parts: dict[str, Part]
    keys: tuple[str, ...] = ()
    rows: Column | None = None


def _parts(metrics: list[M.Metric]) -> dict[str, Part]:
    return {n: p for m in metrics for n, p in m.parts.items() if isinstance(p, Part)}


def _served(e: Encounters) -> Slice:
    return Slice(e.find("service_date"), _parts([M.row_count(), M.filtered_charges(e)]))


def _collected(e: Encounters) -> Slice:
    date = e.find("service_date")
    dated = None if date is None else e.time(date).isNotNull()
    kept = e.find("transaction_date") or date
    return Slice(kept, _parts([M.filtered_payments(e, where=dated)]))


def _denials(e: Encounters) -> Slice:
    e.need("state", "default", "No state column found")
    text = e.raw(e.need("denial", "default", "No denial description column found")).cast("string")
    values = D.denial_values(e)
    parts = {f"_{n}": Part(values[n], counts=n != "expected") for n in values}
    return Slice(None, parts, ("text", "state"), D.is_denial(text))


def _tool(e: Encounters) -> Slice:
    parts: dict[str, Part] = {}
    for metrics in (M.tool_visits, M.tool_charges, M.tool_gross, M.tool_net):
        try:
            parts |= _parts(metrics(e))
        except MissingColumns:
            continue
    return Slice(e.find("service_date", "tool_filter"), parts)


def _tool_ar(e: Encounters) -> Slice:
    parts: dict[str, Part] = {}
    for build in (M.tool_ar_parts, lambda e: _parts(M.summary_metrics(e, None))):
        try:
            parts |= build(e)
        except MissingColumns:
            continue
    return Slice(e.find("service_date", "tool"), parts)


def _aging(e: Encounters) -> Slice:
    return Slice(e.find("bill_date"), _parts([M.ar_31_60(e, None), M.ar_60_plus(e, None)]))


def _unbilled(e: Encounters) -> Slice:
    return Slice(e.need("service_date", "unbilled_week", ""), _parts(R.unbilled_metrics(e)))


# What the interactive tools read.
TOOL_SLICES = ("tool", "tool_ar")

# What each report reads; those whose columns are missing keep nothing and say so later.
SLICES: dict[str, Callable[[Encounters], Slice]] = {
    "progress": lambda e: Slice(e.find("service_date", "progress"), _parts(R.progress_metrics(e))),
    "totals": lambda e: Slice(e.find("service_date"), _parts([*R.total_metrics(e), M.days_in_ar_weekly(e, None)])),
    "aging": _aging,
    "period": lambda e: Slice(e.find("service_date", "period"), _parts(R.period_parts(e)),
                              tuple(c for c in ("year", "quarter") if c in e.columns)),
    "ar": lambda e: Slice(e.find("service_date"), _parts(R.ar_parts(e))),
    "created": lambda e: Slice(e.find("created_date") or e.find("service_date", "breakdown"),
                               _parts(R.created_metrics(e))),
    "served": _served,
    "collected": _collected,
    "month": lambda e: Slice(e.find("service_date", "month_to_date"), _parts(R.month_metrics(e))),
    "unbilled": _unbilled,
    "denials": _denials,
    "tool": _tool,
    "tool_ar": _tool_ar,
}


def _slices(e: Encounters) -> dict[str, Slice]:
    found = {}
    for name, build in SLICES.items():
        try:
            found[name] = build(e)
        except MissingColumns:
            continue
    return {n: s for n, s in found.items() if s.parts}


def _kind_of(s: Slice) -> tuple:
    """Slices that keep the same keys share their rows."""
    return s.date, s.keys


class Rollup(Encounters):
    """Stored sums that the reports read in place of the encounters.

    Knows the columns of the encounters; ``time`` is the stored date whatever the
    column, since every slice has one.
    """

    stored = True

    def __init__(self, df: DataFrame | Encounters, table: DataFrame | None = None,
                 only: tuple[str, ...] = tuple(SLICES)):
        source = Encounters.of(df)
        self.df, self.types, self.columns = source.df, source.types, source.columns
        self.slices = {n: s for n, s in _slices(source).items() if n in only}
        kinds = list(dict.fromkeys(_kind_of(s) for s in self.slices.values()))
        self.kinds = {n: kinds.index(_kind_of(s)) for n, s in self.slices.items()}
        self.held = self._columns()
        self.table = stage_table(self._sums(source), "rollup") if table is None else table

    def _columns(self) -> dict[tuple[str, str], str]:
        """Which stored column holds a part of a slice; equal sums are kept once."""
        named: dict[tuple, str] = {}
        return {(name, part): named.setdefault((str(p.value), str(p.where), p.counts), f"{name}{part}")
                for name, s in self.slices.items() for part, p in s.parts.items()}

    def time(self, name: str) -> Column:
        return F.col("ts")

    def slice(self, name: str) -> DataFrame:
        """The stored rows of a report, with its sums under their own names."""
        if name not in self.slices:
            return self.table.filter(F.lit(False))
        s = self.slices[name]
        return self.table.filter(F.col("kind") == self.kinds[name]).select(
            "ts", *s.keys, *[F.col(f"`{self.held[name, p]}`").alias(p) for p in s.parts])

    def _sums(self, e: Encounters) -> DataFrame:
        """One aggregation per date; each reads that date and the columns it adds up."""
        columns = {"text": e.find("denial"), "state": e.find("state"), "year": "year", "quarter": "quarter"}
        frames = []
        for kind in sorted(set(self.kinds.values())):
            mine = {n: s for n, s in self.slices.items() if self.kinds[n] == kind}
            first = next(iter(mine.values()))
            keys = {"kind": F.lit(kind), "ts": e.time(first.date) if first.date else F.lit(None)}
            for k in first.keys:
                keys[k] = (e.raw(columns[k]) if k in ("text", "state")
                           else e.number(columns[k]).cast("double").try_cast("int"))
            sums = {}
            for n, s in mine.items():
                for part, p in s.parts.items():
                    sums.setdefault(self.held[n, part], p.stored())
            rows = e.df if first.rows is None else e.df.filter(first.rows)
            frames.append(rows.groupBy(*[keys.get(k, F.lit(None)).cast(t).alias(k) for k, t in KEYS.items()])
                          .agg(*[c.alias(name) for name, c in sums.items()]))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def merge(self, other: Rollup) -> Rollup:
        """The rollup of both tables together; they must have the same columns."""
        both = self.table.unionByName(other.table)
        held = [c for c in self.table.columns if c not in KEYS]
        summed = both.groupBy(*KEYS).agg(*[F.sum(f"`{c}`").alias(c) for c in held])
        return Rollup(Encounters(self.df), summed, tuple(self.slices))

