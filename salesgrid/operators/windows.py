"""Windows of whole months. Bounds are columns, so nothing runs until the query does.

The data's own first and last month come from a table, through a scalar subquery, or from
`Months`, which were read once and are literals from then on. `sales_lines` hands a window's bounds
to the scan (`MonthWindow.bounds`).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesgrid.functions.dates import month_start


@dataclass(frozen=True)
class MonthWindow:
    """Half-open: from the first day of the first month up to, not including, `stop`.

    `literal`: both bounds are made of literals alone.
    """

    start: Column
    stop: Column
    literal: bool = False

    def has(self, col: str | Column = "date") -> Column:
        c = F.col(col) if isinstance(col, str) else col
        return (c >= self.start) & (c < self.stop)

    @property
    def end(self) -> Column:
        """Last day of the window."""
        return F.date_sub(self.stop, 1)

    @property
    def last_month(self) -> Column:
        return F.add_months(self.stop, -1)

    def shifted(self, months: int) -> "MonthWindow":
        start, stop = (F.add_months(c, months) for c in (self.start, self.stop))
        return MonthWindow(start, stop, self.literal)

    def bounds(self, spark: SparkSession, kind: str) -> tuple[Column, Column]:
        """Start and stop of the type `kind`, in a form that reaches a scan of such a column.

        A scan takes a literal, or a subquery whose value is compared as it is; a bound
        worked out from a subquery is therefore made the value of one.
        """
        ends = self.start.cast(kind), self.stop.cast(kind)
        if self.literal:
            return ends
        return tuple(spark.range(1).select(c.alias("v")).scalar() for c in ends)

    @classmethod
    def of(cls, start: str, stop: str) -> "MonthWindow":
        return cls(F.lit(start).cast("date"), F.lit(stop).cast("date"), True)

    @classmethod
    def period(cls, period: dict[str, Column], literal: bool = False) -> "MonthWindow":
        """The window of a `mat_period` or `ytd_period`."""
        return cls(period["start"], period["stop"], literal)


def hull(*windows: MonthWindow) -> MonthWindow:
    """From the first start to the last stop of the windows."""

    def ends(pick, side: str) -> Column:
        return reduce(pick, [getattr(w, side) for w in windows])

    return MonthWindow(
        ends(F.least, "start"), ends(F.greatest, "stop"), all(w.literal for w in windows)
    )


def with_prev_year(window: MonthWindow) -> MonthWindow:
    """The window and the same months a year earlier, as one span."""
    return hull(window.shifted(-12), window)


@dataclass(frozen=True)
class Months:
    """The first and last month of some data, null if there are none."""

    first: dt.date | None
    last: dt.date | None

    @classmethod
    def read(cls, df: DataFrame, col: str = "date") -> "Months":
        """Both bounds by one aggregate over the date column, run now."""
        return cls(*df.agg(month_start(F.min(col)), month_start(F.max(col))).first())


def first_month(df: DataFrame | Months, col: str = "date") -> Column:
    if isinstance(df, Months):
        return F.lit(df.first).cast("date")
    return df.agg(month_start(F.min(col)).alias("m")).scalar()


def last_month(df: DataFrame | Months, col: str = "date") -> Column:
    if isinstance(df, Months):
        return F.lit(df.last).cast("date")
    return df.agg(month_start(F.max(col)).alias("m")).scalar()


def clamped_end(df: DataFrame | Months, as_of: str, col: str = "date") -> Column:
    """The month before `as_of`'s month, or the data's last month if that is earlier."""
    before = F.add_months(F.trunc(F.lit(as_of).cast("date"), "MM"), -1)
    return F.least(before, last_month(df, col))


def _to_month(text: str) -> Column:
    return F.lit(text + "-01" if len(text) == 7 else text).cast("date")


def resolve_window(
    df: DataFrame | Months,
    mode: str | None = None,
    as_of: str | None = None,
    start: str | None = None,
    end: str | None = None,
    col: str = "date",
) -> MonthWindow:
    """ALL, MAT (12 months), YTD, or an explicit range whose end is clamped to the data.

    A full end date keeps its day; `YYYY-MM` means the whole month.
    """
    mode, known = (mode or "").upper(), isinstance(df, Months)
    if mode in ("MAT", "YTD"):
        if as_of is None:
            raise ValueError(f"{mode} needs as_of")
        last = clamped_end(df, as_of, col)
        first = F.add_months(last, -11) if mode == "MAT" else F.trunc(last, "YEAR")
        return MonthWindow(first, F.add_months(last, 1), known)
    if start is not None and end is not None:
        stop = (
            F.add_months(_to_month(end), 1) if len(end) == 7 else F.date_add(_to_month(end), 1)
        )
        return MonthWindow(_to_month(start), F.least(stop, F.add_months(last_month(df, col), 1)), known)
    if mode not in ("", "ALL"):
        raise ValueError(f"unknown window mode {mode}")
    return MonthWindow(first_month(df, col), F.add_months(last_month(df, col), 1), known)


def prev_year_window(window: MonthWindow) -> MonthWindow:
    """The same months one year earlier."""
    return window.shifted(-12)


def in_window(df: DataFrame, window: MonthWindow, col: str = "date") -> DataFrame:
    return df.filter(window.has(col))


def mat_period(year, anchor_month) -> dict[str, Column]:
    """Twelve months ending with the anchor month of `year`: start, end, stop, label."""
    y = F.lit(year) if isinstance(year, int) else year
    m = F.lit(anchor_month) if isinstance(anchor_month, int) else anchor_month
    last = F.make_date(y, m, F.lit(1))
    return {
        "label": F.concat(F.lit("MAT "), y.cast("string")),
        "start": F.add_months(last, -11),
        "end": F.last_day(last),
        "stop": F.add_months(last, 1),
    }


def ytd_period(year, end_month) -> dict[str, Column]:
    """January of `year` to its end month: start, end, stop, label."""
    y = F.lit(year) if isinstance(year, int) else year
    m = F.lit(end_month) if isinstance(end_month, int) else end_month
    last = F.make_date(y, m, F.lit(1))
    return {
        "label": F.concat(F.lit("YTD "), y.cast("string")),
        "start": F.trunc(last, "YEAR"),
        "end": F.last_day(last),
        "stop": F.add_months(last, 1),
    }
