"""Period arithmetic on dates and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_index(ts: Column) -> Column:
    """Quarters since year 0: an integer axis without gaps."""
    return (F.year(ts) * 4 + F.quarter(ts) - 1).cast("int")


def month_index(ts: Column) -> Column:
    return (F.year(ts) * 12 + F.month(ts)).cast("int")


def quarter_start(ts: Column) -> Column:
    return F.trunc(ts, "quarter")


def fiscal_year(ts: Column, first_month: int = 4) -> Column:
    """Year in which the fiscal year that holds ts began."""
    return (F.year(ts) - (F.month(ts) < first_month).cast("int")).cast("int")


def calendar_months_between(a: Column, b: Column) -> Column:
    """Calendar months from a to b, days ignored."""
    return month_index(b) - month_index(a)


def fractional_months_between(a: Column, b: Column, days: float = 30.4375) -> Column:
    return F.datediff(b, a) / F.lit(days)


def add_months(ts: Column, n: Column) -> Column:
    """Date n months on, n rounded half away from zero."""
    return F.add_months(ts, F.round(n).cast("int"))


def loose_month(text: Column, formats: tuple[str, ...] = ("MM/yyyy", "MMM-yy", "yyyy-M", "yyyy-MM-dd")) -> Column:
    """First month that one of the formats reads from text, or null."""
    return F.coalesce(*[F.trunc(F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date"), "month") for f in formats])


def partial_date(text: Column) -> Column:
    """A struct of date and precision (year, month or day) from YYYY, YYYY-MM or YYYY-MM-DD; null otherwise."""
    t = F.trim(text)
    length = F.length(t)
    full = F.concat(t, F.when(length == 4, F.lit("-01-01")).when(length == 7, F.lit("-01")).otherwise(F.lit("")))
    date = F.when(t.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$"), F.try_to_timestamp(full, F.lit("yyyy-MM-dd")).cast("date"))
    precision = F.when(length == 4, F.lit("year")).when(length == 7, F.lit("month")).otherwise(F.lit("day"))
    return F.when(date.isNotNull(), F.struct(date.alias("date"), precision.alias("precision")))


def stage_at(asof: Column, milestones: list[tuple[str, Column]], start: str) -> Column:
    """Name of the last of the ordered dated milestones reached by asof."""
    out = F.lit(start)
    for name, at in milestones:
        out = F.when(F.coalesce(at <= asof, F.lit(False)), F.lit(name)).otherwise(out)
    return out
