"""Column expressions shared by the operators: coercions, rates, text clean-up, calendar terms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PER = 100_000.0
WEEKS_PER_YEAR = 52.1775


def number(c: Column, default: float | None = None) -> Column:
    """A double where the value can be read as one, else null or ``default``."""
    out = c.try_cast("double")
    out = F.when(F.isnan(out), F.lit(None)).otherwise(out)
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def day(c: Column) -> Column:
    """A date where the value can be read as one, else null."""
    return c.try_cast("timestamp").cast("date")


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")


def padded(c: Column, width: int = 2) -> Column:
    """Zero-padded on the left; longer values stay whole."""
    s = stripped(c)
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def rate(count: Column, population: Column, scale: float = PER, digits: int | None = None) -> Column:
    """``count`` per ``scale`` of ``population``; null where the population is null or 0."""
    out = F.try_divide(count.cast("double"), population.cast("double")) * F.lit(scale)
    return out if digits is None else F.bround(out, digits)


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def week_angle(week: Column, period: float = WEEKS_PER_YEAR, k: int = 1) -> Column:
    return week.cast("double") * F.lit(2 * math.pi * k / period)


def change(short: Column, long: Column, metric: str) -> Column:
    """How a metric changes with the horizon: a difference for scores, else percent of the short value, null unless that is positive."""
    if metric in ("mda", "r2"):
        return F.bround(long - short, 3)
    return F.when(short > 0, F.bround((F.try_divide(long, short) - 1) * 100, 1))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
