"""Exponential smoothing of monthly series, as expressions over one array of values a series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights that a fit tries, in the order in which equal errors are resolved.
LEVELS = (0.05, 0.2, 0.4, 0.6, 0.8)
TRENDS = (0.01, 0.1, 0.3)
SEASONS = (0.05, 0.2, 0.4)
DAMPINGS = (0.8, 0.9, 0.98)


def grid(seasonal: bool) -> list[tuple[int, float, float, float, float]]:
    """(place, level, trend, season, damping) of every combination of weights."""
    found = [(lw, tw, sw, d) for lw in LEVELS for tw in TRENDS
             for sw in (SEASONS if seasonal else (0.0,)) for d in DAMPINGS]
    return [(i, *w) for i, w in enumerate(found)]


def grid_column(seasonal: bool) -> Column:
    names = ("place", "level_w", "trend_w", "season_w", "damp")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)])
                     for row in grid(seasonal)])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _mean(values: Column, n: int) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, x: t + x) / n


def _state(level: Column, slope: Column, pattern: Column, squares: Column) -> Column:
    return F.struct(level.alias("level"), slope.alias("slope"), pattern.alias("pattern"), squares.alias("squares"))


def smoothed(values: Column, w: Column, season: int) -> Column:
    """Level, slope, seasonal pattern and squared one-step errors after all values.

    ``w`` holds the weights of one grid row. The trend is damped; with a season, the pattern is a ring
    of ``season`` offsets of which the first belongs to the next month.
    """
    if season:
        def begun(first: Column) -> Column:
            second = _mean(F.slice(values, season + 1, season), season)
            return _state(first, (second - first) / season,
                          F.transform(F.slice(values, 1, season), lambda v: v - first), F.lit(0.0))

        start = _let(_mean(F.slice(values, 1, season), season), begun)
    else:
        start = _state(F.get(values, F.lit(0)), F.get(values, F.lit(1)) - F.get(values, F.lit(0)),
                       F.array(F.lit(0.0)), F.lit(0.0))

    def step(s: Column, actual: Column) -> Column:
        offset = F.get(s["pattern"], F.lit(0))
        carried = s["level"] + w["damp"] * s["slope"]
        error = actual - (carried + offset)
        level = w["level_w"] * (actual - offset) + (1 - w["level_w"]) * carried

        def moved(now: Column) -> Column:
            slope = w["trend_w"] * (now - s["level"]) + (1 - w["trend_w"]) * w["damp"] * s["slope"]
            pattern = s["pattern"]
            if season:
                renewed = w["season_w"] * (actual - now) + (1 - w["season_w"]) * offset
                pattern = F.concat(F.slice(pattern, 2, season - 1), F.array(renewed))
            return _state(now, slope, pattern, s["squares"] + error * error)

        return _let(level, moved)

    return F.aggregate(values, start, step)


def ahead(state: Column, damp: Column, periods: int, season: int) -> Column:
    """Forecasts of the next months: level, damped trend summed up, and the month's offset."""
    months = F.array(*[F.lit(h) for h in range(1, periods + 1)])

    def one(h: Column) -> Column:
        reach = F.aggregate(F.sequence(F.lit(1), h), F.lit(0.0), lambda t, i: t + F.pow(damp, i))
        offset = F.get(state["pattern"], (h - 1) % season) if season else F.lit(0.0)
        return state["level"] + reach * state["slope"] + offset

    return F.transform(months, one)
