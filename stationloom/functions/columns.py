"""Column expressions that the levels share."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0


def number(col: Column) -> Column:
    """The column as double, NaN as null."""
    value = col.cast("double")
    return F.when(~F.isnan(value), value)


def rounded(col: Column, places: int) -> Column:
    """The column rounded as the SQL's engine does: the scaled double, halves away from zero.

    Spark's own ``round`` goes by the decimal digits that the double prints as, which parts from it near halves.
    """
    return F.round(col * 10.0**places) / 10.0**places


def season(month: Column) -> Column:
    """winter, spring, summer or autumn of a month's number."""
    return (
        F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").otherwise("autumn")
    )


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points by the haversine formula."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def dewpoint(temperature: Column, humidity: Column) -> Column:
    """Dewpoint by the Magnus formula; humidity is held between 0.1 and 100."""
    a, b = 17.625, 243.04
    rh = F.greatest(F.lit(0.1), F.least(F.lit(100.0), humidity))
    g = F.log(rh / 100) + a * temperature / (b + temperature)
    made = b * g / (a - g)
    return F.when(temperature.isNotNull() & humidity.isNotNull(), made)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of the pairs without null; null where one side is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    # constant sides are told by their range: sums of squares may miss zero by rounding
    flat = (F.max(x) == F.min(x)) | (F.max(y) == F.min(y))
    return F.when(~flat, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def quantile(value: Column, share: float, over: WindowSpec | None = None) -> Column:
    """Quantile with linear interpolation, nulls left out."""
    made = F.percentile(value, F.lit(share))
    return made.over(over) if over is not None else made
