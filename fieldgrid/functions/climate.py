"""Unit conversions and humidity from temperature and dew point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the Magnus form of saturation vapour pressure, and unit factors.
MAGNUS_A = 17.625
MAGNUS_B = 243.04
KELVIN_OFFSET = 273.15
METRES_PER_SECOND_TO_MM_PER_DAY = 8.64e7
NDVI_SCALE = {"modis": 10000.0, "sentinel": 200.0}


def kelvin_to_celsius(value: Column) -> Column:
    return value - F.lit(KELVIN_OFFSET)


def rate_to_mm_per_day(value: Column) -> Column:
    """Metres per second to millimetres per day; negative rates become 0."""
    return F.when(value > 0, value * F.lit(METRES_PER_SECOND_TO_MM_PER_DAY)).when(value.isNotNull(), F.lit(0.0))


def _magnus(t: Column) -> Column:
    return F.exp(F.lit(MAGNUS_A) * t / (F.lit(MAGNUS_B) + t))


def relative_humidity(temperature: Column, dewpoint: Column) -> Column:
    """Percent, from temperatures in Celsius."""
    return F.lit(100.0) * _magnus(dewpoint) / _magnus(temperature)


def relative_humidity_sd(temperature: Column, temperature_sd: Column, dewpoint: Column, dewpoint_sd: Column) -> Column:
    """First-order error propagation of both input deviations."""
    rh = relative_humidity(temperature, dewpoint)

    def slope(t: Column) -> Column:
        return rh * F.lit(MAGNUS_A * MAGNUS_B) / F.pow(F.lit(MAGNUS_B) + t, 2)

    return F.sqrt(F.pow(slope(temperature) * temperature_sd, 2) + F.pow(slope(dewpoint) * dewpoint_sd, 2))


def scale_by_source(value: Column, source: Column, scale: dict[str, float] | None = None) -> Column:
    """Divide by the divisor of each source."""
    rule = None
    for name, divisor in (scale or NDVI_SCALE).items():
        branch = value / F.lit(float(divisor))
        rule = F.when(source == name, branch) if rule is None else rule.when(source == name, branch)
    return rule
