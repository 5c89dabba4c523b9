"""Orbit quantities as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth's gravitational parameter (km3/s2) and equatorial radius (km). Fixed values.
MU, RADIUS = 398600.4418, 6378.137


def semi_major_axis(mean_motion: Column) -> Column:
    """km, from revolutions a day."""
    n = mean_motion * F.lit(2 * math.pi / 86400.0)
    return F.pow(F.lit(MU) / (n * n), F.lit(1.0 / 3.0))


def apogee(sma: Column, ecc: Column) -> Column:
    return sma * (F.lit(1.0) + ecc) - F.lit(RADIUS)


def perigee(sma: Column, ecc: Column) -> Column:
    return sma * (F.lit(1.0) - ecc) - F.lit(RADIUS)


def bin_edge(x: Column, width: float) -> Column:
    """Lower edge of x's bin, an integer."""
    return (F.floor(x / F.lit(float(width))) * F.lit(int(width))).cast("int")


def regime(perigee_km: Column, apogee_km: Column) -> Column:
    """By both altitudes: LEO, HEO, GEO (35786 +- 500 km), else MEO; UNKNOWN if either is missing."""
    inside = lambda c: c.between(35286, 36286)
    return F.when(perigee_km.isNull() | apogee_km.isNull(), "UNKNOWN").when(apogee_km < 2000, "LEO").when(perigee_km < 2000, "HEO").when(inside(perigee_km) & inside(apogee_km), "GEO").otherwise("MEO")


def regime_by_mean(altitude: Column) -> Column:
    """By mean altitude, the other definition in use: GEO is 35786 +- 200 km and all above it HEO."""
    return F.when(altitude.isNull(), "UNKNOWN").when(altitude < 2000, "LEO").when(altitude < 35586, "MEO").when(altitude <= 35986, "GEO").otherwise("HEO")


def storm_level(kp_max_x10: Column) -> Column:
    """G1 to G5 by tenths of Kp, null for quiet days."""
    return F.when(kp_max_x10 >= 90, "G5").when(kp_max_x10 >= 80, "G4").when(kp_max_x10 >= 70, "G3").when(kp_max_x10 >= 60, "G2").when(kp_max_x10 >= 50, "G1")


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    """Share in per cent as a double, null for an empty whole."""
    return F.round(F.lit(100.0) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), places)


def percent_or_zero(part: Column, whole: Column, places: int = 1) -> Column:
    """Share in per cent, 0.0 for an empty whole; halves go to the even digit."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), places))
