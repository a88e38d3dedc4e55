"""Scalar weather functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_from(u: Column, v: Column) -> Column:
    """Bearing in degrees that the wind comes from."""
    return F.pmod(F.lit(270.0) - F.degrees(F.atan2(v, u)), F.lit(360.0))


def saturation_kpa(celsius: Column) -> Column:
    return 0.6108 * F.exp(17.27 * celsius / (celsius + 237.3))


def reference_et(pressure: Column, temperature: Column, dew_point: Column, wind: Column, radiation: Column) -> Column:
    """Daily reference evapotranspiration in mm by the FAO-56 equation, 0 at least.

    Pressure in kPa, temperatures in Celsius, wind in m/s at 2 m, net radiation in MJ per m2 and day.
    """
    slope = 4098 * saturation_kpa(temperature) / (temperature + 237.3) ** 2
    gamma = 0.665e-3 * pressure
    top = 0.408 * slope * radiation + gamma * 900 / (temperature + 273) * wind * (saturation_kpa(temperature) - saturation_kpa(dew_point))
    et = top / (slope + gamma * (1 + 0.34 * wind))
    return F.when(et.isNotNull(), F.greatest(et, F.lit(0.0)))


def planar_area_km2(square_degrees: Column, lat: Column) -> Column:
    """An area in square degrees around a latitude, for shapes of a few degrees; places.geodesic_area_km2 is exact."""
    return square_degrees * 111.0**2 * F.cos(F.radians(lat))


def size_tier(area: Column) -> Column:
    return F.when(area < 1500, "micro").when(area < 3500, "small").when(area < 6000, "medium").when(area < 9000, "large").otherwise("macro")


def spread_confidence(centre: Column, low: Column, high: Column) -> Column:
    """High, medium or low by the spread relative to the centre."""
    share = (high - low) / centre
    return F.when(centre.isNull() | (centre <= 0), None).when(share <= 0.5, "high").when(share <= 1.0, "medium").otherwise("low")
