"""Distances, travel costs and the UTM to longitude/latitude conversion."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rollbook import constants as K


def scale_degrees(stored: Column, scale: float = K.DEGREE_SCALE) -> Column:
    """Degrees from coordinates stored as scaled integers."""
    return stored / F.lit(scale)


def sphere_km(
    lng1: Column, lat1: Column, lng2: Column, lat2: Column,
    radius_km: float = K.SPHERE_RADIUS_KM,
) -> Column:
    """Great-circle distance in km, stable for near and antipodal points."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    turn = F.radians(lng2 - lng1)
    across = F.cos(p2) * F.sin(turn)
    along = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(turn)
    facing = F.sin(p1) * F.sin(p2) + F.cos(p1) * F.cos(p2) * F.cos(turn)
    return F.atan2(F.sqrt(across * across + along * along), facing) * radius_km


def origin_km(lng: Column, lat: Column,
              origin: tuple[float, float] = (K.ORIGIN_LNG, K.ORIGIN_LAT)) -> Column:
    """Distance from a fixed point, given as (longitude, latitude)."""
    return sphere_km(F.lit(origin[0]), F.lit(origin[1]), lng, lat)


def travel_euros(
    km: Column, fuel: float = K.FUEL_EUROS_PER_LITRE, wear: float = K.WEAR_EUROS,
    km_per_litre: float = K.KM_PER_LITRE, trips: float = 2.0,
) -> Column:
    """Transport cost of a round trip."""
    return km * trips / km_per_litre * (fuel + wear)


def utm_to_lonlat(
    easting: Column, northing: Column,
    central_meridian: float = K.UTM_CENTRAL_MERIDIAN,
    false_northing: float = K.UTM_FALSE_NORTHING,
) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees: inverse Krueger series, third order."""
    n = K.WGS84_FLATTENING / (2 - K.WGS84_FLATTENING)
    rectifying = K.WGS84_RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96,
        n**2 / 48 + n**3 / 15,
        17 * n**3 / 480,
    )
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3,
        7 * n**2 / 3 - 8 * n**3 / 5,
        56 * n**3 / 15,
    )
    xi = (northing - false_northing) / (K.UTM_SCALE * rectifying)
    eta = (easting - K.UTM_FALSE_EASTING) / (K.UTM_SCALE * rectifying)
    xi_0, eta_0 = xi, eta
    for j, b in enumerate(beta, start=1):
        xi_0 = xi_0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta_0 = eta_0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi_0) / F.cosh(eta_0))
    lat = chi
    for j, d in enumerate(delta, start=1):
        lat = lat + d * F.sin(2 * j * chi)
    lng = F.lit(central_meridian) + F.degrees(F.atan2(F.sinh(eta_0), F.cos(xi_0)))
    return lng, F.degrees(lat)
