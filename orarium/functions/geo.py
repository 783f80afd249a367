"""Distances, boxes and the sun, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. Two radii are in use and must stay apart: the mean radius for distances shown,
# a rounded one for comparing registry locations.
EARTH_RADIUS_METRES = 6_371_008.8
REGISTRY_RADIUS_METRES = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_METRES) -> Column:
    """Great-circle distance in metres; null where a coordinate is."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(half.isNotNull(), 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(half))))


def in_box(lat: Column, lon: Column, west, south, east, north, margin: float = 0.0) -> Column:
    return lat.between(F.lit(south) - margin if not isinstance(south, Column) else south - margin, F.lit(north) + margin if not isinstance(north, Column) else north + margin) & lon.between(F.lit(west) - margin if not isinstance(west, Column) else west - margin, F.lit(east) + margin if not isinstance(east, Column) else east + margin)


def box_area(west: Column, south: Column, east: Column, north: Column) -> Column:
    return (east - west) * (north - south)


def cell(lat: Column, lon: Column, degrees: float) -> Column:
    """The grid cell of a point, as a key for equi joins."""
    return F.struct(F.floor(lat / degrees).alias("y"), F.floor(lon / degrees).alias("x"))


def round_coordinate(x: Column, digits: int = 5) -> Column:
    """Half up, also below zero."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def sun_elevation(at: Column, lat: Column, lon: Column) -> Column:
    """Degrees of the sun above the horizon at an instant: the low-precision almanac formulas."""
    # Degrees, and degrees or hours a day since noon of 1 January 2000 (UTC).
    anomaly_at, anomaly_rate = 357.529, 0.98560028
    longitude_at, longitude_rate = 280.459, 0.98564736
    centre_first, centre_second = 1.915, 0.020
    tilt_at, tilt_rate = 23.439, -0.00000036
    sidereal_at, sidereal_rate = 18.697374558, 24.06570982441908
    days = F.unix_micros(at) / 86_400_000_000 - 10_957.5
    anomaly = F.radians(F.lit(anomaly_at) + F.lit(anomaly_rate) * days)
    seen = F.radians(F.lit(longitude_at) + F.lit(longitude_rate) * days + centre_first * F.sin(anomaly) + centre_second * F.sin(2 * anomaly))
    tilt = F.radians(F.lit(tilt_at) + F.lit(tilt_rate) * days)
    declination = F.asin(F.sin(tilt) * F.sin(seen))
    ascension = F.atan2(F.cos(tilt) * F.sin(seen), F.cos(seen))
    hour_angle = F.radians((F.lit(sidereal_at) + F.lit(sidereal_rate) * days) % 24 * 15 + lon) - ascension
    return F.degrees(F.asin(F.sin(F.radians(lat)) * F.sin(declination) + F.cos(F.radians(lat)) * F.cos(declination) * F.cos(hour_angle)))


def sun_is_down(at: Column, lat: Column, lon: Column) -> Column:
    """Below the horizon, with refraction and the sun's radius as sunset is timed."""
    return sun_elevation(at, lat, lon) < -0.833


def curve(lat: Column, lon: Column, bits: int = 16) -> Column:
    """A place's number on a space-filling curve: the bits of its row and column, of 2 ** bits each, take turns. Places with
    near numbers lie near each other, so files in its order hold compact areas."""
    steps = 1 << bits
    index = lambda share: F.greatest(F.lit(0), F.least(F.floor(share * steps), F.lit(steps - 1))).cast("bigint")
    y, x = index((lat + 90) / 180), index((lon + 180) / 360)
    out = F.lit(0).cast("bigint")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(y, k).bitwiseAND(F.lit(1)), 2 * k + 1)).bitwiseOR(F.shiftleft(F.shiftright(x, k).bitwiseAND(F.lit(1)), 2 * k))
    return out
