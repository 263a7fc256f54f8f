"""Vectors: speed, direction, and rotation of grid-relative winds to east and north."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gas constant of dry air (J kg-1 K-1) and gravity (m s-2).
R_DRY = 287.05
GRAVITY = 9.80665


def speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def components(speed_cm_s: Column, toward_deg: Column) -> tuple[Column, Column]:
    """Speed in cm/s and the direction it flows toward, to u and v in m/s."""
    s = speed_cm_s / 100.0
    return s * F.sin(F.radians(toward_deg)), s * F.cos(F.radians(toward_deg))


def flip_dir(deg: Column) -> Column:
    """From where it comes to where it goes, or back."""
    return F.pmod(deg + 180.0, F.lit(360.0))


def rotate_by(u: Column, v: Column, angle: Column) -> tuple[Column, Column]:
    """East and north components, the grid's x axis being `angle` radians counterclockwise from east."""
    c, s = F.cos(angle), F.sin(angle)
    return c * u - s * v, s * u + c * v


def lambert_angle(lon: Column, cone: float, lov: float) -> Column:
    """The grid's angle from east (radians) on a Lambert conformal grid; negative of the convergence."""
    wrapped = F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    centre = math.fmod(lov + 540.0, 360.0) - 180.0
    return -F.radians((wrapped - centre) * cone)


def _unit(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    lon, lat = F.radians(lon), F.radians(lat)
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def _clip1(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def geographic_to_rotated(lon: Column, lat: Column, pole_lat: float, pole_lon: float) -> tuple[Column, Column]:
    """Rotated longitude and latitude on a grid whose south pole lies at (pole_lon, pole_lat)."""
    tilt = math.radians(90.0 + pole_lat)
    x, y, z = _unit(lon - pole_lon, lat)
    along = x * math.cos(tilt) + z * math.sin(tilt)
    up = z * math.cos(tilt) - x * math.sin(tilt)
    return F.degrees(F.atan2(y, along)), F.degrees(F.asin(_clip1(up)))


def rotated_to_geographic(rlon: Column, rlat: Column, pole_lat: float, pole_lon: float) -> tuple[Column, Column]:
    tilt = math.radians(90.0 + pole_lat)
    x, y, z = _unit(rlon, rlat)
    along = x * math.cos(tilt) - z * math.sin(tilt)
    up = z * math.cos(tilt) + x * math.sin(tilt)
    lon = F.pmod(F.degrees(F.atan2(y, along)) + (pole_lon + 180.0), F.lit(360.0)) - 180.0
    return lon, F.degrees(F.asin(_clip1(up)))


def rotated_pole_angle(lon: Column, lat: Column, pole_lat: float, pole_lon: float, step: float = 1e-3) -> Column:
    """Angle of the rotated grid's x axis from east, by a finite difference along rotated longitude."""
    rlon, rlat = geographic_to_rotated(lon, lat, pole_lat, pole_lon)
    lon1, lat1 = rotated_to_geographic(rlon, rlat, pole_lat, pole_lon)
    lon2, lat2 = rotated_to_geographic(rlon + step, rlat, pole_lat, pole_lon)
    east = (F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0) * F.cos(F.radians(lat1))
    return F.atan2(lat2 - lat1, east)


def omega_to_w(omega: Column, temperature: Column, pressure: Column) -> Column:
    """Vertical velocity (m/s, up) from omega (Pa/s), temperature (K) and pressure (Pa)."""
    density = pressure / (temperature * R_DRY)
    return -omega / (density * GRAVITY)


def centred_rate(acc: Column, next_acc: Column) -> Column:
    """Rate centred on t from the hourly accumulations ending at t and at t + 1 h."""
    return (acc + next_acc) / 7200.0
