"""Units, coordinate systems, names and numbers."""

from __future__ import annotations

import math
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkmosaic.errors import InputError, ScaleError
from linkmosaic.sources.schema import RasterMeta

#: Square metres in a hectare and an acre; metres in a foot, feet in a metre.
HECTARE = 10000.0
ACRE = 4046.8564224
FOOT = 0.3048
FEET = 3.28084

LABELS = {"pixels": ("px", "px"), "metric": ("ha", "m"), "imperial": ("ac", "ft")}


def area_divisor(units: str) -> float:
    return {"pixels": 1.0, "metric": HECTARE, "imperial": ACRE}[units]


def distance_factor(units: str) -> float:
    return {"pixels": 1.0, "metric": 1.0, "imperial": FEET}[units]


def unit_labels(units: str) -> tuple[str, str]:
    """Labels of areas and distances."""
    return LABELS[units]


def is_projected(crs: int | None) -> bool:
    """EPSG code: unknown systems and those in degrees are not; the 4000s hold systems in degrees."""
    return crs is not None and not 4000 <= crs < 5000


def to_pixels(meta: RasterMeta, units: str, budget: float, min_patch: float, width: float, search: float) -> dict:
    """Budget and patch size in cells, width and search in cells, of user units."""
    if units not in LABELS:
        raise InputError(f"unknown units {units!r}")
    if units == "pixels":
        return {"budget": budget, "min_patch": min_patch, "width": width, "search": search}
    if not is_projected(meta.crs):
        raise ScaleError("metric and imperial units need a projected coordinate system")
    area, step = area_divisor(units), FOOT if units == "imperial" else 1.0
    return {
        "budget": budget * area / meta.cell_area,
        "min_patch": min_patch * area / meta.cell_area,
        "width": width * step / meta.res_mean,
        "search": search * step / meta.res_mean,
    }


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a place in degrees."""
    zone = F.floor((lon + 180) / 6) + 1
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("long")


def safe_name(col: Column, most: int = 64) -> Column:
    """Runs of anything but letters, digits, _ and - become _; outer _ go; nothing left: layer."""
    name = F.trim(F.regexp_replace(col, r"[^A-Za-z0-9_-]+", "_"), F.lit("_"))
    return F.substring(F.when(F.coalesce(name, F.lit("")) == "", "layer").otherwise(name), 1, most)


def number(col: Column, digits: int = 2) -> Column:
    """Fixed digits, halves to the even one; null is empty."""
    return F.when(col.isNull(), "").otherwise(F.format_string(f"%.{digits}f", F.bround(col, digits)))


def byte_size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if abs(n) < 1024:
            return f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"


def default_output_dir(source: str | None = None) -> str:
    return os.path.dirname(source) or "." if source else os.getcwd()


def utm_forward(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in metres on the WGS 84 ellipsoid, by a sixth-order series in the third flattening."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = math.sqrt(f * (2 - f))
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = 0.9996
    return 500000 + k * big * east, k * big * north + F.when(lat < 0, 10000000.0).otherwise(0.0)


def utm_inverse(x: Column, y: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a UTM place."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    k = 0.9996
    xi0 = (y - F.when(south, 10000000.0).otherwise(0.0)) / (k * big)
    eta0 = (x - 500000) / (k * big)
    xi, eta = xi0, eta0
    for j, c in enumerate(beta, 1):
        xi = xi - c * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - c * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, c in enumerate(delta, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + zone * 6 - 183, F.degrees(lat)
