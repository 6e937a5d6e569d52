"""Earth geometry as Column expressions: areas, offsets, transverse Mercator, equal area."""

from __future__ import annotations

from math import cos, radians, sin, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import _col

# Sphere radii (m) of the three cell-area forms and metres per degree.
R_MEAN = 6371008.8
R_ROUND = 6371000.0
M_PER_DEG_LAT = 111132.0
M_PER_DEG_LON_EQ = 111320.0

# WGS84 ellipsoid and the UTM grid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_FALSE_EAST = 500000.0
UTM_FALSE_NORTH_SOUTH = 10000000.0


def wrap_180(lon) -> Column:
    """0..360 longitudes to -180..180."""
    return F.pmod(_col(lon) + 180.0, F.lit(360.0)) - 180.0


def wrap_360(lon) -> Column:
    return F.pmod(_col(lon), F.lit(360.0))


def coslat(lat) -> Column:
    return F.cos(F.radians(_col(lat)))


def cell_area_km2(lat, dlat, dlon, form: str = "cosine") -> Column:
    """Area of a lat/lon cell in km².

    ``cosine``: mean radius, cosine at the centre; ``cosine_round``: the same with a 6371 km
    radius; ``band``: exact spherical band between the two edges, 6371 km radius.
    """
    lat = _col(lat)
    dlat = _col(dlat) if isinstance(dlat, (str, Column)) else F.lit(float(dlat))
    dlon = _col(dlon) if isinstance(dlon, (str, Column)) else F.lit(float(dlon))
    if form in ("cosine", "cosine_round"):
        r_km = (R_MEAN if form == "cosine" else R_ROUND) / 1000.0
        return F.lit(r_km * r_km) * F.abs(F.radians(dlat)) * F.abs(F.radians(dlon)) * coslat(lat)
    if form == "band":
        r_km = R_ROUND / 1000.0
        top, bottom = F.radians(lat + dlat / 2), F.radians(lat - dlat / 2)
        return F.lit(r_km * r_km) * F.abs(F.radians(dlon)) * F.abs(F.sin(top) - F.sin(bottom))
    raise ValueError("form must be 'cosine', 'cosine_round' or 'band'")


def metres_per_degree_lon(lat) -> Column:
    return F.greatest(F.lit(M_PER_DEG_LON_EQ) * coslat(lat), F.lit(1e-9))


def east_offset_m(lat, lon, lon0) -> Column:
    return (_col(lon) - lon0) * M_PER_DEG_LON_EQ * coslat(lat)


def north_offset_m(lat, lat0) -> Column:
    return (_col(lat) - lat0) * M_PER_DEG_LAT


def angle_between_deg(dot, length) -> Column:
    """Angle of a vector to a unit direction, from their dot product; safe at rounding edges."""
    cosine = _col(dot) / F.greatest(_col(length), F.lit(1e-12))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def utm_zone(lon) -> Column:
    return (F.floor((_col(lon) + 180.0) / 6.0) + 1).cast("int")


def utm_epsg(lat, lon) -> Column:
    return F.when(_col(lat) >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)


# Krüger series to third order in the third flattening n (published; error below 1 mm in a zone).
_N = WGS84_F / (2 - WGS84_F)
_RECT = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
    _N**2 / 48 + _N**3 / 15,
    17 * _N**3 / 480,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3,
    7 * _N**2 / 3 - 8 * _N**3 / 5,
    56 * _N**3 / 15,
)
_ECC = sqrt(WGS84_F * (2 - WGS84_F))


def central_meridian(zone) -> Column:
    return _col(zone) * 6.0 - 183.0


def utm_forward(lat, lon, zone, south) -> tuple[Column, Column]:
    """(easting, northing) in metres of the given UTM zone; ``zone`` and ``south`` are columns."""
    phi, dlam = F.radians(_col(lat)), F.radians(_col(lon) - central_meridian(zone))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * s))
    xi0 = F.atan2(t, F.cos(dlam))
    eta0 = F.atanh(F.sin(dlam) / F.sqrt(1 + t * t))
    xi, eta = xi0, eta0
    for j, a in enumerate(_ALPHA, start=1):
        xi = xi + F.lit(a) * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta + F.lit(a) * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    north0 = F.when(_col(south), F.lit(UTM_FALSE_NORTH_SOUTH)).otherwise(F.lit(0.0))
    return (
        F.lit(UTM_FALSE_EAST) + F.lit(UTM_K0 * _RECT) * eta,
        north0 + F.lit(UTM_K0 * _RECT) * xi,
    )


def utm_inverse(easting, northing, zone, south) -> tuple[Column, Column]:
    """(lat, lon) in degrees from UTM metres."""
    north0 = F.when(_col(south), F.lit(UTM_FALSE_NORTH_SOUTH)).otherwise(F.lit(0.0))
    xi = (_col(northing) - north0) / F.lit(UTM_K0 * _RECT)
    eta = (_col(easting) - F.lit(UTM_FALSE_EAST)) / F.lit(UTM_K0 * _RECT)
    xi0, eta0 = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xi0 = xi0 - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    phi = chi
    for j, d in enumerate(_DELTA, start=1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    lon = central_meridian(zone) + F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0)))
    return F.degrees(phi), lon


# Cylindrical equal area with a 30° standard parallel on WGS84 (the EASE-2 global form).
_K30 = cos(radians(30)) / sqrt(1 - (_ECC * sin(radians(30))) ** 2)


def equal_area_xy(lat, lon) -> tuple[Column, Column]:
    """Equal-area metres; shoelace areas of projected rings are true areas."""
    s = F.sin(F.radians(_col(lat)))
    q = F.lit(1 - _ECC**2) * (
        s / (1 - F.lit(_ECC**2) * s * s) + F.atanh(F.lit(_ECC) * s) / F.lit(_ECC)
    )
    return (
        F.lit(WGS84_A * _K30) * F.radians(_col(lon)),
        F.lit(WGS84_A / (2 * _K30)) * q,
    )
