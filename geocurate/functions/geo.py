"""Column functions on positions and headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid and UTM projection constants.
WGS84_SEMI_MAJOR_M = 6378137.0
WGS84_FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING_M = 500_000.0
UTM_FALSE_NORTHING_SOUTH_M = 10_000_000.0


def utm_zone(lon: Column) -> Column:
    """Zone number by longitude alone (no Norway / Svalbard exceptions)."""
    return ((lon + 180) / 6).cast("int") + 1


def utm(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing in metres of a WGS84 position.

    Transverse Mercator series of Snyder, "Map Projections: A Working Manual",
    equations 8-9, 8-10 and 3-21, written as one native expression tree.
    """
    e2 = WGS84_FLATTENING * (2 - WGS84_FLATTENING)
    ep2 = e2 / (1 - e2)
    e4, e6 = e2 * e2, e2 * e2 * e2

    phi = F.radians(lat)
    central = F.radians(((utm_zone(lon) - 1) * 6 - 177).cast("double"))
    cos_phi, tan_phi = F.cos(phi), F.tan(phi)

    nu = F.lit(WGS84_SEMI_MAJOR_M) / F.sqrt(1 - e2 * F.pow(F.sin(phi), F.lit(2.0)))
    t = tan_phi * tan_phi
    c = ep2 * cos_phi * cos_phi
    a = cos_phi * (F.radians(lon) - central)

    meridian = WGS84_SEMI_MAJOR_M * (
        (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
        - (3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
        + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi)
        - (35 * e6 / 3072) * F.sin(6 * phi)
    )

    def power(k: int) -> Column:
        return F.pow(a, F.lit(float(k)))

    east_series = (
        a
        + (1 - t + c) * power(3) / 6
        + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * power(5) / 120
    )
    north_series = (
        power(2) / 2
        + (5 - t + 9 * c + 4 * c * c) * power(4) / 24
        + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * power(6) / 720
    )
    easting = UTM_SCALE * nu * east_series + UTM_FALSE_EASTING_M
    northing = UTM_SCALE * (meridian + nu * tan_phi * north_series)
    shifted = F.when(lat < 0, northing + UTM_FALSE_NORTHING_SOUTH_M).otherwise(northing)
    return easting, shifted


def cell(coordinate: Column, size: float) -> Column:
    """Index of the grid interval of length *size* that holds the coordinate."""
    return F.floor(coordinate / F.lit(float(size))).cast("long")


def heading_bucket(heading: Column, size: float) -> Column:
    """Heading interval without wrap-around: 360 and 0 degrees differ."""
    return cell(heading, size)


def wrapped_heading_bucket(heading: Column, size: float) -> Column:
    """Heading interval of the heading taken modulo 360."""
    return cell(F.pmod(heading, F.lit(360.0)), size)


def outer_group(
    cell_x: Column, cell_y: Column, cell_h: Column | None, spatial: int, angular: int
) -> Column:
    """Group number from the cell indices modulo *spatial* / *angular*.

    The modulus separates neighbouring cells.  Two places in the *same* cell with
    headings a multiple of *angular* buckets apart still share a group.
    """
    xm = F.pmod(cell_x, F.lit(spatial))
    ym = F.pmod(cell_y, F.lit(spatial))
    if cell_h is None:
        return (xm * spatial + ym).cast("long")
    hm = F.pmod(cell_h, F.lit(angular))
    return (xm * (spatial * angular) + ym * angular + hm).cast("long")


def distance(east_a: Column, north_a: Column, east_b: Column, north_b: Column) -> Column:
    de, dn = east_a - east_b, north_a - north_b
    return F.sqrt(de * de + dn * dn)
