"""Distances, grid indices and grid bounds."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS_M, GRID_LAT_DEG, GRID_LON_DEG, METRES_PER_DEGREE
from .columns import col, lit_or_col


def planar_distance_m(lat1, lon1, lat2, lon2) -> Column:
    """Equirectangular distance at the mid latitude of two points."""
    lat1, lon1, lat2, lon2 = map(lit_or_col, (lat1, lon1, lat2, lon2))
    mid = F.radians((lat1 + lat2) / 2.0)
    north = F.radians(lat2 - lat1) * EARTH_RADIUS_M
    east = F.radians(lon2 - lon1) * EARTH_RADIUS_M * F.cos(mid)
    return F.hypot(east, north)


def _cos_floor(lat: Column) -> Column:
    return F.greatest(F.cos(F.radians(lat)), F.lit(1e-9))


def radius_distance_m(lat, lon, probe_lat, probe_lon) -> Column:
    """Distance on the plane tangent at the probe's latitude."""
    lat, lon, probe_lat, probe_lon = map(lit_or_col, (lat, lon, probe_lat, probe_lon))
    north = (lat - probe_lat) * METRES_PER_DEGREE
    east = (lon - probe_lon) * METRES_PER_DEGREE * _cos_floor(probe_lat)
    return F.hypot(east, north)


def point_segment_distance_m(lat, lon, lat_a, lon_a, lat_b, lon_b) -> Column:
    """Distance from a point to a segment, on a plane local to the point."""
    lat, lon, lat_a, lon_a, lat_b, lon_b = map(lit_or_col, (lat, lon, lat_a, lon_a, lat_b, lon_b))
    scale = METRES_PER_DEGREE * _cos_floor(lat)
    ax, ay = (lon_a - lon) * scale, (lat_a - lat) * METRES_PER_DEGREE
    bx, by = (lon_b - lon) * scale, (lat_b - lat) * METRES_PER_DEGREE
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    along = F.when(length2 <= 1e-9, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length2)))
    return F.hypot(ax + along * dx, ay + along * dy)


def cell_index(coordinate, step: float) -> Column:
    return F.floor(lit_or_col(coordinate) / F.lit(step)).cast("int")


def cell_y(lat="lat") -> Column:
    return cell_index(lat, GRID_LAT_DEG)


def cell_x(lon="lon") -> Column:
    return cell_index(lon, GRID_LON_DEG)


def cell_center(index, step: float, factor: int = 1) -> Column:
    return (col(index) + 0.5) * F.lit(step * factor)


def coarse_index(index, factor: int) -> Column:
    """Integer division that truncates toward zero, as SQL does."""
    return F.call_function("div", col(index), F.lit(factor)).cast("int")


def grid_bounds(bbox, lat_step: float = GRID_LAT_DEG, lon_step: float = GRID_LON_DEG):
    """(min_lon, min_lat, max_lon, max_lat) -> index ranges with one cell of margin.

    The ranges are plain integers so that the predicate on the cell columns reaches the
    Parquet row-group statistics.
    """
    min_lon, min_lat, max_lon, max_lat = bbox
    rows = (math.trunc(min_lat / lat_step) - 1, math.trunc(max_lat / lat_step) + 1)
    columns = (math.trunc(min_lon / lon_step) - 1, math.trunc(max_lon / lon_step) + 1)
    return rows, columns


def in_box(bbox, lat="lat", lon="lon") -> Column:
    min_lon, min_lat, max_lon, max_lat = bbox
    return col(lon).between(min_lon, max_lon) & col(lat).between(min_lat, max_lat)
