"""Great-circle distance and the cells that turn a radius search into an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_194.9


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat = F.radians(lat2 - lat1) / 2
    dlng = F.radians(lng2 - lng1) / 2
    chord = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def lat_row(lat: Column, size_m: Column | float) -> Column:
    return F.floor(lat * F.lit(METRES_PER_DEGREE) / size_m)


def lng_columns(row: Column, size_m: Column | float) -> Column:
    """Number of cells around the earth in one latitude row.

    A cell is as wide as a `size_m` step can reach at the row edge nearest the pole, one further
    row out, so a neighbour in any adjacent row is never more than one column away. Where
    such a step can cross the pole, the row is one cell.
    """
    edge = (F.greatest(F.abs(row), F.abs(row + 1)) + 1) * size_m / F.lit(METRES_PER_DEGREE)
    reach = F.sin(size_m / F.lit(EARTH_RADIUS_M)) / F.cos(F.radians(F.least(edge, F.lit(90.0))))
    fits = (edge < 90.0) & (reach < 1.0)
    return F.when(fits, F.floor(F.lit(360.0) / F.degrees(F.asin(F.least(reach, F.lit(1.0)))))).otherwise(F.lit(1)).cast("long")


def lng_column(lng: Column, row: Column, size_m: Column | float, step: int | Column = 0) -> Column:
    """Column index of a longitude in one latitude row, `step` columns further east around the earth."""
    columns = lng_columns(row, size_m)
    return F.pmod(F.floor((lng + 180.0) / 360.0 * columns) + step, columns)
