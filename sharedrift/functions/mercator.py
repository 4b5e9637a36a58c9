"""Spherical web-Mercator as column expressions (no UDF; all of it compiles into whole-stage code)."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sharedrift import settings as S


def plottable(lat: Column, lng: Column) -> Column:
    """Inside the square web-Mercator world; NULL coordinates are not."""
    return (
        lat.isNotNull() & lng.isNotNull()
        & lat.between(-S.MAX_PLOT_LATITUDE, S.MAX_PLOT_LATITUDE)
        & lng.between(-S.MAX_PLOT_LONGITUDE, S.MAX_PLOT_LONGITUDE)
    )


def _world_pixels(zoom) -> Column:
    """Width of the world in pixels; ``zoom`` is a number or a column."""
    if isinstance(zoom, int):
        return F.lit(float(S.TILE_SIZE << zoom))
    return F.lit(float(S.TILE_SIZE)) * F.pow(F.lit(2.0), zoom)


def _last_tile(zoom) -> Column:
    return F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom) - 1


# Unit square, (0, 0) at the top left ------------------------------------------------------------------------------

def unit_x(lng: Column) -> Column:
    return F.when(lng > 180, lng - 360).otherwise(lng) / 360 + 0.5


def unit_y(lat: Column) -> Column:
    return F.lit(0.5) - F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) / (2 * math.pi)


def address(lat: Column, lng: Column, zoom: int, clamp: bool = False) -> tuple[Column, Column]:
    """Tile (or cell) x, y at a zoom; NULL where not plottable.

    Unclamped, longitude 180 gives x = 2^zoom, one past the last tile.
    """
    def step(unit: Column) -> Column:
        index = F.floor(unit * float(1 << zoom))
        if clamp:
            index = F.greatest(F.least(index, F.lit((1 << zoom) - 1)), F.lit(0))
        return F.when(plottable(lat, lng), index)

    return step(unit_x(lng)), step(unit_y(lat))


def coarser(index: Column, levels) -> Column:
    """The address, ``levels`` zooms up, that contains an address; ``levels`` is a number or a column."""
    return F.call_function("shiftright", index, F.lit(levels) if isinstance(levels, int) else levels)


# World pixels at a zoom -------------------------------------------------------------------------------------------

def pixel_x(lng: Column, zoom) -> Column:
    return (lng + 180) / 360 * _world_pixels(zoom)


def pixel_y(lat: Column, zoom) -> Column:
    s = F.sin(F.radians(lat))
    return (F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * _world_pixels(zoom)


def pixel_to_lng(px: Column, zoom) -> Column:
    return (px / _world_pixels(zoom) - 0.5) * 360


def pixel_to_lat(py: Column, zoom) -> Column:
    return F.lit(90.0) - F.atan(F.exp((py / _world_pixels(zoom) - 0.5) * (2 * math.pi))) * (360 / math.pi)


def pixel_to_tile(p: Column, zoom) -> Column:
    """Tile index of a pixel, clamped to the tiles that exist."""
    return F.floor(F.least(F.greatest(p / S.TILE_SIZE, F.lit(0.0)), _last_tile(zoom)))


def lng_to_tile(lng: Column, zoom) -> Column:
    return pixel_to_tile(pixel_x(lng, zoom), zoom)


def lat_to_tile(lat: Column, zoom) -> Column:
    return pixel_to_tile(pixel_y(lat, zoom), zoom)


def tile_to_lng(tile: Column, zoom) -> Column:
    return pixel_to_lng(tile * S.TILE_SIZE, zoom)


def tile_to_lat(tile: Column, zoom) -> Column:
    return pixel_to_lat(tile * S.TILE_SIZE, zoom)


def tile_of_pixel(p: Column) -> Column:
    """The tile whose half-open pixel range [min, min + size) holds the pixel (not clamped)."""
    return F.floor(p / S.TILE_SIZE)


def offset_in_tile(p: Column) -> Column:
    return F.floor(p % S.TILE_SIZE)


def metres_per_pixel(lat: Column, zoom) -> Column:
    return F.cos(F.radians(lat)) * S.EARTH_CIRCUMFERENCE_M / _world_pixels(zoom)
