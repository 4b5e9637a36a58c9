"""Flat-top hexagon lattice on world pixels.

The lattice is anchored at world pixel (0, 0) and does not depend on the tile, so a place has one hexagon per
(zoom, radius).  Column ``c`` is centred at ``r + 1.5 r c``; odd columns sit half a height lower.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharedrift import settings as S
from sharedrift.functions import mercator

_ROOT3 = math.sqrt(3.0)


def height(radius: float) -> float:
    return _ROOT3 * radius


def radius_of_size(size: int | None) -> float:
    """Pixel radius for a user-facing hexagon size."""
    return S.HEX_RADIUS_DEFAULT if size is None else float(size * S.HEX_RADIUS_PER_SIZE)


def with_hexagon(df: DataFrame, px: Column, py: Column, radius: float) -> DataFrame:
    """Add ``hex_c``, ``hex_k``: the hexagon whose centre is nearest to the pixel.

    Nearest centre by rounding in cube coordinates (q + s + t = 0): round all three, then recompute the one that
    moved most.  Built in steps so each intermediate is computed once per row.
    """
    q = (px - radius) * (2.0 / 3.0 / radius)
    t = (py - height(radius) / 2) * (1.0 / height(radius)) - F.col("_q") / 2
    rounded = (
        df.withColumn("_q", q)
        .withColumn("_t", t)
        .withColumns({
            "_rq": F.rint("_q"), "_rt": F.rint("_t"), "_rs": F.rint(-F.col("_q") - F.col("_t")),
        })
        .withColumns({
            "_dq": F.abs(F.col("_rq") - F.col("_q")),
            "_dt": F.abs(F.col("_rt") - F.col("_t")),
            "_ds": F.abs(F.col("_rs") + F.col("_q") + F.col("_t")),
        })
    )
    q_moved = (F.col("_dq") > F.col("_dt")) & (F.col("_dq") > F.col("_ds"))
    t_moved = ~q_moved & (F.col("_dt") > F.col("_ds"))
    axial = rounded.withColumns({
        "_c": F.when(q_moved, -F.col("_rt") - F.col("_rs")).otherwise(F.col("_rq")).cast("long"),
        "_r": F.when(t_moved, -F.col("_rq") - F.col("_rs")).otherwise(F.col("_rt")).cast("long"),
    })
    odd = F.col("_c").bitwiseAND(F.lit(1).cast("long"))
    return axial.withColumns({
        "hex_c": F.col("_c"),
        "hex_k": F.col("_r") + F.shiftright(F.col("_c") - odd, 1),
    }).drop("_q", "_t", "_rq", "_rt", "_rs", "_dq", "_dt", "_ds", "_c", "_r")


def centre(radius: float) -> tuple[Column, Column]:
    """World-pixel centre of (``hex_c``, ``hex_k``)."""
    h = height(radius)
    odd = F.col("hex_c").bitwiseAND(F.lit(1).cast("long"))
    return F.col("hex_c") * (1.5 * radius) + radius, F.col("hex_k") * h + h / 2 + odd * (h / 2)


def hexagon_id(cx: Column, cy: Column, zoom) -> Column:
    """``lat,lng`` of the centre, rounded half-even to 3 decimals."""
    lat = F.bround(mercator.pixel_to_lat(cy, zoom), 3)
    lng = F.bround(mercator.pixel_to_lng(cx, zoom), 3)
    return F.concat_ws(",", lat.cast("string"), lng.cast("string"))


def ring(cx: Column, cy: Column, radius: float) -> Column:
    """Closed corner ring of seven ``struct<x, y>``."""
    return F.array(*[
        F.struct(
            (cx + radius * math.cos(i * math.pi / 3)).alias("x"),
            (cy + radius * math.sin(i * math.pi / 3)).alias("y"),
        )
        for i in (0, 1, 2, 3, 4, 5, 0)
    ])


def ring_wkt(corners: Column, decimals: int = 2) -> Column:
    text = F.transform(corners, lambda p: F.concat_ws(
        " ", F.round(p["x"], decimals).cast("string"), F.round(p["y"], decimals).cast("string")))
    return F.concat(F.lit("POLYGON(("), F.array_join(text, ", "), F.lit("))"))


def touches_square(cx: Column, cy: Column, radius: float, x0: Column, y0: Column, size: float) -> Column:
    """Exact overlap of a hexagon with an axis-parallel square (separating axes: x, y and the two slanted edges)."""
    h2, s2 = height(radius) / 2, size / 2
    dx, dy = F.abs(cx - (x0 + s2)), F.abs(cy - (y0 + s2))
    # the slanted edges' normals are (cos 30, sin 30) and its mirror images
    slant = dx * (_ROOT3 / 2) + dy / 2
    return (dx <= radius + s2) & (dy <= h2 + s2) & (slant <= h2 + s2 * (_ROOT3 / 2 + 0.5))
