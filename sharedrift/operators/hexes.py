"""Hexagon counts, trends and map features."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharedrift import settings as S
from sharedrift.functions import hexagons, mercator
from sharedrift.operators.trends import share_trends

HEXAGON = ("z", "hex_c", "hex_k")


def hex_year_counts(
    counts: DataFrame, zooms: Sequence[int], radius: float = S.HEX_RADIUS_DEFAULT
) -> DataFrame:
    """Observations per species, hexagon and year at each zoom, summed from 0.01-degree places."""
    lat, lng = F.col("lat_e2") / F.lit(100.0), F.col("lng_e2") / F.lit(100.0)
    placed = (
        counts
        .withColumns({"_wx": mercator.pixel_x(lng, 0), "_wy": mercator.pixel_y(lat, 0)})
        .withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms])))
    )
    scale = F.pow(F.lit(2.0), F.col("z"))
    binned = hexagons.with_hexagon(placed, F.col("_wx") * scale, F.col("_wy") * scale, radius)
    return binned.groupBy("orderkey", "specieskey", *HEXAGON, "year").agg(F.sum("n").alias("n"))


def hex_trends(
    counts: DataFrame,
    zooms: Sequence[int],
    radius: float = S.HEX_RADIUS_DEFAULT,
    years: tuple[int, int] | None = None,
    min_species_years: int = S.YEAR_THRESHOLD_DEFAULT,
    min_fit_years: int = S.MIN_FIT_YEARS_PLACE,
) -> DataFrame:
    """Trend of every species in every hexagon it was seen in; the year threshold is on the hexagon as a whole."""
    if years:
        counts = counts.where(F.col("year").between(*years))
    trends = share_trends(
        hex_year_counts(counts, zooms, radius), HEXAGON,
        min_species_years=min_species_years, min_fit_years=min_fit_years, fill_unfitted=False,
    )
    cx, cy = hexagons.centre(radius)
    return trends.withColumn("hex_id", hexagons.hexagon_id(cx, cy, F.col("z")))


def hex_tile_features(trends: DataFrame, radius: float = S.HEX_RADIUS_DEFAULT) -> DataFrame:
    """One row per hexagon and tile it is drawn on, with its corner ring in the tile's own pixels.

    A tile draws a border of a few pixels around itself.  A hexagon is first sent to every tile its extent reaches,
    a handful at most, then kept where it truly overlaps.
    """
    border, size = S.TILE_DRAW_BORDER, S.TILE_SIZE
    h2 = hexagons.height(radius) / 2
    cx, cy = hexagons.centre(radius)

    def reach(low, high):
        last = F.pow(F.lit(2.0), F.col("z")) - 1
        first = F.greatest(F.floor((low - border) / size), F.lit(0))
        final = F.least(F.floor((high + border) / size), last.cast("long"))
        return F.when(first <= final, F.sequence(first, final))

    placed = (
        trends.withColumns({"_cx": cx, "_cy": cy})
        .withColumn("x", F.explode(reach(F.col("_cx") - radius, F.col("_cx") + radius)))
        .withColumn("y", F.explode(reach(F.col("_cy") - h2, F.col("_cy") + h2)))
    )
    left, top = F.col("x") * size, F.col("y") * size
    drawn = placed.where(hexagons.touches_square(
        F.col("_cx"), F.col("_cy"), radius, left - border, top - border, size + 2 * border))
    return drawn.withColumn("ring", hexagons.ring(F.col("_cx") - left, F.col("_cy") - top, radius)).drop("_cx", "_cy")
