"""Web-Mercator tiles: cell counts, the zoom pyramid, nested tile documents and point features."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharedrift import settings as S
from sharedrift.functions import mercator
from sharedrift.functions.features import sorted_map, sorted_map_of_maps

TILE = ("specieskey", "z", "x", "y")


def grid_counts(clean: DataFrame, zoom: int = S.GRID_ZOOM) -> DataFrame:
    """Observations per species, year and cell of one zoom."""
    x, y = mercator.address(F.col("decimallatitude"), F.col("decimallongitude"), zoom)
    return clean.groupBy("specieskey", "year", x.alias("x"), y.alias("y")).agg(F.count("*").alias("count"))


def grid_of_points(points: DataFrame, zoom: int = S.GRID_ZOOM) -> DataFrame:
    """The same from exact points."""
    x, y = mercator.address(F.col("lat"), F.col("lng"), zoom)
    return points.groupBy("specieskey", "year", x.alias("x"), y.alias("y")).agg(F.sum("count").alias("count"))


def cell_year_counts(
    points: DataFrame, zoom: int = S.JOB_TILE_ZOOM, lookahead: int = S.JOB_CELL_LOOKAHEAD
) -> DataFrame:
    """Observations per species, year, tile (x, y) and look-ahead cell (x1, y1); unplottable rows are left out."""
    lat, lng = F.col("lat"), F.col("lng")
    x1, y1 = mercator.address(lat, lng, zoom + lookahead)
    celled = points.where(mercator.plottable(lat, lng)).groupBy(
        "specieskey", "year", x1.alias("x1"), y1.alias("y1")).agg(F.sum("count").alias("count"))
    return celled.withColumns({
        "x": mercator.coarser(F.col("x1"), lookahead), "y": mercator.coarser(F.col("y1"), lookahead),
    }).select("specieskey", "year", "x", "y", "x1", "y1", "count")


def tile_pyramid(
    points: DataFrame, max_zoom: int = S.PYRAMID_MAX_ZOOM, lookahead: int = S.PYRAMID_CELL_LOOKAHEAD
) -> DataFrame:
    """Counts per species, tile, look-ahead cell and year at zooms 0 to ``max_zoom``.

    ``points`` has one row per exact place, name and year: ``n_points`` counts those rows, ``n_obs`` the observations
    behind them.  Both add up, so the finest cells are counted once and every coarser zoom is a shift of them: zooms down to
    ``PYRAMID_MIDDLE_ZOOM`` are summed within a shuffle of the finest cells, the rest within one of the middle zoom's cells.
    """
    finest = max_zoom + lookahead
    fx, fy = mercator.address(F.col("lat"), F.col("lng"), finest)
    base = points.groupBy("orderkey", "specieskey", fx.alias("_cx"), fy.alias("_cy"), "year").agg(
        F.count("*").alias("n_points"), F.sum("count").alias("n_obs"))
    middle = min(S.PYRAMID_MIDDLE_ZOOM, max_zoom)
    levels = _levels(base, middle, max_zoom, lookahead)
    if middle:
        levels |= _levels(levels[middle], 0, middle, lookahead) | {middle: levels[middle]}
    cells = reduce(DataFrame.unionByName, (level.withColumn("z", F.lit(z)) for z, level in levels.items()))
    return cells.select(
        "orderkey", "specieskey", "z",
        mercator.coarser(F.col("_cx"), lookahead).alias("x"),
        mercator.coarser(F.col("_cy"), lookahead).alias("y"),
        F.concat_ws(":", F.col("_cx").cast("string"), F.col("_cy").cast("string")).alias("cellid"),
        "year", "n_points", "n_obs",
    )


def _levels(cells: DataFrame, first: int, last: int, lookahead: int) -> dict[int, DataFrame]:
    """Cells of zoom ``last`` summed for each zoom from ``first`` on, which all read one shuffle of them.

    The cells of one species, year and tile of zoom ``first`` come together; a group has at most
    4^(last - first + lookahead) rows.  A task sums one zoom, so its hash tables have no more rows than it reads, however
    many zooms there are.
    """
    deep = last - first + lookahead
    tile = {"_tx": mercator.coarser(F.col("_cx"), deep), "_ty": mercator.coarser(F.col("_cy"), deep)}
    keys = ["orderkey", "specieskey", "year", "_tx", "_ty"]
    dealt = cells.withColumns(tile).repartition(*keys)
    levels = {last: dealt}
    for z in range(first, last):
        cell = [mercator.coarser(F.col(c), last - z).alias(c) for c in ("_cx", "_cy")]
        levels[z] = dealt.groupBy(*keys, *cell).agg(F.sum("n_points").alias("n_points"), F.sum("n_obs").alias("n_obs"))
    return {z: level.drop("_tx", "_ty") for z, level in levels.items()}


def with_group_rows(pyramid: DataFrame) -> DataFrame:
    """The pyramid plus each group as a pseudo-species keyed by its group key, told apart by ``is_group``.

    Group rows are summed from the already reduced species rows.
    """
    group = (
        pyramid.groupBy("orderkey", "z", "x", "y", "cellid", "year")
        .agg(F.sum("n_points").alias("n_points"), F.sum("n_obs").alias("n_obs"))
        .withColumns({"specieskey": F.col("orderkey"), "is_group": F.lit(True)})
    )
    return pyramid.withColumn("is_group", F.lit(False)).unionByName(group)


def tile_documents(pyramid: DataFrame, count: str = "n_points") -> DataFrame:
    """One JSON document per species and tile: year -> cell -> count.

    A tile has at most 4^lookahead cells a year, which bounds each collected map and each key of the one shuffle that
    serves both levels.  Rows of ``with_group_rows`` keep their flag, so a species and a group with the same key stay
    apart.
    """
    tile = [*TILE, *(["is_group"] if "is_group" in pyramid.columns else [])]
    placed = pyramid.select(*tile, "year", "cellid", count).repartition(*tile)
    # a species that stands in two groups has two rows for a cell; the document holds their sum
    summed = placed.groupBy(*tile, "year", "cellid").agg(F.sum(count).alias(count))
    per_year = summed.groupBy(*tile, "year").agg(sorted_map("cellid", count).alias("cells"))
    return per_year.groupBy(*tile).agg(F.to_json(sorted_map_of_maps("year", "cells")).alias("json"))


def point_tile_features(trends: DataFrame, zooms: Sequence[int]) -> DataFrame:
    """One row per point trend and zoom: its tile and its whole pixel within the tile.

    The tile is the one whose half-open pixel range holds the point, so no tile ever scans the data.  A point on longitude
    180 belongs to the last pixel of the last tile.
    """
    lat, lng = F.col("lat_e2") / F.lit(100.0), F.col("lng_e2") / F.lit(100.0)
    placed = (
        trends
        .withColumns({"_wx": mercator.pixel_x(lng, 0), "_wy": mercator.pixel_y(lat, 0)})
        .withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms])))
        .withColumns({
            "_px": F.least(F.col("_wx") * F.pow(F.lit(2.0), F.col("z")), S.TILE_SIZE * F.pow(F.lit(2.0), F.col("z")) - 1),
            "_py": F.col("_wy") * F.pow(F.lit(2.0), F.col("z")),
        })
    )
    return placed.withColumns({
        "x": mercator.tile_of_pixel(F.col("_px")), "y": mercator.tile_of_pixel(F.col("_py")),
        "local_x": mercator.offset_in_tile(F.col("_px")), "local_y": mercator.offset_in_tile(F.col("_py")),
    }).drop("_wx", "_wy", "_px", "_py")
