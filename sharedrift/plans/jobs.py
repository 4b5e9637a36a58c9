"""Batch jobs: prepared tables written once, then read by every later job.

Raw observations are scanned once per level of detail.  Each later table is derived from a written one, so a lost
executor costs a re-read of a small table and never a second pass over the observations.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharedrift import schemas
from sharedrift import settings as S
from sharedrift.functions import features
from sharedrift.operators import counts, filters, fits, hexes, names, tiles, trends
from sharedrift.sources import tables


def prepare(occurrences: DataFrame, out: str, group_key: int | None = None,
            min_year: int = S.MIN_RECORD_YEAR) -> None:
    """Write ``points`` (exact, per name), ``species_point_year``, ``group_point_year`` and ``names`` below ``out``.

    The observations are read once, for the points; everything else follows from those.  The tables read by key are
    sorted by it and carry a Bloom filter of it, so a reader of one species touches few files and row groups.
    """
    spark = occurrences.sparkSession
    clean = filters.quality_filter(occurrences, group_key, min_year)
    tables.write_keyed(counts.named_points(clean), f"{out}/points", "specieskey", "lat", "lng")
    points = read_points(spark, out)
    tables.write_parquet(names.names_of_points(points).select("specieskey", "scientificname"), f"{out}/names",
                         ["scientificname", "specieskey"])
    rounded = points.groupBy(
        "orderkey", "specieskey", counts.hundredths(F.col("lat")).alias("lat_e2"),
        counts.hundredths(F.col("lng")).alias("lng_e2"), "year",
    ).agg(F.sum("count").alias("n"))
    tables.write_keyed(rounded, f"{out}/species_point_year", "specieskey", "lat_e2", "lng_e2", "year")
    tables.write_keyed(counts.group_point_year(read_species_point_year(spark, out)), f"{out}/group_point_year",
                       "orderkey", "lat_e2", "lng_e2", "year")


def read_points(spark: SparkSession, prepared: str) -> DataFrame:
    return tables.read_parquet(spark, f"{prepared}/points", schemas.NAMED_POINTS)


def read_species_point_year(spark: SparkSession, prepared: str) -> DataFrame:
    return tables.read_parquet(spark, f"{prepared}/species_point_year", schemas.SPECIES_POINT_YEAR)


def read_group_point_year(spark: SparkSession, prepared: str) -> DataFrame:
    return tables.read_parquet(spark, f"{prepared}/group_point_year", schemas.GROUP_POINT_YEAR)


def export_text(spark: SparkSession, prepared: str, out: str) -> None:
    """The tab-delimited exchange files: species features, group features, names."""
    lng, lat = F.col("lng_e2") / F.lit(100.0), F.col("lat_e2") / F.lit(100.0)
    species = trends.year_maps(
        counts.over_groups(read_species_point_year(spark, prepared)), ["specieskey", "lat_e2", "lng_e2"])
    group = trends.group_year_maps(read_group_point_year(spark, prepared), list(counts.GROUP_POINT))
    tables.write_tsv(tables.feature_text(species, ["specieskey"], lng, lat, F.col("species_seen")), f"{out}/species")
    tables.write_tsv(tables.feature_text(group, ["orderkey"], lng, lat, F.col("group_counts")), f"{out}/group")
    tables.write_tsv(tables.read_parquet(spark, f"{prepared}/names", schemas.NAMES), f"{out}/names")


def cell_slopes(spark: SparkSession, points_path: str, out: str, zoom: int = S.JOB_TILE_ZOOM,
                lookahead: int = S.JOB_CELL_LOOKAHEAD) -> None:
    """Slope of the raw counts per species and cell, from exact point counts."""
    cells = tiles.cell_year_counts(tables.read_points(spark, points_path), zoom, lookahead)
    result = fits.slopes(cells, ["specieskey", "x", "y", "x1", "y1"])
    tables.write_parquet(result, out, ["specieskey", "x", "y"])


def tile_documents(spark: SparkSession, points_path: str, out: str, min_year: int = S.MIN_RECORD_YEAR_PYRAMID,
                   zooms: Sequence[int] | None = None) -> None:
    """Zoom pyramid as one JSON document per species and tile, and per group and tile.

    ``points_path``: points per name.  With ``zooms``, only those zooms are replaced; the others stay as they are.
    """
    points = tables.read_parquet(spark, points_path, schemas.NAMED_POINTS).where(F.col("year") >= min_year)
    documents = tiles.tile_documents(tiles.with_group_rows(tiles.tile_pyramid(points)))
    if zooms is not None:
        documents = documents.where(F.col("z").isin(*zooms))
    tables.write_tiles(documents, out, keep_other_zooms=zooms is not None)


def wide_records(spark: SparkSession, prepared: str, out: str) -> None:
    """Tab-delimited rows of species, place and year with the counts of the species and of its group."""
    lng, lat = F.col("lng_e2") / F.lit(100.0), F.col("lat_e2") / F.lit(100.0)
    wide = counts.species_group_wide(read_species_point_year(spark, prepared), read_group_point_year(spark, prepared))
    tables.write_tsv(wide.select(
        "specieskey", features.wkt_point(lng, lat).alias("geom"), "year", "speciescount", "ordercount"), out)


def grid(spark: SparkSession, prepared: str, out: str, zoom: int = S.GRID_ZOOM) -> None:
    """Observations per species, year and cell of one zoom, from exact points."""
    cells = tiles.grid_of_points(read_points(spark, prepared), zoom)
    tables.write_keyed(cells, out, "specieskey", "x", "y", "year")


def map_features(spark: SparkSession, prepared: str, out: str, zooms: Sequence[int], radius: float,
                 years: tuple[int, int], min_years: int = S.YEAR_THRESHOLD_DEFAULT) -> None:
    """Point and hexagon trend features for every tile of the zooms."""
    per_point = read_species_point_year(spark, prepared)
    points = tiles.point_tile_features(
        trends.point_trends(per_point, years=years, min_species_years=min_years), zooms)
    tables.write_by_zoom(points, f"{out}/points", "x", "y", "specieskey", "lat_e2", "lng_e2")
    hexagons = hexes.hex_tile_features(
        hexes.hex_trends(per_point, zooms, radius, years, min_species_years=min_years), radius)
    tables.write_by_zoom(hexagons, f"{out}/hexagons", "x", "y", "specieskey", "hex_c", "hex_k")
