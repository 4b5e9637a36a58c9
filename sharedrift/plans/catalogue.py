"""Named queries: each operator over the whole test tables, all groups and species at once.

Doubles are rounded only here, so results can be compared with another engine's.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sharedrift import schemas
from sharedrift.functions import features, hexagons, mercator
from sharedrift.operators import boxes, charts, counts, filters, fits, hexes, learning, names, tiles, trends
from sharedrift.plans import jobs
from sharedrift.sources import occurrence, tables

Query = Callable[[SparkSession, str], DataFrame]

HEX_ZOOMS = (1, 3)
HEX_RADIUS = 80.0
CLOSE_REQUESTS = 1_000_000_000  # added to the key of a supplier's second request
HEX_MIN_YEARS = 2
POINT_ZOOMS = (0, 1, 2, 3, 4, 5, 6, 7)
PIXEL_ZOOM = 6
RANGE = (1996, 2000)
RANGE_MIN_YEARS = 2
NAME_PATTERN = "Supplier#%0_1"  # some of the names
HEX_SIZE = 10
READ_SPECIES = (1, 3, 7)
READ_GROUP = 3
DECIMALS = {"slope": 9, "intercept": 6, "significance": 6, "sse": 9, "intercept_stderr": 4, "mse": 9,
            "slope_stderr": 7}


# Shared inputs ----------------------------------------------------------------------------------------------------

def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.quality_filter(occurrence.occurrences_from_star(spark, sf_dir))


def point_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.species_point_year(clean(spark, sf_dir))


def exact_points(spark: SparkSession, sf_dir: str, with_name: bool = False) -> DataFrame:
    return counts.species_point_year_exact(clean(spark, sf_dir), with_name)


def box_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests per supplier: boxes placed by its key, corners in either order, years by its remainders."""
    key = F.col("s_suppkey")
    start_lat, start_lng = (key * 37 % 130 - 80).cast("double"), (key * 53 % 300 - 175).cast("double")
    height, width = (key % 5 * 10 + 15).cast("double"), (key % 7 * 10 + 20).cast("double")
    flip = key % 2 == 1
    suppliers = occurrence.star_table(spark, sf_dir, "supplier").join(
        occurrence.star_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    wide = suppliers.select(
        key.alias("request_id"),
        F.col("n_regionkey").cast("int").alias("orderkey"),
        key.cast("int").alias("specieskey"),
        F.when(flip, start_lat + height).otherwise(start_lat).alias("lat_a"),
        start_lng.alias("lng_a"),
        F.when(flip, start_lat).otherwise(start_lat + height).alias("lat_b"),
        (start_lng + width).alias("lng_b"),
        F.when(flip, 1996).otherwise(1995).alias("min_year"),
        F.when(key % 3 == 0, 2000).otherwise(2001).alias("max_year"),
    )
    # and a small box around one of the places observed, its sides on whole hundredths of a degree
    spot = key % 60
    lat_e2, lng_e2 = spot * 7919 % 17800 - 8900, spot * 6133 % 36000 - 18000
    close = suppliers.select(
        (key + CLOSE_REQUESTS).alias("request_id"), F.col("n_regionkey").cast("int").alias("orderkey"),
        key.cast("int").alias("specieskey"), ((lat_e2 - key % 3) / F.lit(100.0)).alias("lat_a"),
        ((lng_e2 + key % 7 * 30) / F.lit(100.0)).alias("lng_a"), ((lat_e2 + key % 5 * 45) / F.lit(100.0)).alias("lat_b"),
        ((lng_e2 - key % 4) / F.lit(100.0)).alias("lng_b"), F.lit(1992).alias("min_year"), F.lit(1999).alias("max_year"))
    return wide.unionByName(close)


def rounded(**decimals: int) -> list[Column]:
    """Rounded columns; adding zero turns a negative zero into zero."""
    return [(F.round(name, places) + F.lit(0.0)).alias(name) for name, places in decimals.items()]


def trend_columns(*keys: str) -> list:
    return [
        *keys, F.col("species_years").cast("long").alias("species_years"), "group_years", *rounded(**DECIMALS),
        F.to_json("species_counts").alias("species_counts"), F.to_json("group_counts").alias("group_counts"),
    ]


def all_point_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.point_trends(point_counts(spark, sf_dir))


def all_hex_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hexes.hex_trends(
        point_counts(spark, sf_dir), HEX_ZOOMS, HEX_RADIUS, min_species_years=HEX_MIN_YEARS)


def all_box_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.box_trends(point_counts(spark, sf_dir), box_requests(spark, sf_dir))


def all_species_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.species_trends(counts.species_years(clean(spark, sf_dir)))


# Sources and counts -----------------------------------------------------------------------------------------------

def occurrence_snapshot(spark, sf_dir):
    return occurrence.occurrence_snapshot(occurrence.occurrences_from_star(spark, sf_dir)).withColumns({
        c: F.round(c, 6) for c in ("decimallatitude", "decimallongitude")})


def snapshot_orc_round_trip(spark, sf_dir):
    """The snapshot written as ORC to the shared folder and read back with its declared schema."""
    path = tables.shared_folder(spark)
    occurrence.write_snapshot(occurrence.occurrences_from_star(spark, sf_dir), path)
    return occurrence.read_occurrences(spark, path, "orc").withColumns({
        c: F.round(c, 6) for c in ("decimallatitude", "decimallongitude")})


def quality_filter_counts(spark, sf_dir):
    return clean(spark, sf_dir).groupBy("orderkey", "year", "basisofrecord").agg(F.count("*").alias("records"))


def species_point_year_exact(spark, sf_dir):
    # exact coordinates are grouping keys; six decimals only for display
    return exact_points(spark, sf_dir).select(
        "orderkey", "specieskey", "year", *rounded(lat=6, lng=6), "count")


def species_keyed_read(spark, sf_dir):
    """Exact points stored in order of species, and read back for some species."""
    path = tables.shared_folder(spark)
    tables.write_keyed(exact_points(spark, sf_dir), path, "specieskey", "lat", "lng")
    return filters.of_species(tables.read_points(spark, path), *READ_SPECIES).select(
        "orderkey", "specieskey", "year", *rounded(lat=6, lng=6), "count")


def group_keyed_read(spark, sf_dir):
    """Group counts stored in order of group, and read back for one group as features with a year map."""
    path = tables.shared_folder(spark)
    tables.write_keyed(counts.group_point_year(point_counts(spark, sf_dir)), path, "orderkey", "lat_e2", "lng_e2", "year")
    one = filters.of_group(tables.read_parquet(spark, path, schemas.GROUP_POINT_YEAR), READ_GROUP)
    return tables.feature_text(
        trends.group_year_maps(one, list(counts.GROUP_POINT)), ["orderkey"], _lng(), _lat(), F.col("group_counts"))


def points_compacted(spark, sf_dir):
    """Exact points rewritten as few files and read back."""
    path = tables.shared_folder(spark)
    tables.compact(exact_points(spark, sf_dir), path)
    return tables.read_points(spark, path).select("orderkey", "specieskey", "year", *rounded(lat=6, lng=6), "count")


def species_point_year(spark, sf_dir):
    return counts.point_degrees(point_counts(spark, sf_dir))


def group_point_year(spark, sf_dir):
    return counts.point_degrees(counts.group_point_year(point_counts(spark, sf_dir)))


def group_point_year_direct(spark, sf_dir):
    return counts.point_degrees(counts.group_point_year_direct(clean(spark, sf_dir)))


def species_group_wide(spark, sf_dir):
    per_species = point_counts(spark, sf_dir)
    return counts.point_degrees(counts.species_group_wide(per_species, counts.group_point_year(per_species)))


def species_names(spark, sf_dir):
    return names.species_names(clean(spark, sf_dir))


def name_autocomplete(spark, sf_dir):
    return names.autocomplete(names.species_names(clean(spark, sf_dir)), NAME_PATTERN)


# Year maps and text -----------------------------------------------------------------------------------------------

def _lng() -> Column:
    return F.col("lng_e2") / F.lit(100.0)


def _lat() -> Column:
    return F.col("lat_e2") / F.lit(100.0)


def _species_maps(spark, sf_dir):
    return trends.year_maps(counts.over_groups(point_counts(spark, sf_dir)), ["specieskey", "lat_e2", "lng_e2"])


def _group_maps(spark, sf_dir):
    group = counts.group_point_year(point_counts(spark, sf_dir))
    return trends.group_year_maps(group, list(counts.GROUP_POINT))


def _species_text(spark, sf_dir):
    return tables.feature_text(_species_maps(spark, sf_dir), ["specieskey"], _lng(), _lat(), F.col("species_seen"))


def _group_text(spark, sf_dir):
    return tables.feature_text(_group_maps(spark, sf_dir), ["orderkey"], _lng(), _lat(), F.col("group_counts"))


def species_year_maps(spark, sf_dir):
    return _species_text(spark, sf_dir)


def group_year_maps(spark, sf_dir):
    return _group_text(spark, sf_dir)


def species_points(spark, sf_dir):
    """Serving-side read: text features decoded to coordinates and one row per year."""
    decoded = tables.features_from_text(_species_text(spark, sf_dir))
    return decoded.select("specieskey", "longitude", "latitude", F.explode("year_counts").alias("year", "n"))


def group_points(spark, sf_dir):
    decoded = tables.features_from_text(_group_text(spark, sf_dir))
    return decoded.select("orderkey", "longitude", "latitude", F.explode("year_counts").alias("year", "n"))


def features_tsv_round_trip(spark, sf_dir):
    """Species features exported as tab-delimited text, imported with declared types and decoded."""
    path = tables.shared_folder(spark)
    tables.write_tsv(_species_text(spark, sf_dir), path)
    decoded = tables.features_from_text(tables.read_tsv(spark, path, schemas.SPECIES_FEATURE_TEXT))
    return decoded.select("specieskey", "longitude", "latitude", F.explode("year_counts").alias("year", "n"))


def wkt_round_trip(spark, sf_dir):
    points = point_counts(spark, sf_dir)
    geom = points.select("specieskey", "year", features.wkt_point(_lng(), _lat()).alias("geom"), "n")
    return geom.withColumns({"x": features.wkt_x(F.col("geom")), "y": features.wkt_y(F.col("geom"))})


def json_round_trip(spark, sf_dir):
    maps = _species_maps(spark, sf_dir).withColumn("text", features.map_to_json(F.col("species_seen")))
    back = maps.withColumn("back", features.json_to_year_counts(F.col("text")))
    return back.select(
        "specieskey", "lat_e2", "lng_e2", "text",
        F.size("back").cast("long").alias("years"),
        F.aggregate(F.map_values("back"), F.lit(0).cast("long"), lambda a, v: a + v).alias("records"),
    )


def species_group_concat(spark, sf_dir):
    """``year,species,group`` lists per point, where at least two of the asked years have data."""
    # the years are cut before both sides are derived, so both read one scan
    per_species = filters.in_years(point_counts(spark, sf_dir), *RANGE)
    wide = counts.species_group_wide(per_species, counts.group_point_year(per_species))
    return (
        wide.groupBy("orderkey", "specieskey", "lat_e2", "lng_e2")
        .agg(features.joined_entries("year", "speciescount", "ordercount").alias("features"),
             F.count("year").alias("years"))
        .where(F.col("years") >= RANGE_MIN_YEARS)
        .select("orderkey", "specieskey", _lng().alias("x"), _lat().alias("y"), "features")
    )


def year_count_strings(spark, sf_dir):
    per_species = point_counts(spark, sf_dir)
    species = counts.over_groups(per_species).groupBy("specieskey", "lat_e2", "lng_e2").agg(
        features.joined_entries("year", "n", between=":").alias("yearcounts"))
    group = counts.group_point_year(per_species).groupBy(*counts.GROUP_POINT).agg(
        features.joined_entries("year", "n", between=":").alias("yearcounts"))
    return (
        species.select(F.lit("species").alias("level"), F.col("specieskey").alias("key"), "lat_e2", "lng_e2",
                       "yearcounts")
        .unionByName(group.select(F.lit("group").alias("level"), F.col("orderkey").alias("key"), "lat_e2",
                                  "lng_e2", "yearcounts"))
    )


def year_range_features(spark, sf_dir):
    """Year maps cut to the asked years; a point stays when enough years remain."""
    cut = _species_maps(spark, sf_dir).withColumn(
        "kept", features.years_between(F.col("species_seen"), *RANGE))
    return cut.where(F.size("kept") >= RANGE_MIN_YEARS).select(
        "specieskey", _lat().alias("lat"), _lng().alias("lng"), F.to_json("kept").alias("yearcounts"))


# Trends -----------------------------------------------------------------------------------------------------------

def species_point_trend(spark, sf_dir):
    return counts.point_degrees(all_point_trends(spark, sf_dir)).select(
        *trend_columns("orderkey", "specieskey", "lat", "lng"))


def species_point_trend_window(spark, sf_dir):
    """Trends over a span of years, of species seen in enough of them."""
    found = trends.point_trends(point_counts(spark, sf_dir), years=RANGE, min_species_years=RANGE_MIN_YEARS)
    return counts.point_degrees(found).select(*trend_columns("orderkey", "specieskey", "lat", "lng"))


def yearly_shares(spark, sf_dir):
    rows = trends.yearly_shares(point_counts(spark, sf_dir), ("lat_e2", "lng_e2"))
    return counts.point_degrees(rows).select(
        "orderkey", "specieskey", "lat", "lng", "year", "species_n", "group_n", *rounded(share=9))


def hex_year_counts(spark, sf_dir):
    return hexes.hex_year_counts(point_counts(spark, sf_dir), HEX_ZOOMS, HEX_RADIUS)


def hex_trend(spark, sf_dir):
    return all_hex_trends(spark, sf_dir).select(
        *trend_columns("orderkey", "specieskey", "z", "hex_c", "hex_k", "hex_id"))


def hex_trend_window(spark, sf_dir):
    """The same in hexagons of a size the user chose."""
    found = hexes.hex_trends(
        point_counts(spark, sf_dir), HEX_ZOOMS, hexagons.radius_of_size(HEX_SIZE), years=RANGE, min_species_years=RANGE_MIN_YEARS)
    return found.select(*trend_columns("orderkey", "specieskey", "z", "hex_c", "hex_k", "hex_id"))


def bbox_trend(spark, sf_dir):
    return all_box_trends(spark, sf_dir).select(*trend_columns("request_id", "orderkey", "specieskey"))


def trend_by_name(spark, sf_dir):
    # three scans on purpose: the name pattern is pushed into the first, the keys found prune the second to the groups
    # asked for, and only the observations of those groups are counted in the third
    base = clean(spark, sf_dir)
    known = names.species_names(base)
    asked = base.join(names.groups_of_names(base, known, NAME_PATTERN), "orderkey", "left_semi")
    found = names.trends_by_name(known, NAME_PATTERN, trends.species_trends(counts.species_years(asked)))
    return found.select("specieskey", "scientificname", "orderkey", "group_years",
                        *rounded(slope=9, significance=6))


def trend_significance(spark, sf_dir):
    return all_species_trends(spark, sf_dir).select("orderkey", "specieskey", "group_years", *rounded(
        slope=9, slope_stderr=9, significance=9))


# Fits of raw counts -----------------------------------------------------------------------------------------------

def _species_yearly(spark, sf_dir):
    return counts.species_years(clean(spark, sf_dir))


def ols_sums_of_squares(spark, sf_dir):
    fit = fits.ols_sums_of_squares(_species_yearly(spark, sf_dir), ["orderkey", "specieskey"], "n")
    return fit.select("orderkey", "specieskey", *rounded(m=6, c=3, ssto=6, ssr=6, sse=6))


def ols_diagnostics(spark, sf_dir):
    fit = fits.ols_diagnostics(_species_yearly(spark, sf_dir), ["orderkey", "specieskey"], "n")
    return fit.select("orderkey", "specieskey", *rounded(
        r2=8, residual_variance=6, slope_stderr=6, intercept_stderr=3, intercept_stderr_alt=3))


def cell_year_counts(spark, sf_dir):
    return tiles.cell_year_counts(exact_points(spark, sf_dir))


def cell_slopes(spark, sf_dir):
    cells = tiles.cell_year_counts(exact_points(spark, sf_dir))
    slopes = fits.slopes(cells, ["specieskey", "x", "y", "x1", "y1"], with_years=True)
    return slopes.select("specieskey", "x", "y", "x1", "y1", *rounded(slope=9),
                         F.to_json("year_counts").alias("year_counts"))


def grid10_counts(spark, sf_dir):
    return tiles.grid_counts(clean(spark, sf_dir))


def grid10_slopes(spark, sf_dir):
    return fits.slopes(tiles.grid_counts(clean(spark, sf_dir)), ["specieskey", "x", "y"]).select(
        "specieskey", "x", "y", *rounded(slope=9))


def mllib_mse(spark, sf_dir):
    grid = tables.written_once(tiles.grid_counts(clean(spark, sf_dir)))
    rows = learning.labelled(grid).where(learning.in_training("specieskey", "year", "x", "y"))
    scored = learning.predictions(learning.train(rows), rows)
    return learning.mean_squared_error(scored).select("n", *rounded(mse=9))


# Projection and tiles ---------------------------------------------------------------------------------------------

def mercator_tiles(spark, sf_dir):
    points = exact_points(spark, sf_dir)
    lat, lng = F.col("lat"), F.col("lng")
    x4, y4 = mercator.address(lat, lng, 4)
    x9, y9 = mercator.address(lat, lng, 9)
    cx, cy = mercator.address(lat, lng, 9, clamp=True)
    return points.select(
        "specieskey", "year", *rounded(lat=6, lng=6),
        F.round(mercator.unit_x(lng), 9).alias("unit_x"), F.round(mercator.unit_y(lat), 9).alias("unit_y"),
        x4.alias("x4"), y4.alias("y4"), x9.alias("x9"), y9.alias("y9"), cx.alias("cx"), cy.alias("cy"),
    )


def mercator_pixels(spark, sf_dir):
    points = exact_points(spark, sf_dir).withColumns({
        "px": mercator.pixel_x(F.col("lng"), PIXEL_ZOOM), "py": mercator.pixel_y(F.col("lat"), PIXEL_ZOOM)})
    tiled = points.withColumns({
        "tile_x": mercator.pixel_to_tile(F.col("px"), PIXEL_ZOOM),
        "tile_y": mercator.pixel_to_tile(F.col("py"), PIXEL_ZOOM)})
    return tiled.withColumns({
        "back_lng": mercator.pixel_to_lng(F.col("px"), PIXEL_ZOOM),
        "back_lat": mercator.pixel_to_lat(F.col("py"), PIXEL_ZOOM),
        "corner_lng": mercator.tile_to_lng(F.col("tile_x"), PIXEL_ZOOM),
        "corner_lat": mercator.tile_to_lat(F.col("tile_y"), PIXEL_ZOOM),
        "metres": mercator.metres_per_pixel(F.col("lat"), PIXEL_ZOOM),
    }).select("specieskey", "year", "tile_x", "tile_y", *rounded(
        lat=6, lng=6, px=4, py=4, back_lng=6, back_lat=6, corner_lng=6, corner_lat=6, metres=6))


def tile_pyramid(spark, sf_dir):
    return tiles.tile_pyramid(exact_points(spark, sf_dir, with_name=True))


def pyramid_with_group(spark, sf_dir):
    return tiles.with_group_rows(tile_pyramid(spark, sf_dir))


def tile_json(spark, sf_dir):
    return tiles.tile_documents(pyramid_with_group(spark, sf_dir))


def tile_table_round_trip(spark, sf_dir):
    """Tile documents written as the zoom-partitioned serving table and read back."""
    path = tables.shared_folder(spark)
    tables.write_tiles(tiles.tile_documents(tile_pyramid(spark, sf_dir)), path)
    return tables.read_tiles(spark, path)


def point_tile_features(spark, sf_dir):
    placed = tiles.point_tile_features(all_point_trends(spark, sf_dir), POINT_ZOOMS)
    return placed.select("orderkey", "specieskey", "lat_e2", "lng_e2", "z", "x", "y", "local_x", "local_y",
                         *rounded(slope=9, significance=6))


def hex_tile_features(spark, sf_dir):
    drawn = hexes.hex_tile_features(all_hex_trends(spark, sf_dir), HEX_RADIUS)
    return drawn.select("orderkey", "specieskey", "z", "x", "y", "hex_c", "hex_k", "hex_id", *rounded(slope=9),
                        hexagons.ring_wkt(F.col("ring")).alias("ring"))


# Jobs -------------------------------------------------------------------------------------------------------------

def _prepared(spark, sf_dir) -> str:
    path = tables.shared_folder(spark)
    jobs.prepare(occurrence.occurrences_from_star(spark, sf_dir), path)
    return path


def job_tile_documents(spark, sf_dir):
    """Prepared points turned into tile documents of species and groups from the pyramid's first year on."""
    path = _prepared(spark, sf_dir)
    jobs.tile_documents(spark, f"{path}/points", f"{path}/tiles")
    return tables.read_tiles(spark, f"{path}/tiles", with_groups=True)


def job_wide_records(spark, sf_dir):
    path = _prepared(spark, sf_dir)
    jobs.wide_records(spark, path, f"{path}/wide")
    return tables.read_tsv(spark, f"{path}/wide", schemas.WIDE_RECORD_TEXT)


def job_grid(spark, sf_dir):
    path = _prepared(spark, sf_dir)
    jobs.grid(spark, path, f"{path}/grid")
    return tables.read_parquet(spark, f"{path}/grid", schemas.GRID)


# Charts -----------------------------------------------------------------------------------------------------------

def _charted(spark, sf_dir):
    return all_box_trends(spark, sf_dir)


def chart_series(spark, sf_dir):
    series = charts.chart_series(
        _charted(spark, sf_dir), ["request_id", "specieskey"], F.col("min_year"), F.col("max_year"))
    return series.select("request_id", "specieskey", "year", *rounded(share=9, line=6, group_line=8))


def trend_summary(spark, sf_dir):
    summary = charts.trend_summary(
        _charted(spark, sf_dir), ["request_id", "specieskey"], F.col("min_year"), F.col("max_year"))
    return summary


def slope_classes(spark, sf_dir):
    classed = all_hex_trends(spark, sf_dir).select(
        "orderkey", "specieskey", "z", "hex_c", "hex_k", *rounded(slope=9))
    return classed.withColumns({
        "slope_class": charts.slope_class(F.col("slope")), "direction": charts.direction(F.col("slope"))})


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        occurrence_snapshot, snapshot_orc_round_trip, quality_filter_counts, species_point_year_exact,
        species_point_year, group_point_year, group_point_year_direct, species_group_wide, species_names,
        name_autocomplete, species_year_maps, group_year_maps, species_points, group_points,
        features_tsv_round_trip, wkt_round_trip, json_round_trip, species_group_concat, year_count_strings,
        year_range_features, species_point_trend, yearly_shares, hex_year_counts, hex_trend, bbox_trend,
        trend_by_name, trend_significance, ols_sums_of_squares, ols_diagnostics, cell_year_counts, cell_slopes,
        grid10_counts, grid10_slopes, mllib_mse, mercator_tiles, mercator_pixels, tile_pyramid,
        pyramid_with_group, tile_json, tile_table_round_trip, point_tile_features, hex_tile_features, chart_series,
        trend_summary, slope_classes, species_keyed_read, group_keyed_read, points_compacted, species_point_trend_window,
        hex_trend_window, job_tile_documents, job_wide_records, job_grid,
    )
}
