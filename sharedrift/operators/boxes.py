"""Trends in user-drawn boxes: a whole table of requests answered in one job.

A request names a species and its group, two opposite corners (in any order) and a span of years.  All sides are inclusive.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharedrift import settings as S
from sharedrift.functions.features import computed, sorted_map
from sharedrift.operators.counts import group_point_year
from sharedrift.operators.filters import in_box
from sharedrift.operators.joins import copied, crowded_keys, dealt, joined_by, spread_join, with_salts
from sharedrift.operators.trends import fit_shares

# Sides of the large and the fine grid cells in hundredths of a degree, one a multiple of the other.
LEVELS_E2 = (500, 50)

# Tasks over which answers of large cells pass the join with the fine ones.
SPREAD_ANSWERS = 1024

# A cell of at most so many places (in one year) keeps the list of them; a finest cell has no more.
LEAF_PLACES = LEVELS_E2[-1] ** 2


def with_corners_ordered(requests: DataFrame) -> DataFrame:
    return requests.withColumns({
        "min_lat": F.least("lat_a", "lat_b"), "max_lat": F.greatest("lat_a", "lat_b"),
        "min_lng": F.least("lng_a", "lng_b"), "max_lng": F.greatest("lng_a", "lng_b"),
    }).drop("lat_a", "lat_b", "lng_a", "lng_b")


def _first_e2(side: Column, limit: float) -> Column:
    """The smallest whole hundredth of a degree that lies on or above a box's lower side."""
    low = F.greatest(side, F.lit(-limit))
    near = F.ceil(low * 100)
    return F.when((near - 1) / F.lit(100.0) >= low, near - 1).when(near / F.lit(100.0) < low, near + 1).otherwise(near)


def _last_e2(side: Column, limit: float) -> Column:
    """The largest whole hundredth of a degree that lies on or below a box's upper side."""
    high = F.least(side, F.lit(limit))
    near = F.floor(high * 100)
    return F.when((near + 1) / F.lit(100.0) <= high, near + 1).when(near / F.lit(100.0) > high, near - 1).otherwise(near)


def _range(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def cell_levels(places: DataFrame, subject: list[str]) -> list[DataFrame]:
    """For each level, from the largest cells to the smallest: (subject, row, column, year, n, n_places, places).

    ``places`` lists the single places (lat_e2, lng_e2, n) of a cell with at most ``LEAF_PLACES`` of them.  Each level is
    summed from the next finer one, so every list that is collected holds at most the lists of one cell's parts.
    ``places`` has one row per (subject, place, year).
    """
    size = LEVELS_E2[-1]
    finest = places.groupBy(
        *subject, F.floor(F.col("lat_e2") / size).alias("row"), F.floor(F.col("lng_e2") / size).alias("column"), "year",
    ).agg(
        F.sum("n").alias("n"), F.count("*").alias("n_places"),
        F.collect_list(F.struct("lat_e2", "lng_e2", "n")).alias("places"))
    levels = [finest]
    for size, finer in zip(reversed(LEVELS_E2[:-1]), reversed(LEVELS_E2[1:])):
        parts = size // finer
        levels.insert(0, levels[0].groupBy(
            *subject, F.floor(F.col("row") / parts).alias("row"), F.floor(F.col("column") / parts).alias("column"), "year",
        ).agg(
            F.sum("n").alias("n"), F.sum("n_places").alias("n_places"),
            F.flatten(F.collect_list("places")).alias("places"),  # of parts that have kept their lists
        ).withColumn("places", F.when(F.col("n_places") <= LEAF_PLACES, F.col("places"))))
    return levels


def _sided(boxes: DataFrame) -> DataFrame:
    """Boxes by their first and last places; a box beyond the plottable world has none."""
    return computed(
        boxes,
        _lat0=_first_e2(F.col("min_lat"), S.MAX_PLOT_LATITUDE), _lat1=_last_e2(F.col("max_lat"), S.MAX_PLOT_LATITUDE),
        _lng0=_first_e2(F.col("min_lng"), S.MAX_PLOT_LONGITUDE), _lng1=_last_e2(F.col("max_lng"), S.MAX_PLOT_LONGITUDE),
    ).where("_lat0 <= _lat1 AND _lng0 <= _lng1")


def _touched(size: int, within: tuple[str, str] | None = None, parent: int = 0) -> list[Column]:
    """Rows and columns of the cells that a box touches, of the whole world or within one cell of a larger level."""
    ranges = []
    for k, (low, high) in enumerate((("_lat0", "_lat1"), ("_lng0", "_lng1"))):
        first, last = F.floor(F.col(low) / size), F.floor(F.col(high) / size)
        if within:
            parts = parent // size
            first = F.greatest(first, F.col(within[k]) * parts)
            last = F.least(last, F.col(within[k]) * parts + parts - 1)
        ranges.append(_range(first, last))
    return ranges


def _whole(size: int) -> Column:
    """Whether the cell lies entirely inside the box."""
    row, column = F.col("row") * size, F.col("column") * size
    return (row >= F.col("_lat0")) & (row + size - 1 <= F.col("_lat1")) & (column >= F.col("_lng0")) & (
        column + size - 1 <= F.col("_lng1"))


def _inside() -> Column:
    """Observations at those places of a cell that lie inside the box."""
    kept = F.filter("places", lambda p: in_box(
        p["lat_e2"], p["lng_e2"], F.col("_lat0"), F.col("_lat1"), F.col("_lng0"), F.col("_lng1")))
    return F.aggregate(kept, F.lit(0).cast("long"), lambda total, p: total + p["n"])


def met_in_cells(boxes: DataFrame, places: DataFrame, subject: list[str]) -> DataFrame:
    """The cells that answer the boxes: (request_id, subject, year, size, row, column, whole, listed, n).

    A box meets the large cells first.  A cell inside it gives its sum, a cell with few places has those inside the box
    counted (``listed``), and only a cell that its edge cuts and that has many places is looked at on the finer level.  So a
    box costs a bounded number of large cells, and finer ones along its edge only where the data are dense.  No place of a box
    is in two of the cells.

    A cell asked for by many requests is spread by request: the salt of a large cell, from the measured number of requests
    that touch it, holds for all its parts.
    """
    large, fine = LEVELS_E2
    large_cells, fine_cells = cell_levels(places, subject)
    top, parts = [*subject, "row", "column"], large // fine
    rows, columns = _touched(large)
    asked = _sided(boxes).select(
        "request_id", *subject, "_lat0", "_lat1", "_lng0", "_lng1", "min_year", "max_year", columns.alias("_columns"),
        F.explode(rows).alias("row")).select("*", F.explode("_columns").alias("column")).drop("_columns")
    crowded = crowded_keys(asked.withColumn("n_rows", F.lit(1)), top, "n_rows")
    asked = dealt(with_salts(asked, crowded, top), ("request_id",))
    met = joined_by(
        asked.withColumn("_s", F.col("_salt")), copied(with_salts(large_cells, crowded, top)), [*top, "_salt"]
    ).where(F.col("year").between(F.col("min_year"), F.col("max_year")))

    # a cell that needs no closer look goes on as it is, spread by request; it meets no finer cell
    met = computed(met, _whole=_whole(large))
    met = computed(
        met, _open=~F.col("_whole") & F.col("places").isNull(),
        _n=F.when(F.col("_whole"), F.col("n")).otherwise(_inside()))  # null without a list of places
    open_ = F.col("_open")
    rows, columns = _touched(fine, ("row", "column"), large)
    closer = F.when(open_, F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: F.struct(
        r.alias("row"), c.alias("column")))))).otherwise(F.array(F.struct("row", "column")))
    passed = met.select(
        "request_id", *subject, "year", "_lat0", "_lat1", "_lng0", "_lng1", "_open", "_whole", "_n", F.size("places").alias("_listed"),
        F.when(open_, F.col("_s")).otherwise(-1 - F.pmod(F.xxhash64("request_id"), F.lit(SPREAD_ANSWERS))).alias("_salt"),
        F.inline(closer))
    owner = crowded.withColumnsRenamed({"_crowded_row": "_crowded__row", "_crowded_column": "_crowded__column"})
    few = copied(with_salts(
        fine_cells.select("*", F.floor(F.col("row") / parts).alias("_row"), F.floor(F.col("column") / parts).alias("_column")),
        owner, [*subject, "_row", "_column"])).drop("_row", "_column")
    finest = joined_by(passed, few, [*top, "year", "_salt"], "left")
    finest = computed(
        finest.where(~open_ | F.col("n").isNotNull()), whole=F.when(open_, _whole(fine)).otherwise(F.col("_whole")))
    return finest.select(
        "request_id", *subject, "year", F.when(open_, fine).otherwise(large).alias("size"), "row", "column", "whole",
        F.when(open_, F.size("places")).otherwise(F.col("_listed")).alias("listed"),
        F.when(~open_, F.col("_n")).when(F.col("whole"), F.col("n")).otherwise(_inside()).alias("n"))


def years_in_boxes(boxes: DataFrame, places: DataFrame, subject: list[str]) -> DataFrame:
    """Observations per request, subject and year inside its box, for boxes of any size and number.

    ``subject`` names the keys that requests share with the places.
    """
    return met_in_cells(boxes, places, subject).groupBy("request_id", *subject, "year").agg(
        F.sum("n").alias("n")).where("n > 0")


def _with_any_data(boxes: DataFrame, counts: DataFrame) -> DataFrame:
    """Requests whose species was seen anywhere in the years asked for."""
    # the record total is tested so that this reads the same counts, and shares their scan, as the other sides
    species = (
        counts.groupBy("orderkey", "specieskey")
        .agg(F.collect_set("year").alias("_years"), F.sum("n").alias("_records"))
        .where(F.col("_records") > 0).drop("_records")
    )
    return (
        spread_join(boxes, species, ["orderkey", "specieskey"], spread_by=("request_id",),
                    sizes=boxes.withColumn("n_rows", F.lit(1)))
        .where(F.exists("_years", lambda year: year.between(F.col("min_year"), F.col("max_year"))))
        .drop("_years")
    )


def box_trends(counts: DataFrame, requests: DataFrame, min_fit_years: int = S.MIN_FIT_YEARS_BOX) -> DataFrame:
    """One trend per request whose species has any data in the years asked for, even if none lies in the box.

    ``counts``: one row per (orderkey, specieskey, lat_e2, lng_e2, year); ``requests`` as ``schemas.BOX_REQUEST``.
    The one count table feeds the species and the group side, from one scan and shuffle.
    """
    boxes = with_corners_ordered(requests)
    # the places of species and of whole groups (without a species) answer the same boxes in one pass
    places = counts.select("orderkey", "specieskey", "lat_e2", "lng_e2", "year", "n").unionByName(
        group_point_year(counts).withColumn("specieskey", F.lit(None).cast("int")))
    both = boxes.withColumn("specieskey", F.explode(F.array("specieskey", F.lit(None).cast("int"))))
    of_group = F.col("specieskey").isNull()
    x = F.when(of_group, (F.col("year") - S.YEAR_ORIGIN).cast("long"))
    found = years_in_boxes(both, places, ["orderkey", "specieskey"]).groupBy("request_id").agg(
        sorted_map("year", "n", ~of_group).alias("species_seen"), sorted_map("year", "n", of_group).alias("group_counts"),
        F.count(x).alias("group_years"), F.sum(x).alias("_sx"), F.sum(x * x).alias("_sxx"))
    none, empty = F.lit(0).cast("long"), F.create_map().cast("map<int,bigint>")
    joined = (
        _with_any_data(boxes, counts)
        .select("request_id", "orderkey", "specieskey", "min_year", "max_year")
        .join(found, "request_id", "left")
        .withColumns({
            "species_seen": F.coalesce("species_seen", empty),
            "group_years": F.coalesce("group_years", none),
            "_sx": F.coalesce("_sx", none),
            "_sxx": F.coalesce("_sxx", none),
            "group_counts": F.coalesce("group_counts", empty),
        })
    )
    return fit_shares(joined, min_fit_years)
