"""Share trends: the species' yearly share of its group at a place, with absences inferred, and a line through it.

A year in which the group was seen and the species was not counts as share 0.  Those zero rows are never built:
with the group's years known per place, a line fit needs only

    n, mean x, sxx      from the group's years alone,
    sum y               from the species' own years (zeros add nothing),
    sxy = sum (x - mean x) y          over the species' own years,
    syy = sum (y - mean y)^2          over the species' own years, plus (absent years) * (mean y)^2,

so one row per (species, place) meets one row per place.  Both carry a year list, bounded by the number of years.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharedrift import settings as S
from sharedrift.functions import statistics
from sharedrift.functions.features import sorted_map
from sharedrift.operators.filters import in_years
from sharedrift.operators.joins import spread_join

STATISTICS = ("slope", "intercept", "significance", "sse", "intercept_stderr", "mse", "slope_stderr")


def species_year_maps(counts: DataFrame, place: tuple[str, ...], min_years: int = 1) -> DataFrame:
    """Year -> count per species and place, kept when the species was seen there in at least ``min_years`` years.

    ``counts`` has one row per (species, place, year).
    """
    maps = counts.groupBy("orderkey", "specieskey", *place).agg(sorted_map("year", "n").alias("species_seen"))
    return maps.where(F.size("species_seen") >= min_years) if min_years > 1 else maps


def year_maps(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Year -> count per key.  ``counts``: one row per (keys, year)."""
    return counts.groupBy(*keys).agg(sorted_map("year", "n").alias("species_seen"))


def year_sums() -> list[Column]:
    x = (F.col("year") - S.YEAR_ORIGIN).cast("long")
    return [F.count("*").alias("group_years"), F.sum(x).alias("_sx"), F.sum(x * x).alias("_sxx")]


def group_totals(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Observations of the group per key and year, and ``n_rows``, how many rows of species they come from.

    Both are tested, so that whatever reads only one of them still reads the same table, from the same shuffle.
    """
    return counts.groupBy(*keys, "year").agg(F.sum("n").alias("n"), F.count("*").alias("n_rows")).where(
        "n IS NOT NULL AND n_rows > 0")


def joined_with_group(species: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Year maps of the species beside those of the group at the same place; a place is spread by its rows of species."""
    return spread_join(species, group_year_maps(totals, keys), keys, sizes=totals)


def group_year_maps(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Year -> count of the group per place, with the sums of its years.  ``totals``: one row per (keys, year)."""
    return totals.groupBy(*keys).agg(*year_sums(), sorted_map("year", "n").alias("group_counts"))


def fit_shares(joined: DataFrame, min_fit_years: int, fill_unfitted: bool = True) -> DataFrame:
    """Fit the shares of ``species_seen`` in ``group_counts``; adds the statistics and ``species_counts``.

    ``species_counts`` carries the inferred zeros (where no fit is made, only if ``fill_unfitted``).
    """
    n, zero = F.col("_n"), F.lit(0.0)
    shares = F.transform(
        F.map_entries("species_seen"),
        lambda e: F.struct(
            (e["key"] - S.YEAR_ORIGIN).cast("double").alias("x"),
            (e["value"].cast("double") / F.col("group_counts")[e["key"]]).alias("y"),
        ),
    )
    staged = (
        joined
        # a place without group data has no mean
        .withColumns({"_n": F.nullif("group_years", F.lit(0)), "species_years": F.size("species_seen")})
        .withColumn("_shares", shares)
        .withColumns({
            "_ys": F.transform("_shares", lambda p: p["y"]),
            "_x_shift": F.col("_sx") / n,
        })
        .withColumns({
            "_y_mean": F.aggregate("_ys", zero, lambda acc, y: acc + y) / n,
            "_flat": (F.col("species_years") == n) & (F.array_max("_ys") == F.array_min("_ys")),
        })
        .withColumns({
            "_sxy": F.when(F.col("_flat"), zero).otherwise(
                F.aggregate("_shares", zero, lambda acc, p: acc + (p["x"] - F.col("_x_shift")) * p["y"])),
            "_syy": F.when(F.col("_flat"), zero).otherwise(
                F.aggregate(
                    "_ys", (n - F.col("species_years")) * F.col("_y_mean") * F.col("_y_mean"),
                    lambda acc, y: acc + (y - F.col("_y_mean")) * (y - F.col("_y_mean")))),
            "_sxx": F.col("_sxx") - F.col("_sx") * F.col("_x_shift"),
            "_x_mean": F.col("_x_shift") + S.YEAR_ORIGIN,
        })
    )
    filled = F.transform_values(
        "group_counts", lambda year, _: F.coalesce(F.col("species_seen")[year], F.lit(0).cast("long")))
    if not fill_unfitted:
        filled = F.when(F.col("group_years") >= min_fit_years, filled).otherwise(F.col("species_seen"))
    return statistics.with_fit(staged, min_fit_years).withColumn("species_counts", filled).drop(
        "species_seen", "_n", "_shares", "_ys", "_sx", "_sxx", "_x_shift", "_x_mean", "_y_mean", "_flat", "_sxy",
        "_syy",
    )


def share_trends(
    counts: DataFrame,
    place: tuple[str, ...],
    years: tuple[int, int] | None = None,
    min_species_years: int = 1,
    min_fit_years: int = S.MIN_FIT_YEARS_PLACE,
    fill_unfitted: bool = True,
) -> DataFrame:
    """Trend of every species at every place it was seen.

    ``counts``: one row per (orderkey, specieskey, *place, year) with ``n``.  The year threshold applies to years the
    species was seen, before absences; only group data at places with species data survives the join.
    """
    if years:
        counts = in_years(counts, *years)
    keys = ["orderkey", *place]
    joined = joined_with_group(
        species_year_maps(counts, place, min_species_years), group_totals(counts, keys), keys)
    return fit_shares(joined, min_fit_years, fill_unfitted)


def point_trends(counts: DataFrame, **options) -> DataFrame:
    """Trends at 0.01-degree places."""
    return share_trends(counts, ("lat_e2", "lng_e2"), **options)


def species_trends(yearly: DataFrame, **options) -> DataFrame:
    """Trends over all places together; ``yearly`` is ``counts.species_years``."""
    return share_trends(yearly, (), **options)


def yearly_shares(counts: DataFrame, place: tuple[str, ...]) -> DataFrame:
    """The long form, one row per (species, place, group year), zeros included.

    Built from the joined maps, for users who want the rows; the trends above do not need it.
    """
    keys = ["orderkey", *place]
    joined = joined_with_group(species_year_maps(counts, place), group_totals(counts, keys), keys)
    return (
        joined
        .select("specieskey", *keys, "species_seen", F.explode("group_counts").alias("year", "group_n"))
        .withColumn("species_n", F.coalesce(F.col("species_seen")[F.col("year")], F.lit(0).cast("long")))
        .withColumn("share", F.col("species_n").cast("double") / F.col("group_n"))
        .drop("species_seen")
    )
