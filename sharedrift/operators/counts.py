"""Observation counts by species, group, place and year.

Every count is a plain hash aggregate, reduced on the map side before its shuffle, so a species, place or dataset
holding a large part of all rows arrives at the reducer as one row per map task and key.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharedrift.operators.joins import spread_join

SPECIES_POINT = ("orderkey", "specieskey", "lat_e2", "lng_e2")
GROUP_POINT = ("orderkey", "lat_e2", "lng_e2")


def hundredths(degrees) -> F.Column:
    """Degrees rounded to 0.01, half-up on the decimal text, as integer hundredths: an exact join and grouping key.

    Only values next to a tie need the (slow) decimal rounding.
    """
    scaled = degrees * 100
    near_tie = F.abs(scaled - F.floor(scaled) - 0.5) < 1e-6
    return F.when(near_tie, F.rint(F.round(degrees, 2) * 100)).otherwise(F.rint(scaled)).cast("int")


def point_degrees(df: DataFrame) -> DataFrame:
    """Show integer hundredths as degrees."""
    return df.withColumns({"lat": F.col("lat_e2") / F.lit(100.0), "lng": F.col("lng_e2") / F.lit(100.0)}).drop(
        "lat_e2", "lng_e2"
    )


def species_point_year_exact(clean: DataFrame, with_name: bool = False) -> DataFrame:
    """Observations per species, year and exact coordinate (per name too, for the pyramid)."""
    name = ["scientificname"] if with_name else []
    return clean.groupBy(
        "orderkey", "specieskey", *name, "year",
        F.col("decimallatitude").alias("lat"), F.col("decimallongitude").alias("lng"),
    ).agg(F.count("*").alias("count"))


def named_points(clean: DataFrame) -> DataFrame:
    """Observations per species, name, year and exact coordinate, and how many of them bear the accepted name.

    Points, names and the pyramid all follow from this one table, so the observations are read once.
    """
    return clean.groupBy(
        "orderkey", "specieskey", "scientificname", "year",
        F.col("decimallatitude").alias("lat"), F.col("decimallongitude").alias("lng"),
    ).agg(F.count("*").alias("count"), F.count(F.when(F.col("specieskey") == F.col("taxonkey"), 1)).alias("accepted"))


def species_point_year(clean: DataFrame) -> DataFrame:
    """Observations per species, year and 0.01-degree place."""
    return clean.groupBy(
        "orderkey", "specieskey",
        hundredths(F.col("decimallatitude")).alias("lat_e2"),
        hundredths(F.col("decimallongitude")).alias("lng_e2"),
        "year",
    ).agg(F.count("*").alias("n"))


def over_groups(counts: DataFrame) -> DataFrame:
    """The same counts whatever the group, so a species that stands in two groups has one row per place and year."""
    return counts.groupBy("specieskey", "lat_e2", "lng_e2", "year").agg(F.sum("n").alias("n"))


def group_totals(counts: DataFrame, *place: str) -> DataFrame:
    """Whole-group observations per place and year, summed over the species counts."""
    return counts.groupBy("orderkey", *place, "year").agg(F.sum("n").alias("n"))


def group_point_year(counts: DataFrame) -> DataFrame:
    return group_totals(counts, "lat_e2", "lng_e2")


def group_point_year_direct(clean: DataFrame) -> DataFrame:
    """The same totals straight from observations."""
    return clean.groupBy(
        "orderkey",
        hundredths(F.col("decimallatitude")).alias("lat_e2"),
        hundredths(F.col("decimallongitude")).alias("lng_e2"),
        "year",
    ).agg(F.count("*").alias("n"))


def species_group_wide(counts: DataFrame, group: DataFrame) -> DataFrame:
    """Species count beside its group's count, per place and year.

    Spread by species (see ``joins.spread_join``), so one crowded place-year does not land in one task.
    """
    return spread_join(
        counts.withColumnRenamed("n", "speciescount"),
        group.withColumnRenamed("n", "ordercount"),
        [*GROUP_POINT, "year"],
        sizes=counts.where("n > 0").withColumn("n_rows", F.lit(1)),  # n is tested to share the scan of the counts
    )


def species_years(clean_or_counts: DataFrame) -> DataFrame:
    """Observations per species and year, over all places."""
    counted = "n" in clean_or_counts.columns
    total = F.sum("n") if counted else F.count("*")
    return clean_or_counts.groupBy("orderkey", "specieskey", "year").agg(total.alias("n"))
