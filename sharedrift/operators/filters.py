"""Row predicates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharedrift import settings as S
from sharedrift.functions.mercator import plottable


def quality_filter(
    occurrences: DataFrame, group_key: int | None = None, min_year: int = S.MIN_RECORD_YEAR
) -> DataFrame:
    """Observations fit for trends, of one group or (``None``) of every group; without a group there is no share.

    A NULL issue flag or basis of record drops the row, as in SQL.
    """
    keep = (
        F.col("specieskey").isNotNull()
        & plottable(F.col("decimallatitude"), F.col("decimallongitude"))
        & (F.col("hasgeospatialissues") == F.lit(False))
        & (F.col("year") >= min_year)
        & ~F.col("basisofrecord").isin(*S.EXCLUDED_BASES)
    )
    group = F.col("orderkey")
    return occurrences.where((group.isNotNull() if group_key is None else group == group_key) & keep)


def accepted_names_only(occurrences: DataFrame) -> DataFrame:
    return occurrences.where(F.col("specieskey") == F.col("taxonkey"))


def of_species(df: DataFrame, *species_keys: int) -> DataFrame:
    """One or a few species by key; pruned by Parquet statistics when the table is sorted by species."""
    return df.where(F.col("specieskey").isin(*species_keys))


def of_group(df: DataFrame, group_key: int) -> DataFrame:
    """One group by key; pruned when the table is sorted by group."""
    return df.where(F.col("orderkey") == group_key)


def in_years(df: DataFrame, min_year: int, max_year: int) -> DataFrame:
    """Both ends inclusive."""
    return df.where(F.col("year").between(min_year, max_year))


def in_box(lat: Column, lng: Column, min_lat, max_lat, min_lng, max_lng) -> Column:
    """Inclusive on all four sides."""
    return lat.between(min_lat, max_lat) & lng.between(min_lng, max_lng)
