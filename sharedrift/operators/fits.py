"""Grouped line fits of raw counts per year."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharedrift.functions import statistics
from sharedrift.functions.features import sorted_map


def slopes(counts: DataFrame, keys: list[str], count: str = "count", with_years: bool = False) -> DataFrame:
    """Least-squares slope of count per year for each key; NULL for fewer than two years.

    ``with_years`` adds the year -> count map (input must then be unique per key and year).
    """
    extra = [sorted_map("year", count).alias("year_counts")] if with_years else []
    return counts.groupBy(*keys).agg(
        F.regr_slope(F.col(count).cast("double"), F.col("year").cast("double")).alias("slope"), *extra
    )


def ols_sums_of_squares(df: DataFrame, keys: list[str], y: str, x: str = "year") -> DataFrame:
    fit = df.groupBy(*keys).agg(*statistics.line_fit(y, x))
    return fit.select(*keys, *[c.alias(name) for name, c in statistics.sums_of_squares().items()])


def ols_diagnostics(df: DataFrame, keys: list[str], y: str, x: str = "year") -> DataFrame:
    fit = df.groupBy(*keys).agg(*statistics.line_fit(y, x))
    return fit.select(*keys, *[c.alias(name) for name, c in statistics.diagnostics().items()])
