"""Chart-ready series and headline figures of a trend.

Input rows carry ``slope``, ``intercept``, ``species_counts`` and ``group_counts``.  The year axis runs from the first
year up to, but not including, the last.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharedrift import settings as S


def _half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def fitted(year: Column) -> Column:
    return F.col("slope") * year + F.col("intercept")


def chart_series(trends: DataFrame, keys: list[str], min_year: Column, max_year: Column) -> DataFrame:
    """One row per trend and axis year: share (NULL without group data), fitted line, and the group's counts scaled
    so that their largest value meets the largest share.

    The two maxima are taken over the axis years of the row's own maps, so no window or shuffle is needed.
    """
    axis = F.when(min_year < max_year, F.sequence(min_year, max_year - 1))
    share = lambda y: F.col("species_counts")[y].cast("double") / F.col("group_counts")[y]
    rows = (
        trends
        .withColumn("_axis", axis)
        .withColumns({
            "_max_share": F.greatest(F.coalesce(F.array_max(F.transform("_axis", share)), F.lit(0.0)), F.lit(0.0)),
            "_max_group": F.array_max(F.transform("_axis", lambda y: F.col("group_counts")[y])),
        })
        .withColumn("year", F.explode("_axis"))
    )
    group = F.coalesce(F.col("group_counts")[F.col("year")], F.lit(0).cast("long"))
    return rows.select(
        *keys, "year",
        share(F.col("year")).alias("share"),
        fitted(F.col("year")).alias("line"),
        F.when(F.col("_max_group") > 0, F.col("_max_share") * group / F.col("_max_group")).alias("group_line"),
    )


def trend_summary(trends: DataFrame, keys: list[str], min_year: Column, max_year: Column) -> DataFrame:
    """Yearly rate per ten thousand, level at the axis end in percent of its start, and direction.

    The level is given only when both ends of the line are above zero, by more than the rounding noise of a line that
    ends at zero exactly (relative to the larger end, so shares may be as small as they like); ``change_pct`` is the level less 100.  A slope
    that is rounding noise beside the line's height counts as level, so no decline.
    """
    start, end = fitted(min_year), fitted(max_year - 1)
    noise = S.LEVEL_NOISE * F.greatest(F.abs(start), F.abs(end))
    level = F.abs(F.col("slope")) <= S.SLOPE_NOISE * F.greatest(F.abs(start), F.abs(end))
    ratio = F.when((start > noise) & (end > noise), _half_up(end * 100 / start))
    return trends.select(
        *keys,
        (_half_up(F.col("slope") * 1000000) / F.lit(100.0)).alias("rate_per_10k"),
        ratio.alias("level_ratio_pct"),
        (ratio - 100).alias("change_pct"),
        direction(F.when(level, 0.0).otherwise(F.col("slope"))).alias("direction"),
    )


def direction(slope: Column) -> Column:
    return F.when(slope < 0, F.lit("decline")).when(slope >= 0, F.lit("no decline"))


def slope_class(slope: Column) -> Column:
    """0 (steepest rise) to 9 (steepest fall); each class includes its lower end.  No class without a slope."""
    classes = F.when(slope.isNull(), F.lit(None).cast("int"))
    for index, lower in enumerate(S.SLOPE_BREAKS):
        classes = classes.when(slope >= lower, F.lit(index))
    return classes.otherwise(F.lit(len(S.SLOPE_BREAKS)))
