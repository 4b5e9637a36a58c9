"""Scientific names: the lookup table, prefix search, and trends chosen by name."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharedrift import settings as S
from sharedrift.operators.filters import accepted_names_only


def species_names(clean: DataFrame) -> DataFrame:
    """Accepted names observed more than once."""
    return (
        accepted_names_only(clean)
        .groupBy("scientificname", "specieskey")
        .agg(F.count("year").alias("records"))
        .where(F.col("records") > 1)
    )


def names_of_points(points: DataFrame) -> DataFrame:
    """The same from ``counts.named_points``."""
    return (
        points.groupBy("scientificname", "specieskey").agg(F.sum("accepted").alias("records")).where(F.col("records") > 1)
    )


def groups_of_names(clean: DataFrame, names: DataFrame, prefix: str) -> DataFrame:
    """The groups in which a species whose name matches was observed, under whatever name; one row each."""
    keys = matching_names(names, prefix).select("specieskey")
    return clean.join(keys, "specieskey", "left_semi").select("orderkey").distinct()


def matching_names(names: DataFrame, prefix: str, ignore_case: bool = False) -> DataFrame:
    """Names LIKE the prefix; a caller's own ``%`` and ``_`` stay wildcards."""
    pattern = prefix if prefix.endswith("%") else prefix + "%"
    name = F.col("scientificname")
    return names.where(name.ilike(pattern) if ignore_case else name.like(pattern))


def autocomplete(
    names: DataFrame, prefix: str, limit: int = S.AUTOCOMPLETE_LIMIT, ignore_case: bool = False
) -> DataFrame:
    """The first names in order; ties are broken by key.  Runs as a per-partition top-k."""
    return (
        matching_names(names, prefix, ignore_case)
        .select("specieskey", "scientificname")
        .orderBy("scientificname", "specieskey")
        .limit(limit)
    )


def trends_by_name(names: DataFrame, prefix: str, trends: DataFrame) -> DataFrame:
    """Trends of the species whose name matches."""
    return matching_names(names, prefix).select("specieskey", "scientificname").join(trends, "specieskey")
