"""The raw observation table: readers, and an adapter that derives one from star-schema tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharedrift import schemas


def read_occurrences(spark: SparkSession, name_or_path: str, fmt: str | None = None) -> DataFrame:
    """A catalog table, or files of the given format (``parquet``, ``orc``) with the declared schema."""
    if fmt is None:
        return spark.table(name_or_path)
    return spark.read.format(fmt).schema(schemas.OCCURRENCE).load(name_or_path)


def star_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.STAR[name]).parquet(f"{sf_dir}/{name}.parquet")


def occurrences_from_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations derived from lineitem, orders, supplier and nation.

    Supplier, nation and region stand for species, family and order, so a group strictly contains its species;
    customers give shared locations and parts a small jitter that rounding to 0.01 degree removes.
    """
    species = star_table(spark, sf_dir, "supplier").join(
        star_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = (
        star_table(spark, sf_dir, "lineitem")
        .join(star_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(species, F.col("l_suppkey") == F.col("s_suppkey"))
    )

    def spread(step: int, span: int) -> F.Column:
        return ((F.col("o_custkey") % 60 * step) % span).cast("double") / F.lit(100.0)

    def jitter(modulus: int) -> F.Column:
        return (F.col("l_partkey") % modulus - modulus // 2).cast("double") / F.lit(1000.0)

    absent = F.lit(None)
    basis = (
        F.when(F.col("l_returnflag") == "R", "FOSSIL_SPECIMEN")
        .when(F.col("l_returnflag") == "N", "HUMAN_OBSERVATION")
        .otherwise("PRESERVED_SPECIMEN")
    )
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("recordid"),
        absent.cast("int").alias("kingdomkey"),
        absent.cast("int").alias("phylumkey"),
        absent.cast("int").alias("classkey"),
        F.col("n_regionkey").cast("int").alias("orderkey"),
        F.col("s_nationkey").cast("int").alias("familykey"),
        absent.cast("int").alias("genuskey"),
        F.col("l_suppkey").cast("int").alias("specieskey"),
        F.col("l_suppkey").cast("int").alias("taxonkey"),
        F.when(F.col("o_custkey") % 97 != 0, spread(7919, 17800) - 89 + jitter(9)).alias("decimallatitude"),
        (spread(6133, 36000) - 180 + jitter(7)).alias("decimallongitude"),
        (F.col("l_linenumber") == 7).alias("hasgeospatialissues"),
        F.year("l_shipdate").alias("year"),
        F.month("l_shipdate").alias("month"),
        F.day("l_shipdate").alias("day"),
        basis.alias("basisofrecord"),
        F.col("o_orderpriority").alias("datasetkey"),
        F.col("o_orderstatus").alias("publishingorgkey"),
        F.col("n_name").alias("countrycode"),
        F.col("s_name").alias("scientificname"),
    )


def write_snapshot(occurrences: DataFrame, path: str, fmt: str = "orc") -> None:
    """The snapshot laid out by group and species, so that a read of one group skips files and stripes by their ranges.

    A crowded species is cut by record, so no file has to hold all of it.
    """
    rows = occurrence_snapshot(occurrences).repartitionByRange("orderkey", "specieskey", "recordid")
    rows.sortWithinPartitions("orderkey", "specieskey").write.mode("overwrite").format(fmt).save(path)


def occurrence_snapshot(occurrences: DataFrame) -> DataFrame:
    """The narrow column set every later step reads; the scan below it is pruned to the same columns."""
    return occurrences.select(*schemas.OCCURRENCE.fieldNames())
