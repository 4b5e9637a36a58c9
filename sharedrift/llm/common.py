"""Pieces several operators share."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def text_key(text: Column) -> Column:
    """128 bits of a text, so rows that share an id but not a text stay apart; null differs from empty."""
    return F.unhex(F.md5(F.concat(F.lit("t"), text)))


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that none can meet a name used inside an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unwrapped(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(row)[c].alias(c) for c in columns])
