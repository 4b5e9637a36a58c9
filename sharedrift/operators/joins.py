"""The one kind of join all trends use: many rows per key with few rows per key, safe for crowded keys."""

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharedrift import settings as S


def same_keys(keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of the keys with those of the other side, whose names carry the prefix.

    Plain equality would make the optimizer test every computed key for NULL down at the scan, on one side only: the
    expressions would run twice, and a table feeding both sides would be scanned and shuffled twice.
    """
    return reduce(and_, (F.col(key).eqNullSafe(F.col(f"{prefix}{key}")) for key in keys))


def crowded_keys(
    sizes: DataFrame, keys: Sequence[str], size: str, rows_per_copy: int = S.ROWS_PER_COPY, most: int = S.MOST_CROWDED_KEYS,
) -> DataFrame:
    """The keys whose measured rows are too many for one task, and over how many tasks (``_salts``) each is spread.

    ``sizes`` has rows of the keys with a number of rows in ``size`` that are summed.  At most ``most`` keys, the largest,
    are returned: that bounds what is broadcast, and any other key holds less than one part in ``most`` of all rows.
    """
    measured = sizes.groupBy(*keys).agg(F.sum(size).alias("_rows")).where(F.col("_rows") > rows_per_copy)
    return measured.orderBy(F.desc("_rows"), *keys).limit(most).select(
        *(F.col(key).alias(f"_crowded_{key}") for key in keys), F.ceil(F.col("_rows") / rows_per_copy).alias("_salts"))


def with_salts(df: DataFrame, crowded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_salts``, 1 for a key that is not crowded.  The broadcast side has at most ``MOST_CROWDED_KEYS`` short rows."""
    found = df.join(F.broadcast(crowded), same_keys(keys, "_crowded_"), "left")
    return found.withColumn("_salts", F.coalesce("_salts", F.lit(1).cast("long"))).drop(*(f"_crowded_{key}" for key in keys))


def dealt(df: DataFrame, spread_by: Sequence[str]) -> DataFrame:
    """A row's salt, one of its key's ``_salts``."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.col("_salts"))).drop("_salts")


def copied(df: DataFrame) -> DataFrame:
    """A row once for each of its key's ``_salts``."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts")


def joined_by(many: DataFrame, few: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    few = few.withColumnsRenamed({key: f"_few_{key}" for key in keys})
    return many.join(few, same_keys(keys, "_few_"), how).drop("_salt", *(f"_few_{key}" for key in keys))


def spread_join(
    many: DataFrame, few: DataFrame, keys: Sequence[str], spread_by: Sequence[str] = ("specieskey",),
    spread: int = S.JOIN_SPREAD, sizes: DataFrame | None = None, size: str = "n_rows",
) -> DataFrame:
    """Inner join in which a key holding a large part of ``many`` does not land in one task.

    Rows of ``many`` are salted by a hash of the ``spread_by`` columns, and the rows of ``few`` (the small side: one row
    per place, or the requests of a species) are copied once per salt.  With ``sizes`` (rows of the keys, and how many rows
    of ``many`` they stand for in ``size``) the number of salts is each key's own, 1 for most; without, it is ``spread`` for
    every key.  The salt is part of the join key, so both sides are shuffled for this join alone and no later grouping can
    lean on its partitioning: adaptive execution stays free to split a skewed partition further, or to turn the join into a
    broadcast once it has measured the small side.  No broadcast of either side is forced here.
    """
    keys = list(keys)
    if sizes is not None:
        crowded = crowded_keys(sizes, keys, size)
        many, few = dealt(with_salts(many, crowded, keys), spread_by), copied(with_salts(few, crowded, keys))
    elif spread > 1:
        many = dealt(many.withColumn("_salts", F.lit(spread).cast("long")), spread_by)
        few = copied(few.withColumn("_salts", F.lit(spread).cast("long")))
    else:
        return joined_by(many, few, keys)
    return joined_by(many, few, [*keys, "_salt"])
