"""URL filter: prefix rules and host lists kept in Bloom filter cascades, exact for every key of the corpus.

A key is a host or one of its parent domains, followed by the start of the path; the universe is the set of all keys that any
url of the corpus can be looked up by.  Level 1 of a cascade is a Bloom filter of the listed keys; level 2 holds the keys of
the rest of the universe that level 1 wrongly accepts; level 3 the listed keys that level 2 wrongly accepts; and so
on until nothing is wrongly accepted.  A key is then listed if it fails at an even level or passes the last, odd one.
Urls are judged by looking their keys up in the levels: no join with lists.

Levels are built as distributed jobs (bit positions, then one bitmap per 32768 of them) and sent to the tasks.  A cascade
larger than ``FILTER_BYTES`` is cut into shards by key; shards are built and applied one after another, with the
verdicts so far kept in a written table, so no task ever holds more than one.

Edge cases: a null url or one without ``://`` has empty host and path, and no key; empty lists match nothing; repeated rules
count once, and if a rule stands in both lists, block wins; of equally long rules the one with the longer host wins; an
empty table gives an empty result; other columns are kept, those named like an output are replaced.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharedrift.llm.common import whole_row
from sharedrift.sources.tables import written_once

BITMAP_BITS = 32768  # bits of one bitmap of Spark's bitmap functions
FIRST_RATE = 0.01  # share of the universe the first level may wrongly accept, relative to the number of listed keys
NEXT_RATE = 0.05
FILTER_BYTES = 64 << 20
MAX_LEVELS = 60


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def domains(host: Column) -> Column:
    """The host and its parent domains, longest first; empty for an empty host."""
    parts = F.split(host, r"\.", -1)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), ".")))


def prefixes(path: Column, lengths: list[int]) -> Column:
    """Starts of the path that have one of the given lengths."""
    starts = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    return F.array_compact(F.array(*starts)) if starts else F.array().cast("array<string>")


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def _keys_of(array: Column, first: bool) -> Column:
    return F.transform(array, lambda key: _hashes(key)[0 if first else 1])


class Level:
    """One Bloom filter: which keys it holds is known by ``hashes`` of ``bits`` positions each."""

    def __init__(self, number: int, hashes: int, bits: int) -> None:
        self.number, self.hashes, self.bits = number, hashes, bits
        self.words = np.zeros((bits // BITMAP_BITS + 1) * (BITMAP_BITS // 8), dtype=np.uint8)

    def positions(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        """Bit positions of keys; mixed differently at each level."""
        with np.errstate(over="ignore"):
            for k in range(self.hashes):
                mixed = h1.astype(np.uint64) + np.uint64(self.number * 64 + k + 1) * (h2.astype(np.uint64) | np.uint64(1))
                mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                yield ((mixed >> np.uint64(20)) % np.uint64(self.bits)).astype(np.int64)

    def accepts(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        hit = np.ones(len(h1), dtype=bool)
        for at in self.positions(h1, h2):
            hit &= (self.words[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return hit


def _level(keys: DataFrame, number: int, count: int, rate: float) -> Level:
    """A Bloom filter of ``keys`` (h1, h2).  Tasks make its bitmaps; gathered, they have ``bits`` / 8 bytes."""
    hashes = max(1, round(-float(np.log2(rate))))
    level = Level(number, hashes, max(64, int(np.ceil(count * hashes / np.log(2)))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in level.positions(batch.column("h1").to_numpy(), batch.column("h2").to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array(at + 1)], names=["at"])  # Spark's bitmaps count from 1

    made = keys.select("h1", "h2").mapInArrow(work, "at bigint").groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    size = BITMAP_BITS // 8
    for row in made.collect():
        level.words[(row["bucket"] - 1) * size:row["bucket"] * size] = np.frombuffer(row["bitmap"], dtype=np.uint8)
    return level


def _accepted(keys: DataFrame, level: Level) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast(level)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = sent.value.accepts(batch.column("h1").to_numpy(), batch.column("h2").to_numpy())
            yield batch.filter(pa.array(hit))

    return keys.mapInArrow(work, keys.schema)


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels that tell the ``listed`` keys from all others of ``universe``; both have a column ``key``."""
    h1, h2 = _hashes(F.col("key"))
    keys = written_once(
        listed.select(h1.alias("h1"), h2.alias("h2"), F.lit(True).alias("listed"))
        .union(universe.select(h1, h2, F.lit(False))).groupBy("h1", "h2").agg(F.max("listed").alias("listed")))
    counts = {row["listed"]: row["count"] for row in keys.groupBy("listed").count().collect()}
    inside, outside = (keys.filter(F.col("listed") == flag).select("h1", "h2") for flag in (True, False))
    count, rate = counts.get(True, 0), min(NEXT_RATE, max(1e-6, FIRST_RATE * counts.get(True, 0) / max(counts.get(False, 0), 1)))
    levels: list[Level] = []
    while count:
        if len(levels) == MAX_LEVELS:
            raise ValueError("two keys of the universe share all hashes")
        levels.append(_level(inside, len(levels), count, rate))
        wrong = written_once(_accepted(outside, levels[-1]))
        inside, outside, count, rate = wrong, inside, wrong.count(), NEXT_RATE
    return levels


def holds(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed: the first level that refuses a key decides, by its parity."""
    result = np.full(len(h1), len(levels) % 2 == 1)
    undecided = np.arange(len(h1))
    for n, level in enumerate(levels):
        passed = level.accepts(h1[undecided], h2[undecided])
        result[undecided[~passed]] = n % 2 == 1
        undecided = undecided[passed]
    return result


def with_membership(rows: DataFrame, keys: str, listed: DataFrame, universe: DataFrame, out: str) -> DataFrame:
    """Add ``out``: for the array column ``keys``, an array that tells which keys are listed."""
    bits = 16 * listed.count()  # of all levels together, generously
    shards = max(1, -(-bits // (8 * FILTER_BYTES)))
    schema = rows.withColumn(out, F.array().cast("array<boolean>")).schema
    hashed = rows.withColumn("_h1", _keys_of(F.col(keys), True)).withColumn("_h2", _keys_of(F.col(keys), False))
    found = hashed.withColumn(out, F.transform(keys, lambda key: F.lit(False)))
    for shard in range(shards):
        def mine(df: DataFrame) -> DataFrame:
            return df if shards == 1 else df.filter(F.pmod(_hashes(F.col("key"))[0], F.lit(shards)) == shard)

        found = _look_up(found, cascade(mine(listed), mine(universe)), shard, shards, out)
        if shards > 1:
            found = written_once(found)
    return found.select(*schema.names)


def _look_up(rows: DataFrame, levels: list[Level], shard: int, shards: int, out: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(levels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = {c: batch.column(c) for c in batch.schema.names}
            h1, h2 = (arrays[c].flatten().to_numpy(zero_copy_only=False) for c in ("_h1", "_h2"))
            yes = holds(sent.value, h1, h2) & (np.mod(h1, shards) == shard)
            yes |= arrays[out].flatten().to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(arrays["_h1"]).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            arrays[out] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(yes))
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    return rows.mapInArrow(work, rows.schema)


def judge(pages: DataFrame, block: DataFrame, allow: DataFrame, path_lengths: list[int]) -> DataFrame:
    """Add host, path, rule and verdict to rows with ``url``.

    ``block`` and ``allow`` have a column ``key``: a domain followed by the start of a path (a rule), or a domain alone (a
    listed host).  ``path_lengths``: the lengths of the rules' paths.  The longest rule decides; without one, a listed host
    is blocked or, failing that, any url allowed.
    """
    rows = with_keys(pages.select("url", whole_row(pages).alias("_row")), path_lengths)
    universe = keys_of(rows)
    rows = with_membership(rows, "_keys", block, universe, "_block")
    rows = with_membership(rows, "_keys", allow, universe, "_allow")
    listed = F.filter(F.arrays_zip("_keys", "_block", "_allow"), lambda k: k["_block"] | k["_allow"])
    rule = F.get(F.filter(listed, lambda k: F.contains(k["_keys"], F.lit("/"))), F.lit(0))
    host_blocked = F.exists(listed, lambda k: k["_block"] & ~F.contains(k["_keys"], F.lit("/")))
    verdict = F.when(rule["_block"], "block").when(rule["_allow"], "allow").when(host_blocked, "block").otherwise("allow")
    added = {"host": F.col("host"), "path": F.col("path"), "rule": rule["_keys"], "verdict": verdict}
    return rows.select(
        *[F.col("_row")[c].alias(c) for c in pages.columns if c not in added], *[column.alias(c) for c, column in added.items()])


def with_keys(pages: DataFrame, path_lengths: list[int]) -> DataFrame:
    """Add host, path and ``_keys``: everything the url can be looked up by, longest first."""
    rows = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    starts = F.concat(prefixes(F.col("path"), sorted(set(path_lengths))), F.array(F.lit("")))
    keys = F.flatten(F.transform(domains(F.col("host")), lambda d: F.transform(starts, lambda p: F.struct(
        (-F.length(d) - F.length(p)).alias("rank"), (-F.length(d)).alias("host"), F.concat(d, p).alias("key")))))
    return rows.withColumn("_keys", F.transform(F.sort_array(keys), lambda k: k["key"]))


def keys_of(rows: DataFrame) -> DataFrame:
    """The universe: every key that occurs, once."""
    return written_once(rows.select(F.explode("_keys").alias("key")).distinct())
