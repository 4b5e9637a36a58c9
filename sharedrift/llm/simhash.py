"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits are cut into 32 segments of two bits; the segments' bit counts (0, 1, 2) are the coordinates of a
point.  One changed bit moves one coordinate by one, so the Manhattan distance of two points never exceeds the number of
differing bits.  The grid: the segments are dealt into 2d groups (d: the most differing bits allowed).  Points at
distance d or less differ in at most d groups, so they agree on all coordinates of some d groups: they share a grid
cell for at least one choice of d groups.  Within a cell, pairs beyond Manhattan distance d are ruled out first and the
rest are verified bit by bit.

Only distinct fingerprints meet (copies share one), a cell gives the edges of a spanning forest and never all pairs of a group,
and a cell of more than ``HOT_CELL`` fingerprints is cut further by the same rule on the coordinates outside it.

Coordinates are kept in unary (00, 01, 11), so the Manhattan distance is the bit count of an exclusive or.

Edge cases: a null or empty text has fingerprint 0 and is linked like any other; repeated rows are separate documents; a
null id takes no part in the smallest id of a component (null if all are null); an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharedrift.llm.common import text_key, unwrapped, whole_row
from sharedrift.llm.components import components
from sharedrift.sources.tables import written_once

SHINGLE_WORDS = 3
MAX_BITS = 3
HASH_SEED = 42
HOT_CELL = 50_000
SEGMENTS = 32
LOW = 0x5555555555555555  # the lower bit of every segment
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64 majority bits over the hashes of all word shingles; bytes lower() and split() know ASCII only, as intended."""
    words = text.lower().split()
    n = len(words) - shingle_words + 1
    if not words:
        return 0
    line = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(line, HASH_SEED)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = (starts + sizes)[shingle_words - 1:].tolist()
    starts = starts[:n].tolist()
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        hashes = np.array([
            xxhash.xxh64_intdigest(line[a:b], HASH_SEED)
            for a, b in zip(starts[at:at + HASHES_AT_ONCE], ends[at:at + HASHES_AT_ONCE])], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, key, fp): the document's id, the hash of its text, and the fingerprint as a signed bigint."""
    rows = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(text_key(F.col("text")), F.lit(b"")).alias("key"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_buffer().to_pybytes(), shingle_words) for t in batch.column("text")]
            fp = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fp], names=["id", "key", "fp"])

    return rows.mapInArrow(work, rows.select("id", "key", F.lit(0).cast("long").alias("fp")).schema)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _point(fp: Column) -> Column:
    """Bit counts of the two-bit segments, in unary."""
    above, low = F.shiftrightunsigned(fp, 1), F.lit(LOW)
    some, both = fp.bitwiseOR(above).bitwiseAND(low), fp.bitwiseAND(above).bitwiseAND(low)
    return some.bitwiseOR(F.shiftleft(both, 1))


def _masks(segments: list[int], max_bits: int) -> list[int]:
    """The bits of every choice of ``max_bits`` out of 2 * ``max_bits`` groups of segments."""
    groups = [segments[k::2 * max_bits] for k in range(2 * max_bits)]
    return [sum(3 << 2 * s for g in chosen for s in g) for chosen in combinations(groups, max_bits)]


def cells(points: DataFrame, max_bits: int = MAX_BITS, hot_cell: int = HOT_CELL) -> DataFrame:
    """(fp, point, choice, cell): the grid cells of every point; ``points`` has distinct fp and point."""
    masks = _masks(list(range(SEGMENTS)), max_bits)
    if max_bits == 0:
        return points.select("fp", "point", F.lit(0).alias("choice"), F.col("fp").alias("cell"))

    def keyed(rows: DataFrame, first: int, some: list[int]) -> DataFrame:
        each = F.array(*[
            F.struct(F.lit(first + k).alias("choice"), F.col("point").bitwiseAND(F.lit(_signed(m))).alias("cell"))
            for k, m in enumerate(some)])
        return rows.select("fp", "point", F.explode(each).alias("_c")).select("fp", "point", "_c.choice", "_c.cell")

    found = keyed(points, 0, masks)
    hot = written_once(
        found.groupBy("choice", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_cell).drop("n"))
    if hot.isEmpty():
        return found
    cut = found.join(hot, ["choice", "cell"], "left_anti")
    for k, mask in enumerate(masks):
        rest = [s for s in range(SEGMENTS) if not mask >> 2 * s & 1]
        finer = [mask | m for m in _masks(rest, max_bits)]
        members = points.withColumn("cell", F.col("point").bitwiseAND(F.lit(_signed(mask)))).join(
            hot.filter(F.col("choice") == k), "cell", "left_semi")
        cut = cut.unionByName(keyed(members, (k + 1) * 1000, finer))
    return cut


def _near(fp: np.ndarray, point: np.ndarray, i: int, others: np.ndarray, max_bits: int) -> np.ndarray:
    """Those of ``others`` within reach of i: first by the lower bound, then exactly."""
    others = others[np.bitwise_count(point[others] ^ point[i]) <= max_bits]
    return others[np.bitwise_count(fp[others] ^ fp[i]) <= max_bits]


def _forest(fp: np.ndarray, point: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Edges that join the members of one cell as all their links would; fewer than the members."""
    tree = np.arange(len(fp))
    for i in range(len(fp) - 1):
        later = np.arange(i + 1, len(fp))
        near = _near(fp, point, i, later[tree[later] != tree[i]], max_bits)
        if len(near):
            trees, first = np.unique(tree[near], return_index=True)
            for j in near[first].tolist():
                yield i, j
            tree[np.isin(tree, trees)] = tree[i]


def links(found: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints; their components are those of all links."""

    def in_cells(fp: np.ndarray, point: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        pairs = [p for a, b in zip(starts.tolist(), ends.tolist())
                 for p in ((a + i, a + j) for i, j in _forest(fp[a:b], point[a:b], max_bits))]
        at = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(fp[at[:, 0]].view(np.int64)), pa.array(fp[at[:, 1]].view(np.int64))], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last cell so far; it may go on in the next batch
        for batch in batches:
            new = np.array([batch.column(c).to_numpy().astype(np.int64) for c in ("choice", "cell", "point", "fp")])
            rows = np.concatenate([*held, new], axis=1)
            change = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
            starts = np.concatenate([[0], change])
            held = [rows[:, starts[-1]:]]
            yield from cut(rows, starts[:-1], starts[1:])
        if held:
            yield from cut(held[0], np.array([0]), np.array([held[0].shape[1]]))

    def cut(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp, point = rows[3].view(np.uint64), rows[2].view(np.uint64)
        two = starts[ends - starts == 2]  # most shared cells hold a pair: all at once
        two = two[np.bitwise_count(point[two] ^ point[two + 1]) <= max_bits]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
        yield pa.RecordBatch.from_arrays(
            [pa.array(fp[two].view(np.int64)), pa.array(fp[two + 1].view(np.int64))], names=["a", "b"])
        more = ends - starts > 2
        yield in_cells(fp, point, starts[more], ends[more])

    dealt = found.select("choice", "cell", "point", "fp").repartition("choice", "cell").sortWithinPartitions("choice", "cell")
    return dealt.mapInArrow(work, "a bigint, b bigint").distinct()


def members(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, key (of its text), fp, component_id (smallest id reachable) and component (its key)."""
    marked = written_once(fingerprints(docs, shingle_words))
    distinct = written_once(marked.groupBy("fp").agg(F.min("id").alias("first_id")))
    points = distinct.select("fp", _point(F.col("fp")).alias("point"))
    roots = components(links(cells(points, max_bits), max_bits))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("component"))
    ids = rooted.groupBy("component").agg(F.min("first_id").alias("component_id"))
    label = rooted.select("fp", "component").join(ids, "component")
    return marked.join(label, "fp").select("id", "key", "fp", "component_id", "component")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest id reachable through links) and component (its key)."""
    return members(docs, shingle_words, max_bits).select(F.col("id").alias("doc_id"), "fp", "component_id", "component")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, the one with the smallest id (of rows repeating that id, the smallest text hash).

    Texts are fingerprinted once; the rows to keep are known by id and text hash, and all texts pass one shuffle, unsorted.
    Rows that repeat both are told apart by their other columns; only they are sorted.
    """
    alike = members(docs, shingle_words, max_bits).filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy(
        "component", "id", "key").agg(F.count(F.lit(1)).alias("n"))
    first = alike.groupBy("component").agg(F.min(F.struct("key", "id", "n")).alias("one")).select(
        F.col("one.id").alias("first_id"), F.col("one.key").alias("first_key"), F.col("one.n").alias("n"))
    rows = docs.select(
        F.col("doc_id").alias("id"), F.coalesce(text_key(F.col("text")), F.lit(b"")).alias("key"), whole_row(docs).alias("row"))
    kept = rows.join(
        first.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")))
    order = Window.partitionBy("id", "key").orderBy(*[F.col("row")[c] for c in docs.columns if c != "text"])
    repeated = kept.filter("n > 1").withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return unwrapped(kept.filter("n = 1").select("row").union(repeated.select("row")), "row", docs.columns)
