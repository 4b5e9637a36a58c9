"""Prefix trie of conversations over range partitions, with a skeleton of splitter paths.

A conversation's path is the sequence of its turns, 16 bytes of SHA-256 over role and text for each; byte order puts all
conversations that share a prefix next to each other.  Splitters, taken from a sample, cut the ordered paths (and within one
path the ids) into shards of about equal size.  A node whose members lie in more than one shard is a prefix of a splitter, so:

* the trie of all splitter paths, the skeleton, is broadcast (at most ``SKELETON_BYTES`` of paths);
* every shard walks its sorted rows once and finishes all nodes that are not in the skeleton;
* for skeleton nodes a shard gives partial aggregates, which Spark reduces by node; their sums over subtrees are then taken
  along the skeleton, whose size is bounded as above.

The ids that end at a skeleton node are hashed in order of shards and ids, streamed from blocks of joined text: SHA-256 has
no other way, but the reader holds one block at a time.

Larger skeletons than allowed are avoided by fewer shards.  A shard's nodes (not its rows) are held in memory.  A
conversation is one row: its turns are digests of 16 bytes and word counts, without texts.

Edge cases: turns are ordered by turn number, null first; equal numbers by the digest of role and text.  Null role or text
is empty; rows without conv_id take no part; repeated rows are separate turns; texts may have any length.  An empty table has no
nodes; a conversation left without turns is a member of the root alone.  Other columns, whatever their names, are ignored.
"""

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharedrift.llm.common import words_of
from sharedrift.sources.tables import written_once

BLOCK = 20  # conversations of one block begin with turns of its first
MAX_HEAD = 4  # a conversation takes fewer turns than this from the first of its block
DIGEST = 16  # bytes a turn takes in a path
SHARD_BYTES = 256_000  # of paths in a shard, about; more where the skeleton would grow beyond its bound
SAMPLES = 8  # sampled paths for each shard
SKELETON_BYTES = 32_000_000  # of splitter paths
ENDS_BYTES = 64_000  # of joined ids in one block
ROWS = 500  # conversations handled at once
NOTHING = hashlib.sha256(b"").hexdigest()

PARTS = """
kind int, node bigint, up bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint,
n_leaves bigint, saved_tokens bigint, words bigint, shard int, nth bigint, ends string"""
NODE, PARTIAL, ENDS = 0, 1, 2


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its block."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(MAX_HEAD)).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, path, words): every conversation with the first turns of its block's first conversation before its own."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.filter("conv_id IS NOT NULL").select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("block"),
        F.struct(
            "turn", F.substring(F.unhex(F.sha2(told, 256)), 1, DIGEST).alias("digest"),
            F.size(words_of(F.col("text"))).alias("words")).alias("turn"))
    own = rows.repartition("block").groupBy("block", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("own"))
    heads = own.filter(F.col("conv_id") == F.col("block")).select(
        F.col("block").alias("of"), F.slice("own", 1, MAX_HEAD - 1).alias("head"))
    h = head_turns(F.col("conv_id"))
    taken = F.slice(F.coalesce("head", F.slice("own", 1, 0)), 1, h)
    whole = own.join(heads, F.col("block") == F.col("of"), "left").select(
        "conv_id", F.concat(taken, F.slice("own", h + 1, F.size("own"))).alias("turns"))
    return whole.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("path"),
        F.col("turns.words").alias("words"))


def splitters(paths: DataFrame, shard_bytes: int = SHARD_BYTES, skeleton_bytes: int = SKELETON_BYTES) -> list[tuple[bytes, int]]:
    """Ordered (path, conv_id) that cut the paths into shards; a bounded sample decides, and only how rows are dealt."""
    size = paths.agg(F.sum(F.octet_length("path") + 12)).first()[0] or 0
    shards = -(-size // shard_bytes)
    if shards < 2:
        return []
    sample = written_once(paths.select("path", "conv_id").orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLES * shards))
    taken = sample.agg(F.sum(F.octet_length("path"))).first()[0]
    if taken > skeleton_bytes:  # fewer shards, so that the sample and the skeleton stay within the bound
        keep = skeleton_bytes / taken
        longest = sample.agg(F.max(F.octet_length("path"))).first()[0]
        shards = max(1, min(int(shards * keep), skeleton_bytes // (SAMPLES * max(longest, 1))))
        sample = sample.orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLES * shards)
    drawn = sorted((bytes(r.path), r.conv_id) for r in sample.collect())
    return sorted(set(drawn[SAMPLES::SAMPLES]))


def skeleton(splits: list[tuple[bytes, int]]) -> tuple[dict[tuple[int, bytes], int], list[int]]:
    """The trie of splitter paths: (node, next digest) to node, and each node's parent; node 0 is the root."""
    steps: dict[tuple[int, bytes], int] = {}
    parents = [-1]
    for path, _ in splits:
        node = 0
        for k in range(0, len(path), DIGEST):
            step = (node, path[k:k + DIGEST])
            if step not in steps:
                steps[step] = len(parents)
                parents.append(node)
            node = steps[step]
    return steps, parents


class Shard:
    """One walk over a shard's rows in order of path and id."""

    def __init__(self, number: int, steps: dict[tuple[int, bytes], int]) -> None:
        self.number, self.steps = number, steps
        self.path = b""
        self.open: list[dict] = []
        self.rows: list[tuple] = []  # finished nodes whose parent, in this shard alone, is not finished
        self.out: list[tuple] = []
        self._enter(0, 0)

    def _enter(self, skeleton_id: int | None, words: int) -> None:
        self.open.append({
            "skeleton": skeleton_id, "words": words, "least": None, "convs": 0, "children": 0, "leaves": 0, "saved": 0,
            "ends": [], "size": 0, "nth": 0, "hash": None, "below": len(self.rows)})

    def _flush(self, node: dict) -> None:
        """Ids that end here: into the node's hash, or into a block if other shards may hold more of them."""
        if not node["ends"]:
            return
        joined = ",".join(map(str, node["ends"]))
        if node["skeleton"] is not None:
            self.out.append((ENDS, node["skeleton"], *[None] * 9, self.number, node["nth"], joined))
        elif node["hash"] is None:
            node["hash"] = hashlib.sha256(joined.encode())
        else:
            node["hash"].update(f",{joined}".encode())
        node["nth"] += 1
        node["ends"], node["size"] = [], 0

    def _leave(self) -> None:
        node = self.open.pop()
        self._flush(node)
        depth, up = len(self.open), self.open[-1] if self.open else None
        if node["skeleton"] is None:
            if not node["children"]:
                node["leaves"] = 1
            node["saved"] += (node["convs"] - 1) * node["words"]
            up["children"] += 1
            up["leaves"] += node["leaves"]
            up["saved"] += node["saved"]
        else:  # this shard's part
            self.out.append((
                PARTIAL, node["skeleton"], None, node["least"], depth, None, node["convs"], node["children"], node["leaves"],
                node["saved"], node["words"], self.number, None, None))
        if up is not None:
            up["convs"] += node["convs"]
            up["least"] = node["least"] if up["least"] is None else min(up["least"], node["least"])
        # children of a node within the shard have waited for its id
        for row in self.rows[node["below"]:]:
            self.out.append((*row[:5], node["least"], *row[6:]))
        del self.rows[node["below"]:]
        if node["skeleton"] is None:
            row = (NODE, None, up["skeleton"], node["least"], depth, None, node["convs"], node["children"], node["leaves"],
                   node["saved"], None, None, None, node["hash"].hexdigest() if node["hash"] else NOTHING)
            (self.rows if up["skeleton"] is None else self.out).append(row)

    def add(self, conv_id: int, path: bytes, words) -> None:
        if path != self.path:
            same, most = 0, min(len(path), len(self.path))
            while same < most and path[same:same + DIGEST] == self.path[same:same + DIGEST]:
                same += DIGEST
            while len(self.open) > same // DIGEST + 1:
                self._leave()
            for k in range(same, len(path), DIGEST):
                above = self.open[-1]["skeleton"]
                self._enter(None if above is None else self.steps.get((above, path[k:k + DIGEST])), words[k // DIGEST])
            self.path = path
        node = self.open[-1]
        node["convs"] += 1
        node["least"] = conv_id if node["least"] is None else min(node["least"], conv_id)
        node["ends"].append(conv_id)
        node["size"] += len(str(conv_id)) + 1
        if node["size"] >= ENDS_BYTES:
            self._flush(node)

    def close(self) -> None:
        while self.open:
            self._leave()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


ARROW = pa.schema([
    (name, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind])
    for name, kind in (field.split() for field in PARTS.replace("\n", " ").split(","))])


def _walk(batches: Iterator[pa.RecordBatch], steps: dict) -> Iterator[pa.RecordBatch]:
    """Shards come one after the other, each in order of path and id."""
    now: Shard | None = None
    for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
        for shard, conv_id, path, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "conv_id", "path", "words"))):
            if now is None or now.number != shard:
                if now is not None:
                    now.close()
                    yield _batch(now.out, ARROW)
                now = Shard(shard, steps)
            now.add(conv_id, path, words)
        if now is not None and len(now.out) > 20_000:
            yield _batch(now.out, ARROW)
            now.out = []
    if now is not None:
        now.close()
        yield _batch(now.out, ARROW)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ends): SHA-256 of a node's joined ids, from blocks that come in order of node, shard and number."""
    node, state = None, None
    for batch in batches:
        done = []
        for at, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
            if at != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = at, hashlib.sha256(ends.encode())
            else:
                state.update(f",{ends}".encode())
        yield pa.RecordBatch.from_pydict({"node": pa.array([n for n, _ in done], pa.int64()), "ends": pa.array([e for _, e in done], pa.string())})
    if state is not None:
        yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.int64()), "ends": pa.array([state.hexdigest()])})


def _dealt(paths: DataFrame, splits: list[tuple[bytes, int]]) -> DataFrame:
    """Paths with their shard, each shard in one partition and in order."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())
            shard = pa.array([bisect_right(splits, key) for key in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, shard], names=[*batch.schema.names, "shard"])

    marked = paths.mapInArrow(work, "conv_id bigint, path binary, words array<int>, shard int")
    return marked.repartitionById(len(splits) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")


def prefix_trie(
    turns: DataFrame, shard_bytes: int = SHARD_BYTES, skeleton_bytes: int = SKELETON_BYTES,
) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    paths = written_once(rebuilt(turns))
    splits = splitters(paths, shard_bytes, skeleton_bytes)
    steps, parents = skeleton(splits)
    sent = spark.sparkContext.broadcast(steps)
    parts = written_once(_dealt(paths, splits).mapInArrow(lambda batches: _walk(batches, sent.value), PARTS))

    ends = parts.filter(F.col("kind") == ENDS).select("node", "shard", "nth", "ends").repartition("node")
    hashes = ends.sortWithinPartitions("node", "shard", "nth").mapInArrow(_hashes, "node bigint, ends string")
    reduced = parts.filter(F.col("kind") == PARTIAL).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("words").alias("words"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]).join(hashes, "node", "left")
    top = _along_skeleton(reduced.collect(), parents)  # at most as many rows as the skeleton has nodes
    finished = spark.createDataFrame(top, "skeleton_id bigint, " + NODES)
    ids = F.broadcast(finished.select("skeleton_id", F.col("conv_id").alias("skeleton_conv_id")))
    local = parts.filter(F.col("kind") == NODE).join(ids, F.col("up") == F.col("skeleton_id"), "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "skeleton_conv_id").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
    return finished.drop("skeleton_id").unionByName(local)


NODES = """conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint,
saved_tokens bigint, ends_sha256 string"""


def _along_skeleton(rows: list, parents: list[int]) -> list[tuple]:
    """Skeleton nodes with children, leaves and savings of their whole subtrees; children have larger numbers than parents."""
    found = {r.node: r for r in rows}
    children, leaves, saved = (np.zeros(len(parents), dtype=np.int64) for _ in range(3))
    for node in sorted(found, reverse=True):
        r = found[node]
        children[node] += r.n_children
        leaves[node] += r.n_leaves + (children[node] == 0)
        saved[node] += r.saved_tokens + (r.n_convs - 1) * r.words
        if node:
            children[parents[node]] += 1
            leaves[parents[node]] += leaves[node]
            saved[parents[node]] += saved[node]
    return [(
        node, r.conv_id, r.depth, found[parents[node]].conv_id if node else None, r.n_convs, int(children[node]), int(leaves[node]),
        int(saved[node]), r.ends or NOTHING) for node, r in sorted(found.items())]
