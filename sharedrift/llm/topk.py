"""Exact top-k by inner product over an impact-ordered index, scored segment by segment.

Index: vectors of integers are dealt into blocks.  Within a block every dimension has a posting list of all vectors, sorted by
value and cut into segments of equal quantised value.  The impact of a segment for a query is the most any of its
postings can add to the score: query value times the segment's extreme.

Query: segments of all dimensions are processed by descending impact, in rounds, adding their postings' exact products to
the scores so far.  After a round, what a vector can still gain is at most the sum over dimensions of the next segment's
impact (nothing, where that is negative).  Processing stops when a proof leaves few possible members, vectors whose score so
far plus that gain reaches the k-th best exact score known; without such a proof it goes on to the last segment that can
add anything.  The possible members are rescored exactly.

Queries are sent to the blocks in groups of ``QUERY_GROUP`` (a bound, whatever their number), one pass over the index for
each group.  A task keeps k results per query and hands on only those.

Edge cases: null vectors and vectors with null or non-finite components take no part, as query or candidate; shorter vectors
count as padded with zeros; equal scores go to the smaller id; a query gets no candidate of its own id; repeated rows are
separate candidates, but a query row repeated with the same vector is asked once; fewer than k candidates give fewer
rows; an empty table gives an empty result; other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharedrift.sources.tables import written_once

BLOCK = 8192
LEVELS = 8  # quantised values on either side of zero
ROUNDS = 10
QUERY_GROUP = 4096
FEW = 64  # a proof is good enough if it leaves this part of a block, or 8 k


def integer_vector(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null if the vector takes no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), max([width, *sizes.tolist()])), dtype=np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


class Block:
    """Posting lists of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.order = np.argsort(-vectors, axis=0, kind="stable").T.astype(np.int32)  # by dimension
        self.values = np.ascontiguousarray(np.take_along_axis(vectors.T, self.order.astype(np.int64), axis=1))
        step = max(1, int(np.abs(vectors).max(initial=0)) // LEVELS + 1)
        level = self.values // step
        cut = np.ones(level.shape, dtype=bool)
        cut[:, 1:] = level[:, 1:] != level[:, :-1]
        self.dim, self.start = np.nonzero(cut)
        self.end = np.append(self.start[1:], 0)
        self.end[np.append(self.dim[1:] != self.dim[:-1], True)] = len(ids)
        self.high, self.low = self.values[self.dim, self.start], self.values[self.dim, self.end - 1]

    def _exact(self, at: np.ndarray, query: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        at = at[self.ids[at] != own]
        return self.vectors[at] @ query, self.ids[at]

    def search(self, own: int, query: np.ndarray, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best k of this block and the results so far (scores, ids), best first, ties to the smaller id."""
        query = np.concatenate([query, np.zeros(max(0, self.vectors.shape[1] - len(query)), dtype=np.int64)])[
            :self.vectors.shape[1]]
        weight = query[self.dim]
        impact = np.where(weight > 0, weight * self.high, weight * self.low)
        useful = np.flatnonzero(impact > 0)
        useful = useful[np.argsort(-impact[useful], kind="stable")]
        so_far = np.zeros(len(self.ids), dtype=np.int64)
        possible = np.arange(len(self.ids))
        least = scores[-1] if len(scores) == k else None
        size = max(1, -(-len(useful) // ROUNDS))
        for at in range(0, len(useful), size):
            self._add(useful[at:at + size], query, so_far)
            rest = useful[at + size:]
            gain = np.zeros(len(query), dtype=np.int64)
            np.maximum.at(gain, self.dim[rest], impact[rest])
            if least is None and len(self.ids) > 4 * k:
                exact, _ = self._exact(np.argpartition(-so_far, 2 * k)[:2 * k], query, own)
                least = np.sort(exact)[-k] if len(exact) >= k else None
            if least is not None:
                possible = np.flatnonzero(so_far + gain.sum() >= least)
                if len(possible) <= max(8 * k, len(self.ids) // FEW):
                    break
        exact, members = self._exact(possible, query, own)
        scores, ids = np.concatenate([scores, exact]), np.concatenate([ids, members])
        best = np.lexsort((ids, -scores))[:k]
        return scores[best], ids[best]

    def _add(self, segments: np.ndarray, query: np.ndarray, so_far: np.ndarray) -> None:
        """A round's segments of one dimension lie side by side: they are added as one stretch."""
        segments = np.sort(segments)
        dims, first = np.unique(self.dim[segments], return_index=True)
        last = np.append(first[1:], len(segments)) - 1
        for d, a, b in zip(dims.tolist(), self.start[segments[first]].tolist(), self.end[segments[last]].tolist()):
            so_far[self.order[d, a:b]] += query[d] * self.values[d, a:b]


def build_index(rows: DataFrame) -> DataFrame:
    """``rows``: id, vector (integers, not null).  One row per block, as a written table."""
    blocks = max(1, -(-rows.count() // BLOCK))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # a partition is one block's share of the rows
        whole = pa.Table.from_batches(held).combine_chunks() if held else None
        for at in range(0, whole.num_rows if whole else 0, 2 * BLOCK):
            part = whole.slice(at, 2 * BLOCK).combine_chunks()
            matrix = _matrix(part["vector"].chunk(0))
            yield pa.RecordBatch.from_pydict({
                "n": pa.array([part.num_rows]), "ids": pa.array([part["id"].to_numpy().tobytes()], pa.binary()),
                "vectors": pa.array([matrix.astype("<i8").tobytes()], pa.binary())})

    return written_once(rows.repartition(blocks).mapInArrow(work, "n bigint, ids binary, vectors binary"))


def _search_group(index: DataFrame, numbers: list[int], own: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast((numbers, own, queries))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, own, queries = sent.value
        none = np.zeros(0, dtype=np.int64)
        best = [(none, none)] * len(numbers)
        for batch in batches:
            for n, ids, vectors in zip(*(batch.column(c) for c in ("n", "ids", "vectors"))):
                block = Block(
                    np.frombuffer(ids.as_buffer(), dtype="<i8"), np.frombuffer(vectors.as_buffer(), dtype="<i8").reshape(n.as_py(), -1))
                best = [block.search(int(o), q, k, *b) for o, q, b in zip(own, queries, best)]
        sizes = [len(ids) for _, ids in best]
        yield pa.RecordBatch.from_pydict({
            "query": np.repeat(np.array(numbers, dtype=np.int64), sizes), "query_id": np.repeat(own, sizes),
            "id": np.concatenate([ids for _, ids in best]), "score": np.concatenate([s for s, _ in best])})

    return index.mapInArrow(work, "query bigint, query_id bigint, id bigint, score bigint")


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``rows`` and ``queries``: id (not null), vector of integers.  Returns query_id, rank, id, score."""
    usable = F.col("id").isNotNull() & F.col("vector").isNotNull()
    index = build_index(rows.filter(usable).select("id", "vector"))
    asked = written_once(queries.filter(usable).select("id", "vector").distinct())
    groups = max(1, -(-asked.count() // QUERY_GROUP))
    dealt = asked.withColumn("_group", F.pmod(F.xxhash64("id", "vector"), F.lit(groups)))
    found = None
    for group in range(groups):  # each group is gathered, sent and answered by itself
        part = dealt.filter(F.col("_group") == group).orderBy("id", "vector").select("id", "vector").toArrow().combine_chunks()
        if not part.num_rows:
            continue
        matrix = _matrix(part["vector"].chunk(0))
        numbers = [group + groups * n for n in range(part.num_rows)]
        answer = _search_group(index, numbers, part["id"].to_numpy(), matrix, k)
        answer = written_once(answer) if groups > 1 else answer
        found = answer if found is None else found.union(answer)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
