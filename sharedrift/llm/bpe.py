"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside Spark tasks.

Encoding: a text is cut into words by the tokenizer's pattern.  Words that are not tokens themselves begin as their bytes.  A
recursive query joins rows of (word, position, token and the next) with the merge table and contracts each word's leftmost
pair of minimum rank until no pair of it can merge.  Distinct words are solved once; results are kept for the next batches in
two generations of bounded size, the older of which is dropped when the newer is full.

Long words: a pair that no pair of lower rank can reach before it is merged is contracted in the same step, anywhere in the word
(``ENCODE_LONG``); the result is the same, in far fewer steps.

Decoding: token ids are unnested with their positions, joined with the vocabulary and aggregated in order of position.

Edge cases: a null text is empty and has no ids; texts may have any length (they are cut at word boundaries into bounded
queries, never shortened); repeated rows give repeated results; an empty table gives an empty result.  A byte sequence the
vocabulary cannot spell is an error, as is an id outside it.
"""

import base64
import re
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEPT_BYTES = 40_000_000  # of the newer generation of words and chunks that a worker keeps
KEPT_WORD = 4096  # characters of the longest that is kept
ENTRY_BYTES = 200  # what a kept word takes beside its characters and ids
QUERY_WORDS = 20_000  # words in one recursive query
QUERY_IDS = 500_000  # ids in one decoding query
SLICE_BYTES = 2_000_000  # text or ids handled at once
LONG_WORD = 64  # bytes from which many pairs are contracted in a step
DUCKDB_MEMORY = "120MB"

LOOSE_SPACE = re.compile(r" (?=\s|\Z)")

# A step contracts the leftmost pair of minimum rank of every word that has a pair.  A word's tokens travel as a list; its
# neighbouring tokens become rows with their positions only to meet the merge table.
ENCODE = """
WITH RECURSIVE state(step, w, tokens) AS (
  SELECT 0, w, tokens FROM seed
  UNION ALL
  SELECT step + 1, w, tokens[:i - 1] || [m] || tokens[i + 2:]
  FROM (
    SELECT w, min(merges.m * 1099511627776 + i) AS place
    FROM (SELECT w, unnest(tokens[:-2]) AS tok, unnest(tokens[2:]) AS nxt, unnest(range(1, len(tokens))) AS i FROM state) AS p
    JOIN merges ON merges.pair = p.tok * 65536 + p.nxt GROUP BY w) AS best
  JOIN (FROM state) AS s USING (w), LATERAL (SELECT place % 1099511627776 AS i, place // 1099511627776 AS m)
)
SELECT w, arg_max(tokens, step) AS ids FROM state GROUP BY w
"""

# For long words, many pairs a step: those whose rank is the least among all within ``reach`` places (no token of these bytes
# is longer, so nothing farther away can take part before them), and of neighbouring pairs of equal rank every other one.  Where
# a merge can make a pair of lower rank (not ``safe``), only the leftmost of equal rank counts as least.  A place keeps its latest
# token only; -1 where it was merged into the one before.
ENCODE_LONG = """
WITH RECURSIVE state(done, w, i, tok) USING KEY (w, i) AS (
  SELECT false, w, i, tok FROM seed
  UNION ALL
  SELECT best IS NULL, w, i, CASE WHEN eaten THEN -1 WHEN hit THEN m ELSE tok END
  FROM (
    SELECT w, i, tok, m, best, hit, coalesce(lag(hit) OVER (PARTITION BY w ORDER BY i), false) AS eaten
    FROM (
      SELECT w, i, tok, m, best, least_here AND run % 2 = 1 AND (nth - run // 2) % 2 = 0 AS hit
      FROM (
        -- a run of equal pairs waits until its first is the least about it; only then is known where it begins
        SELECT *, max(CASE WHEN m IS DISTINCT FROM before THEN nth * 2 + least_here::INTEGER END) OVER (PARTITION BY w ORDER BY i) AS run
        FROM (
          SELECT w, i, tok, m, min(m) OVER (PARTITION BY w) AS best, lag(m) OVER (PARTITION BY w ORDER BY i) AS before,
                 row_number() OVER (PARTITION BY w ORDER BY i) AS nth,
                 coalesce(place = min(place) OVER (
                   PARTITION BY w ORDER BY i ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING), false) AS least_here
          FROM (
            SELECT w, i, tok, m, m * 1099511627776 + CASE WHEN safe THEN 0 ELSE i END AS place
            FROM (SELECT w, i, tok, lead(tok) OVER (PARTITION BY w ORDER BY i) AS nxt FROM state WHERE NOT done AND tok >= 0) AS p
            LEFT JOIN merges ON merges.pair = p.tok * 65536 + p.nxt)))))
)
SELECT w, list(tok ORDER BY i) AS ids FROM state WHERE tok >= 0 GROUP BY w
"""

# Bytes stand as characters of the same number, so they can be concatenated as text.
DECODE = """
SELECT part, string_agg(chars, '' ORDER BY place) AS chars
FROM pieces JOIN vocab USING (id) GROUP BY part
"""


def read_ranks(path: str) -> bytes:
    """A rank file: base64 token and rank per line.  Its size is bounded by the vocabulary; tasks get its content."""
    with open(path, "rb") as file:
        return file.read()


class Codec:
    """The vocabulary and the merge table inside one in-process DuckDB, and the words solved so far."""

    def __init__(self, rank_file: bytes, pattern: str) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        self.vocabulary = np.fromiter(self.ranks.values(), dtype=np.uint32)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0
        self.byte_rank = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int64)
        self.db = duckdb.connect()
        self.folder = tempfile.TemporaryDirectory()  # goes with this object
        self.db.execute(f"SET threads = 1; SET memory_limit = '{DUCKDB_MEMORY}'; SET temp_directory = '{self.folder.name}'")
        self.tables: set[str] = set()

    def _need(self, name: str, content) -> None:
        """Make a table on its first use: a worker that only decodes needs no merge table, and the other way round."""
        if name not in self.tables:
            self.db.register("given", content())
            self.db.execute(f"CREATE TABLE {name} AS FROM given")
            self.db.unregister("given")
            self.tables.add(name)

    def _merges(self) -> pa.Table:
        """Every pair of tokens that together is a token."""
        rows = np.array([
            (a, b, m) for token, m in self.ranks.items() for cut in range(1, len(token))
            if (a := self.ranks.get(token[:cut])) is not None and (b := self.ranks.get(token[cut:])) is not None],
            dtype=np.int64).reshape(-1, 3)
        left, right, merged = rows.T
        unsafe = np.union1d(left[left > merged], right[right > merged])
        return pa.table({"pair": left * 65536 + right, "m": merged, "safe": ~np.isin(merged, unsafe)})

    def _reach(self, raw: np.ndarray) -> int:
        """Bytes of the longest token made of some bytes only."""
        present = set(raw.tolist())
        return max((len(token) for token in self.ranks if present.issuperset(token)), default=1)

    def _vocab(self) -> pa.Table:
        return pa.table({"id": self.vocabulary, "chars": [token.decode("latin-1") for token in self.ranks]})

    def solve(self, words: list[str]) -> None:
        """Add the ids of distinct words to ``known``."""
        for is_long in (False, True):
            group: list[str] = []
            todo = [w for w in words if (len(w) * 4 > LONG_WORD and len(w.encode()) > LONG_WORD) == is_long]
            size = 0
            for word in todo:
                if group and (len(group) >= QUERY_WORDS or size > QUERY_IDS):
                    self._contract(group, is_long)
                    group, size = [], 0
                group.append(word)
                size += len(word)
            if group:
                self._contract(group, is_long)

    def _keep(self, word: str, ids: bytes) -> None:
        self.known[word] = ids
        self.size += ENTRY_BYTES + len(word) + len(ids)

    def _contract(self, words: list[str], is_long: bool) -> None:
        coded = [w.encode() for w in words]
        whole = [self.ranks.get(b) for b in coded]
        rest = [n for n, rank in enumerate(whole) if rank is None]
        for word, rank in zip(words, whole):
            if rank is not None:
                self._keep(word, rank.to_bytes(4, "little"))
        if not rest:
            return
        sizes = np.array([len(coded[n]) for n in rest], dtype=np.int64)
        raw = np.frombuffer(b"".join(coded[n] for n in rest), dtype=np.uint8)
        tokens = self.byte_rank[raw]
        if (tokens < 0).any():
            raise ValueError("a byte of the text is not in the vocabulary")
        self._need("merges", self._merges)
        ends, numbers = np.cumsum(sizes), np.array(rest, dtype=np.int64)
        if is_long:
            query = ENCODE_LONG.format(reach=self._reach(np.unique(raw)))
            seed = {"w": np.repeat(numbers, sizes), "i": np.arange(len(raw)) - np.repeat(ends - sizes, sizes), "tok": tokens}
        else:
            query = ENCODE
            seed = {"w": numbers, "tokens": pa.LargeListArray.from_arrays(pa.array(np.append(0, ends)), pa.array(tokens))}
        self.db.register("seed", pa.table(seed))
        solved = self.db.sql(query).to_arrow_table().combine_chunks()
        ids = solved["ids"].chunk(0)
        packed = ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        ends = ids.offsets.to_numpy() * 4
        for n, a, b in zip(solved["w"].to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
            self._keep(words[n], packed[a:b])

    def chunks(self, text: str) -> list[str]:
        """Cut before every space that something other than white space follows: no word of the pattern spans it."""
        if LOOSE_SPACE.search(text):
            return regex.split(r"(?= \S)", text, flags=regex.V1)
        parts = text.split(" ")
        return parts[:1] + [" " + part for part in parts[1:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        if self.size > KEPT_BYTES:
            self.older, self.known, self.size = self.known, {}, 0
        cut = [self.chunks(text) for text in texts]
        new = self._unknown(set().union(*cut))
        words = {chunk: self.pattern.findall(chunk) for chunk in new}
        self.solve(list(self._unknown({w for found in words.values() for w in found})))
        known = self.known
        for chunk, found in words.items():
            if len(found) != 1:
                self._keep(chunk, b"".join([known[w] for w in found]))
        ids = [b"".join(map(known.__getitem__, chunks)) for chunks in cut]
        for some in (words, *words.values()):
            for word in some:
                if len(word) > KEPT_WORD:
                    known.pop(word, None)
        return ids

    def _unknown(self, words: set[str]) -> set[str]:
        """Those not known yet; what only the older generation knows is taken over."""
        new = words.difference(self.known)
        for word in new.intersection(self.older):
            self._keep(word, self.older[word])
        return new.difference(self.older)

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """Bytes of each sequence of packed ids; a long sequence is decoded in pieces."""
        step = QUERY_IDS * 4
        pieces = [(n, ids[at:at + step]) for n, ids in enumerate(packed) for at in range(0, len(ids), step)]
        out: list[list[bytes]] = [[] for _ in packed]
        group: list[tuple[int, bytes]] = []
        size = 0
        for n, piece in pieces:
            if group and size + len(piece) > step:
                self._decode(group, out)
                group, size = [], 0
            group.append((n, piece))
            size += len(piece)
        self._decode(group, out)
        return [b"".join(parts) for parts in out]

    def _decode(self, group: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        if not group:
            return
        ids = np.frombuffer(b"".join(piece for _, piece in group), dtype="<u4")
        part = np.repeat(np.arange(len(group)), [len(piece) // 4 for _, piece in group])
        if not np.isin(ids, self.vocabulary).all():
            raise ValueError("an id is not in the vocabulary")
        self._need("vocab", self._vocab)
        self.db.register("pieces", pa.table({"part": part, "place": np.arange(len(ids)), "id": ids}))
        chars = dict(self.db.execute(DECODE).fetchall())
        for k, (n, _) in enumerate(group):
            out[n].append(chars[k].encode("latin-1"))


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    key = (hash(rank_file), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def _appended(rows: DataFrame, source: str, targets: list[str], work) -> DataFrame:
    """Add binary columns computed from another, in slices of bounded size."""
    rows = rows.drop(*targets)

    def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(source)
            sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                found = [pa.array(column, type=pa.binary()) for column in work(part.column(source).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, *found], names=[*batch.schema.names, *targets])

    return rows.mapInArrow(batchwise, rows.withColumns({target: F.lit(b"") for target in targets}).schema)


def encode(
    docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None,
) -> DataFrame:
    """Add the column ``ids``: the text's token ids, packed as little-endian unsigned 32-bit integers.

    With ``decoded``, the ids are decoded in the same pass, into a column of that name, as ``decode`` would.
    """
    def work(texts: list[str | None]) -> list[list[bytes]]:
        codec = _codec(rank_file, pattern)
        packed = codec.encode([t or "" for t in texts])
        return [packed, codec.decode(packed)] if decoded else [packed]

    return _appended(docs, text, [ids, decoded] if decoded else [ids], work)


def decode(coded: DataFrame, rank_file: bytes, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the column ``decoded``: the bytes that packed ids stand for."""
    return _appended(coded, ids, [decoded], lambda packed: [_codec(rank_file, pattern).decode([b or b"" for b in packed])])


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
