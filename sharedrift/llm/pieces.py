"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding: the text, normalised by the model's own rules, is a row of symbols, one per character.  All neighbours that
together are a piece stand in an agenda, ordered by the piece's score, the leftmost first among equals.  The best pair is
joined, its new neighbours enter the agenda, and entries whose symbols have changed meanwhile are passed over.  What is
left at the end are the pieces; a character outside the vocabulary becomes the pieces of its bytes, or the unknown piece.

No merge crosses two characters that stand side by side in no piece, so the text is cut there and every distinct part is
solved once.  Short parts are solved many at a time: each has its agenda in a row of a matrix, and every step takes the best
entry of every row.  Long parts have a heap.  Solved parts are kept in two generations of bounded size, the older of which is
dropped when the newer is full.

Checked: every text of every Arrow batch is also encoded whole by the sentencepiece library; ``agrees`` tells whether both
gave the same ids.  Decoding is the library's.

Edge cases: a null text is empty and has no ids; texts and words may have any length (an agenda takes n log n steps and a
text is never shortened); ids of repeated rows are repeated; an empty table gives an empty result; other columns pass
unchanged, but those named as an output are replaced.  Models other than merge-type, and pieces that no merge makes (user
defined, unused), are an error.
"""

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 2_000_000  # text or ids handled at once
KEPT_BYTES = 120_000_000  # of the newer generation of solved parts
KEPT_PART = 4096  # characters of the longest part that is kept
SHORT = 24  # characters of the longest part solved in a row of a matrix
ROWS = 8192  # parts solved at once
NO_RANK = np.iinfo(np.int32).max
ENTRY_BYTES = 200  # what a kept part takes beside its text and ids
SPACE = "▁"
LETTERS = "".join(c for c in map(chr, range(0x250)) if c.isalpha())  # of Latin script


def read_model(path: str) -> bytes:
    """A model file; its size is bounded by the vocabulary, and tasks get its content."""
    with open(path, "rb") as file:
        return file.read()


class Pieces:
    """A merge-type vocabulary with the parts solved so far."""

    def __init__(self, model: bytes) -> None:
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        numbers = range(sp.vocab_size())
        plain = [i for i in numbers if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if any(sp.is_unused(i) for i in plain):
            raise ValueError("the vocabulary has unused pieces")
        self.ids = {sp.id_to_piece(i): i for i in plain}
        steps = {score: n for n, score in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        self.rank = {piece: steps[sp.get_score(i)] for piece, i in self.ids.items() if len(piece) > 1}
        self.unknown = [sp.unk_id()]
        bytes_of = {sp.id_to_piece(i): i for i in numbers if sp.is_byte(i)}
        self.byte_ids = [bytes_of[f"<0x{b:02X}>"] for b in range(256)] if bytes_of else None
        self.joined = {piece[k:k + 2] for piece in self.rank for k in range(len(piece) - 1)}
        # one pattern cuts texts where no piece goes on: before words, and between letters and other characters
        inside = [pair for pair in self.joined if pair[0] != SPACE]
        if any(pair[1] == SPACE for pair in inside) or not self.byte_ids:
            pattern = ".+"
        elif any((pair[0] in LETTERS) != (pair[1] in LETTERS) for pair in inside):
            pattern = f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"
        else:
            pattern = f"{SPACE}*(?:[{LETTERS}]+|[^{SPACE}{LETTERS}]+)|{SPACE}+"
        self.cut = re.compile(pattern, re.DOTALL)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0
        self._make_table()

    def _make_table(self) -> None:
        """For the row agendas: symbols by number (pieces by their id), and for each pair of symbols its rank and piece."""
        self.number = dict(self.ids)
        for piece in self.rank:
            for c in piece:
                self.number.setdefault(c, len(self.number) + self.library.vocab_size())
        splits = [(self.number[piece[:k]], self.number[piece[k:]], rank, self.ids[piece])
                  for piece, rank in self.rank.items() for k in range(1, len(piece))
                  if piece[:k] in self.number and piece[k:] in self.number]
        table = np.array(splits, dtype=np.int64).reshape(-1, 4)
        self.width = max(self.number.values(), default=0) + 2
        keys = table[:, 0] * self.width + table[:, 1]
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks, self.pair_pieces = np.append(table[order, 2], NO_RANK), np.append(table[order, 3], 0)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of neighbouring symbols; a negative symbol is none."""
        wanted = np.where((left >= 0) & (right >= 0), left * self.width + right, -1)
        at = np.searchsorted(self.pair_keys, wanted)
        return np.where(self.pair_keys[at] == wanted, self.pair_ranks[at], NO_RANK), self.pair_pieces[at]

    def merge_rows(self, parts: list[str]) -> list[bytes]:
        """Packed ids of short parts, all of whose characters are symbols of the vocabulary."""
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        symbols = np.full((len(parts), int(sizes.max()) + 1), -1, dtype=np.int64)
        symbols[np.arange(symbols.shape[1]) < sizes[:, None]] = [self.number[c] for c in "".join(parts)]
        agenda, pieces = self._pairs(symbols[:, :-1], symbols[:, 1:])
        rows = np.arange(len(parts))
        while len(rows):
            best = agenda[rows].argmin(axis=1)  # the leftmost of the best
            live = agenda[rows, best] < NO_RANK
            rows, best = rows[live], best[live]
            if not len(rows):
                break
            mine, theirs, made = symbols[rows], agenda[rows], pieces[rows]
            mine[np.arange(len(rows)), best] = made[np.arange(len(rows)), best]
            # the symbols after the joined two, and the pairs they begin, move up by one place
            places = np.arange(symbols.shape[1])
            moved = places[None, :] + (places[None, :] > best[:, None])
            moved[:, -1] = symbols.shape[1] - 1
            symbols[rows] = mine = np.take_along_axis(mine, moved, axis=1)
            moved = moved[:, :-1].clip(max=agenda.shape[1] - 1)
            theirs, made = np.take_along_axis(theirs, moved, axis=1), np.take_along_axis(made, moved, axis=1)
            theirs[:, -1] = NO_RANK
            for shift in (-1, 0):  # the two pairs that the new symbol is part of
                at = best + shift
                some = np.flatnonzero((at >= 0) & (at < theirs.shape[1]))
                theirs[some, at[some]], made[some, at[some]] = self._pairs(mine[some, at[some]], mine[some, at[some] + 1])
            agenda[rows], pieces[rows] = theirs, made
        ids, count = symbols.astype("<i4"), (symbols >= 0).sum(axis=1)
        packed, step = ids.tobytes(), 4 * ids.shape[1]
        return [packed[n * step:n * step + 4 * k] for n, k in enumerate(count.tolist())]

    def merge(self, part: str) -> list[str]:
        """The pieces of a part, by an agenda of neighbouring symbols."""
        rank, n = self.rank, len(part)
        symbols: list[str | None] = list(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(rank[pair], i, pair) for i in range(n - 1) if (pair := part[i:i + 2]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            left, j = symbols[i], after[i]
            if left is None or j == n or len(left) + len(symbols[j]) != len(piece):
                continue  # one of the two has been joined with another meanwhile
            symbols[i], symbols[j] = piece, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (pair := piece + symbols[k]) in rank:
                    heapq.heappush(agenda, (rank[pair], i, pair))
            if (h := before[i]) >= 0 and (pair := symbols[h] + piece) in rank:
                heapq.heappush(agenda, (rank[pair], h, pair))
        return [s for s in symbols if s is not None]

    def solve(self, part: str) -> bytes:
        ids: list[int] = []
        for symbol in self.merge(part) if len(part) > 1 else part:
            if (found := self.ids.get(symbol)) is not None:
                ids.append(found)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in symbol.encode())
            else:
                ids += self.unknown
        if not self.byte_ids and self.unknown[0] in ids:  # neighbouring unknown characters are one piece
            ids = [x for n, x in enumerate(ids) if x != self.unknown[0] or n == 0 or ids[n - 1] != x]
        return np.array(ids, dtype="<i4").tobytes()

    def _keep(self, part: str, found: bytes) -> None:
        self.known[part] = found
        self.size += ENTRY_BYTES + len(part) + len(found)

    def learn(self, parts: set[str]) -> None:
        """Have the ids of distinct parts in ``known``."""
        older, symbols = self.older, self.ids.keys()
        rows = []
        for part in parts:
            if part in older:
                self._keep(part, older[part])
            elif 1 < len(part) <= SHORT and symbols >= set(part):
                rows.append(part)
            else:
                self._keep(part, self._solve_long(part))
        rows.sort(key=len)
        for k in range(0, len(rows), ROWS):
            some = rows[k:k + ROWS]
            for part, found in zip(some, self.merge_rows(some)):
                self._keep(part, found)

    def _solve_long(self, part: str) -> bytes:
        """A long part is cut between any two characters that stand side by side in no piece."""
        cuts = [0, *(k for k in range(1, len(part)) if part[k - 1:k + 1] not in self.joined), len(part)]
        if len(cuts) == 2 or not self.byte_ids:
            return self.solve(part)
        return b"".join([self.solve(part[a:b]) for a, b in zip(cuts, cuts[1:])])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if self.size > KEPT_BYTES:
            self.older, self.known, self.size = self.known, {}, 0
        cut = [self.cut.findall(self.library.normalize(text)) if text else [] for text in texts]
        new = set().union(*cut).difference(self.known)
        self.learn(new)
        ids_of = self.known.__getitem__
        found = [b"".join(map(ids_of, parts)) for parts in cut]
        for part in new:
            if len(part) > KEPT_PART:
                del self.known[part]
        return found


_loaded: dict[int, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    """One vocabulary per worker process."""
    key = hash(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(model)
    return _loaded[key]


def _slices(batches: Iterator[pa.RecordBatch], sizes) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``SLICE_BYTES``, or one row."""
    for batch in batches:
        at = np.cumsum(sizes(batch).astype(np.int64)) // SLICE_BYTES
        cuts = (np.flatnonzero(np.diff(at)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


def _lists(packed: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))


def encode(
    docs: DataFrame, model: bytes, text: str = "text", ids: str = "ids", agrees: str = "agrees", decoded: str | None = None,
) -> DataFrame:
    """Add ``ids``, an array of the text's ids, and ``agrees``: whether the library gives the same.

    With ``decoded``, the ids are decoded in the same pass, into a column of that name, as ``decode`` would.
    """
    rows = docs.drop(*filter(None, (ids, agrees, decoded)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        library = pieces.library
        for part in _slices(batches, lambda b: pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)):
            texts = [t or "" for t in part.column(text).to_pylist()]
            packed, same, back = pieces.encode(texts), [], []
            for t, own in zip(texts, packed):
                theirs = library.encode(t)
                same.append(array("i", theirs).tobytes() == own)
                if decoded:
                    back.append(library.decode(theirs if same[-1] else np.frombuffer(own, dtype="<i4").tolist()) if theirs else "")
            yield pa.RecordBatch.from_arrays(
                [*part.columns, _lists(packed), pa.array(same), *([pa.array(back, type=pa.string())] if decoded else [])], names=names)

    more = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(agrees, T.BooleanType())]
    more += [T.StructField(decoded, T.StringType())] if decoded else []
    names = [*rows.columns, *(field.name for field in more)]
    return rows.mapInArrow(work, T.StructType([*rows.schema.fields, *more]))


def decode(coded: DataFrame, model: bytes, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``: the text the library makes of the ids (null: empty)."""
    rows = coded.drop(decoded)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _pieces(model).library
        for part in _slices(batches, lambda b: 4 * pc.fill_null(pc.list_value_length(b.column(ids)), 0).to_numpy(zero_copy_only=False)):
            texts = pa.array([library.decode(x) if x else "" for x in part.column(ids).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, decoded])

    return rows.mapInArrow(work, T.StructType([*rows.schema.fields, T.StructField(decoded, T.StringType())]))


def ids_text(ids: Column) -> Column:
    """The ids as decimal numbers joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
