"""Language-model scores from a weighted backoff automaton.

Automaton: the states are the empty context and all contexts seen, each with a failure arc to its longest suffix.  An arc's
weight is the discounted probability of a word; a failure arc's weight returns the mass the state's own arcs leave, so the
probabilities of a state sum to one.  The root has add-one weights for every word.

Traversal: the state before a token is the longest suffix of the text so far that is a state, at most ``order`` - 1 words.
Every token is dealt to the part of the automaton that holds its state, in one shuffle: training texts make the arcs there, and
all texts look theirs up.  A task of the map side packs what it has for a part (``_packed``): each n-gram of a document once,
as numbers into the words and contexts of the pack.  A part returns one weight for each document and pack, and the n-grams that
aren't arcs of their state: these are joined with the state's failure weight and, one word shorter, with the arcs of the next
length and at last with the table of words.  Every n-gram counts, whatever its number.

Frequent words, those that make up at least 1 / ``MODEL_PARTS`` of the training tokens, so no more than ``MODEL_PARTS``, are sent to
every task with their counts.  Their root weights need no join; the arcs of the state that such a word makes are dealt by the whole pair, as
its total is known everywhere, so that no part holds all that follows a very frequent word.  All other words are
dealt by word; contexts of several words, which only orders above 2 have, by context.  Words are known by 64-bit hashes, contexts
of several words by hashes of these.

The text starts in the state of the end token, as if another text had ended.

Edge cases: a null or empty text is the end token alone; a null id counts as a remainder of zero (training); repeated rows
count and are scored each; with no training documents every word is unknown; an empty table gives an empty result; other
columns are ignored.
"""

import struct
from collections.abc import Iterator
from functools import reduce
from math import log10

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sharedrift.sources.tables import written_once

ORDER = 2
MODEL_PARTS = 1 << 20
DISCOUNT = 0.5
HELD_OUT = 2  # remainder of the checksum modulo FOLDS
FOLDS = 7
END = b"\n"  # no word has white space
SLICE_BYTES = 6_000_000
PART_TOKENS = 3 << 20  # training tokens a part of the automaton is made for
CHUNK_BYTES = 2_000_000  # of packs looked at together
MERGED_WORDS = 1 << 18  # words whose counts a task adds up before it returns them
DOC, BASE, SUM, ARC, STATE, GIVEN, FAILED = range(7)  # kinds of rows the parts return


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)), F.lit(FOLDS)) == HELD_OUT


class Tokens:
    """The tokens of some documents as numbers into ``hashes``; each document is led by an end token that is context only."""

    def __init__(self, texts: pa.Array) -> None:
        found = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
        words, size = found.flatten(), np.diff(found.offsets.to_numpy())
        real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        if not real.all():  # white space at an end of a text
            size = size - np.bincount(np.repeat(np.arange(len(texts)), size)[~real], minlength=len(texts))
            words = words.filter(pa.array(real))
        coded = words.dictionary_encode()
        sizes = size + 2
        first = np.cumsum(sizes) - sizes
        self.doc = np.repeat(np.arange(len(texts)), sizes)
        self.offset = np.arange(len(self.doc)) - first[self.doc]
        self.lead = self.offset == 0
        inner = ~self.lead
        inner[first + sizes - 1] = False
        self.codes = np.full(len(self.doc), len(coded.dictionary), dtype=np.int64)
        self.codes[inner] = coded.indices.to_numpy()
        distinct = [*coded.dictionary.view(pa.binary()).to_pylist(), END]
        self.hashes = np.array([xxhash.xxh64_intdigest(w) for w in distinct], dtype=np.uint64).view(np.int64)

    def distinct(self, at: np.ndarray, length: int, by_doc: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One position of each different n-gram that ends at some positions, how many of them it ends at, and each position's n-gram."""
        key, size = self.codes[at], len(self.hashes)
        for more in [self.codes[at - back] for back in range(1, length)] + [self.doc[at]] * by_doc:
            if size * (int(more.max(initial=0)) + 1) >= 1 << 62:
                key = pd.factorize(key)[0]
                size = int(key.max(initial=-1)) + 1
            key, size = more * size + key, size * (int(more.max(initial=0)) + 1)
        key = pd.factorize(key)[0]
        one = np.empty(key.max(initial=-1) + 1, dtype=np.int64)
        one[key] = at
        return one, np.bincount(key, minlength=len(one)), key

    def gram(self, at: np.ndarray, length: int, order: int) -> list[pa.Array]:
        """The words of the n-grams that end at some positions, by hash; nulls up to the greatest length."""
        return [pa.array(self.hashes[self.codes[at - back]]) for back in range(length - 1, -1, -1)] + [
            pa.nulls(len(at), pa.int64())] * (order - length)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of 64-bit numbers."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


class Automaton:
    """The frequent n-grams by length.  A state is a number among the kept n-grams of its length, -1 if not kept."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, distinct: int) -> None:
        order = np.argsort(words)
        self.words = words[order]  # hashes, sorted
        self.tokens, self.distinct = tokens, distinct
        self.counts = [counts[order]]
        self.by_count = np.argsort(-self.counts[0], kind="stable")  # the most frequent words first
        self.keys: list[np.ndarray] = []  # for lengths from 2: prefix state * number of words + word, sorted
        self.root = np.log10(self.counts[0] + 1.0) - self.log_total()
        self.arcs: list[np.ndarray] = []
        self.failures: list[np.ndarray] = []

    def log_total(self) -> float:
        return log10(self.tokens + self.distinct + 1)

    def word_numbers(self, tokens: Tokens) -> np.ndarray:
        return _find(self.words, tokens.hashes)[tokens.codes]

    def states(self, word: np.ndarray, lead: np.ndarray) -> list[np.ndarray]:
        """For each length, the state of the n-gram that ends at each position, within its document."""
        found = [word]
        for keys in self.keys:
            found.append(np.where(lead, -1, _find(keys, self.extend(found[-1], word))))
        return found

    def extend(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Key of the n-gram made of the state before each position and the word there; -1 without one."""
        before = np.concatenate([[-1], state[:-1]])
        return np.where((before >= 0) & (word >= 0), before * len(self.words) + word, -1)

    def add_length(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Kept n-grams one word longer: arcs of the states made by the last length."""
        order = np.argsort(keys)
        self.keys.append(keys[order])
        self.counts.append(counts[order])
        state, word = np.divmod(self.keys[-1], max(len(self.words), 1))
        probability = (self.counts[-1] - DISCOUNT) / self.counts[-2][state]
        if len(self.keys) == 1:
            self.tail, shorter = word, 10.0 ** self.root[word]
        else:  # the n-gram without its first word
            self.tail = _find(self.keys[-2], self.tail[state] * len(self.words) + word)
            shorter = 10.0 ** self.arcs[-1][self.tail]
        left = 1 - np.bincount(state, probability, len(self.counts[-2]))
        left_shorter = 1 - np.bincount(state, shorter, len(self.counts[-2]))
        self.arcs.append(np.log10(probability))
        self.failures.append(np.log10(np.maximum(left, 1e-9) / np.maximum(left_shorter, 1e-9)))


def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key, -1 if it isn't there."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.searchsorted(sorted_keys, wanted)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == wanted, at, -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Tokens of a bounded number of documents at a time."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("_text")).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                part = batch.slice(a, b - a)
                yield part, Tokens(part.column("_text"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(
        F.col("text"), F.lit("")).cast("binary").alias("_text"))


def word_counts(training: DataFrame) -> DataFrame:
    """(key, n): occurrences of every word, by hash.  A written table."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for _, tokens in _slices(batches):
            n = np.bincount(tokens.codes[~tokens.lead], minlength=len(tokens.hashes))
            held.append((tokens.hashes[n > 0], n[n > 0]))
            if sum(len(key) for key, _ in held) > 2 * MERGED_WORDS:
                held = [added(held)]
                if len(held[0][0]) > MERGED_WORDS:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, held.pop())], names=["key", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, added(held))], names=["key", "n"])

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        number, key = pd.factorize(np.concatenate([key for key, _ in held]))
        return key, np.bincount(number, np.concatenate([n for _, n in held]), len(key)).astype(np.int64)

    found = training.mapInArrow(work, "key bigint, n bigint")
    return written_once(found.groupBy("key").agg(F.sum("n").alias("n")))


def _words(length: int) -> list[str]:
    return [f"g{i}" for i in range(1, length + 1)]


def gram_counts(training: DataFrame, order: int) -> DataFrame:
    """(length, g1, g2, ..., n): occurrences of every n-gram of two words and more.  A written table."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens in _slices(batches):
            for length in range(2, order + 1):
                at, n, _ = tokens.distinct(np.flatnonzero(tokens.offset >= length - 1), length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), length)), *tokens.gram(at, length, order), pa.array(n)], names=names)

    names = ["length", *_words(order), "n"]
    found = training.mapInArrow(work, ", ".join(f"{name} bigint" for name in names))
    return written_once(found.groupBy(*names[:-1]).agg(F.sum("n").alias("n")))


def _frequent(counts: DataFrame, least: float) -> list[np.ndarray]:
    """The columns of the n-grams that make up enough of the training tokens: at most MODEL_PARTS of them."""
    return [c.to_numpy() for c in counts.filter(F.col("n") >= least).toArrow().combine_chunks().columns]


def train(docs: DataFrame, counts: DataFrame, order: int = ORDER, grams: DataFrame | None = None) -> Automaton:
    """The automaton of the frequent n-grams of the documents that are not held out; ``counts``, ``grams``: their counts."""
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = tokens / MODEL_PARTS
    model = Automaton(*_frequent(counts, least), tokens, distinct)
    if order > 1 and grams is None:
        grams = gram_counts(_texts(docs).filter("NOT held_out"), order)
    for length in range(2, order + 1):
        *words, n = _frequent(grams.filter(F.col("length") == length).select(*_words(length), "n"), least)
        # the parts of a frequent n-gram are as frequent, so all are known
        numbers = [_find(model.words, w) for w in words]
        state = numbers[0]
        for keys, number in zip(model.keys, numbers[1:-1]):
            state = _find(keys, state * len(model.words) + number)
        model.add_length(state * len(model.words) + numbers[-1], n)
    return model


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays in one compressed piece, the first bytes of all their values before the second ones."""
    head = b"".join(struct.pack("<cI", a.dtype.char.encode(), len(a)) for a in arrays)
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays]
    whole = b"".join([bytes([len(arrays)]), head, *planes])
    return struct.pack("<I", len(whole)) + pa.compress(whole, "zstd", asbytes=True)


def _unpacked(piece: bytes) -> list[np.ndarray]:
    whole = pa.decompress(piece[4:], struct.unpack("<I", piece[:4])[0], "zstd", asbytes=True)
    at, found = 1 + 5 * whole[0], []
    for kind, size in struct.iter_unpack("<cI", whole[1:at]):
        kind = np.dtype(kind.decode())
        planes = np.frombuffer(whole, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        found.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size * kind.itemsize
    return found


def _packs(tokens: Tokens, model: Automaton, training: np.ndarray, order: int, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """(part, length, pack) of the rare words and the n-grams of some documents, each once for a document.

    A pack: steps of the document, occurrences, those it is looked up for, whether they count, and each word's number in the pack,
    where the frequent words come first: these are given by steps of their rank, the others by hash.  Then the same for contexts."""
    number, real = model.word_numbers(tokens), ~tokens.lead
    rank = np.empty(len(model.words), dtype=np.int64)
    rank[model.by_count] = np.arange(len(rank))
    ranks = np.where(number >= 0, rank[number] if len(rank) else 0, len(rank))
    hashes = [tokens.hashes[tokens.codes]]
    for length in range(2, order):
        before = np.concatenate([[0], hashes[-1][:-1]])
        hashes.append(_mixed(before, hashes[0]))
    for length in range(1, order + 1):
        if length == 1:
            at = np.flatnonzero(real & (number < 0))
        else:
            at = np.flatnonzero(tokens.offset >= length - 1)
            if length < order:
                at = at[training[tokens.doc[at]] | (tokens.offset[at] == length - 1)]
        one, n, key = tokens.distinct(at, length, by_doc=True)
        asked = n
        if 1 < length < order:
            asked = np.bincount(key[tokens.offset[at] == length - 1], minlength=len(one))
        if not len(one):
            continue
        word, context = hashes[0][one], hashes[length - 2][one - 1] if length > 1 else None
        before = ranks[one - 1] if length == 2 else np.full(len(one), len(rank))
        dealt = word if length == 1 else np.where(before < len(rank), _mixed(context, word), context)
        part = (_mixed(dealt, np.zeros(len(one), dtype=np.int64)).view(np.uint64) % np.uint64(parts)).astype(np.int64)
        by_part = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
        part, one, n, asked, before = part[by_part], one[by_part], n[by_part], asked[by_part], before[by_part]
        ends = np.flatnonzero(np.diff(part, append=-1)) + 1

        def numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Numbers from 0 in each part, the index of one row of each number, and where the numbers of each part end."""
            found = pd.factorize(part * (int(codes.max()) + 1) + codes)[0]
            row = np.empty(found.max() + 1, dtype=np.int64)
            row[found] = np.arange(len(found))
            last = np.maximum.accumulate(found)[ends - 1] + 1  # in order of appearance, so one part's after another's
            return found - np.repeat(np.concatenate([[0], last[:-1]]), np.diff(ends, prepend=0)), row, last

        words, word_row, word_end = numbered(tokens.codes[one])
        if length == 2:
            contexts, context_row, context_end = numbered(tokens.codes[one - 1])
        elif length > 2:
            contexts, context_row, context_end = numbered(pd.factorize(hashes[length - 2][one - 1])[0])
        doc, a, word_a, context_a = tokens.doc[one], 0, 0, 0

        def listed(numbers: np.ndarray, ranked: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
            """New numbers and the steps of the ranks; the order of the others."""
            order = np.argsort(ranked, kind="stable")
            new = np.empty(len(order), dtype=np.int64)
            new[order] = np.arange(len(order))
            frequent = int(np.count_nonzero(ranked < len(rank)))
            return [_narrow(new[numbers]), _narrow(np.diff(ranked[order[:frequent]], prepend=0))], order[frequent:]

        for i, b in enumerate(ends):
            rows = word_row[word_a:word_end[i]]
            coded, others = listed(words[a:b], ranks[one[rows]])
            pack = [_narrow(np.diff(doc[a:b], prepend=0)), _narrow(n[a:b]), _narrow(asked[a:b]),
                    training[doc[a:b]].astype(np.uint8), *coded, hashes[0][one[rows[others]]]]
            if length > 1:
                rows = context_row[context_a:context_end[i]]
                coded, others = listed(contexts[a:b], before[rows])
                pack += [*coded, *[hashes[j][one[rows[others]] - 1] for j in range(length - 1)]]
                context_a = context_end[i]
            yield int(part[a]), length, _packed(pack)
            a, word_a = b, word_end[i]


class _Pack:
    """Of several packs of one length: row, n, asked and training of the n-grams, their numbers of word and context, and what these are."""

    def __init__(self, packs: list[tuple[int, bytes]], model: Automaton) -> None:
        rows, contexts, words, each, word_at, context_at = [], [], [], [], 0, 0
        for first, piece in packs:
            step, n, asked, training, word, ranks, others, *more = _unpacked(piece)
            rows.append(first + np.cumsum(step, dtype=np.int64))
            each.append((n, asked, training, word.astype(np.int64) + word_at))
            words.append(self.known_first(ranks, [others], model))
            word_at += len(words[-1][0])
            if more:
                context, ranks, *others = more
                each[-1] += (context.astype(np.int64) + context_at,)
                contexts.append(self.known_first(ranks, others, model))
                context_at += len(contexts[-1][0])
        self.rows = np.concatenate(rows)
        self.n, self.asked, self.training, self.word, *self.context = map(np.concatenate, zip(*each))
        self.words = [*map(np.concatenate, zip(*words))]  # hashes, counts
        self.contexts = [*map(np.concatenate, zip(*contexts))]  # hashes, totals, hashes of the last word, the last two words, ...

    @staticmethod
    def known_first(steps: np.ndarray, others: list[np.ndarray], model: Automaton) -> list[np.ndarray]:
        """Hashes and counts, 0 if not known, of frequent words by steps of their rank, then of others by hash; the others' suffixes."""
        frequent = model.by_count[np.cumsum(steps, dtype=np.int64)]
        counts = np.concatenate([model.counts[0][frequent], np.zeros(len(others[-1]), dtype=np.int64)])
        return [np.concatenate([model.words[frequent], others[-1]]), counts, *others[:-1]]


def _numbered(each: list[list[np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns of the rows that differ in the first column, and for every given set of rows their numbers among these."""
    columns = [*map(np.concatenate, zip(*each))]
    number = pd.factorize(columns[0])[0]
    one = np.empty(number.max(initial=-1) + 1, dtype=np.int64)
    one[number] = np.arange(len(number))
    return [c[one] for c in columns], np.split(number, np.cumsum([len(rows[0]) for rows in each])[:-1])


def _looked_up(packs: list[tuple[int, bytes]], length: int, order: int, model: Automaton) -> Iterator[dict[str, np.ndarray]]:
    """What a part returns for n-grams of one length: weights summed by document, and what the next joins need.

    The packs are unpacked some at a time: to number words and contexts, to count the n-grams, to look them up."""
    groups, held, log_total = [[]], 0, model.log_total()
    for pack in packs:
        if held > CHUNK_BYTES:
            groups.append([])
            held = 0
        groups[-1].append(pack)
        held += len(pack[1])
    words, contexts = [], []
    for group in groups:
        pack = _Pack(group, model)
        words.append(pack.words)
        contexts.append(pack.contexts)
    (word_hash, word_n), word_of = _numbered(words)
    if length > 1:
        (state, total, *suffixes), state_of = _numbered(contexts)
    del words, contexts
    numbers, grams, counts = [], [], []
    for i, group in enumerate(groups):
        pack = _Pack(group, model)
        key = word_of[i][pack.word]
        if length > 1:
            key += state_of[i][pack.context[0]] * len(word_hash)
        number, distinct = pd.factorize(key)
        numbers.append(number.astype(np.int32))
        grams.append([distinct])
        counts.append(np.bincount(number, pack.n * pack.training, len(distinct)))
    (gram,), gram_of = _numbered(grams)
    n = np.bincount(np.concatenate(gram_of), np.concatenate(counts), len(gram)).astype(np.int64)
    del grams, counts
    if length == 1:
        weight = np.log10(n + 1.0)
    else:
        gram_state, gram_word = np.divmod(gram, len(word_hash))
        needed = (total > 0) | (length < order)  # arcs of a state whose total is known may lie in other parts too
        total = np.where(total > 0, total, np.bincount(gram_state, n, len(state))).astype(np.int64)
        weight = np.log10((np.maximum(n, 1) - DISCOUNT) / np.maximum(total, 1)[gram_state])
    for i, group in enumerate(groups):
        pack = _Pack(group, model)
        asked = np.flatnonzero(pack.asked)
        at, rows, times = gram_of[i][numbers[i][asked]], pack.rows[asked], pack.asked[asked].astype(np.int64)
        there = n[at] > 0
        given = np.where(there, weight[at], 0.0)
        if length > 1 and not there.all():
            fails_state, fails_word = gram_state[at[~there]], gram_word[at[~there]]
            needed[fails_state] = True
            known = np.zeros(len(fails_word), dtype=bool)
            if length == 2:  # the root weight of a frequent word
                known = word_n[fails_word] > 0
                given[~there] = np.where(known, np.log10(word_n[fails_word] + 1.0) - log_total, 0.0)
            yield {"kind": FAILED, "row": rows[~there], "k": times[~there], "w": pa.array(word_hash[fails_word], mask=known),
                   **{f"c{j}": s[fails_state] for j, s in enumerate([*suffixes, state], 1)}}
        number, sums = pd.factorize(rows)
        added = {"row": sums, "weight": np.bincount(number, given * times, len(sums))}
        if length == 1:
            yield {"kind": BASE, **added, "k": np.bincount(number, there * times, len(sums)).astype(np.int64)}
        else:
            yield {"kind": SUM, **added}
    if length == 1:
        return
    arcs = np.flatnonzero(n)
    arc_state, arc_word, weight = gram_state[arcs], gram_word[arcs], weight[arcs]
    frequent = word_n[arc_word] > 0 if length == 2 else np.zeros(len(arcs), dtype=bool)
    near = np.bincount(arc_state[frequent], (word_n[arc_word[frequent]] + 1) * 10.0 ** -log_total, len(state))
    own = np.bincount(arc_state, minlength=len(state))
    told = np.flatnonzero(needed & (own > 0))
    yield {"kind": STATE, f"c{length - 1}": state[told], "n": own[told], "k": total[told], "weight": near[told]}
    left = np.flatnonzero(~frequent & needed[arc_state])
    yield {"kind": GIVEN, "w": word_hash[arc_word[left]], **{f"c{j}": s[arc_state[left]] for j, s in enumerate([*suffixes, state], 1)}}
    if length < order:
        yield {"kind": ARC, "w": word_hash[arc_word], f"c{length - 1}": state[arc_state], "weight": weight}


def _backed_off(parts: DataFrame, counts: DataFrame, order: int, log_total: float) -> list[DataFrame]:
    """(row, weight): the failure weights of n-grams that are no arcs of their state, and what they weigh one word shorter."""
    sums, asked = [], None
    for length in range(order, 1, -1):
        state, chain = f"c{length - 1}", [f"c{j}" for j in range(1, length)]
        here = parts.filter(F.col("length") == length)
        failed = here.filter(F.col("kind") == FAILED).select("row", *chain, "w", "k")
        if asked is not None:
            arcs = here.filter(F.col("kind") == ARC).select(state, "w", "weight")
            found = asked.join(arcs, [state, "w"], "left")
            sums.append(found.filter("weight IS NOT NULL").select("row", (F.col("k") * F.col("weight")).alias("weight")))
            failed = failed.unionByName(found.filter("weight IS NULL").drop("weight"))
        given = here.filter(F.col("kind") == GIVEN).select(*chain, "w")
        if length == 2:
            given = given.join(counts, "w").select(state, ((F.col("n") + 1) * 10.0 ** -log_total).alias("shorter"))
        else:
            shorter = parts.filter((F.col("length") == length - 1) & (F.col("kind") == ARC)).select(f"c{length - 2}", "w", "weight")
            given = given.join(shorter, [f"c{length - 2}", "w"]).select(state, F.pow(F.lit(10.0), "weight").alias("shorter"))
        left = here.filter(F.col("kind") == STATE).select(state, "n", "k", F.col("weight").alias("shorter")).unionByName(
            given, allowMissingColumns=True).groupBy(state).agg(F.sum("n").alias("n"), F.max("k").alias("k"), F.sum("shorter").alias("shorter"))
        failures = written_once(left.select(state, (  # each arc gives DISCOUNT of its count away
            F.log10(DISCOUNT * F.col("n") / F.col("k")) - F.log10(F.greatest(1 - F.col("shorter"), F.lit(1e-9)))).alias("weight")))
        sums.append(failed.select("row", state, "k").join(failures, state).select("row", (F.col("k") * F.col("weight")).alias("weight")))
        asked = failed.filter("w IS NOT NULL").select("row", *chain[:-1], "w", "k")
    root = F.log10(F.coalesce("n", F.lit(0)) + 1) - log_total
    sums.append(asked.join(counts, "w", "left").select("row", (F.col("k") * root).alias("weight")))
    return sums


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score."""
    texts = _texts(docs)
    counts = word_counts(texts.filter("NOT held_out"))
    model = train(docs, counts, 1)
    context = docs.sparkSession.sparkContext
    sent, log_total = context.broadcast(model), model.log_total()
    parts = max(context.defaultParallelism, model.tokens // PART_TOKENS + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document and each pack; ``row`` is the document's, or the first one's of the pack."""
        model, row = sent.value, TaskContext.get().partitionId() << 33
        for part, tokens in _slices(batches):
            word, real, size = model.word_numbers(tokens), ~tokens.lead, part.num_rows
            known = word >= 0
            n_tokens, n_known = (np.bincount(tokens.doc[here], minlength=size) for here in (real, real & known))
            base = np.bincount(tokens.doc[real], np.where(known, model.root[word] if len(model.root) else 0.0, 0.0)[real], size)
            missing = (n_tokens - n_known) * model.log_total()
            rows = row + np.arange(size)
            yield pa.RecordBatch.from_arrays([
                pa.array((rows % parts).astype(np.int32)), pa.array(rows), part.column("doc_id"), part.column("held_out"),
                pa.array(n_tokens), pa.array(n_known), pa.array(base - missing), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary())],
                names=dealt_names)
            training = ~part.column("held_out").to_numpy(zero_copy_only=False)
            for to, length, pack in _packs(tokens, model, training, order, parts):
                yield pa.RecordBatch.from_arrays([
                    pa.array([to], pa.int32()), pa.array([row]), *[pa.nulls(1, t) for t in (
                        part.schema.field("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64())],
                    pa.array([length]), pa.array([pack], pa.binary())], names=dealt_names)
            row += size

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            own = batch.filter(pc.is_null(batch.column("pack")))
            yield row_batch({"kind": DOC, "row": own.column("row"), "doc_id": own.column("doc_id"), "held_out": own.column("held_out"),
                             "n": own.column("n"), "k": own.column("k"), "weight": own.column("weight")}, 0, own.num_rows)
            for row, length, pack in zip(*(batch.column(c).to_pylist() for c in ("row", "length", "pack"))):
                if pack is not None:
                    packs.setdefault(length, []).append((row, pack))
        for length in sorted(packs):
            for found in _looked_up(packs.pop(length), length, order, sent.value):
                yield row_batch(found, length, len(next(v for k, v in found.items() if k != "kind")))

    def row_batch(found: dict, length: int, size: int) -> pa.RecordBatch:
        found |= {"kind": np.full(size, found["kind"], dtype=np.int32), "length": np.full(size, length, dtype=np.int32)}
        return pa.RecordBatch.from_arrays([
            pa.nulls(size, kind) if name not in found else found[name] if isinstance(found[name], pa.Array)
            else pa.array(found[name], kind) for name, kind in returned.items()], names=[*returned])

    id_field = docs.schema["doc_id"].dataType
    id_type = id_field.simpleString()
    dealt_names = ["part", "row", "doc_id", "held_out", "n", "k", "weight", "length", "pack"]
    returned = {"kind": pa.int32(), "length": pa.int32(), "row": pa.int64(), "doc_id": to_arrow_type(id_field), "held_out": pa.bool_(),
                **{f"c{j}": pa.int64() for j in range(1, order)}, "w": pa.int64(), "n": pa.int64(), "k": pa.int64(), "weight": pa.float64()}
    contexts = "".join(f"c{j} bigint, " for j in range(1, order))
    dealt = texts.mapInArrow(
        deal, f"part int, row bigint, doc_id {id_type}, held_out boolean, n bigint, k bigint, weight double, length bigint, pack binary")
    found = written_once(dealt.repartitionById(parts, F.col("part")).mapInArrow(
        look_up, f"kind int, length int, row bigint, doc_id {id_type}, held_out boolean, {contexts}w bigint, n bigint, k bigint, weight double"))
    zero = F.lit(0.0)
    weight = F.col("weight")
    sums = [found.filter(F.col("kind").isin(BASE, SUM)).select("row", *[F.when(F.col("kind") == kind, value).otherwise(none).alias(name) for kind, value, none, name in (
        (BASE, weight, zero, "_base"), (BASE, F.col("k"), F.lit(0), "_known"), (SUM, weight, zero, "_score"))])]
    if order > 1:
        sums += [m.select("row", zero.alias("_base"), F.lit(0).cast("long").alias("_known"), weight.alias("_score"))
                 for m in _backed_off(found, counts.withColumnRenamed("key", "w"), order, log_total)]
    added = reduce(DataFrame.unionByName, sums).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("_base", "_known", "_score")])
    base = weight + F.coalesce("_base", zero)
    return found.filter(F.col("kind") == DOC).join(added, "row", "left").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("k") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.coalesce("_score", zero) if order > 1 else base).alias("score"))
