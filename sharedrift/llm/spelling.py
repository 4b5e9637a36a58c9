"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

A word's letter counts are a vector.  One replaced letter changes two counts by one or none, an inserted or deleted letter one:
words one edit apart have a squared distance of two at most.  A Gram matrix gives all squared distances between two blocks
of words at once (|a - b|^2 = |a|^2 + |b|^2 - 2ab).

Blocks: words are blocked by length, and within a length by how many of their letters fall into each of ``GROUPS`` groups of
letters (the groups' counts sum to the length).  Words one edit apart lie in the same or in adjacent blocks: those whose
counts differ by one in one group, or by one up and one down in two.  Each block's words stay at home and meet the words
of half of its neighbours, which are sent to it; the other half meets them the other way round.  A block of more than
``BLOCK_WORDS`` words is cut, and the visitors go to each of its parts; visitors are streamed.  Pairs within squared
distance two are then verified letter by letter.

Edge cases: a null text has no words; a null doc_id counts as empty text in the noise hash; repeated rows count again; words may
have any length (letters beyond ``MOST`` in a group count as that many, which keeps neighbours adjacent; long words use exact
double precision); among near words of equal number the first in code-point order is the form.  An empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharedrift.sources.tables import written_once

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
NOISE = 97  # every 97th hash deletes a letter
MIN_LETTERS, MIN_COUNT = 5, 3
DOMINANCE = 2  # a form occurs at least so many times as often
GROUPS = 6
MOST = 1000  # letters of a group that a block tells apart; below 2^10
BLOCK_WORDS = 4096  # words at home in one part of a block
VISITORS = 8192  # words compared with a part at once
EXACT_NORM = 1 << 22  # squared norms up to this are exact in single precision


def lower_ascii(run: Column) -> Column:
    """Lower-case A-Z only; the general function does the same to a run of ASCII letters, and is faster."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def noisy_words(docs: DataFrame) -> DataFrame:
    """(word): every run of letters, those that the hash picks without one of their letters."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % NOISE == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of enough letters and occurrences."""
    return (
        noisy_words(docs).filter(F.length("word") >= MIN_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= MIN_COUNT))


def block_of(word: Column) -> Column:
    """The numbers of letters in each group, ten bits a group; together they tell the length too."""
    rest = [F.translate(word, "".join(LETTERS[g::GROUPS]), "") for g in range(GROUPS)]
    counts = [F.least(F.length(word) - F.length(r), F.lit(MOST)).cast("long") for r in rest]
    return sum((F.shiftleft(c, 10 * g) for g, c in enumerate(counts[1:], 1)), counts[0])


def moves() -> list[int]:
    """What one edit adds to a block's number: half of the neighbours, and the block itself."""
    ups = [1 << 10 * g for g in range(GROUPS)]
    return [0, *ups, *(a - b for k, a in enumerate(ups) for b in ups[:k])]


def vectors(words: np.ndarray) -> np.ndarray:
    """Letter counts, one row a word."""
    sizes = np.char.str_len(words)
    codes = np.frombuffer("".join(words.tolist()).encode("utf-32-le"), dtype="<u4")
    column = np.where(codes >= 0xC0, codes - 0xC0 + 26, codes - 97)
    cell = np.repeat(np.arange(len(words)), sizes) * len(LETTERS) + column
    return np.bincount(cell, minlength=len(words) * len(LETTERS)).reshape(len(words), len(LETTERS))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words at the same place differ by one insertion, deletion or replacement; lengths differ by one at most."""
    if not len(a):
        return np.zeros(0, dtype=bool)
    width = max(a.dtype.itemsize, b.dtype.itemsize, 8) // 4 + 1
    x, y = (w.astype(f"<U{width}").view("<u4").reshape(-1, width) for w in (a, b))  # padded with zeros
    n, m = np.char.str_len(a), np.char.str_len(b)
    same = x == y
    ahead = np.argmin(same, axis=1)  # letters both begin with, as at least one place differs
    ahead = np.where(same.all(axis=1), n, ahead)
    # after the first difference: the rest must be the same, shifted in the longer word
    places = np.arange(width)
    tail = places > ahead[:, None]
    as_replaced = (same | ~tail).all(axis=1) & (n == m) & (ahead < n)
    long, short = np.where((n > m)[:, None], x, y), np.where((n > m)[:, None], y, x)
    shifted = np.concatenate([long[:, 1:], np.zeros((len(a), 1), dtype=np.uint32)], axis=1)
    as_shifted = ((shifted == short) | (places < ahead[:, None])).all(axis=1) & (np.abs(n - m) == 1)
    return as_replaced | as_shifted


def near(home: np.ndarray, guests: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words at home and of guests one edit apart; guests of the block itself (``own``) only once a pair."""
    a, b = vectors(home), vectors(guests)
    norm_a, norm_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    kind = np.float32 if max(norm_a.max(), norm_b.max()) < EXACT_NORM else np.float64
    # the Gram matrix with halves of the squared norms: ab + 1 - |a|^2 / 2 - |b|^2 / 2 >= 0 where the distance is two at most
    left = np.column_stack([a, 1 - norm_a / 2, np.ones(len(a))]).astype(kind)
    right = np.column_stack([b, np.ones(len(b)), -norm_b / 2]).astype(kind)
    i, j = np.divmod(np.flatnonzero((left @ right.T).ravel() >= 0), len(guests))
    once = ~own[j] | (home[i] < guests[j])
    i, j = i[once], j[once]
    good = np.zeros(len(i), dtype=bool)
    long = np.maximum(np.char.str_len(home)[i], np.char.str_len(guests)[j])
    for low, high in ((0, 32), (32, 256), (256, 1 << 62)):  # words of like lengths together: short ones need no wide rows
        some = np.flatnonzero((long > low) & (long <= high))
        step = max(1, 8_000_000 // (4 * int(long[some].max() + 2))) if len(some) else 1
        for k in range(0, len(some), step):
            at = some[k:k + step]
            width = f"<U{int(long[at].max())}"
            good[at] = one_edit(home[i[at]].astype(width), guests[j[at]].astype(width))
    return i[good], j[good]


def pairs(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(a, n_a, b, n_b): every two words one edit apart, once; ``words`` has distinct word and n."""
    blocked = written_once(words.select("word", "n", block_of(F.col("word")).alias("block")))
    sizes = blocked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / block_words).cast("int").alias("parts"))
    large = written_once(sizes.filter("parts > 1"))
    one = F.coalesce("parts", F.lit(1))
    home = blocked.join(large, "block", "left").select(
        "block", F.pmod(F.xxhash64("word"), one).cast("int").alias("part"), F.lit(False).alias("guest"),
        F.lit(False).alias("own"), "word", "n")
    steps = F.array(*[F.struct(F.lit(m).cast("long").alias("by"), F.lit(m == 0).alias("own")) for m in moves()])
    sent = blocked.select("block", "word", "n", F.explode(steps).alias("step")).select(
        (F.col("block") + F.col("step.by")).alias("block"), "step.own", "word", "n")
    guests = sent.join(sizes, "block").select(  # only to blocks that have words
        "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("guest"), "own", "word", "n")
    dealt = home.unionByName(guests).repartition("block", "part").sortWithinPartitions("block", "part", "guest")
    return dealt.mapInArrow(_meet, "a string, n_a bigint, b string, n_b bigint")


def _strings(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.str_)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one part of a block come together, those at home first; the home may go on in the next batch."""
    at, home, counts = None, None, None
    for batch in batches:
        block, part, guest, own, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "part", "guest", "own", "n"))
        words = batch.column("word")
        change = np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0) | np.diff(guest)) + 1
        for start, end in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            if start == end:
                continue
            here = (int(block[start]), int(part[start]))
            some = _strings(words.slice(start, end - start))
            if not guest[start]:
                if here == at:
                    home, counts = np.concatenate([home, some]), np.concatenate([counts, n[start:end]])
                else:
                    at, home, counts = here, some, n[start:end]
            elif here == at:
                for k in range(0, len(some), VISITORS):
                    they, m = some[k:k + VISITORS], n[start + k:min(end, start + k + VISITORS)]
                    i, j = near(home, they, own[start + k:start + k + len(they)])
                    yield pa.RecordBatch.from_pydict({
                        "a": pa.array(home[i].tolist(), pa.string()), "n_a": pa.array(counts[i], pa.int64()),
                        "b": pa.array(they[j].tolist(), pa.string()), "n_b": pa.array(m[j], pa.int64())})


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word along the forms.  A form occurs at least twice as often as its word, so paths are no
    longer than the logarithm of the largest count, and every round doubles what has been walked."""
    walked = written_once(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = walked.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = written_once(walked.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        walked = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return walked


def variants(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = written_once(vocabulary(docs.select("doc_id", "text")))
    found = pairs(words, block_words)
    other = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("by"), F.col("n_b").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("by"), F.col("n_a").alias("m")))
    best = found.select(F.explode(other).alias("o")).select("o.*").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("rank"), "by")).alias("best"))
    large = -F.col("best.rank") >= DOMINANCE * F.col("n")
    forms = written_once(words.join(best, "word", "left").select(
        "word", F.when(large, F.col("best.by")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, -F.col("best.rank")).alias("form_n")))
    return forms.join(with_roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
