"""Spelling variants against all single edits of every word."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sharedrift.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, block long, run string"
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def edits(word, letters=spelling.LETTERS):
    for i in range(len(word) + 1):
        yield from (word[:i] + a + word[i:] for a in letters)
        if i < len(word):
            yield word[:i] + word[i + 1:]
            yield from (word[:i] + a + word[i + 1:] for a in letters)


def brute(rows):
    lower, found = str.maketrans(spelling.UPPER, spelling.LOWER), Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            found[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in found.items() if len(w) >= 5 and k >= 3}
    form, near = {}, {}
    for w in n:
        some = {e for e in edits(w) if e in n} - {w}
        best = min(some, key=lambda e: (-n[e], e), default=None)
        near[w], form[w] = len(some), best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n[w], near[w], n[form[w]] if form[w] else -1) for w in n)


def got(spark, rows, **options):
    out = spelling.variants(spark.createDataFrame([(*r, "w", 1, 2, "r") for r in rows], SCHEMA), **options)
    assert out.columns == COLUMNS
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or -1) for r in out.collect())


def awkward():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdeéÉÀABÿ", k=rng.randint(3, 9))) for _ in range(2500)]
    weights = [1 / (k % 400 + 1) for k in range(len(words))]
    rows = [(rng.choice([None, 1, 2, k]), rng.choice([" ", ", ", "1"]).join(rng.choices(words, weights, k=60))) for k in range(600)]
    rows += [(1, None), (2, ""), (None, None), (3, "İK×ß÷ ﬁne Kelvin")]
    x = "x" * 400
    return rows + [(9, f"{x} {x[:-1]} y{x[2:]} {x[1:]}z {x}ab")] * 4 + [(9, x)] * 7


@pytest.mark.parametrize("options", [{}, {"block_words": 7}])
def test_variants(spark, options):
    rows = awkward()
    want = brute(rows)
    assert got(spark, rows, **options) == want
    assert any(form != "" and form != root for _, form, root, *_ in want)


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, "a bb"), (3, "once only")]) == []


def test_very_long_words_use_double_precision():
    a = np.array(["e" * 3000, "e" * 2999 + "f", "e" * 2998])
    i, j = spelling.near(a[:1], a, np.zeros(3, dtype=bool))
    assert j.tolist() == [1]


def test_one_edit():
    rng = random.Random(7)
    words = ["".join(rng.choices("ab", k=rng.randint(1, 5))) for _ in range(60)]
    pairs = [(a, b) for a in words for b in words if abs(len(a) - len(b)) <= 1]
    found = spelling.one_edit(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert found.tolist() == [a != b and b in set(edits(a, "ab")) for a, b in pairs]


def test_neighbours_lie_in_adjacent_blocks(spark):
    rng, step = random.Random(8), set(spelling.moves())
    pairs = [(w, e) for w in ("drift", "été", "zz", "ÿab") for e in rng.sample(sorted(set(edits(w)) - {w, ""}), 150)]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        (spelling.block_of(spelling.F.col("a")) - spelling.block_of(spelling.F.col("b"))).alias("d")).collect()
    assert all(r.d in step or -r.d in step for r in rows)
