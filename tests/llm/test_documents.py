"""Operators on documents against plain Python, on awkward rows and on the test tables."""

import base64
import hashlib
import pathlib
import re
import time
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sharedrift.llm import bpe, licenses, lm, mixing, quality, simhash
from sharedrift.llm.queries import QUERIES, RANK_FILE
from tests.llm.fixtures import documents

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module", params=["awkward", "sf0.001"])
def docs(request, spark):
    df = documents(spark) if request.param == "awkward" else spark.read.parquet(f"{SMALL}/documents.parquet")
    return df.cache()


def lower(text):
    return "".join(c.lower() if c < "\x80" else c for c in text or "")


def words(text):
    return WORD.findall(text or "")


# Mixing -----------------------------------------------------------------------------------------------------------

def filled(sizes):
    """Targets by resharing the excess round after round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / max(sum(weight[s] for s in free), 1)
        over = {s: 3.0 * sizes[s] for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return capped | {s: weight[s] * level for s in free}
        capped |= over


def test_mix_reaches_its_targets(docs):
    got = [r.asDict() for r in mixing.taken_by_document(docs).collect()]
    rows = docs.select("doc_id", "text", "source").collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter(
        (r.doc_id, r.source, len(words(r.text))) for r in rows)
    sizes = defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
    want, taken = filled(sizes), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.taken_by_document(docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(tuple(r.values()) for r in got)


def test_slots_are_spread_and_blocks_cover_them(spark):
    wanted = spark.createDataFrame([("a", 6000.0), ("b", 3000.0), (None, 1010.0)], "source string, target double")
    slots = mixing.schedule(wanted, 10).orderBy("slot").collect()
    assert Counter(s.source for s in slots) == {"a": 600, "b": 300, None: 101}
    assert sorted(s["rank"] for s in slots if s.source == "a") == list(range(600))
    assert [s["rank"] for s in slots if s.source == "b"] == list(range(300))
    for n in (50, 200, 600):
        assert abs(sum(s.source == "a" for s in slots[:n]) / n - 0.6) < 6 / n
    assert sum(s.words for s in slots) == 10010


# Byte-level BPE -----------------------------------------------------------------------------------------------------

def test_ids_equal_those_of_another_implementation(docs):
    file = bpe.read_ranks(RANK_FILE)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.decode(bpe.encode(docs, file, public_tokenizers.PATTERN), file, public_tokenizers.PATTERN)
    assert set(docs.columns) <= set(coded.columns)
    got = coded.select("doc_id", "text", "ids", "decoded").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in docs.collect())
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == other.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_long_words_and_odd_spaces():
    file = bpe.read_ranks(RANK_FILE)
    codec = bpe.Codec(file, public_tokenizers.PATTERN)
    other = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = ["a" * 9000, "ab" * 999, "3334" * 50, "-" * 501, " " * 300, "x  y \n z", " \t\x1c q", "é" * 400 + "  ", "\n \n a  b"]
    assert [np.frombuffer(i, "<u4").tolist() for i in codec.encode(texts)] == [other.encode_ordinary(t) for t in texts]
    with pytest.raises(ValueError):
        codec.decode([np.array([10 ** 6], "<u4").tobytes()])


# License scan -------------------------------------------------------------------------------------------------------

def test_phrase_places(docs):
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.licenses(docs).collect())
    want = Counter()
    for r in docs.collect():
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))
        places = [(i, label) for label, phrase in licenses.PHRASES for i in range(len(found))
                  if found[i:i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places] or [None]
        want[(r.doc_id, len(found), len(places), min(starts, key=lambda x: x or 0), max(starts, key=lambda x: x or 0),
              ",".join(sorted({label for _, label in places})))] += 1
    assert got == want


def test_altered_notice_is_found(spark):
    notice = dict((b, a) for a, b in licenses.NOTICES if a == "bsd")
    text = next(iter(notice)).split()
    altered = " ".join(["Intro"] * 7 + text[:9] + ["(inserted)"] + text[9:]) + " outro"
    row = licenses.licenses(spark.createDataFrame([(1, altered), (2, " ".join(text[:8]))], "doc_id long, text string"))
    got = {r.doc_id: (r.labels, r.score) for r in row.collect()}
    assert got[1][0] == "bsd" and 0.75 <= got[1][1] < 1 and got[2] == ("", 0.0)


def test_notices_that_follow_each_other_are_found(spark):
    notice = "All rights reserved."
    texts = [notice, f"{notice} {notice}", f"{notice}\n{notice}\n{notice}", f"x {notice} y {notice} z", "all rights all rights"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter("label IS NOT NULL")
    spans = sorted((r.doc_id, r.label, r.start, r.end) for r in rows.collect())
    assert spans == [(n, "all-rights-reserved", at, at + 3) for n, at in [(0, 0), (1, 0), (1, 3), (2, 0), (2, 3), (2, 6), (3, 1), (3, 5)]]


# SimHash ------------------------------------------------------------------------------------------------------------

def brute_fingerprint(text):
    found = [w.encode() for w in words(lower(text))]
    if not found:
        return 0
    shingles = [b" ".join(found[i:i + 3]) for i in range(len(found) - 2)] or [b" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Root of each distinct fingerprint."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    return {f: find(f) for f in fps}


def test_simhash_components(docs):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    root = brute_components([f for _, f in rows])
    first = {}
    for i, f in rows:
        if i is not None:
            first[root[f]] = min(first.get(root[f], i), i)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_of(F.col("fp")), "component_id").collect()
    assert Counter(map(tuple, got)) == Counter((i, f"{f:016x}", first.get(root[f])) for i, f in rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(first.get(root[brute_fingerprint(r.text)], -1) for r in kept.collect()) == sorted(
        first.get(x, -1) for x in set(root.values()))


@pytest.mark.parametrize("hot_cell", [2, simhash.HOT_CELL])
def test_links_lose_no_component(spark, hot_cell):
    rng = np.random.default_rng(5)
    fps = set(rng.integers(0, 2 ** 63, 300).tolist())
    for centre in list(fps)[:6]:  # crowded neighbourhoods and chains
        at = centre
        for _ in range(60):
            fps.add(centre ^ sum(1 << int(b) for b in rng.integers(0, 62, rng.integers(1, 5))))
            at ^= sum(1 << int(b) for b in rng.integers(0, 62, 3))
            fps.add(at)
    points = spark.createDataFrame([(f,) for f in fps], "fp long").withColumn("point", simhash._point(F.col("fp")))
    edges = simhash.links(simhash.cells(points, hot_cell=hot_cell)).collect()
    assert all((e.a ^ e.b).bit_count() <= 3 for e in edges) and len(edges) < 20 * 20 * len(fps)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for e in edges:
        root[find(e.b)] = find(e.a)
    want = brute_components(fps)
    assert len({(find(f), want[f]) for f in fps}) == len(set(want.values())) == len({find(f) for f in fps})


# Quality ------------------------------------------------------------------------------------------------------------

def test_quality_measures(docs):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in quality.quality(docs).collect())
    want = Counter()
    for r in docs.collect():
        text, w = r.text or "", words(r.text)
        seen = defaultdict(list)
        for i in range(len(w) - 2):
            seen[tuple(w[i:i + 3])].append(i)
        repeated = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
        lines = [line for line in text.split("\n") if words(line)]
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        want[(r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
              len(repeated), failed)] += 1
    assert got == want


def test_boilerplate_lines_are_removed_and_copies_keep_theirs(spark):
    unique = lambda n: " ".join(f"w{n}x{k}" for k in range(60))
    rows = [(n, f"Shared   Footer line\n{unique(n)}", "h") for n in range(20)]
    rows += [(100 + n, unique("copy"), "h") for n in range(30)]
    footer = " ".join(f"f{k}" for k in range(80))
    rows += [(200 + n, f"{footer}\nown{n} text{n}", "j") for n in range(20)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[n].n_removed_words == 3 and got[n].kept for n in range(20))
    assert all(got[100 + n].n_removed_words == 0 and got[100 + n].kept for n in range(30))
    assert all(got[200 + n].n_removed_words == 80 and not got[200 + n].kept for n in range(20))


def test_different_documents_with_two_common_lines_count_each(spark):
    """A header and a footer in 20 different texts; and a text with 20 copies, which keeps its lines."""
    own = lambda n: " ".join(f"w{n}x{k}" for k in range(60))
    rows = [(n, f"The header line\n{own(n)}\nThe footer line", "h") for n in range(20)]
    rows += [(100 + n, f"{own(0)}\nThe header line", "k") for n in range(20)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[n].n_removed_words == 6 for n in range(20))
    assert all(got[100 + n].n_removed_words == 0 for n in range(20))


def test_cleaned_texts_lose_only_boilerplate_lines(spark):
    own = lambda n: " ".join(f"w{n}x{k}" for k in range(60))
    rows = [(n, f"Shared   Line\n\n{own(n)}\nshared line\n  tail {n}\n", "h", n) for n in range(20)]
    rows += [rows[0], (50, f"Shared line\n{own(50)}", "other", 1), (51, "shared line", "h", 1), (52, None, "h", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")
    got = quality.cleaned_documents(docs)
    assert got.columns == docs.columns
    want = [(n, f"\n{own(n)}\n  tail {n}\n", "h", n) for n in [*range(20), 0]] + [(50, rows[-3][1], "other", 1)]
    assert Counter(map(tuple, got.collect())) == Counter(want)


CLASHING = ["_text", "_simhash", "_id", "_first", "_nth", "id", "key", "fp", "row", "n", "component", "first_id", "text_", "_own", "at",
            "line", "cleaned", "_cleaned", "__text_rejected", "_doc_id_rejected", "d", "r", "_removed", "_copies"]


def test_columns_of_any_name_pass_through(spark):
    """Operators that return whole rows keep the caller's values whatever the columns are called."""
    own = lambda n: " ".join(f"w{n}x{k}" for k in range(60))
    rows = [(n, f"the shared line\n{own(n % 15)}", "h", *[f"{c}{n}" for c in CLASHING]) for n in range(30)] + [
        (99, "short", "h", *CLASHING), (None, None, None, *CLASHING), (7, f"the shared line\n{own(7)}", "h", *["again"] * len(CLASHING))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    for operator in (simhash.keep_one, quality.kept_documents, quality.cleaned_documents):
        out = operator(docs)
        assert out.columns == docs.columns
        found = [tuple(r) for r in out.collect()]
        assert found
        by_rest = {tuple(r[3:]) for r in rows}
        assert all(r[3:] in by_rest for r in found)
    assert sorted(r.doc_id for r in quality.kept_documents(docs).collect()) == sorted([*range(30), 7])
    kept = simhash.keep_one(docs).collect()  # of the two rows with id 7 the one first in the order of its other columns
    assert [r["_text"] for r in kept if r.doc_id == 7] == ["_text7"] and len([r for r in kept if r.doc_id in range(15)]) == 15


def test_one_very_long_word(spark):
    rng = np.random.default_rng(3)
    word = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 100_000))
    codec = bpe.Codec(bpe.read_ranks(RANK_FILE), public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    start = time.monotonic()
    [ids] = codec.encode([word])
    assert time.monotonic() - start < 30
    assert np.frombuffer(ids, dtype="<u4").tolist() == other.encode_ordinary(word)
    for text in ("a" * 9000, "aab" * 3000, "ab" * 5000 + "a", "日" * 2000, "é" * 999, "0" * 501, "=" * 5000 + "-" * 777):
        assert np.frombuffer(codec.encode([text])[0], dtype="<u4").tolist() == other.encode_ordinary(text)
    pieces = ["a", "b", "ab", "aa", "the", "e", "t", "日", "é", "x", "aaaa"]
    for _ in range(300):
        text = "".join(rng.choice(pieces[:rng.integers(2, len(pieces) + 1)], rng.integers(40, 120)))
        assert np.frombuffer(codec.encode([text])[0], dtype="<u4").tolist() == other.encode_ordinary(text)


def test_words_are_kept_within_bounds(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BYTES", 20_000)
    codec = bpe.Codec(bpe.read_ranks(RANK_FILE), public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = np.random.default_rng(5)
    for _ in range(60):
        text = " ".join("".join(rng.choice(list("etaoinsh"), 6)) for _ in range(80))
        assert np.frombuffer(codec.encode([text])[0], dtype="<u4").tolist() == other.encode_ordinary(text)
    assert len(codec.known) + len(codec.older) < 600


# Language model -----------------------------------------------------------------------------------------------------

def brute_lm(rows, order=2):
    """Counts in dictionaries, one token after the other."""
    is_held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    texts = [(i, is_held(i), words(lower(t)) + ["\n"]) for i, t in rows]
    c, pairs = Counter(), Counter()
    for _, held, tokens in texts:
        if not held:
            c.update(tokens)
            pairs.update(zip(["\n"] + tokens, tokens))
    n, v = sum(c.values()), len(c)
    uni = lambda w: (c[w] + 1) / (n + v + 1)
    after = defaultdict(list)
    for h, w in pairs:
        after[h].append(w)
    alpha = {h: max(1 - sum((pairs[h, w] - 0.5) / c[h] for w in ws), 1e-9) / max(1 - sum(map(uni, ws)), 1e-9)
             for h, ws in after.items()}
    for i, held, tokens in texts:
        total = 0.0
        for h, w in zip(["\n"] + tokens, tokens):
            total += log10((pairs[h, w] - 0.5) / c[h]) if (h, w) in pairs else log10(alpha.get(h, 1.0)) + log10(uni(w))
        yield i, held, len(tokens), sum(w in c for w in tokens), n, sum(log10(uni(w)) for w in tokens), total


def test_lm_scores(docs):
    got = sorted(map(tuple, lm.score(docs).collect()), key=str)
    want = sorted(brute_lm([(r.doc_id, r.text) for r in docs.collect()]), key=str)
    by = lambda rows: sorted((str(r[:5]), round(r[5], 6), round(r[6], 6)) for r in rows)
    assert by(got) == by(want)


def test_automaton_probabilities_sum_to_one_and_pruning_keeps_them(spark, monkeypatch):
    monkeypatch.setattr(lm, "MODEL_PARTS", 200)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = lm.word_counts(lm._texts(docs).filter("NOT held_out"))
    for order in (2, 3):
        model = lm.train(docs, counts, order)
        assert len(model.words) <= 200 and all(len(k) <= 200 for k in model.keys)
        root = (counts.count() - len(model.words)) and (
            10 ** model.root.sum() if False else float(np.sum(10 ** model.root)))
        assert root < 1
        state, word = np.divmod(model.keys[0], len(model.words))
        for s in np.unique(state)[:20]:
            own = state == s
            mass = np.sum(10 ** model.arcs[0][own]) + 10 ** model.failures[0][s] * (1 - np.sum(10 ** model.root[word[own]]))
            assert mass == pytest.approx(1.0)


@pytest.mark.parametrize("parts", [1, 200])
def test_lm_scores_keep_every_pair(spark, monkeypatch, parts):
    """The same scores whatever number of n-grams is sent to the tasks."""
    monkeypatch.setattr(lm, "MODEL_PARTS", parts)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == pytest.approx({i: total for i, *_, total in brute_lm(rows)})


@pytest.mark.parametrize("parts", [1, 50, 1 << 20])
def test_longer_contexts_back_off_step_by_step(spark, monkeypatch, parts):
    monkeypatch.setattr(lm, "MODEL_PARTS", parts)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(list("abcdefg"), 12))) for i in range(60)]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c, order = Counter(), 4
    for i, text in rows:
        w = ["\n", *text.split(), "\n"]
        if not held[i]:
            c.update((x,) for x in w[1:])
            c.update(tuple(w[k:k + n]) for n in range(2, order + 1) for k in range(len(w) - n + 1))
    vocabulary = [g[0] for g in c if len(g) == 1]
    tokens = sum(c[w,] for w in vocabulary)

    def p(h, w):
        if not h:
            return (c[w,] + 1) / (tokens + len(vocabulary) + 1)
        if not c[h]:
            return p(h[1:], w)
        if c[*h, w]:
            return (c[*h, w] - 0.5) / c[h]
        own = [v for v in vocabulary if c[*h, v]]
        return (1 - sum((c[*h, v] - 0.5) / c[h] for v in own)) / (1 - sum(p(h[1:], v) for v in own)) * p(h[1:], w)

    want = {}
    for i, text in rows:
        w = ["\n", *text.split(), "\n"]
        want[i] = sum(log10(p(tuple(w[max(0, k - order + 1):k]), w[k])) for k in range(1, len(w)))
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), order).collect()}
    assert got == pytest.approx(want)


def test_lm_scores_write_few_bytes_for_a_pair(spark, monkeypatch):
    """All word pairs of the documents are scored, but they don't stand in tables one by one."""
    monkeypatch.setattr(lm, "MODEL_PARTS", 200)
    written, write_once = [], lm.written_once
    monkeypatch.setattr(lm, "written_once", lambda df: written.append(write_once(df)) or written[-1])
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(map("w{}".format, rng.integers(0, 4000, 400)))) for i in range(300)]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == pytest.approx({i: total for i, *_, total in brute_lm(rows)})
    pairs = sum(len(set(zip(w, w[1:]))) for w in (["\n", *text.split(), "\n"] for _, text in rows))
    files = [f for df in written for f in pathlib.Path(df._scratch_path.removeprefix("file:")).rglob("*.parquet")]
    assert len(files) > 0
    assert sum(f.stat().st_size for f in files) < 8 * pairs


def test_context_helps_on_held_out_documents(spark, sf_dir):
    got = lm.score(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("held_out").agg(
        F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    assert got[0] > got[1]


# All together -------------------------------------------------------------------------------------------------------

def test_empty_tables(spark):
    none = documents(spark, empty=True)
    file = bpe.read_ranks(RANK_FILE)
    for df in (mixing.taken_by_document(none), bpe.encode(none, file, public_tokenizers.PATTERN), licenses.licenses(none),
               simhash.near_duplicates(none), quality.quality(none), lm.score(none)):
        assert df.count() == 0
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_pipeline_stages(spark, docs):
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = rows, stage(spark, rows, SMALL).cache()
        assert rows.columns == docs.columns
        old, new = Counter(map(tuple, before.collect())), Counter(map(tuple, rows.collect()))
        assert set(new) <= set(old) and new
        if name == "quality_rules":
            verdicts = Counter(r.kept for r in quality.quality(before).collect())
            assert sum(new.values()) == verdicts[True]
        elif name == "mix_sources":
            sizes = defaultdict(int)
            for r, n in old.items():
                sizes[r[docs.columns.index("source")]] += n * len(words(r[1]))
            want, longest = filled(sizes), max(len(words(r[1])) for r in old)
            got = defaultdict(int)
            for r, n in new.items():
                got[r[docs.columns.index("source")]] += n * len(words(r[1]))
                assert n <= 3 * old[r]
            assert all(0 <= got[s] - want[s] + 1 <= longest + 1 for s in want)
    last = corpus_pipeline.STAGES[-1][1](spark, rows, SMALL).collect()
    assert len(last) == rows.count() and all(r.round_trip for r in last)


def test_run_follows_the_stages(spark):
    got = corpus_pipeline.run(spark, SMALL)
    rows = got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("h")).collect()
    assert rows and all(r.n_tokens > 0 and len(r.h) == 64 for r in rows)
    again = corpus_pipeline.run(spark, SMALL).select("doc_id", "n_tokens", F.sha2("ids", 256)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_query_digests(spark):
    file = bpe.read_ranks(RANK_FILE)
    codec = bpe.Codec(file, public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op2_byte_bpe"](spark, SMALL).collect():
        [ids] = codec.encode([texts[r.doc_id]])
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
