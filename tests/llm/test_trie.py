"""The prefix trie against a dictionary of all prefixes, with shards and skeletons of several sizes."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from sharedrift.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, words int, node long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[:d - 1]].add(path[:d])
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[k] for k in children[path]) or 1
        saved[path] = sum(saved[k] for k in children[path]) + (len(members[path]) - 1) * words
    return sorted((
        min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p],
        hashlib.sha256(",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items())


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2) for r in rows], SCHEMA)


def got(spark, rows, **options):
    out = trie.prefix_trie(table(spark, rows), **options)
    assert out.columns == COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in out.collect())


def awkward():
    rng, rows = random.Random(5), []
    for c in [*range(-30, 200), None]:
        for t in range(rng.randint(1, 6)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]),
                         rng.choice(["a", "b b", "", None, "same text \t here", "é" * 3000])))
    rows += [(1000 + k, t, "user", f"x{t}") for k in range(200) for t in range(5)]  # many copies
    rows += [(3001, t, "user", str(t % 3)) for t in range(700)] + [(3001, 5, "user", "2")]  # a long one, a repeated row
    return rows


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 900}, {"shard_bytes": 2000, "skeleton_bytes": 3000}])
def test_trie(spark, monkeypatch, options):
    monkeypatch.setattr(trie, "ENDS_BYTES", 60)
    rows = awkward()
    assert got(spark, rows, **options) == brute(rows)


def test_small_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []
    lonely = next(c for c in range(1, 200) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(lonely, 1, "user", "a b")]  # loses its turn and has no first conversation: a member of the root alone
    assert got(spark, rows) == brute(rows) and len(brute(rows)) == 1


def test_splitters_stay_within_their_bound(spark):
    paths = trie.rebuilt(table(spark, awkward()))
    for bound in (400, 4000, 100_000):
        splits = trie.splitters(paths, 300, bound)
        assert sum(len(path) for path, _ in splits) <= bound
    assert splits == sorted(splits) and len(splits) > 5
    steps, parents = trie.skeleton(splits)
    assert len(parents) == len(steps) + 1 and all(p < n for n, p in enumerate(parents))
