"""SentencePiece ids against the sentencepiece library, text by text, and the round trip."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from sharedrift.llm import pieces
from sharedrift.llm.queries import PIECE_MODEL, op11_sentencepiece
from tests.llm.fixtures import documents

ALPHABET = [
    "a", "b", "e", "t", " ", "  ", "▁", "\n", "é", "ß", "日", "本", "😀", "　", "0", "1", "9", ".", ",", "<", "/s>", "<s>", "th",
    "ing", "́", "\x00", "ﬁ", "<0x41>", "<unk>"]


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(PIECE_MODEL)


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def own(coder, text):
    return np.frombuffer(coder.encode([text])[0], dtype="<i4").tolist()


def test_random_texts(model, library):
    coder, rng = pieces.Pieces(model), random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choices(ALPHABET, k=rng.randint(0, 25)))
        assert own(coder, text) == library.encode(text), repr(text)


@pytest.mark.parametrize("text", [
    "".join(random.Random(2).choices("abcdefghij", k=100_000)), " " * 50_001, "ab" * 60_000, "日" * 30_000, "\n" * 10_000])
def test_long_words(model, library, text):
    assert own(pieces.Pieces(model), text) == library.encode(text)


def test_without_cuts_and_with_small_generations(model, library, monkeypatch):
    """Texts solved as one agenda, and parts dropped all the time, give the same ids."""
    monkeypatch.setattr(pieces, "KEPT_BYTES", 500)
    coder, rng = pieces.Pieces(model), random.Random(3)
    texts = [" ".join("".join(rng.choices("etaoin shrdlu", k=9)) for _ in range(40)) for _ in range(30)]
    for text in texts:
        whole = np.frombuffer(coder.solve(library.normalize(text)), dtype="<i4").tolist()
        assert own(coder, text) == whole == library.encode(text)
    assert len(coder.known) + len(coder.older) < 200


def test_rows_and_heap_give_the_same(model):
    coder, rng = pieces.Pieces(model), random.Random(4)
    parts = ["".join(rng.choices("▁etaoinshrdlu日0", k=rng.randint(2, pieces.SHORT))) for _ in range(3000)]
    assert coder.merge_rows(parts) == [coder.solve(p) for p in parts]


def test_table(spark, model, library):
    docs = documents(spark)
    coded = pieces.encode(docs, model)
    assert coded.columns == [c for c in docs.columns if c != "ids"] + ["ids", "agrees"]
    rows = pieces.decode(coded, model).collect()
    at_once = pieces.encode(docs, model, decoded="decoded")
    assert sorted(map(str, rows)) == sorted(map(str, at_once.collect()))
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode(r.text or "")
        assert r.agrees and r.ids == ids and r.decoded == library.decode(ids) and r.words == "y"
    assert pieces.decode(pieces.encode(documents(spark, empty=True), model), model).count() == 0


def test_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op11_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agrees) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids).encode()).hexdigest(), True)
