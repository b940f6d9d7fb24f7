"""Unequal texts that a sum of powers modulo 2^64 cannot tell apart keep their own results."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from swapledger.llm import bpe_backtrack, ngram_join, packing, rans_store
from swapledger.llm.piece_memo import PieceMemo, span_hashes
from swapledger.llm.word_tokens import vocabulary_path

ONE = "".join("ab"[i.bit_count() % 2] for i in range(1024))
TWO = ONE.translate(str.maketrans("ab", "ba"))
TEXTS = [ONE, TWO, f"{ONE} x {TWO}", "plain words", TWO]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)


def test_the_texts_collide():
    data = np.frombuffer((ONE + TWO).encode(), np.uint8)
    a, b = span_hashes(data, np.array([0, 1024]), np.array([1024, 2048]))
    assert a == b and ONE != TWO


def test_memo_compares_bytes():
    calls = []

    def learn(pieces):
        calls.append(pieces)
        return [np.frombuffer(p, np.uint8).astype(np.uint32)[:5] for p in pieces]

    memo = PieceMemo(learn)
    for text in (ONE + TWO + "xyz", TWO + ONE + "xyz", TWO + TWO + "xyz", "".join(chr(97 + i % 26) for i in range(2048)) + "xyz"):
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends = np.array([0, 1024, 2048, 2051]), np.array([1024, 2048, 2051, 2051])
        ids, counts = memo.encode(data, starts, ends)
        want = [data[a:b][:5] for a, b in zip(starts, ends)]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == np.concatenate(want).tolist()


def test_bpe(docs):
    t = Tokenizer.from_file(bpe_backtrack.vocabulary_path(bpe_backtrack.VOCABULARY))
    for r in bpe_backtrack.with_bpe(docs, keep=True).collect():
        assert r.ids == t.encode(r.text, add_special_tokens=False).ids and r.decoded == r.text
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_token_ids_and_packing(spark, docs):
    t = Tokenizer.from_file(vocabulary_path())
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in enumerate(TEXTS)}
    folder = rans_store.new_folder(spark)
    rans_store.write_ids(docs, folder)
    for r in rans_store.read_ids(spark, folder, with_ids=True).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == [*want[r.doc_id], 1]
    for r in packing.pack_documents(docs).collect():
        assert r.ids_crc32 == zlib.crc32(np.array([*want[r.doc_id], 0], "<u4").tobytes())


def test_join(docs):
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_links(docs).collect()}
    assert got == {0: (0, 0), 1: (1, 1), 2: (2, 0), 3: (3, 0), 4: (1, 1)}
