"""Rows of the whole pipeline against a plain version, stage by stage, on planted documents."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from swapledger.llm.word_tokens import vocabulary_path
from tests.llm.test_ngram_join import brute as near

RND = random.Random(3)
HIDDEN = "AKIA" + "Q7" * 10
BODY = "".join(RND.choices("ABCDEFGHIJKLMNOPqrstuvwxyz0123456789+/", k=64))
PEM = f"-----BEGIN PRIVATE KEY-----\n{BODY}\n{BODY[::-1]}\n-----END PRIVATE KEY-----"


def prose(n):
    return " ".join("".join(RND.choices("klmnopqrstuvwxyz", k=6)) for _ in range(n))


def planted():
    """(doc_id, text, score); the small ids hold what later ones repeat."""
    base, passage, twin = prose(60), prose(20), prose(50)
    near_copy = " ".join([*base.split()[:-1], "changed"])
    return [
        (1, base, 0.9), (2, near_copy, 0.9), (3, base.upper(), 0.7),
        (4, twin, 0.49), (5, twin, 0.5), (6, f"{twin} changed", 0.8),
        (7, prose(30) + " " + passage, 0.6), (8, prose(5) + " " + passage + " " + prose(5), 0.6), (9, passage, 0.6),
        (10, prose(10) + f" {HIDDEN} " + prose(3), 0.6), (11, prose(10) + f"\n{PEM}\n" + prose(4), 1.0),
        (12, prose(8) + " " + passage + ' password = "abcdefGHIJKL123456" ' + prose(2), 0.6),
        (13, "", 0.5), (14, None, 0.5), (15, prose(3000), 0.5), (16, prose(40), 0.1),
    ]


def without_repeats(rows):
    low = {}
    for i, text in rows:
        b = (text or "").encode()
        for p in range(len(b) - 49):
            low[b[p : p + 50]] = min(low.get(b[p : p + 50], i), i)
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 49):
            if low[b[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        kept = bytes(x for x, g in zip(b, gone) if not g).decode()
        if not any(gone) or kept.strip(" "):
            out.append((i, kept))  # null text is empty from here on
    return out


def hidden(text):
    text = re.sub(r"-----BEGIN PRIVATE KEY-----.*?-----END PRIVATE KEY-----", "<private_key>", text, flags=re.S)
    return re.sub(r'(password = ")[A-Za-z0-9]+', r"\1<assign>", text.replace(HIDDEN, "<access>"))


def test_rows_of_run(spark, monkeypatch, tmp_path):
    rows = planted()
    scores = {i: s for i, _, s in rows}
    monkeypatch.setattr(cp.quality_fm, "train", lambda *a: None)
    monkeypatch.setattr(cp.quality_fm, "with_quality", lambda docs, model, output: docs.withColumn(
        output, F.element_at(F.create_map(*[F.lit(x) for kv in scores.items() for x in kv]), F.col("doc_id").cast("int"))))
    stages = {}
    keep = cp.written
    monkeypatch.setattr(cp, "written", lambda df, name: stages.setdefault(name, keep(df, name)))
    spark.createDataFrame([(i, t, "en", "a", 1) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = cp.run(spark, str(tmp_path)).collect()

    want = [(i, t) for i, t, s in rows if s >= 0.5]
    assert {i for i, _ in want} == set(range(1, 16)) - {4}
    named = lambda k: sorted((r.doc_id, r.text) for r in stages[f"stage-{k}"].collect())
    assert named(0) == want
    first = {c for _, c, _ in near(want)}
    want = [(i, t) for i, t in want if i in first or not (t or "").split()]
    assert {2, 3, 6}.isdisjoint(i for i, _ in want) and named(1) == want
    want = without_repeats(want)
    assert 9 not in {i for i, _ in want} and named(2) == want
    want = [(i, hidden(t)) for i, t in want]
    assert named(3) == want and BODY not in "".join(t for _, t in want)
    assert all(r.n_chars == len(r.text) for r in stages["stage-3"].collect())
    encoder, pieces = Tokenizer.from_file(vocabulary_path()), []
    for i, t in want:
        ids = [*encoder.encode(t, add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            pieces.append((i, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == pieces
    filled = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048
