"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from swapledger.llm import (
    block_topk, bpe_backtrack, fingerprint, language_id, ngram_join, packing, quality_fm, rans_store, secret_index, suffix_dedup,
)

LONG = "word another thing here and there again " * 30_000
ROWS = [
    (1, None, "en", "a", 5), (2, "", None, None, None), (3, "Hello there, my friends. " * 9, "en", "a", 200), (3, "Hello there, my friends. " * 9, "en", "a", 200),
    (None, "Hello there, my friends. " * 9, None, "b", 1), (5, LONG, "en", "a", len(LONG)), (6, "\n \t", "fr", "c", 3),
    (7, "password = abcdefABCDEF123456 é中文 \U0001f600 <|endoftext|>", "fr", "c", 40), (None, None, None, None, None), (8, "12 34 --", "de", "a", 8),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    """Columns that share names with what the operators work with."""
    names = ["block", "bucket", "kind", "message", "payload", "key", "score", "text_key", "low_id", "_h", "file", "section", "ids", "size", "label", "recorded", "part", "piece",
             "_score", "_hash", "_rank", "_id_key", "_secrets", "_SECRETS_", "_n_bytes", "_N_REMOVED", "_kept_sha256", "n_tokens", "ids_sha256", "secrets", "lang_pred",
             "Quality_Score", "_number", "_group", "_bin", "bits", "depth", "nodes"]
    return docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (3, 1, 0), (5, 1, 0), (7, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id long, quality int, toxic int")


def test_packing(docs, clashing, none):
    for df in (docs, clashing):
        out = packing.pack_documents(df).collect()
        assert sum(r.piece == 0 for r in out) == len(ROWS) and max(r.length for r in out) == 2048
        used = {}
        for r in sorted(out, key=lambda r: r.offset):
            assert r.offset == used.get(r.sequence_id, 0)
            used[r.sequence_id] = r.offset + r.length
        assert max(used.values()) <= 2048
    assert packing.pack_documents(none).collect() == []


def test_quality(spark, docs, clashing, none):
    model = quality_fm.train(clashing, labels(spark), F.lit(True))
    for df in (docs, clashing):
        out = quality_fm.with_quality(df, model)
        assert out.columns == [*[c for c in df.columns if c.lower() != "quality_score"], "quality_score"]
        assert all(0 <= r.quality_score <= 1 for r in out.collect())
    assert quality_fm.with_quality(none, model).collect() == []
    assert quality_fm.train(docs, labels(spark).limit(0), F.lit(True)) is None
    assert {r.quality_score for r in quality_fm.with_quality(docs, None).collect()} == {0.5}


def test_fingerprint(docs, clashing, none):
    for df in (docs, clashing):
        out = fingerprint.fingerprints(df).collect()
        assert len(out) == len(ROWS)
        assert len({r.fingerprint for r in out if r.n_chars == 225}) == 1
        assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in out)
    assert fingerprint.fingerprints(none).collect() == []


def test_token_ids(spark, docs, clashing, none):
    for df in (docs, clashing, none):
        folder = rans_store.new_folder(spark)
        rans_store.write_ids(df, folder)
        out = sorted(rans_store.read_ids(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
        assert len(out) == (0 if df is none else len(ROWS))
        at = 0
        for r in out:
            assert r.start == at and len(r.ids) == 4 * r.n_tokens
            at += r.n_tokens


def test_suffix(docs, clashing, none):
    for df in (docs, clashing):
        out = suffix_dedup.remove_repeats(df)
        added = ["_n_bytes", "_n_removed", "_n_spans", "_kept_sha256"]
        assert out.count() == len(ROWS) and out.columns == [*[c for c in df.columns if c.lower() not in added], *added]
    assert suffix_dedup.remove_repeats(none).collect() == []


def test_bpe(docs, clashing, none):
    for df in (docs, clashing):
        out = bpe_backtrack.with_bpe(df, keep=True) if df is docs else bpe_backtrack.with_bpe(df)
        rows = out.collect()
        assert len(rows) == len(ROWS)
        if df is docs:
            assert all(r.decoded == (r.text or "") for r in rows)
    assert bpe_backtrack.with_bpe(none).collect() == []


def test_join(docs, clashing, none):
    for df in (docs, clashing):
        assert ngram_join.near_links(df).count() == len(ROWS)
        kept = ngram_join.one_of_each(df)
        assert kept.columns == df.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "6", "7", "8", "None"]
    assert ngram_join.one_of_each(none).collect() == []


def test_language(docs, clashing, none):
    model = language_id.learn(docs, F.lit(True))
    for df in (docs, clashing):
        out = {r.doc_id: r for r in language_id.with_language(df, model).collect() if r.doc_id}
        assert out[1].lang_pred == out[6].lang_pred == out[8].lang_pred == "und" and out[3].lang_pred == "en"
    assert language_id.with_language(none, language_id.learn(none, F.lit(True))).collect() == []
    assert language_id.with_language(docs, language_id.learn(none, F.lit(True))).first().lang_pred == "und"


def test_secrets(docs, clashing, none):
    for df in (docs, clashing):
        found = {r.doc_id: r.secrets for r in secret_index.find_secrets(df).collect() if r.doc_id}
        assert [(s.kind, s.start, s.end) for s in found[7]] == [("assign", 0, 29)] and found[1] == []
        masked = {r.doc_id: r.text for r in secret_index.mask_secrets(df).collect() if r.doc_id}
        assert masked[7].startswith("password = <assign> é") and masked[1] is None
    assert secret_index.find_secrets(none).collect() == []


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (50, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [-1.0, 0.5]),
            (7, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (8, []), (100, [1e15, 1.0])]
    df = spark.createDataFrame([(e, i, 0, 0) for i, e in rows], "embedding array<float>, vec_id long, part int, dim int")
    out = block_topk.top_k(df, F.col("vec_id") % 50 == 0).collect()
    got = {q: [r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50)}
    assert got == {0: [100, 5, 50, 6], 50: [100, 0, 5, 6]}
    assert block_topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_pipeline(spark, docs, clashing, none, tmp_path):
    clashing.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).columns[:2] == ["doc_id", "piece"]
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, none, str(tmp_path)).columns == list(cp.COLUMNS)
        assert stage(spark, clashing, str(tmp_path)).columns == list(cp.COLUMNS)
