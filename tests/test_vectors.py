"""Vector tables and approximate retrieval."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swapledger.operators import vectors as V


def unit(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_pinned_model(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(unit(20, 8))], "vec_id int, embedding array<float>")
    V.build_vector_table(df, str(tmp_path / "v"), "m", 8)
    assert V.open_vector_table(spark, str(tmp_path / "v"), "m", 8).count() == 20
    with pytest.raises(ValueError):
        V.open_vector_table(spark, str(tmp_path / "v"), "other", 8)
    with pytest.raises(Exception):
        V.build_vector_table(df, str(tmp_path / "w"), "m", 9)


def test_hash_index_meets_its_recall(spark, tmp_path):
    x = unit(600, 16, seed=3)
    x[:300] = x[:300] * 0.3 + unit(6, 16, seed=9)[np.arange(300) % 6]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id int, embedding array<float>").repartition(4)
    index = V.HashIndex(16, bits=5)
    visits, recall = index.build(df, str(tmp_path / "i"), k=5)
    assert 1 <= visits <= 32 and recall >= 0.95
    queries = df.where("vec_id % 3 = 0").selectExpr("vec_id as query_id", "embedding as vec")
    got = {}
    for r in index.search(str(tmp_path / "i"), queries, 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = x.astype(np.float64)
    exact = {q: set(np.lexsort((np.arange(600), -np.round(x @ x[q], 12)))[:5].tolist()) for q in got}
    assert len(got) == 200 and np.mean([len(got[q] & exact[q]) / 5 for q in got]) >= 0.9
    # The signature in expressions is the signature by hand.
    planes = np.array(index.planes)
    want = [int(((planes @ v > 0) * (1 << np.arange(5))).sum()) for v in x[:50]]
    assert [r[0] for r in df.where("vec_id < 50").orderBy("vec_id").select(index.bucket(df.embedding)).collect()] == want


def test_queries_in_rows_match_queries_in_an_array(spark):
    x = unit(60, 8)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id int, embedding array<float>")
    queries = df.where("vec_id < 7").selectExpr("vec_id as query_id", "embedding as vec")
    listed = V.cosine_top_k_many(df, queries.selectExpr("collect_list(struct(query_id, vec))").scalar(), 4)
    rows = V.cosine_top_k_joined(df, queries, 4)
    pick = lambda d: sorted((r.query_id, r.rank, r.vec_id) for r in d.collect())
    assert pick(rows) == pick(listed) and len(pick(rows)) == 28


def test_hashed_terms(spark):
    import hashlib

    enc = V.HashedTerms(64)
    texts = ["a b a  c\n", "", None, " é é word " * 5]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    for r in got.select("t", enc.column(got.t).alias("v")).collect():
        want = np.zeros(64)
        for w in (r.t or "").split():
            want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
        assert np.allclose(r.v, want / (np.linalg.norm(want) or 1), atol=1e-6)
    assert np.allclose(np.linalg.norm(V.LetterProfile(8).encode(["abc", "zz", ""]), axis=1), [1, 1, 0])


def test_blocks_give_the_scores_of_the_plain_form(spark):
    """Ties, repeated ids, gaps, zeros, other lengths and missing vectors, over several blocks and packs."""
    x = [[float(np.float32(a)) for a in v] for v in unit(40, 4, seed=5)]
    rows = [(i % 35, x[i % 30]) for i in range(70)] + [(90, None), (91, [0.0] * 4), (92, [1.0, None, 0.0, 0.0]), (93, [1.0, 2.0]), (94, [float("nan")] * 4)]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(i, x[i]) for i in range(5)] + [(7, None), (8, [0.0] * 4), (9, [3.0, 1.0])], "query_id int, vec array<float>")
    for k in (3, 73):
        many = queries.agg(F.collect_list(F.struct("query_id", "vec"))).scalar()
        form = lambda df: sorted((r.query_id, r["rank"], r.vec_id, repr(r.score)) for r in df.collect())
        assert form(V.cosine_top_k_joined(table, queries, k)) == form(V.cosine_top_k_many(table, many, k))
    plan = V.cosine_top_k_joined(table, queries, 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan


def test_hashed_terms_are_made_once(spark):
    from swapledger.plans import all_queries

    df = all_queries()["txt_04_embedded_texts"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "replace(" not in plan
