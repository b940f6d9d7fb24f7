import random
from itertools import combinations

import pyarrow as pa
import pytest

from swapledger.llm import ngram_join as nj
from swapledger.llm.components import components


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        u = len(sets[a] | sets[b])
        if u and len(sets[a] & sets[b]) / u >= 0.8:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), 2**63 - 1), 2**63 - 1 if d is None else d)
    return sorted((str(d), low[find(i)] if low[find(i)] < 2**63 - 1 else None, links[i]) for i, (d, _) in enumerate(rows))


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghé") for _ in range(4))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rnd.randint(40, 150))]
        for _ in range(rnd.randint(1, 9)):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 3
    base = [word() for _ in range(120)]
    for _ in range(60):
        w = list(base)
        w[rnd.randrange(len(w))] = word()
        rows.append((n, "\n".join(w)))
        n += 1
    rows += [(n, rows[0][1].upper()), (n + 1, ""), (n + 2, None), (n + 3, " \n "), (n + 4, "a b c"), (n + 5, "A  b c"),
             (n + 6, "a b c d"), (None, rows[4][1]), (n + 7, "x y " * 5000), (n + 7, "x y " * 5000)]
    return rows


@pytest.mark.parametrize("cell", [2048, 16])
def test_equals_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(nj, "CELL", cell)
    rows = corpus()
    df = spark.createDataFrame([(t, i, 1) for i, t in rows], "text string, doc_id long, size int")
    got = [(str(r.doc_id), r.class_id, r.n_links) for r in nj.near_links(df).collect()]
    want = brute(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = nj.one_of_each(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted({w[1] for w in want})


def test_null_and_equal_ids_meet_their_own_text_only(spark, monkeypatch):
    verify = nj._verify

    def strict(threshold):
        inner = verify(threshold)

        def once(frame):
            assert frame["text_key"].is_unique, "a cell got rows of other texts, or one text twice"
            return inner(frame)

        return once

    monkeypatch.setattr(nj, "_verify", strict)
    rows = corpus()
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else i, t) for k, (i, t) in enumerate(rows)]
    rows += [(None, rows[0][1])] * 20
    got = [(str(r.doc_id), r.class_id, r.n_links) for r in nj.near_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    last = 2**62  # null counts as the largest id
    want = brute([(last if i is None else i, t) for i, t in rows])
    want = [("None" if d == str(last) else d, None if c == last else c, n) for d, c, n in want]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nj.near_links(df).collect() == []
    assert nj.one_of_each(df).collect() == []


def test_prefix_depth_reaches_recall():
    d = nj.prefix_depth()
    assert 1 - (1 - 0.8**d) ** nj.TREES >= nj.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** nj.TREES


def test_pairs_at_the_threshold_meet():
    assert 1 - (1 - 0.8 ** nj.prefix_depth()) ** nj.TREES >= 0.9999
    rnd, pairs = random.Random(11), 12_000
    texts = []
    for _ in range(pairs):
        w = [f"w{rnd.getrandbits(48):x}" for _ in range(14)]
        texts += [" ".join(w[:13]), " ".join([*w[:12], w[13]])]  # 8 of 10 shingles are common
    a, b = shingles(texts[0]), shingles(texts[1])
    assert len(a & b) / len(a | b) == 0.8
    n = len(texts)
    batch = pa.RecordBatch.from_pydict({"doc_id": range(n), "text": texts, "text_hash": range(n)})
    nodes = [x for out in nj._signatures("text", nj.THRESHOLD)(iter([batch])) for x in out.column("nodes").to_pylist()]
    lost = sum(not set(x) & set(y) for x, y in zip(nodes[::2], nodes[1::2]))
    assert lost <= 1


def test_texts_stop_at_different_depths():
    for n in range(1, 40):
        # The least similarity, by trying all sizes of a partner and of what is common.
        reach = [c / (n + m - c) for m in range(1, 3 * n) for c in range(0, min(n, m) + 1) if not c == n == m]
        low = min([x for x in reach if x >= 0.8 - 1e-12], default=1.0)
        assert nj.least_similarity(n) == pytest.approx(low)
        d = nj.stop_depth(n)
        assert d == nj.DEPTH or 1 - (1 - low ** (d + 1)) ** nj.TREES < nj.RECALL
        assert 1 - (1 - low**d) ** nj.TREES >= nj.RECALL
    assert {nj.stop_depth(n) for n in (3, 6, 9)} == {6, 7, 8}


def test_short_texts_meet_at_their_own_depth(spark):
    """Sets of 6 and 7 shingles at 6/7, the least there is, and sets of 5 at 0.8 of 4; few other pairs are made."""
    rnd, texts = random.Random(4), []
    for _ in range(1500):
        w = [f"w{rnd.getrandbits(40):x}" for _ in range(11)]
        texts += [" ".join(w[:10]), " ".join(w[:11])]
    n = len(texts)
    batch = pa.RecordBatch.from_pydict({"doc_id": range(n), "text": texts, "text_hash": range(n)})
    out = next(iter(nj._signatures("text", nj.THRESHOLD)(iter([batch]))))
    assert set(out.column("size").to_pylist()) == {6, 7} and set(out.column("depth").to_pylist()) == {7, 8}
    assert {len(x) for x in out.column("nodes").to_pylist()} == {2 * nj.TREES, 3 * nj.TREES}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nj.near_links(df).collect()}
    assert all(got[i] == i - i % 2 for i in range(n))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}
