"""Covering SimHash against a plain version."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from swapledger.llm import covering_simhash as cs
from swapledger.llm import queries as Q

SF = "/root/testdata/sf0.001"


def plain_bits(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)) if h else 0


def plain_classes(bits):
    """Class of each entry over all pairs."""
    of = list(range(len(bits)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, j in itertools.combinations(range(len(bits)), 2):
        if (bits[i] ^ bits[j]).bit_count() <= 4:
            a, b = top(i), top(j)
            of[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(bits))]


def test_every_set_of_four_bits_is_left_out_by_a_mask():
    masks = np.array(cs.covering_masks(), np.uint64)
    assert len(masks) == 31
    one = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    pair = (one[:, None] | one[None, :]).ravel()
    for a in range(64):
        for b in range(a, 64):
            hit = np.zeros(len(pair), bool)
            for m in masks[(masks & (one[a] | one[b])) == 0]:
                hit |= (pair & m) == 0
            assert hit.all()


def test_query_matches_plain_version(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    bits = [plain_bits(r.text) for r in docs]
    want = {(r.doc_id, f"{b:016x}", docs[c].doc_id) for r, b, c in zip(docs, bits, plain_classes(bits))}
    assert {tuple(r) for r in Q.op11_covering_simhash(spark, SF).collect()} == want


@pytest.mark.parametrize("cell", [4, 1024])
def test_links_of_chains_and_hot_buckets(spark, cell):
    rng = random.Random(5)
    bits = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            bits.add(x)
            for i in rng.sample(range(64), rng.choice([1, 4, 5, 6])):
                x ^= 1 << i
    bits = sorted(bits)
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    nodes = spark.createDataFrame([(s,) for s in signed], "bits long").repartition(5)
    got = cs.components(cs.links_within(nodes, cell=cell))
    found = {r.node: r.root for r in got.collect()}
    want = plain_classes(bits)
    groups = {}
    for s, w in zip(signed, want):
        groups.setdefault(w, []).append(s)
    for members in groups.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_edges(spark):
    long = "a b c d e f g h " * 40_000
    rows = [(5, "One two Three four five"), (4, "one  two\tthree FOUR five"), (None, "one two three four five"), (1, None), (2, ""), (3, " \n"),
            (9, "É é"), (9, "É é"), (10, "é é"), (11, long), (12, long), (None, "solo"), (13, "x y")]
    df = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in rows], "doc_id long, text string, bits long, bucket int, class_id int").repartition(3)
    got = cs.near_classes(df).collect()
    assert len(got) == len(rows)
    text = {r.doc_id: r for r in got if r.doc_id}
    assert {text[i].class_id for i in (4, 5)} == {4} and {text[i].class_id for i in (1, 2, 3)} == {1} and text[1].bits == 0
    assert sorted((r.class_id is None, r.bits) for r in got if r.doc_id is None) == sorted(
        [(False, text[4].bits), (True, [r.bits for r in got if r.doc_id is None and r.bits != text[4].bits][0])])
    assert text[11].class_id == text[12].class_id == 11 and text[9].bits != text[10].bits
    for i, t in rows:
        if i:
            assert text[i].bits & (2**64 - 1) == plain_bits(t)
    assert cs.near_classes(df.limit(0)).collect() == []
    named = df.select(F.col("doc_id").alias("a"), F.col("text").alias("bits"), F.lit(1).alias("doc_id"))
    assert cs.near_classes(named, "a", "bits").count() == len(rows)


def test_exploded_nodes_are_not_broadcast(spark):
    # Spark sizes the rows of all tables like the nodes they come from, so it takes them for small.
    nodes = spark.range(200).select((F.col("id") * 7919).alias("bits"))
    text = cs.links_within(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "Broadcast" not in text
