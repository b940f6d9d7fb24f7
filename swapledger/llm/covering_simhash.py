"""SimHash near copies by covering locality-sensitive hashing.

A text's fingerprint has 64 bits: bit i is 1 if it is set in over half of the XXH64 values
(UTF-8, seed 42) of its four-word shingles, repeats included.  Two fingerprints link if
they differ in at most ``RADIUS`` bits.

The tables are masks of a covering code.  Every bit i gets a nonzero vector m(i) of
``RADIUS`` + 1 bits, and the table of a nonzero vector v keeps the bits with an odd number
of common ones in m(i) and v.  Up to ``RADIUS`` differing bits span at most ``RADIUS``
dimensions, so some nonzero v is orthogonal to all of them, and its table keeps none of these bits:
the pair meets there for certain.  For a radius of 4 there are 31 tables of 32 kept bits or so.

Equal fingerprints are one node.  Nodes that meet in a table are compared exactly in cells of
about 2 x ``CELL`` nodes: a bucket beyond ``CELL`` nodes is dealt into parts and every two
parts are a cell, so a hot bucket is shared out and no pair is left out.  A cell emits one edge
per linked node (to the smallest node it reaches in the cell), never the pairs; components of
these edges give the classes.

Defined results: null text is empty; texts without words have fingerprint zero, which links
like any other; rows with equal texts share a class; null ids count as the largest id, and a
class of null ids only has a null class; texts of any length are hashed whole; an empty table
gives an empty result.  Only the two named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from swapledger.llm.common import runs_of, slices, written
from swapledger.llm.components import components

WORDS, SEED, BITS = 4, 42, 64
RADIUS = 4
#: Fingerprints of a bucket that one task compares with each other.
CELL = 1024
#: Shingles that are hashed before their bits are counted.
_CHUNK = 1 << 16


def shingle_bits(text: bytes | None) -> int:
    """Fingerprint of one text (UTF-8) as an unsigned number."""
    # bytes.lower changes A-Z only, and bytes.split cuts at ASCII white space only.
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: max(1, len(words) - WORDS + 1)].tolist(), ends[min(WORDS, len(words)) - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(starts), _CHUNK):
        cut = zip(starts[a : a + _CHUNK], ends[a : a + _CHUNK])
        h = np.array([xxh64_intdigest(line[x:y], SEED) for x, y in cut], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 4_000_000):
        bits = np.array([shingle_bits(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "bits": pa.array(bits.view(np.int64))})


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Masks such that any ``radius`` bits or fewer are all left out by one of them.

    The vectors m(i) run through all nonzero vectors in turn, so every table keeps about
    half of the bits.
    """
    top = 1 << (radius + 1)
    code = [1 + i % (top - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(code) if (m & v).bit_count() % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_roots(bits: np.ndarray, radius: int) -> np.ndarray:
    """For each of some fingerprints the first one it reaches over links among them."""
    n = len(bits)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    root, seen = np.arange(n), np.zeros(n, bool)
    for i in range(n):
        if seen[i]:
            continue
        seen[i] = True
        front = near[i] & ~seen
        while front.any():
            seen |= front
            root[front] = i
            front = near[front].any(axis=0) & ~seen
    return root


def _verify(radius: int):
    """Edges (node, first node it reaches) of each cell; cells come as runs of sorted rows."""

    def edges(cell: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        begins = runs_of(cell)
        for x, y in zip(begins.tolist(), [*begins[1:].tolist(), len(cell)]):
            if y - x > 1:
                own = bits[x:y].view(np.uint64)
                root = linked_roots(own, radius)
                hit = np.flatnonzero(root != np.arange(y - x))
                a.append(own[hit].view(np.int64))
                b.append(own[root[hit]].view(np.int64))
        return pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = bits = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.concatenate([cell, batch.column("cell").to_numpy(zero_copy_only=False)])
            bits = np.concatenate([bits, batch.column("bits").to_numpy(zero_copy_only=False)])
            # The last cell of a batch may go on in the next one.
            cut = int(np.searchsorted(cell, cell[-1]))
            yield edges(cell[:cut], bits[:cut])
            cell, bits = cell[cut:], bits[cut:]
        yield edges(cell, bits)

    return run


def links_within(nodes: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(a, b) edges that connect whatever ``bits`` lie within ``radius``, at most one per node and cell."""
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(covering_masks(radius))])
    members = nodes.select("bits", F.explode(masks).alias("x")).select(
        "bits", F.xxhash64("x.t", F.col("bits").bitwiseAND(F.col("x.m"))).alias("bucket"))
    size = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select(
        "bucket", F.ceil(F.col("n") / cell).cast("int").alias("parts"))
    # Buckets are unique on the right, so the rows of a hot one may be split on the left.  Spark sizes both
    # sides like the nodes before they were exploded, so without the hint it would broadcast one of them.
    placed = members.join(size.hint("merge"), "bucket").select("bits", "bucket", "parts", F.pmod(F.xxhash64("bits"), "parts").cast("int").alias("part"))
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(
        F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("part")))
    cells = placed.select("bits", "bucket", "part", F.explode(others).alias("other")).select(
        "bits", F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("cell"))
    return cells.repartition("cell").sortWithinPartitions("cell", "bits").mapInArrow(_verify(radius), "a long, b long")


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """doc_id, bits (fingerprint as a signed long), class_id (smallest id it reaches), one row per row."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(given.mapInArrow(_sign, "doc_id long, bits long"), "simhash")
    nodes = written(signed.groupBy("bits").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    class_of = components(written(links_within(nodes, radius, cell).distinct(), "simhash-links"))
    named = nodes.join(class_of, nodes["bits"] == class_of["node"], "left").select(
        "bits", "low", F.coalesce("root", "bits").alias("root"))
    low = named.groupBy("root").agg(F.min("low").alias("class_id"))
    known = written(named.join(low, "root").select("bits", "class_id"), "simhash-classes")
    # One row per fingerprint on the right, so a fingerprint that many rows share may be split on the left.
    return signed.join(known, "bits").select("doc_id", "bits", "class_id")
