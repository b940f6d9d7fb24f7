"""Near-duplicate join on five-word shingles: MinHash LSH forest, then exact verification.

Each text has ``TREES`` labels of up to ``DEPTH`` minima, and a tree's labels form a trie whose
nodes are their prefixes.  Matching starts at the deepest prefixes and shortens them text by
text: a text stops at the first depth d at which a partner of the least similarity it can have
is met in some tree with the target probability, 1 - (1 - s^d)^trees >= ``RECALL``.  That least
similarity follows from the number of its shingles (``least_similarity``): a set of six, say,
has no partner between 0.8 and 6/7, and one of three has none but itself.  So short texts stop
at depth 8 or 7, long ones at 6, and a pair meets at the shallower of its two depths, where
both have met their target.  A pair at exactly 0.8 that no third text connects is met with
probability 0.999994, at 0.85 with more than 0.9999999.  Texts descend no further than they
match, so labels are made only to the depth where a text stops.

Texts with equal shingle sets are one text from the start.  Members of a trie node are
linked to the smallest of the texts that stop there (a star, never all pairs); a node at which
no text stops links nothing.  The components of these stars are the candidate clusters.  All links inside a cluster are then computed exactly
from whole shingle sets, as incidence products in tasks that emit counts and roots only.
A cluster larger than ``CELL`` is split into blocks, and every pair of blocks is a cell
of its own, so a hot group is shared out and no link is dropped.

Defined results: null text is empty; texts without words link to nothing and are classes
of their own; texts of any length count whole; rows with equal shingle sets share a class;
ties go to the smallest id; null ids count as the largest id (and show as null); an empty
table gives an empty result; other columns may have any name, and ``one_of_each`` returns
them as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swapledger.llm.common import U64, fresh, mixed, slices, written
from swapledger.llm.components import components
from swapledger.llm.shingles import set_hash, shingle_sets

THRESHOLD = 0.8
TREES, DEPTH = 40, 8
RECALL = 0.99999
#: Texts of a cluster that one task compares with each other.
CELL = 1024
_NO_ID = np.iinfo(np.int64).max
_FACTORS = (mixed(np.arange(1, TREES * DEPTH + 1, dtype=U64)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_ADDED = mixed(np.arange(1001, 1001 + TREES * DEPTH, dtype=U64)).astype(np.uint32)


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEPTH, recall: float = RECALL) -> int:
    """Longest shared prefix that still meets the target recall for a pair at the threshold."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


@lru_cache
def least_similarity(size: int, threshold: float = THRESHOLD) -> float:
    """Smallest Jaccard at or over the threshold that a set of ``size`` can have with another set; 1 if there is none."""
    if size > 1000:
        return threshold
    low = 1.0
    for other in range(1, int(size / threshold) + 2):
        common = math.ceil(threshold * (size + other) / (1 + threshold) - 1e-9)
        if common <= min(size, other) and not common == size == other:
            low = min(low, common / (size + other - common))
    return max(low, threshold)


@lru_cache
def stop_depth(size: int, threshold: float = THRESHOLD) -> int:
    """Depth to which the prefix of a text of ``size`` shingles is shortened."""
    return prefix_depth(least_similarity(size, threshold))


def minima(shingles: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Smallest value of the set under each of the hash functions numbered ``used``."""
    x = (shingles ^ (shingles >> U64(29))).astype(np.uint32)
    low = np.full(len(used), 0xFFFFFFFF, np.uint32)
    factor, add = _FACTORS[used], _ADDED[used]
    for a in range(0, len(x), 128):
        v = x[a : a + 128, None] * factor + add
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(low, v.min(axis=0), out=low)
    return low


def _signatures(text: str, threshold: float):
    first = prefix_depth(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            tree = mixed(np.arange(TREES, dtype=U64) + U64(77))
            for batch in slices(batches, text, 2_000_000):
                key, size, nodes, depth = [], [], [], []
                for s in shingle_sets(batch.column(text)):
                    key.append(set_hash(s))
                    size.append(len(s))
                    depth.append(stop_depth(len(s), threshold) if len(s) else first)
                    if not len(s):
                        nodes.append([])
                        continue
                    used = (np.arange(TREES)[:, None] * DEPTH + np.arange(depth[-1])).ravel()
                    node, own = tree, []
                    for level, low in enumerate(minima(s, used).reshape(TREES, depth[-1]).T):
                        node = mixed(node * U64(31) + low.astype(U64))
                        if level + 1 >= first:
                            own.append(node)
                    nodes.append(np.concatenate(own).view(np.int64))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "text_key": pa.array(key, pa.int64()),
                    "size": pa.array(size, pa.int64()), "depth": pa.array(depth, pa.int32()), "nodes": pa.array(nodes, pa.list_(pa.int64())),
                })

    return sign


def _incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x columns) 0/1 matrix of the shingles that two or more sets have, and column weights.

    Shingles that the same sets have become one column with their number as weight.
    """
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    value, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[code] > 1
    row, code = row[keep], code[keep]
    by = np.argsort(code, kind="stable")
    row, code = row[by], code[by]
    if not len(row):
        return np.zeros((len(sets), 0), np.float32), np.zeros(0, np.float32)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    with np.errstate(over="ignore"):
        who = np.add.reduceat(mixed(row.astype(U64) + U64(5)), first)
    _, sample, weight = np.unique(who, return_index=True, return_counts=True)
    ends = np.r_[first[1:], len(row)]
    out = np.zeros((len(sets), len(sample)), np.float32)
    for c, f in enumerate(sample.tolist()):
        out[row[first[f] : ends[f]], c] = 1
    return out, weight.astype(np.float32)


def linked(sets: list[np.ndarray], split: int | None, threshold: float) -> np.ndarray:
    """Boolean matrix of pairs with exact Jaccard at or over the threshold (diagonal false).

    With ``split``, only pairs of a row before and a row from ``split`` on count.
    """
    size = np.array([len(s) for s in sets], np.float64)
    m = len(sets)
    common = np.zeros((m, m), np.float64)
    matrix, weight = _incidence(sets)
    for c in range(0, matrix.shape[1], 8192):
        part = matrix[:, c : c + 8192]
        common += (part * weight[c : c + 8192]) @ part.T
    link = common / np.maximum(size[:, None] + size[None, :] - common, 1) >= threshold
    np.fill_diagonal(link, False)
    if split is not None:
        link[:split, :split] = False
        link[split:, split:] = False
    return link


def roots(link: np.ndarray) -> np.ndarray:
    """For each row the smallest row of its component."""
    root = np.full(len(link), -1)
    for i in range(len(link)):
        if root[i] < 0:
            front = np.zeros(len(link), bool)
            front[i] = True
            root[i] = i
            while front.any():
                front = link[front].any(axis=0) & (root < 0)
                root[front] = i
    return root


def _verify(threshold: float):
    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        sets = shingle_sets(pa.array(frame["text"], pa.string()))
        frame = frame.assign(own=[set_hash(s) for s in sets], at=range(len(sets)))
        frame = frame[frame["own"] == frame["text_key"]].drop_duplicates("text_key").sort_values(["part", "text_key"])
        sets = [sets[i] for i in frame["at"]]
        part = frame["part"].to_numpy()
        split = int((part == part[0]).sum()) if len(part) and part[0] != part[-1] else None
        if len(sets) < 2 or (split is None and frame["low"].iat[0] != frame["high"].iat[0]):
            link = np.zeros((len(sets), len(sets)), bool)
        else:
            link = linked(sets, split, threshold)
        key = frame["text_key"].to_numpy()
        return pd.DataFrame({
            "text_key": key, "root": key[roots(link)] if len(key) else key, "n_text_links": link.sum(axis=1),
            "n_links": link @ frame["copies"].to_numpy(),
        })

    return verify


def near_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, text_key, text_id, class_key, class_id, n_links, n_text_links.

    ``text_id`` is the smallest id with the same shingle set, ``class_id`` the smallest id
    reached over links (Jaccard at or over ``threshold``).  ``n_links`` counts all other
    documents linked to it (its own copies too), ``n_text_links`` only different texts.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(
        given.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
            _signatures("text", threshold), "doc_id long, text_hash long, text_key long, size long, depth int, nodes array<long>"),
        "forest-labels",
    )
    texts = written(
        signed.where("size > 0").groupBy("text_key")
        .agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("low_id"), F.col("text_hash").alias("low_hash"))).alias("low"),
             F.count("*").alias("copies"), F.first("depth").alias("depth"), F.first("nodes").alias("nodes"))
        .select("text_key", "low.*", "copies", "depth", "nodes"),
        "forest-texts",
    )
    # A text's nodes come level by level, the one where it stops last.
    member = texts.select("text_key", (F.size("nodes") - TREES).alias("_last"), F.posexplode("nodes").alias("_at", "node"))
    stops = F.when(F.col("_at") >= F.col("_last"), F.col("text_key"))
    met = member.groupBy("node").agg(F.min(stops).alias("hub"), F.count("*").alias("n")).where("n > 1 and hub is not null").drop("n")
    stars = member.join(met, "node").where("text_key <> hub").select(F.col("text_key").alias("a"), F.col("hub").alias("b"))
    cluster = components(stars)
    size = cluster.groupBy("root").agg(F.ceil(F.count("*") / F.lit(CELL)).cast("long").alias("parts"))
    placed = written(
        cluster.join(size, "root").join(texts.drop("nodes", "depth").withColumnRenamed("text_key", "node"), "node")
        .select(F.col("root").alias("cluster"), F.col("node").alias("text_key"), "low_id", "low_hash", "copies", "parts",
                F.pmod(F.xxhash64("node"), "parts").alias("part")),
        "forest-clusters",
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    # Ids may be null or repeated, so a text is met by id and hash; rows equal in both are one before they are dealt.
    own = given.groupBy(F.coalesce("doc_id", F.lit(_NO_ID)).alias("low_id"), F.xxhash64("text").alias("low_hash")).agg(F.first("text").alias("text"))
    # Members grow with the corpus: the texts meet them by sort-merge at every size.
    cells = (
        own.join(placed.hint("merge"), ["low_id", "low_hash"])
        .select("text", "text_key", "copies", "cluster", "part", other.alias("other"))
        .select("text", "text_key", "copies", "cluster", "part", F.least("part", "other").alias("low"),
                F.greatest("part", "other").alias("high"))
    )
    checked = written(
        cells.groupBy("cluster", "low", "high")
        .applyInPandas(_verify(threshold), "text_key long, root long, n_text_links long, n_links long"),
        "forest-links",
    )
    class_of = components(checked.select(F.col("text_key").alias("a"), F.col("root").alias("b")))
    totals = checked.groupBy("text_key").agg(F.sum("n_text_links").alias("n_text_links"), F.sum("n_links").alias("n_links"))
    of_text = (
        texts.select("text_key", "low_id", "copies").join(totals, "text_key", "left")
        .join(class_of.withColumnRenamed("node", "text_key"), "text_key", "left")
        .withColumn("class_key", F.coalesce("root", "text_key"))
    )
    low = of_text.groupBy("class_key").agg(F.min("low_id").alias("class_id"))
    known = of_text.join(low, "class_key").select(
        "text_key", "class_key", F.col("low_id").alias("text_id"), "class_id",
        (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"),
    )
    with_words = signed.where("size > 0").select("doc_id", "text_hash", "text_key").join(known, "text_key")
    without = signed.where("size = 0").select(
        F.lit(None).cast("long").alias("text_key"), "doc_id", "text_hash", F.lit(None).cast("long").alias("class_key"),
        F.col("doc_id").alias("text_id"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(0).cast("long").alias("n_text_links"),
    )
    real = lambda c: F.when(F.col(c) < _NO_ID, F.col(c)).alias(c)
    return with_words.unionByName(without).select(
        "doc_id", "text_hash", "text_key", real("text_id"), "class_key", real("class_id"), "n_links", "n_text_links"
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: the smallest id, then the smallest text hash.

    Rows without words are kept.  Of rows equal in id and text any one stays.
    """
    id_key, hashed, rank = fresh("_id_key", docs), fresh("_hash", docs), fresh("_rank", docs)
    keyed = docs.withColumn(id_key, F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID))).withColumn(hashed, F.xxhash64(text))
    links = near_links(docs, doc_id, text, threshold).where("class_key is not null")
    first = links.groupBy("class_key").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias(id_key), F.col("text_hash").alias(hashed))).alias("first")
    ).select("first.*")
    same = Window.partitionBy(id_key, hashed).orderBy(hashed)
    kept = keyed.join(first.hint("merge"), [id_key, hashed]).withColumn(rank, F.row_number().over(same)).where(F.col(rank) == 1)
    wordless = docs.where(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\t-\\r ]+", "") == "")
    return kept.select(*docs.columns).unionByName(wordless)
