"""Exact top-k inner products by block-at-a-time pruning.

Vectors become whole numbers, floor(``SCALE`` * x), and are packed into blocks of a range
of ids; a block is a small forward index and keeps each term's largest and smallest value.
A query's bound for a block is the sum over its terms of weight * maximum (or minimum for
a negative weight).  Blocks are scored in descending order of their bound until the bound
falls below the query's k-th score.  Queries travel in packs, blocks in groups of at most
``GROUP_BYTES``, each of which keeps its own maxima and minima (the stated query set against
all rows).  A pack first meets the group with the largest summed bound; the k-th scores found
there are floors, and of every other group only the queries whose bound reaches their floor
are sent to it.  Each such cell keeps k rows per query, and the best k of all are the answer;
nothing is approximated, and no cell is scored twice.  ``pruning`` reports the blocks scored.

Defined results: vectors that are null or hold null, NaN or infinite components, and rows
without an id, take no part; a vector meets only vectors of its own length; rows that share
the query's id are not its candidates; ties go to the smaller id; repeated query rows
answer once each; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swapledger.llm.common import written

SCALE = 256
#: Vectors per block, bytes of vectors per group of blocks, queries per pack.
BLOCK, GROUP_BYTES, PACK = 256, 4 << 20, 512
#: Parts over which the packs of one length are dealt when they meet the groups' bounds.
SPREAD = 64
_PACKED = "part int, number int, dim int, ids binary, vectors binary, high binary, low binary"
_FOUND = "part int, number int, row int, query_id long, vec_id long, score long, scored int"
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _pack(size: Callable[[int], int]):
    """Packs of ``size(dim)`` whole-number vectors of one length, in the order they come, with their extremes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, list]]] = {}
        number = 0

        def flush(dim: int) -> pa.RecordBatch:
            nonlocal number
            mine = held.pop(dim)
            vectors = np.floor(np.array([v for _, v in mine], np.float64).reshape(len(mine), dim) * SCALE)
            number += 1
            return pa.RecordBatch.from_pydict({
                "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "number": pa.array([number], pa.int32()),
                "dim": pa.array([dim], pa.int32()), "ids": [np.array([i for i, _ in mine], "<i8").tobytes()],
                "vectors": [vectors.astype("<f8").tobytes()],
                "high": [vectors.max(axis=0).astype("<f8").tobytes()], "low": [vectors.min(axis=0).astype("<f8").tobytes()],
            })

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == size(len(v)):
                    yield flush(len(v))
        for dim in sorted(held):
            yield flush(dim)

    return run


def _group_size(dim: int) -> int:
    """Vectors of a group: whole blocks within ``GROUP_BYTES``, at least one."""
    return BLOCK * max(1, GROUP_BYTES // (8 * max(dim, 1) * BLOCK))


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, dim) if dim else np.zeros((0, 0))


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Upper bounds of the products: a row per query, a column per row of extremes."""
    bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    # Bounds may be rounded once sums pass 2^53; the slack keeps them upper bounds.
    bound = bound + np.abs(bound) * 2.0**-40
    return np.where(np.isnan(bound), np.inf, bound)


def _of_pair(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a pack's queries and their bounds for one group."""
    ids = np.frombuffer(r["query_ids"], "<i8")
    if not r["dim"]:
        return ids, np.zeros(len(ids))
    return ids, _bounds(_matrix(r["queries"], r["dim"]), _matrix(r["high"], r["dim"]), _matrix(r["low"], r["dim"]))[:, 0]


def _outlook(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each pack's summed bound for each group."""
    for batch in batches:
        rows = batch.to_pylist()
        yield pa.RecordBatch.from_pydict({
            **{n: pa.array([r[n] for r in rows], pa.int32()) for n in ("part", "number", "at_part", "at_number")},
            "outlook": pa.array([float(_of_pair(r)[1].sum()) for r in rows], pa.float64()),
        })


def _reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The queries of each pack whose bound for a group reaches their floor; pairs without any are dropped."""
    for batch in batches:
        for r in batch.to_pylist():
            ids, bound = _of_pair(r)
            floor = np.full(len(ids), _LEAST)
            for f in r["floors"] or []:
                floor[f["row"]] = f["floor"]
            live = np.flatnonzero((floor == _LEAST) | (bound >= floor))
            if len(live):
                queries = _matrix(r["queries"], r["dim"])
                yield pa.RecordBatch.from_pydict({
                    **{n: pa.array([r[n]], pa.int32()) for n in ("part", "number", "dim", "at_part", "at_number")},
                    "query_ids": [ids[live].tobytes()], "queries": [queries[live].tobytes() if r["dim"] else b""],
                    "rows": [live.astype("<i4").tobytes()], "floor": [floor[live].astype("<i8").tobytes()],
                })


def _dot(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact products: as doubles while every sum stays under 2^53, else as unbounded whole numbers."""
    dim = queries.shape[1]
    if not dim or not len(queries) or not len(vectors):
        return np.zeros((len(queries), len(vectors)), np.int64)
    if float(np.abs(queries).max()) * float(np.abs(vectors).max()) * dim < 2.0**53:
        return (queries @ vectors.T).astype(np.int64)
    whole = lambda x: np.array([[int(c) for c in r] for r in x.tolist()], object)
    out = whole(queries) @ whole(vectors).T
    return np.clip(out, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
    """(query row, id, score) of each query's ``k`` best in these vectors, and the blocks scored per query.

    Scores below a query's ``floor`` are left out.
    """
    cuts = range(0, len(ids), BLOCK)
    high = np.stack([vectors[a : a + BLOCK].max(axis=0) for a in cuts])
    low = np.stack([vectors[a : a + BLOCK].min(axis=0) for a in cuts])
    bound = _bounds(queries, high, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    score = np.full((len(queries), k), _LEAST)
    found = np.full((len(queries), k), _MOST)
    floor = np.full(len(queries), _LEAST) if floor is None else floor
    scored = np.zeros(len(queries), np.int32)
    for turn in range(len(cuts)):
        block = order[:, turn]
        # A block whose bound equals the k-th score may still hold a smaller id.
        least = np.maximum(score[:, -1], floor)
        live = np.flatnonzero((least == _LEAST) | (bound[np.arange(len(queries)), block] >= least))
        if not len(live):
            break
        scored[live] += 1
        for b in np.unique(block[live]):
            rows = live[block[live] == b]
            a = int(b) * BLOCK
            own = ids[a : a + BLOCK]
            got = _dot(queries[rows], vectors[a : a + BLOCK])
            same = own[None, :] == query_ids[rows][:, None]
            got = np.where(same, _LEAST, got)
            every = np.concatenate([score[rows], got], axis=1)
            names = np.concatenate([found[rows], np.where(same, _MOST, own[None, :])], axis=1)
            best = np.lexsort((names, ~every), axis=1)[:, :k]
            score[rows] = np.take_along_axis(every, best, axis=1)
            found[rows] = np.take_along_axis(names, best, axis=1)
    # A place never filled holds the least score, which no product has.
    row, col = np.nonzero((score != _LEAST) & (score >= floor[:, None]))
    return row, found[row, col], score[row, col], scored


def _cells(k: int, count: bool):
    """Best rows of each (queries, group) pair; with ``count`` also a null row per query, which counts its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                query_ids, ids = np.frombuffer(r["query_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                queries, vectors = _matrix(r["queries"], r["dim"]), _matrix(r["vectors"], r["dim"])
                if not r["dim"]:
                    queries, vectors = np.zeros((len(query_ids), 1)), np.zeros((len(ids), 1))
                names, floor = np.frombuffer(r["rows"], "<i4"), np.frombuffer(r["floor"], "<i8")
                row, found, score, scored = search(queries, query_ids, vectors, ids, k, floor)
                row, asked = names[row], query_ids[row]
                n, m = len(row), len(names) if count else 0
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(n + m, r["part"]), pa.int32()), "number": pa.array(np.full(n + m, r["number"]), pa.int32()),
                    "row": pa.array(np.r_[row, names[:m]], pa.int32()), "query_id": pa.array(np.r_[asked, query_ids[:m]], pa.int64()),
                    "vec_id": pa.array([*found.tolist(), *[None] * m], pa.int64()), "score": pa.array([*score.tolist(), *[None] * m], pa.int64()),
                    "scored": pa.array(np.r_[np.zeros(n, np.int32), scored[:m]], pa.int32()),
                })

    return run


def _search(vectors: DataFrame, is_query: Column, k: int, vec_id: str, embedding: str, count: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows found by all cells, and the groups of blocks."""
    usable = (
        vectors.withColumn("_query", is_query).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), "_query")
        .where("vec_id is not null and embedding is not null")
        .where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    )
    # Rows of one id may be many: they are dealt on by their hash.
    ranged = usable.select("vec_id", "embedding").repartitionByRange("vec_id", F.xxhash64("embedding")).sortWithinPartitions("vec_id")
    groups = written(ranged.mapInArrow(_pack(_group_size), _PACKED), "vector-blocks").withColumnsRenamed({"part": "at_part", "number": "at_number"})
    packs = written(usable.where("_query").select("vec_id", "embedding").mapInArrow(_pack(lambda dim: PACK), _PACKED), "query-packs").select(
        "part", "number", "dim", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    # Most vectors have one length, so the packs of a length are dealt over SPREAD copies of the small bounds.
    spread = lambda d: d.withColumn("_salt", F.pmod(F.xxhash64("part", "number"), F.lit(SPREAD)))
    extremes = groups.select("at_part", "at_number", "dim", "high", "low").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)).cast("array<long>")))
    reach = "part int, number int, dim int, at_part int, at_number int, query_ids binary, queries binary, rows binary, floor binary"
    meet = lambda sent: sent.join(groups.select("at_part", "at_number", "ids", "vectors"), ["at_part", "at_number"]).mapInArrow(_cells(k, count), _FOUND)

    outlook = spread(packs).join(extremes, ["dim", "_salt"]).mapInArrow(_outlook, "part int, number int, at_part int, at_number int, outlook double")
    chosen = written(
        outlook.groupBy("part", "number").agg(F.max_by(F.struct("at_part", "at_number"), F.struct("outlook", "at_part", "at_number")).alias("_at"))
        .select("part", "number", "_at.*"), "first-groups")
    opening = chosen.join(packs, ["part", "number"]).join(groups.select("at_part", "at_number", "high", "low"), ["at_part", "at_number"])
    first = written(meet(opening.withColumn("floors", F.lit(None).cast("array<struct<row:int,floor:long>>")).mapInArrow(_reaching, reach)), "first-cells")
    floors = (
        first.where("vec_id is not null").groupBy("part", "number", "row").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k)
        .groupBy("part", "number").agg(F.collect_list(F.struct("row", "floor")).alias("floors"))  # at most PACK rows of a pack
    )
    known = spread(packs).join(chosen.withColumnsRenamed({"at_part": "_part", "at_number": "_number"}), ["part", "number"]).join(floors, ["part", "number"], "left")
    others = known.join(extremes, ["dim", "_salt"]).where(~((F.col("at_part") == F.col("_part")) & (F.col("at_number") == F.col("_number"))))
    return first.unionByName(meet(others.mapInArrow(_reaching, reach))), groups


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows where ``is_query`` holds, against all rows."""
    found, _ = _search(vectors, is_query, k, vec_id, embedding)
    best = Window.partitionBy("part", "number", "row").orderBy(F.desc("score"), "vec_id")
    return found.where("vec_id is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pruning(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, blocks (of the query's length), scored: how many of them the search had to score, a row per query row."""
    found, groups = _search(vectors, is_query, k, vec_id, embedding, count=True)
    mine = groups.select("dim", F.ceil(F.octet_length("ids") / F.lit(8 * BLOCK)).alias("n")).groupBy("dim").agg(F.sum("n").alias("blocks"))
    dims = vectors.where(is_query).select(F.col(vec_id).cast("long").alias("query_id"), F.size(embedding).alias("dim")).groupBy("query_id").agg(F.max("dim").alias("dim"))
    asked = found.groupBy("part", "number", "row", "query_id").agg(F.sum("scored").alias("scored"))
    return asked.join(dims, "query_id").join(mine, "dim").select("query_id", "blocks", "scored")
