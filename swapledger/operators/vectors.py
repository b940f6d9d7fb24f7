"""Embeddings: pluggable encoders, vector tables, exact and approximate retrieval."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swapledger.session import scratch_dir


class Encoder(Protocol):
    """What an external embedding provider offers: a name, a dimension, batch encoding."""

    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedTerms:
    """Offline default: term counts hashed into slots, unit length, a batch of texts at a time."""

    def __init__(self, dim: int = 64):
        self.name = f"hashed-terms-{dim}"
        self.dim = dim

    def column(self, text: Column) -> Column:
        """The text's vector; a text without words gives zeros."""
        dim = self.dim

        @F.arrow_udf(T.ArrayType(T.FloatType()))
        def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            slots = _Slots(dim)
            for texts in batches:
                counts = np.zeros((len(texts), dim))
                for i, value in enumerate(texts.cast(pa.large_binary())):
                    # Bytes split at ASCII white space, which is what \s+ means.
                    words = (value.as_py() or b"").split()
                    counts[i] = np.bincount(np.fromiter(map(slots.__getitem__, words), np.int64, len(words)), minlength=dim)
                    if len(slots) > _KNOWN_WORDS:
                        slots.clear()
                lengths = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
                unit = (counts / np.where(lengths == 0, 1.0, lengths)).astype(np.float32)
                yield pa.ListArray.from_arrays(np.arange(0, unit.size + 1, dim, dtype=np.int32), unit.ravel())

        # A filter on the vector would otherwise be moved below and make it a second time.
        return embed.asNondeterministic()(text)


class _Slots(dict):
    """Slot of each word met so far."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: bytes) -> int:
        slot = self[word] = int.from_bytes(hashlib.md5(word).digest()[:4], "big") % self.dim
        return slot


#: Words beyond which a task forgets their slots.
_KNOWN_WORDS = 200_000


class LetterProfile:
    """Stand-in for an external encoder: counts of bytes by residue, unit length, a whole batch at a time."""

    def __init__(self, dim: int = 32):
        self.name = f"letter-profile-{dim}"
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        raw = [t.encode() for t in texts]
        row = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
        residue = np.frombuffer(b"".join(raw), np.uint8) % self.dim
        out = np.bincount(row * self.dim + residue, minlength=len(raw) * self.dim).reshape(len(raw), self.dim).astype(float)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1.0, norms)


def embed_udf(encoder: Encoder):
    """Arrow-batched UDF around an encoder; the encoder is set up once per task."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors = encoder.encode([t or "" for t in texts]).astype("float32")
            yield pd.Series(list(vectors))

    return embed


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_top_k(table: DataFrame, query: Column, k: int, vector: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """Rows most like one query vector; every task keeps only its own best ``k``."""
    q = table.withColumn("_q", query).withColumn(
        "score", F.try_divide(dot(F.col(vector), F.col("_q")), norm(F.col(vector)) * norm(F.col("_q")))
    )
    return q.drop("_q").orderBy(F.desc("score"), tie).limit(k)


def cosine_top_k_many(
    table: DataFrame, queries: Column, k: int, vector: str = "embedding", tie: str = "vec_id"
) -> DataFrame:
    """The same for a packed array of (query_id, vec); queries are few and given by the caller.

    Every row meets every query inside its own task; the ranking is cut per task
    before the shuffle, so at most k rows per task and query move.
    """
    spread = table.withColumn("_q", F.explode(queries)).withColumn(
        "score", F.try_divide(dot(F.col(vector), F.col("_q.vec")), norm(F.col(vector)) * norm(F.col("_q.vec")))
    ).withColumn("query_id", F.col("_q.query_id")).drop("_q")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), tie)
    return spread.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine_top_k_joined(table: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", tie: str = "vec_id") -> DataFrame:
    """The same for a stated query set of any size, as rows (query_id, vec): dealt in packs, so that no task holds them all.

    Blocks of rows meet packs of queries; a pair gives the best ``k`` of each of its queries.
    """
    packs = _blocks(queries.select("query_id", "vec").repartition(_PACKS, "query_id"), _PACK_ROWS, "_queries")
    return _best_of_pairs(_blocks(table, _BLOCK_ROWS, "_rows").crossJoin(packs), table, queries, k, vector, tie)


def _blocks(df: DataFrame, size: int, name: str, by: str | None = None) -> DataFrame:
    """Rows as Arrow batches of at most ``size``, one value each; with ``by`` those of one value, which stays beside them."""
    fields = [f for f in df.schema if f.name == by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in pc.unique(batch[by]) if by else [None]:
                part = batch.filter(pc.equal(batch[by], value)) if by else batch
                for at in range(0, part.num_rows, size):
                    piece = part.slice(at, size)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, piece.schema) as out:
                        out.write_batch(piece)
                    own = {by: pa.array([value.as_py()], value.type)} if by else {}
                    yield pa.RecordBatch.from_pydict({**own, name: pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return df.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.BinaryType())]))


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Length of each vector (-1 for a missing one or one with gaps), and all entries in a row, as doubles."""
    gaps = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    entries = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    holes = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False))
    if len(holes):
        ends = np.cumsum(np.maximum(gaps, 0))
        whole = gaps.copy()
        whole[np.searchsorted(ends, holes, side="right")] = -1
        entries = entries[np.repeat(whole >= 0, np.maximum(gaps, 0))]
        gaps = whole
    return gaps, entries


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up in the order of ``dot``, so that they are equal to the last bit."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _best_of_block(rows: pa.RecordBatch, queries: pa.RecordBatch, k: int, vector: str, tie: str) -> pa.RecordBatch:
    """The best ``k`` rows of a block for each query; a product finds the candidates, ``_dots`` scores them."""
    own, entries = _matrix(rows[vector])
    wanted, asked = _matrix(queries["vec"])
    ties = rows[tie].to_numpy(zero_copy_only=False)
    found = []
    for dim in np.unique(wanted):
        q_at = np.flatnonzero(wanted == dim)
        r_at = np.flatnonzero(own == dim) if dim > 0 else np.array([], dtype=np.int64)
        rest = np.setdiff1d(np.arange(rows.num_rows), r_at)
        x = entries[np.repeat(own == dim, np.maximum(own, 0))].reshape(len(r_at), -1) if len(r_at) else np.zeros((0, 1))
        q = asked[np.repeat(wanted == dim, np.maximum(wanted, 0))].reshape(len(q_at), -1) if len(r_at) else np.zeros((len(q_at), 1))
        with np.errstate(all="ignore"):
            nx, nq = np.sqrt(_dots(x, x)), np.sqrt(_dots(q, q))
            near = q @ x.T / np.outer(nq, nx)
            none = np.outer(nq, nx) == 0
            near[~np.isfinite(near)] = np.inf
            near[none] = -np.inf
            floor = np.partition(near, len(r_at) - k, axis=1)[:, len(r_at) - k] if len(r_at) > k else np.full(len(q_at), -np.inf)
            qi, ri = np.nonzero((near >= floor[:, None] - 1e-9) & ~none)
            found.append((q_at[qi], r_at[ri], _dots(q[qi], x[ri]) / (nx[ri] * nq[qi]), np.zeros(len(qi), bool)))
        # Pairs without a score come last.
        short = np.flatnonzero((~none).sum(axis=1) < k)
        for i in short:
            left = np.concatenate([rest, r_at[none[i]]])
            left = left[np.argsort(ties[left], kind="stable")[:k]]
            found.append((np.full(len(left), q_at[i]), left, np.zeros(len(left)), np.ones(len(left), bool)))
    qi, ri, score, none = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((ties[ri], -np.where(np.isnan(score), np.inf, score), ~np.isnan(score), none, qi))
    qi, ri, score, none = qi[order], ri[order], score[order], none[order]
    starts = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
    place = np.arange(len(qi)) - np.repeat(starts, np.diff(np.r_[starts, len(qi)]))
    keep = place < k
    out = rows.take(pa.array(ri[keep]))
    names = [*out.schema.names, "query_id", "score"]
    return pa.RecordBatch.from_arrays([*out.columns, queries["query_id"].take(pa.array(qi[keep])), pa.array(score[keep], mask=none[keep])], names=names)


def _best_of_pairs(pairs: DataFrame, table: DataFrame, queries: DataFrame, k: int, vector: str, tie: str) -> DataFrame:
    """Rank of the best ``k`` rows of each query over pairs of a block and a pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda raw: pa.ipc.open_stream(raw).read_next_batch()
        for batch in batches:
            for rows, asked in zip(batch["_rows"], batch["_queries"]):
                yield _best_of_block(read(rows.as_py()), read(asked.as_py()), k, vector, tie)

    scored = pairs.select("_rows", "_queries").mapInArrow(
        run, T.StructType([*table.schema.fields, queries.schema["query_id"], T.StructField("score", T.DoubleType())]))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Rows of a block, and queries of a pack.
_BLOCK_ROWS, _PACK_ROWS = 2048, 512
#: Packs of a stated query set.
_PACKS = 16


def build_vector_table(vectors: DataFrame, path: str, model: str, dim: int, vector: str = "embedding") -> None:
    """Write vectors with model name and dimension pinned; a wrong length is an error."""
    size = F.size(vector)
    checked = vectors.withColumn(
        vector, F.when(size == dim, F.col(vector)).otherwise(F.raise_error(F.lit(f"vector is not of length {dim}")))
    )
    checked.write.mode("overwrite").parquet(f"{path}/vectors")
    vectors.sparkSession.createDataFrame([(model, dim)], "model string, dim int").write.mode("overwrite").json(f"{path}/meta")


def open_vector_table(spark, path: str, model: str, dim: int) -> DataFrame:
    """Vectors of a table, if it was built by this model and dimension."""
    meta = spark.read.schema("model string, dim int").json(f"{path}/meta").first()
    if meta is None or (meta.model, meta.dim) != (model, dim):
        raise ValueError(f"vector table was built by {meta}, not by {model}/{dim}")
    return spark.read.parquet(f"{path}/vectors")


class HashIndex:
    """Approximate retrieval by hyperplane signatures, with the recall measured when it is built.

    A vector's bucket is the side of each of ``bits`` fixed planes it lies on, and the table is
    written by bucket.  A query visits buckets in order of the squared distance of its
    projections to the planes it would have to cross, so near buckets come first.  How many it
    visits is settled by measurement: for at most ``SAMPLE`` stored vectors the exact
    neighbours are found, and the number of visits is the smallest that meets ``target`` of them.
    """

    SAMPLE = 200

    def __init__(self, dim: int, bits: int = 6, seed: int = 7):
        self.bits = bits
        planes = np.random.default_rng(seed).normal(size=(bits, dim))
        self.planes = (planes / np.linalg.norm(planes, axis=1, keepdims=True)).tolist()

    def projections(self, vector: Column) -> list[Column]:
        return [dot(vector, F.expr(f"array({', '.join(f'{x!r}D' for x in p)})")) for p in self.planes]

    def bucket(self, vector: Column) -> Column:
        return sum((F.when(p > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, p in enumerate(self.projections(vector))), F.lit(0))

    def visits(self, vector: Column) -> Column:
        """All buckets in the order in which a query visits them."""
        side = F.array(*[F.struct((p > 0).alias("up"), (p * p).alias("cost")) for p in self.projections(vector)])
        cost = lambda b: F.aggregate(
            F.transform(side, lambda s, i: F.when(s["up"] == (F.getbit(b, i) == 1), 0.0).otherwise(s["cost"])), F.lit(0.0), lambda a, x: a + x)
        every = F.sequence(F.lit(0), F.lit((1 << self.bits) - 1))
        return F.transform(F.array_sort(F.transform(every, lambda b: F.struct(cost(b.cast("long")).alias("cost"), b.alias("b")))), lambda x: x["b"])

    def build(self, table: DataFrame, path: str, k: int = 10, target: float = 0.95, vector: str = "embedding", tie: str = "vec_id") -> tuple[int, float]:
        """Write the index of all rows; returns the visits that searches make and the recall measured with them."""
        indexed = table.withColumn("bucket", self.bucket(F.col(vector)))
        indexed.write.partitionBy("bucket").parquet(f"{path}/vectors")
        stored = table.sparkSession.read.parquet(f"{path}/vectors")
        # A bounded number of queries, picked by hash, against all rows.
        some = stored.select(F.col(tie).alias("query_id"), F.col(vector).alias("vec")).orderBy(F.xxhash64(tie), tie).limit(self.SAMPLE)
        best = cosine_top_k_joined(stored, some, k, vector, tie).select("query_id", "bucket")
        turn = best.join(some, "query_id").select(F.array_position(self.visits(F.col("vec")), F.col("bucket")).alias("turn"))
        # One row per number of visits.
        met = sorted((r["turn"], r["n"]) for r in turn.groupBy("turn").agg(F.count("*").alias("n")).collect())
        total, so_far, visits = sum(n for _, n in met), 0, 1
        for at, n in met:
            visits, so_far = at, so_far + n
            if so_far >= target * total:
                break
        recall = so_far / total if total else 1.0
        table.sparkSession.createDataFrame([(int(visits), float(recall))], "visits int, recall double").coalesce(1).write.json(f"{path}/meta")
        return int(visits), recall

    def search(self, path: str, queries: DataFrame, k: int, vector: str = "embedding", tie: str = "vec_id") -> DataFrame:
        """query_id, the index's columns, score and rank of each query's best ``k`` in the buckets it visits.

        ``queries`` are (query_id, vec); their number is free, since they meet the table by bucket.
        """
        spark = queries.sparkSession
        meta = spark.read.schema("visits int, recall double").json(f"{path}/meta").first()
        table = spark.read.parquet(f"{path}/vectors")
        sent = queries.select("query_id", "vec", F.explode(F.slice(self.visits(F.col("vec")), 1, meta.visits)).alias("bucket"))
        packs = _blocks(sent.repartition("bucket").sortWithinPartitions("bucket"), _PACK_ROWS, "_queries", "bucket")
        return _best_of_pairs(_blocks(table, _BLOCK_ROWS, "_rows", "bucket").join(packs, "bucket"), table, queries, k, vector, tie)


def vector_store(vectors: DataFrame, model: str, dim: int) -> tuple[str, DataFrame]:
    """Build and reopen a vector table in the scratch folder."""
    path = scratch_dir(vectors.sparkSession, "vectors")
    build_vector_table(vectors, path, model, dim)
    return path, open_vector_table(vectors.sparkSession, path, model, dim)
