"""Helpers shared by the training-data operators: written tables, Arrow buffers, byte hashes."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from swapledger.session import scratch_dir

U64 = np.uint64
ODD = np.uint64(0x9E3779B97F4A7C15)
ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage in a way that survives lost executors.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, docs: DataFrame) -> str:
    """``name``, lengthened until no column of ``docs`` has it (names meet whatever their case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, names: list[str], keep: str) -> DataFrame:
    """``docs`` without columns named like the results an operator adds; ``keep``, its input, stays."""
    taken = {n.lower() for n in names} - {keep.lower()}
    return docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in taken])


def squeeze(data: bytes | np.ndarray) -> bytes:
    """Compressed bytes of a buffer."""
    return zstandard.ZstdCompressor(level=1).compress(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes())


def unsqueeze(data: bytes, dtype=np.uint8) -> np.ndarray:
    """Array from compressed bytes."""
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Document ids as longs; null counts as the largest long."""
    return pc.fill_null(column.cast(pa.int64()), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``most`` bytes of text (a longer text is a piece of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def frozen(batch: pa.RecordBatch) -> bytes:
    """A record batch as compressed bytes."""
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return squeeze(sink.getvalue())


def thawed(data: bytes) -> pa.RecordBatch:
    """The record batch that ``frozen`` packed."""
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()
    return table.combine_chunks().to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def gram_hashes(data: np.ndarray, k: int, odd: np.uint64 = ODD) -> np.ndarray:
    """Hash of the ``k`` bytes from each position on; spans double, so few passes are made."""
    if len(data) < k:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        span, size, factor = data.astype(U64) + U64(1), 1, odd
        whole, length = None, 0
        while True:
            if k & size:
                if whole is None:
                    whole, length = span, size
                else:
                    n = len(data) - (length + size) + 1
                    whole = whole[:n] * factor + span[length : length + n]
                    length += size
            if size * 2 > k:
                return mixed(whole)
            n = len(span) - size
            span, size, factor = span[:n] * factor + span[size : size + n], size * 2, factor * factor


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over each window of ``width`` entries."""
    size = 1
    while size * 2 <= width:
        x, size = op(x[:-size], x[size:]), size * 2
    return op(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after the other."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


def runs_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
