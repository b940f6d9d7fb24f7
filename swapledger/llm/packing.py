"""Best-fit packing by the sum of squares: training sequences of at most ``CAPACITY`` tokens.

An online rule places every piece where the sum over residual gaps g of N(g)^2 becomes
smallest, N(g) being the number of open bins with gap g; a new bin counts as a choice.
Ties go to the smallest gap that is left.  Pieces are dealt by hash into groups of about
``GROUP`` pieces, packed longest first; the bins that stay open are then dealt anew and
packed as pieces of their own, so that groups lose next to nothing.  Groups grow in
number with the input, never in size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swapledger.llm.common import slices, written
from swapledger.llm.word_tokens import encoder, vocabulary_path

CAPACITY = 2048
GROUP = 30_000
END_ID = 0
PIECE = "piece int, start long, length long, ids_crc32 long"


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size, in the order given, and the levels of all bins."""
    count = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    level: list[int] = []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    far = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        # Change of the sum for gap g: one bin less at g, one more at g - s (a full bin has no gap).
        after = count[: capacity - s + 1] * 2 + 1
        after[0] = 0
        change = np.where(count[s:] > 0, after - 2 * count[s:] + 1, far)
        left = int(change.argmin())
        fresh = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if change[left] <= fresh and change[left] < far:
            gap = left + s
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            b, left = len(level), capacity - s
            level.append(0)
        bins[i], offsets[i] = b, level[b]
        level[b] += s
        if left:
            open_bins[left].append(b)
            count[left] += 1
    return bins, offsets, np.array(level, np.int64)


def _pieces(text: str, path: str, capacity: int, keep: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in slices(batches, text, 1_500_000):
            row, piece, start, length, crc = [], [], [], [], []
            ids, counts = code.encode(batch.column(text))
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts)
            for i, (first, last) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
                own = raw[4 * first : 4 * last] + END_ID.to_bytes(4, "little")
                n = last - first + 1
                for k, x in enumerate(range(0, n, capacity)):
                    y = min(x + capacity, n)
                    row.append(i)
                    piece.append(k)
                    start.append(x)
                    length.append(y - x)
                    crc.append(zlib.crc32(own[4 * x : 4 * y]))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(at) for c in keep]
                + [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                [*keep, "piece", "start", "length", "ids_crc32"],
            )

    return cut


def _pack(capacity: int):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "ids_crc32", "doc_id"], ascending=[False, True, True]).reset_index(drop=True)
        bins, offsets, level = sum_of_squares(frame["length"].to_numpy(), capacity)
        group = int(frame["_group"].iat[0])
        return frame.assign(_bin=(group << 24) + bins, _offset=offsets, _level=level[bins]).drop(columns="_group")

    return pack


def _dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    return df.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-rows // GROUP)))))


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                   path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty (one end id); texts longer than ``capacity`` ids are cut, others never;
    repeated rows, ties and equal ids are packed like any others; null ids stay null; an empty
    table gives no sequences.  Only the two named columns are read, so others may have any name.
    """
    path = path or vocabulary_path()
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Numbered once and written, so that equal rows are dealt over all groups, and the same way after a lost task.
    pieces = written(
        given.mapInArrow(_pieces("text", path, capacity, ["doc_id"]), f"doc_id long, {PIECE}").withColumn("_number", F.monotonically_increasing_id()),
        "pieces")
    rows = pieces.where(F.col("length") < capacity).count()
    first = written(
        _dealt(pieces.where(F.col("length") < capacity), ["_number"], rows).drop("_number").groupBy("_group").applyInPandas(
            _pack(capacity), f"doc_id long, {PIECE}, _bin long, _offset long, _level long"
        ),
        "packed",
    )
    bins = first.groupBy("_bin").agg(F.max("_level").alias("_size"))
    unfilled = bins.where(F.col("_size") < capacity)
    n_open = unfilled.count()
    joined = _dealt(unfilled, ["_bin"], n_open).groupBy("_group").applyInPandas(
        _repack(capacity), "_bin long, _seq long, _base long"
    )
    packed = first.join(joined, "_bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce(F.col("_seq") * 2, F.col("_bin") * 2 + 1).alias("_place"),
        (F.col("_offset") + F.coalesce("_base", F.lit(0))).alias("offset"),
    )
    full = pieces.where(F.col("length") == capacity)
    # Numbers: packed sequences count up from 0, whole ones go below it, by document, piece and content.
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_place").alias("sequence_id"), "offset").unionByName(
        full.drop("_number").withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    )


def _repack(capacity: int):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_size", "_bin"], ascending=[False, True]).reset_index(drop=True)
        bins, offsets, _ = sum_of_squares(frame["_size"].to_numpy(), capacity)
        return pd.DataFrame({"_bin": frame["_bin"], "_seq": (int(frame["_group"].iat[0]) << 24) + bins, "_base": offsets})

    return pack
