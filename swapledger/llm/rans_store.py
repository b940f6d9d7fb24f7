"""Token-id files: static range asymmetric numeral system with interleaved lanes.

One frequency table, counted over all documents and scaled to ``2**SCALE`` with at least 1
for every id of the vocabulary, serves every block.  A *section* holds whole documents
(about ``SECTION`` ids) and is one record of the file: a header, the document directory
and blocks of ``BLOCK`` ids.  Blocks are independent: id t of a block belongs to lane
t % ``LANES``, each lane has a 64-bit state and gives off 32-bit words into the block's one
word stream.  Every ``EVERY`` steps a checkpoint keeps the word position and all states,
so a block decodes in parallel pieces; a CRC-32 of every block's bytes and of its ids
guards it.  Records are Parquet rows of the file's number, the section's number and the
bytes, written by Spark's own committer to the shared folder.

Layout of a section, little-endian: ``RAN1``, u32 documents, u64 ids, then i64 document
ids, u32 lengths, and per block u32 ids, u32 words, u32 checkpoints, u32 CRC of what
follows in the block, u32 CRC of its ids; u32 word positions of the checkpoints, u64
states of the checkpoints, u32 words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swapledger.llm.common import U64, ids_of, slices, squeeze, unsqueeze, written
from swapledger.llm.word_tokens import encoder, vocabulary_path
from swapledger.session import scratch_dir

SCALE = 20
LANES = 32
BLOCK = 32_768
EVERY = 256
SECTION = 1_000_000
END_ID = 1
_LOW = U64(1 << 31)
_MASK = U64((1 << SCALE) - 1)
_WORD = U64(32)
_FILE = "file int, section int, n_docs long, n_ids long, payload binary"


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to ``2**scale``, at least 1 each, near proportion to ``counts``."""
    total, room = max(int(counts.sum()), 1), (1 << scale) - len(counts)
    exact = counts * (room / total)
    freq = np.floor(exact).astype(np.int64)
    short = room - int(freq.sum())
    freq[np.argsort(-(exact - freq), kind="stable")[:short]] += 1
    rest = room - int(freq.sum())
    freq[int(freq.argmax())] += rest
    return freq + 1


class Table:
    """Frequencies, their running sums and the id of every slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(U64)
        self.base = (np.cumsum(freq) - freq).astype(U64)
        self.of_slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode_blocks(ids: np.ndarray, table: Table) -> list[bytes]:
    """The blocks of an id stream; all blocks advance together, lane by lane."""
    blocks = -(-len(ids) // BLOCK)
    out = []
    for b in range(0, blocks, 32):
        out += _encode(ids[b * BLOCK : (b + 32) * BLOCK], table)
    return out


def _encode(ids: np.ndarray, table: Table) -> list[bytes]:
    n = len(ids)
    blocks = -(-n // BLOCK)
    steps = -(-min(n, BLOCK) // LANES)
    grid = np.zeros(blocks * BLOCK, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK // LANES, LANES).transpose(1, 0, 2)[:steps])
    size = np.full(blocks, BLOCK)
    size[-1] = n - (blocks - 1) * BLOCK
    freq, start = table.freq[grid], table.base[grid]
    live = np.arange(BLOCK).reshape(BLOCK // LANES, LANES)
    state = np.full((blocks, LANES), _LOW, U64)
    words = np.zeros((steps, blocks, LANES), np.uint32)
    given = np.zeros((steps, blocks, LANES), bool)
    kept = {}
    for t in range(steps - 1, -1, -1):
        full = state >= freq[t] << U64(63 - SCALE)
        on = None if (t + 1) * LANES <= size[-1] else live[t][None, :] < size[:, None]
        if on is not None:
            full &= on
        words[t], given[t] = state, full
        x = state >> (full * _WORD)
        whole, rest = np.divmod(x, freq[t])
        whole <<= U64(SCALE)
        whole += rest
        whole += start[t]
        state = whole if on is None else np.where(on, whole, state)
        if t % EVERY == 0:
            kept[t] = state
    out = []
    for b in range(blocks):
        used = -(-int(size[b]) // LANES)
        per_step = given[:used, b].sum(axis=1)
        before = np.r_[0, np.cumsum(per_step)]
        marks = list(range(0, used, EVERY))
        stream = words[:used, b][given[:used, b]]
        body = (
            before[marks].astype("<u4").tobytes() + np.stack([kept[t][b] for t in marks]).astype("<u8").tobytes()
            + stream.astype("<u4").tobytes()
        )
        own = ids[b * BLOCK : b * BLOCK + int(size[b])].astype("<u4").tobytes()
        out.append(struct.pack("<5I", int(size[b]), len(stream), len(marks), zlib.crc32(body), zlib.crc32(own)) + body)
    return out


def decode_blocks(raw: memoryview, n_ids: int, table: Table) -> np.ndarray:
    """Ids of consecutive blocks; every checkpoint starts a piece, all pieces advance together."""
    at, out, first = 0, np.empty(n_ids, np.uint32), 0
    pos, state, left, place, checks, streams, base = [], [], [], [], [], [], 0
    while first < n_ids:
        size, n_words, marks, crc, crc_ids = struct.unpack_from("<5I", raw, at)
        body = raw[at + 20 : at + 20 + 4 * marks + 8 * LANES * marks + 4 * n_words]
        if zlib.crc32(body) != crc:
            raise ValueError("damaged block: checksum of its bytes differs")
        pos.append(np.frombuffer(body, "<u4", marks).astype(np.int64) + base)
        state.append(np.frombuffer(body, "<u8", marks * LANES, 4 * marks).reshape(marks, LANES).astype(U64))
        streams.append(np.frombuffer(body, "<u4", n_words, 4 * marks + 8 * LANES * marks))
        start = np.arange(marks) * EVERY * LANES
        left.append(np.minimum(size - start, EVERY * LANES))
        place.append(first + start)
        checks.append((first, first + size, crc_ids))
        base, first, at = base + n_words, first + size, at + 20 + len(body)
    if not checks:
        return out
    pos, state = np.concatenate(pos), np.concatenate(state)
    left, place = np.concatenate(left), np.concatenate(place)
    stream = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(U64)
    lane = np.arange(LANES)
    order = np.argsort(-left, kind="stable")
    pos, state, left, place = pos[order], state[order], left[order], place[order]
    all_on = np.searchsorted(-left, -(np.arange(EVERY) + 1) * LANES, "right")
    some_on = np.searchsorted(-left, -np.arange(EVERY) * LANES, "left")
    for t in range(EVERY):
        # Pieces are sorted by length: the first ``m`` still have ids, the first ``w`` a whole step.
        m, w = int(some_on[t]), int(all_on[t])
        if not m:
            break
        x = state[:m]
        slot = (x & _MASK).astype(np.int64)
        s = table.of_slot[slot]
        new = table.freq[s] * (x >> U64(SCALE))
        new += slot.astype(U64) - table.base[s]
        need = new < _LOW
        target = place[:m, None] + t * LANES + lane
        if w < m:
            on = lane[None, :] < (left[:m] - t * LANES)[:, None]
            need &= on
            new = np.where(on, new, x)
            out[target[on]] = s[on]
        else:
            out[target] = s
        row, col = np.nonzero(need)
        count = need.sum(axis=1)
        word = stream[pos[row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]]
        new[row, col] = (new[row, col] << _WORD) | word
        state[:m] = new
        pos[:m] += count
    for a, b, crc in checks:
        if zlib.crc32(out[a:b].astype("<u4").tobytes()) != crc:
            raise ValueError("damaged block: checksum of its ids differs")
    return out


def _tokenise(path: str):
    """Sections of raw ids, in the order the rows come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, number = encoder(path), 0
        ids: list[np.ndarray] = []
        docs: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            size = np.concatenate(sizes)
            end = np.cumsum(size)
            stream = np.insert(np.concatenate(ids), np.concatenate([end]), END_ID)
            out = pa.RecordBatch.from_pydict({
                "file": pa.array([TaskContext.get().partitionId()], pa.int32()), "section": pa.array([number], pa.int32()),
                "n_docs": [len(size)], "n_ids": [len(stream)],
                "payload": [np.concatenate(docs).astype("<i8").tobytes() + (size + 1).astype("<u4").tobytes()
                            + squeeze(stream.astype(np.uint16 if code.size <= 1 << 16 else np.uint32))],
            })
            number, held = number + 1, 0
            ids.clear(), docs.clear(), sizes.clear()
            return out

        for batch in slices(batches, "text", 1_500_000):
            own, counts = code.encode(batch.column("text"))
            ids.append(own)
            docs.append(ids_of(batch.column("doc_id")))
            sizes.append(counts)
            held += len(own) + len(counts)
            if held >= SECTION:
                yield flush()
        if held:
            yield flush()

    return run


def _raw(row: dict, wide: bool) -> tuple[bytes, np.ndarray]:
    head = 12 * row["n_docs"]
    return row["payload"][:head], unsqueeze(row["payload"][head:], np.uint32 if wide else np.uint16)


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                total += np.bincount(_raw(row, size > 1 << 16)[1], minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    return run


def _compress(freq: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        for batch in batches:
            for row in batch.to_pylist():
                head, ids = _raw(row, len(freq) > 1 << 16)
                start = struct.pack("<4sIQ", b"RAN1", row["n_docs"], row["n_ids"])
                row["payload"] = start + head + b"".join(encode_blocks(ids, table))
                yield pa.RecordBatch.from_pydict({
                    "file": pa.array([row["file"]], pa.int32()), "section": pa.array([row["section"]], pa.int32()),
                    "n_docs": [row["n_docs"]], "n_ids": [row["n_ids"]], "payload": [row["payload"]],
                })

    return run


def write_ids(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> None:
    """Encode all texts, in ascending id order, into ``folder``: ``ids`` (records) and ``table`` (frequencies).

    Null texts are empty (one end id); null ids come last; rows of one id are ordered, and dealt
    to files, by the hash of their text, then by the text; texts of any length are written whole;
    an empty table gives no sections.  Only the two named columns are read, so others may have any name.
    """
    path = path or vocabulary_path()
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ordered = given.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    raw = written(ordered.mapInArrow(_tokenise(path), _FILE), "raw-ids")
    size = encoder(path).size
    counts = raw.select("n_docs", "payload").mapInArrow(_count(size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    seen = counts.toPandas()  # one row per id of the vocabulary at most
    total = np.zeros(size, np.int64)
    total[seen["id"].to_numpy(np.int64)] = seen["n"].to_numpy(np.int64)
    freq = scaled(total)
    docs.sparkSession.createDataFrame([(SCALE, freq.tolist())], "scale int, frequencies array<long>").write.parquet(f"{folder}/table")
    raw.mapInArrow(_compress(freq), _FILE).write.option("compression", "none").parquet(f"{folder}/ids")


def _expand(freq: np.ndarray, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(freq)
        for batch in batches:
            for row in batch.to_pylist():
                raw = memoryview(row["payload"])
                magic, n_docs, n_ids = struct.unpack_from("<4sIQ", raw)
                if magic != b"RAN1":
                    raise ValueError("not a section of ids")
                doc = np.frombuffer(raw, "<i8", n_docs, 16)
                size = np.frombuffer(raw, "<u4", n_docs, 16 + 8 * n_docs).astype(np.int64)
                ids = decode_blocks(raw[16 + 12 * n_docs :], n_ids, table).astype("<u4")
                end = np.cumsum(size)
                one = ids.tobytes()
                parts = [one[4 * a : 4 * b] for a, b in zip((end - size).tolist(), end.tolist())]
                columns = {
                    "doc_id": pa.array(doc, pa.int64(), mask=doc == np.iinfo(np.int64).max),
                    "file": pa.array([row["file"]] * n_docs, pa.int32()), "section": pa.array([row["section"]] * n_docs, pa.int32()),
                    "inside": pa.array(end - size, pa.int64()), "n_tokens": pa.array(size, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array(parts, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def read_ids(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 (and ``ids``, unsigned 32-bit)."""
    freq = np.array(spark.read.parquet(f"{folder}/table").first()["frequencies"], np.int64)
    stored = spark.read.parquet(f"{folder}/ids")
    # Running starts: over the files (as many as partitions wrote), then inside each file.
    per_file = stored.groupBy("file").agg(F.sum("n_ids").alias("n"))
    file_start = per_file.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("_file_start"))
    inside = Window.partitionBy("file").orderBy("section")
    starts = (
        stored.select("file", "section", "n_ids")
        .withColumn("_start", F.sum("n_ids").over(inside) - F.col("n_ids")).join(file_start, "file")
        .select("file", "section", (F.col("_start") + F.col("_file_start")).alias("_start"))
    )
    schema = "doc_id long, file int, section int, inside long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    rows = stored.select("file", "section", "payload").mapInArrow(_expand(freq, with_ids), schema)
    return rows.join(starts, ["file", "section"]).select(
        "doc_id", (F.col("_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )


def new_folder(spark: SparkSession) -> str:
    """A fresh shared folder for id files."""
    return scratch_dir(spark, "token-ids")
