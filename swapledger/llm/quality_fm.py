"""Quality classifier: factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct words (lower case, hashed into ``WORDS`` places,
weight log(1 + count), the whole scaled to length 1), one place per statistic and bucket
for the structure of the text, and one per bucket of the recorded length.  The score is

    sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)),

the sum-of-squares identity, linear in the number of features.  The machine is trained in
one task on a bounded sample of labelled rows (``SAMPLE`` at most, chosen by hash); scoring
reads every whole text where it lies, without a shuffle.

Defined results: null or empty text is scored by its structure alone; a null length has a
place of its own; rows without a label, or with a null one, are not learned from; with no
usable label at all every score is 0.5; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swapledger.llm.common import U64, ranges, slices, utf8, without
from swapledger.llm.piece_memo import span_hashes
from swapledger.llm.shingles import lowered, word_spans

WORDS = 1 << 16
BUCKETS = 16
#: Structure statistics, in the order of their places behind the words.
STATISTICS = (
    "length", "words", "word_length", "distinct", "upper", "digit", "sign", "space", "line_length", "same_as_before",
    "pipe", "repeated_lines", "inner_sign", "recorded_length",
)
SIZE = WORDS + BUCKETS * len(STATISTICS)
FACTORS = 8
#: Labelled rows that training reads at most.
SAMPLE = 12_000
EPOCHS, BATCH, RATE, DECAY = 8, 256, 0.1, 1e-6
#: Steps that training makes at least, and passes over the rows at most for that.
STEPS, MOST_EPOCHS = 100, 60


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Bucket of a ratio in 0..1, finer near both ends."""
    r = np.where(whole > 0, part / np.maximum(whole, 1), 0.0)
    return np.clip(np.searchsorted([0.002, 0.01, 0.03, 0.06, 0.1, 0.16, 0.24, 0.34, 0.46, 0.6, 0.75, 0.88, 0.96], r), 0, BUCKETS - 1)


def _log(x: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(x, 0) + 1), 0, BUCKETS - 1).astype(np.int64)


def features(column: pa.Array, recorded: pa.Array | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, offsets) of every text's features."""
    data, offsets = lowered(column)
    n = len(offsets) - 1
    starts, ends, before = word_spans(data, offsets)
    doc = np.repeat(np.arange(n), np.diff(before))
    word = span_hashes(data, starts, ends)
    place = (word % U64(WORDS)).astype(np.int64)
    pair, count = np.unique(doc * WORDS + place, return_counts=True)
    own, index = pair // WORDS, pair % WORDS
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(own, value * value, n))
    value = value / np.maximum(norm[own], 1e-9)

    raw, at = utf8(column)
    size = np.diff(at)
    of = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][at])
    letters = ((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128)
    digit, space = (raw >= 48) & (raw <= 57), (raw == 32) | ((raw >= 9) & (raw <= 13))
    sign = ~(letters | digit | space)
    upper = (raw >= 65) & (raw <= 90)
    line = raw == 10
    words = np.diff(before)
    same = np.r_[False, (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])]
    inner = sign[np.maximum(ends - 2, 0)] if len(raw) == len(data) else np.zeros(len(ends), bool)
    inner = inner & (ends - starts > 2)
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    begin = np.flatnonzero(edge[:-1] | np.r_[False, line[:-1]]) if len(raw) else np.zeros(0, np.int64)
    close = np.r_[begin[1:], len(raw)][: len(begin)]
    of_line = np.searchsorted(at, begin, "right") - 1
    text_line = span_hashes(raw, begin, close)
    by = np.lexsort((text_line, of_line))
    again = np.r_[False, (text_line[by][1:] == text_line[by][:-1]) & (of_line[by][1:] == of_line[by][:-1])] if len(by) else np.zeros(0, bool)
    lines = np.bincount(of_line, minlength=n)
    distinct = np.bincount(own, minlength=n)
    told = np.full(n, BUCKETS - 1) if recorded is None else np.where(
        recorded.is_null().to_numpy(zero_copy_only=False), BUCKETS - 1,
        np.minimum(_log(recorded.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False) / 16), BUCKETS - 2),
    )
    places = np.stack([
        _log(size / 16), _log(words), np.clip(of(~space) / np.maximum(words, 1), 0, BUCKETS - 1).astype(np.int64),
        _share(distinct, words), _share(of(upper), of(letters)), _share(of(digit), size), _share(of(sign), size), _share(of(space), size),
        _log(size / np.maximum(lines, 1)), _share(np.bincount(doc[same], minlength=n), words), _share(of(raw == 124), words),
        _share(np.bincount(of_line[by][again], minlength=n), lines), _share(np.bincount(doc[inner], minlength=n), words), told,
    ], axis=1) + WORDS + BUCKETS * np.arange(len(STATISTICS))
    # Interleave: the words of a text, then its statistics.
    k = len(STATISTICS)
    total = distinct + k
    off = np.r_[0, np.cumsum(total)]
    out_index, out_value = np.empty(off[-1], np.int64), np.empty(off[-1])
    slot = ranges(off[:-1], distinct)
    out_index[slot], out_value[slot] = index, value
    tail = (off[1:] - k)[:, None] + np.arange(k)
    out_index[tail], out_value[tail] = places, 1 / np.sqrt(k)
    return out_index, out_value, off


def raw_scores(model: tuple, index: np.ndarray, value: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins of the machine and the factor sums of each row (every row has features)."""
    bias, weight, factor = model
    vx = factor[index] * value[:, None].astype(np.float32)
    sums = np.add.reduceat(vx, off[:-1], axis=0)
    squares = np.add.reduceat((vx * vx).sum(axis=1), off[:-1])
    linear = np.add.reduceat(weight[index] * value, off[:-1])
    return bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def fit(label: np.ndarray, index: np.ndarray, value: np.ndarray, off: np.ndarray, seed: int = 7) -> tuple:
    """Logistic loss by AdaGrad over shuffled batches."""
    rnd = np.random.default_rng(seed)
    weight = np.zeros(SIZE)
    factor = rnd.normal(0, 0.01, (SIZE, FACTORS)).astype(np.float32)
    rate = np.clip(label.mean(), 0.01, 0.99)
    bias = float(np.log(rate / (1 - rate)))
    seen_w, seen_v, seen_b = np.full(SIZE, 1e-4), np.full((SIZE, FACTORS), 1e-4, np.float32), 1e-4
    # Few rows need more passes until the loss settles: the number of steps is held, not that of epochs.
    for _ in range(max(EPOCHS, min(MOST_EPOCHS, -(-STEPS * BATCH // max(len(label), 1))))):
        order = rnd.permutation(len(label))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            n = off[rows + 1] - off[rows]
            at = ranges(off[rows], n)
            i, x, o = index[at], value[at], np.r_[0, np.cumsum(n)]
            margin, sums = raw_scores((bias, weight, factor), i, x, o)
            d = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[rows]
            each = np.repeat(d, n) * x / len(rows)
            used, back = np.unique(i, return_inverse=True)
            g = np.bincount(back, each) + DECAY * weight[used]
            seen_w[used] += g * g
            weight[used] -= RATE * g / np.sqrt(seen_w[used])
            gv = each[:, None] * (np.repeat(sums, n, axis=0) - factor[i] * x[:, None])
            by = np.argsort(back, kind="stable")
            gv = np.add.reduceat(gv[by], np.flatnonzero(np.r_[True, np.diff(back[by]) > 0]), axis=0).astype(np.float32)
            gv += DECAY * factor[used]
            seen_v[used] += gv * gv
            factor[used] -= RATE * gv / np.sqrt(seen_v[used])
            gb = float(d.mean())
            seen_b += gb * gb
            bias -= RATE * gb / np.sqrt(seen_b)
    return bias, weight.astype(np.float32), factor


_ROWS = "label int, index binary, value binary"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1_500_000):
        index, value, off = features(batch.column("text"), batch.column("recorded"))
        cut = list(zip(off.tolist(), off[1:].tolist()))
        yield pa.RecordBatch.from_pydict({
            "label": batch.column("label"), "index": [index[a:b].astype("<i4").tobytes() for a, b in cut],
            "value": [value[a:b].astype("<f4").tobytes() for a, b in cut],
        })


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in b.to_pylist()]
    # The order of arrival must not matter.
    rows.sort(key=lambda r: (r["index"], r["label"]))
    if rows:
        size = np.array([len(r["index"]) // 4 for r in rows])
        bias, weight, factor = fit(
            np.array([r["label"] for r in rows], np.float64), np.frombuffer(b"".join(r["index"] for r in rows), "<i4").astype(np.int64),
            np.frombuffer(b"".join(r["value"] for r in rows), "<f4").astype(np.float64), np.r_[0, np.cumsum(size)],
        )
        yield pa.RecordBatch.from_pydict({"bias": [bias], "weight": [weight.astype("<f4").tobytes()], "factor": [factor.astype("<f4").tobytes()]})


def train(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", recorded: str | None = "n_chars",
          label: str = "quality", sample: int = SAMPLE) -> tuple | None:
    """The machine, from at most about ``sample`` labelled rows for which ``learn`` (on labels) holds."""
    known = labels.where(learn & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).cast("long").alias("_id"), (F.col(label) > 0).cast("int").alias("label"))
    n = known.count()
    if not n:
        return None
    chosen = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(min(1.0, sample / n) * 1_000_000))
    length = F.col(recorded) if recorded else F.lit(None)
    # At most about ``sample`` short rows: a bounded broadcast.
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text"), length.cast("long").alias("recorded")).join(
        F.broadcast(chosen), "_id")
    model = rows.select("label", "text", "recorded").mapInArrow(_describe, _ROWS).repartition(1).mapInArrow(
        _train, "bias double, weight binary, factor binary").collect()
    if not model:
        return None
    m = model[0]
    return m["bias"], np.frombuffer(m["weight"], "<f4"), np.frombuffer(m["factor"], "<f4").reshape(SIZE, FACTORS)


def with_quality(docs: DataFrame, model: tuple | None, text: str = "text", recorded: str | None = "n_chars", output: str = "quality_score") -> DataFrame:
    """``docs`` with the probability of label 1 in ``output``; a column of that name is replaced."""
    docs = without(docs, [output], text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in slices(batches, text, 1_500_000):
            if machine is None:
                score = np.full(batch.num_rows, 0.5)
            else:
                told = batch.column(recorded) if recorded else None
                margin, _ = raw_scores(machine, *features(batch.column(text), told))
                score = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, output])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(output, T.DoubleType())]))
