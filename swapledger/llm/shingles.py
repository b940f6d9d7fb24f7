"""Words and five-word shingles of whole texts as 64-bit hashes, a batch at a time.

Words are hashed by XXH3, not by a sum of powers, for which unequal words of one hash can be
written down; a shingle mixes the hashes of its five words.

A word is a run of characters other than ASCII white space, in lower case.  A text with
one to four words has one shingle, all of its words; a text without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

from swapledger.llm.common import ODD, ODD2, U64, mixed, utf8

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
with np.errstate(over="ignore"):
    _PLACE = np.cumprod(np.r_[U64(1), np.full(WORDS - 1, ODD2, U64)], dtype=U64)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case UTF-8 bytes and offsets of a text column (null: empty)."""
    data, offsets = utf8(column)
    if len(data) and data.max() < 128:
        up = (data >= 65) & (data <= 90)
        return data + up.astype(np.uint8) * np.uint8(32), offsets
    texts = [t.lower().encode() for t in column.fill_null("").to_pylist()]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum(sizes)]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each text (n + 1 entries)."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = inside & (edge[:-1] | ~np.r_[False, inside[:-1]])
    close = inside & (edge[1:] | ~np.r_[inside[1:], False])
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(close) + 1, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = lowered(column)
    starts, ends, before = word_spans(data, offsets)
    raw = data.tobytes()
    word = np.empty(len(starts), U64)
    # A portion at a time: the numbers of all words at once would be many Python objects.
    for c in range(0, len(starts), 1 << 15):
        cut = slice(c, c + (1 << 15))
        word[cut] = [xxh3_64_intdigest(raw[a:b], 42) for a, b in zip(starts[cut].tolist(), ends[cut].tolist())]
    with np.errstate(over="ignore"):
        factor = _PLACE
        n = len(word) - WORDS + 1
        full = mixed(sum((word[i : n + i] * factor[i] for i in range(WORDS)), np.zeros(max(n, 0), U64))) if n > 0 else word[:0]
        out = []
        for a, b in zip(before.tolist(), before[1:].tolist()):
            if b - a >= WORDS:
                out.append(np.unique(full[a : b - WORDS + 1]))
            elif b > a:
                out.append(mixed((word[a:b] * factor[: b - a]).sum(keepdims=True, dtype=U64) + U64(b - a)))
            else:
                out.append(word[:0])
    return out


def set_hash(shingles: np.ndarray) -> int:
    """Signed 64-bit hash of a set of shingles, whatever their order."""
    with np.errstate(over="ignore"):
        total = mixed(shingles * ODD + ODD2).sum(keepdims=True, dtype=U64) + U64(len(shingles))
        return int(mixed(total).view(np.int64)[0])

