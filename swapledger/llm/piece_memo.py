"""Ids of remembered text pieces, looked up for whole batches of pieces at once.

A hash finds the place; the remembered bytes decide.  Pieces whose hash another piece holds
are encoded anew each time, so no piece ever gets another one's ids.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from swapledger.llm.common import ODD, U64, mixed, ranges

#: Distinct pieces, and bytes of them, that a worker remembers before it starts anew.
MOST, MOST_BYTES = 750_000, 16_000_000
_INVERSE = U64(pow(int(ODD), -1, 1 << 64))
_tables: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _tables.get(int(base))
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = _tables[int(base)] = np.cumprod(np.r_[U64(1), np.full(max(n, 1 << 21), base, U64)], dtype=U64)
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; equal spans get equal hashes."""
    if not len(starts):
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, U64)
        total[0] = 0
        np.cumsum((data.astype(U64) + U64(1)) * _powers(ODD, len(data)), dtype=U64, out=total[1:])
        return mixed((total[ends] - total[starts]) * _powers(_INVERSE, len(data) + 1)[starts])


class PieceMemo:
    """Maps pieces (spans of bytes) to runs of ids; ``learn`` encodes pieces seen for the first time."""

    def __init__(self, learn: Callable[[list[bytes]], list[np.ndarray]]):
        self.learn = learn
        self.clear()

    def clear(self) -> None:
        self.slots = np.zeros(1 << 16, U64)
        self.number = np.zeros(1 << 16, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.counts, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0
        self.bytes, self.held = np.zeros(1 << 16, np.uint8), 0
        self.byte_at, self.byte_n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the keys (-1: unknown), by open addressing with linear steps."""
        mask = U64(len(self.slots) - 1)
        at = ((keys >> U64(1)) & mask).astype(np.int64)
        have = self.slots[at]
        found = np.where(have == keys, self.number[at], -1)
        todo = np.flatnonzero((have != keys) & (have != 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & int(mask)
            have, key = self.slots[at], keys[todo]
            hit = have == key
            found[todo[hit]] = self.number[at[hit]]
            on = ~hit & (have != 0)
            todo, at = todo[on], at[on]
        return found

    def _put(self, keys: np.ndarray, number: np.ndarray) -> None:
        mask = len(self.slots) - 1
        at = ((keys >> U64(1)) & U64(mask)).astype(np.int64)
        while len(keys):
            free = self.slots[at] == 0
            self.slots[at[free]] = keys[free]
            placed = self.slots[at] == keys
            self.number[at[placed]] = number[placed]
            keys, number, at = keys[~placed], number[~placed], (at[~placed] + 1) & mask

    def _same(self, number: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each span has the bytes of the remembered piece of that number."""
        size = ends - starts
        same = self.byte_n[number] == size
        at = np.flatnonzero(same & (size > 0))
        if len(at):
            n = size[at]
            equal = self.bytes[ranges(self.byte_at[number[at]], n)] == data[ranges(starts[at], n)]
            same[at] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        return same

    def _append(self, pieces: list[bytes]) -> int:
        """Encode and remember pieces without a way to find them; returns the first one's number."""
        parts = self.learn(pieces)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        long = np.fromiter(map(len, pieces), np.int64, len(pieces))
        total = int(size.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(parts) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            self.byte_at = np.concatenate([self.byte_at, np.zeros_like(self.byte_at)])
            self.byte_n = np.concatenate([self.byte_n, np.zeros_like(self.byte_n)])
        every = int(long.sum())
        while self.held + every > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.bytes[self.held : self.held + every] = np.frombuffer(b"".join(pieces), np.uint8)
        self.byte_at[self.n : self.n + len(parts)] = self.held + np.cumsum(long) - long
        self.byte_n[self.n : self.n + len(parts)] = long
        self.held += every
        if total:
            self.ids[self.used : self.used + total] = np.concatenate(parts)
        self.starts[self.n : self.n + len(parts)] = self.used + np.cumsum(size) - size
        self.counts[self.n : self.n + len(parts)] = size
        first = self.n
        self.used, self.n = self.used + total, self.n + len(parts)
        return first

    def _add(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        number = self._append(pieces) + np.arange(len(pieces))
        if self.n * 3 > len(self.slots):
            old = self.slots != 0
            held, of = self.slots[old], self.number[old]
            self.slots = np.zeros(len(self.slots) * 4, U64)
            self.number = np.zeros(len(self.slots), np.int32)
            self._put(held, of)
        self._put(keys, number)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and the number of ids of each piece."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.n > MOST or self.held > MOST_BYTES:
            self.clear()
        keys = span_hashes(data, starts, ends) | U64(1)
        found = self._find(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            raw = data.tobytes()
            at = missing[first]
            known = self.n
            self._add(new, [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            found[missing] = known + back
        other = np.flatnonzero(~self._same(found, data, starts, ends))
        if len(other):
            spans = [data[a:b].tobytes() for a, b in zip(starts[other].tolist(), ends[other].tolist())]
            distinct = {piece: i for i, piece in enumerate(dict.fromkeys(spans))}
            found[other] = self._append(list(distinct)) + np.array([distinct[s] for s in spans])
        counts = self.counts[found]
        return self.ids[ranges(self.starts[found], counts)], counts
