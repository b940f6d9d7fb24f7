"""Exact byte-level BPE by backtracking, and decoding with an offset table.

An Aho-Corasick automaton finds every vocabulary token in a piece of text.  The encoder
takes the longest token at each place, checks it against its left neighbour in a
compatibility table, steps to shorter tokens where the pair would have merged otherwise,
and backs up over places from which no token fits; a place is given up at most once, so
the work is linear.  Pieces are the vocabulary's pre-tokens; each worker encodes a
distinct piece once and looks whole batches up at once.

Defined results: null text is empty; the text of a special token is that token, as in the
library; bytes that do not form UTF-8 decode to the replacement character.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from swapledger.llm.common import ranges, slices, utf8, without
from swapledger.llm.piece_memo import PieceMemo
from swapledger.llm.word_tokens import plain_rows, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
#: The vocabulary's pre-tokenizer, as published with it.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_LETTER, _DIGIT, _SIGN = 1, 2, 3
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = _LETTER
_ODD = np.zeros(256, bool)
_ODD[:32] = True
_ODD[[9, 10, 13]] = False
_ODD[[39, 127]] = True
_ODD[0xC2] = True
_ODD[0xC4:] = True
_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        size = 1 + max([*vocab.values(), *special.values()])
        words = [b""] * size
        for t, i in vocab.items():
            words[i] = raw(t)
        for t, i in special.items():
            words[i] = t.encode()
        self.pair: dict[tuple[int, int], int] = {}
        self.made = [-1] * size
        self.halves: list[tuple[int, int] | None] = [None] * size
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.pair[left, right] = rank
            if self.halves[whole] is None:
                self.made[whole], self.halves[whole] = rank, (left, right)
        # Only single bytes and merge results can come out of merging.
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            if len(words[i]) == 1 or self.halves[i] is not None:
                self.automaton.add_word(words[i].decode("latin-1"), (len(words[i]), i))
        self.automaton.make_automaton()
        self.known: dict[tuple[int, int], bool] = {}
        self.pattern = regex.compile(PATTERN)
        self.special = special
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        # Offset table of decoding: the bytes of token i are text[at[i] : at[i + 1]].
        self.text = np.frombuffer(b"".join(words), np.uint8)
        self.at = np.r_[0, np.cumsum([len(w) for w in words])]
        self.memo = PieceMemo(lambda pieces: [np.array(self.piece(p), np.uint32) for p in pieces])

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts of a token along one side, each with the rank of the merge that uses it up."""
        out, until = [], _NEVER
        while True:
            out.append((token, until))
            halves = self.halves[token]
            if halves is None:
                return out
            token, until = halves[side], self.made[token]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b as they are when they stand side by side.

        A merge over the border happens if two border parts form a pair whose rank comes
        before the left one is used up and not after the right one is (the left of two
        equal merges goes first).
        """
        known = self.known.get((a, b))
        if known is None:
            right = self._edge(b, 0)
            known = not any(
                (m := self.pair.get((x, y))) is not None and m < px and m <= py
                for x, px in self._edge(a, 1) for y, py in right
            )
            if len(self.known) > 1_000_000:
                self.known.clear()
            self.known[a, b] = known
        return known

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        n = len(piece)
        fits: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            fits[end + 1 - size].append((end + 1, token))
        dead = bytearray(n + 1)
        out: list[int] = []
        tried: list[tuple[int, int]] = []  # place and choice of each token so far
        place, k = 0, len(fits[0]) - 1 if n else -1
        while place < n:
            while k >= 0:
                end, token = fits[place][k]
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
                k -= 1
            if k >= 0:
                out.append(token)
                tried.append((place, k))
                place = end
                k = len(fits[place]) - 1 if place < n else -1
            else:
                dead[place] = 1
                if not out:
                    raise ValueError("the vocabulary cannot spell this piece")
                out.pop()
                place, k = tried.pop()
                k -= 1
        return out

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text of any kind."""
        ids: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                ids.append(self.special[part])
            else:
                for p in self.pattern.findall(part):
                    ids += self.piece(p.encode())
        return np.array(ids, np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        data, offsets = utf8(column)
        n = len(offsets) - 1
        plain = plain_rows(data, offsets, _ODD)
        begin = self._pieces(data, offsets)
        close = np.r_[begin[1:], len(data)][: len(begin)]
        keep = plain[np.searchsorted(offsets, begin, "right") - 1] if len(begin) else np.zeros(0, bool)
        begin, close = begin[keep], close[keep]
        ids, counts = self.memo.encode(data, begin, close)
        of_text = np.r_[0, np.cumsum(counts)][np.searchsorted(begin, offsets)]
        total = np.diff(of_text)
        if plain.all():
            return ids, total
        parts, at = [], 0
        for i in np.flatnonzero(~plain).tolist():
            own = self.whole(column[i].as_py())
            parts += [ids[of_text[at] : of_text[i]], own]
            total[i], at = len(own), i + 1
        parts.append(ids[of_text[at] : of_text[n]])
        return np.concatenate(parts), total

    @staticmethod
    def _pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of plain texts begin.

        Runs of letters, digits and signs take one space before them along.  A run of
        white space before such a run gives up its last character: to that run if it is a
        space, else as a pre-token of its own.
        """
        kind = _CLASS[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begin = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]] | edge[:-1]) if len(data) else np.zeros(0, np.int64)
        close = np.r_[begin[1:], len(data)][: len(begin)]
        blank, final = kind[begin] == 0, edge[close]
        mark = np.zeros(len(data) + 1, bool)
        run = begin[~blank]
        mark[run - ((data[run - 1] == 32) & ~edge[run])] = True
        a, b = begin[blank & final], close[blank & ~final]
        mark[a] = True
        a = begin[blank & ~final]
        mark[a[b - a > 1]] = True
        mark[b[data[b - 1] != 32] - 1] = True
        return np.flatnonzero(mark[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the decoded text."""
        i = ids.astype(np.int64)
        raw = self.text[ranges(self.at[i], self.at[i + 1] - self.at[i])].tobytes()
        return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBpe:
    """The worker's codec of a vocabulary file."""
    return ByteBpe(path)


def with_bpe(docs: DataFrame, text: str = "text", path: str | None = None, keep: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with ``keep``, ``ids`` and ``decoded``.

    Columns of ``docs`` with these names are replaced; null text is empty and repeated rows
    stay rows of their own; an empty table gives an empty result.
    """
    path = path or vocabulary_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in slices(batches, text, 1_500_000):
            ids, counts = bpe.encode(batch.column(text))
            end = np.cumsum(counts)
            own = [ids[a:b] for a, b in zip((end - counts).tolist(), end.tolist())]
            decoded = [bpe.decode(x) for x in own]
            columns = [
                pa.array(counts, pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own]),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
            ]
            if keep:
                columns += [pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())), pa.array([x.decode() for x in decoded])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *added])

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if keep:
        fields += [("ids", T.ArrayType(T.LongType())), ("decoded", T.StringType())]
    added = [n for n, _ in fields]
    docs = without(docs, added, text)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in fields)]))
