"""Ids of a public word-level BPE vocabulary for whole texts, by the tokenizers library.

The vocabulary's pre-tokenizer drops white space and cuts a lower-cased text into letter
runs, single digits and runs of other signs.  Plain texts (ASCII and Latin-1 letters, no
apostrophe, no special token) are cut that way for a whole batch at once; the library's
BPE model encodes each distinct piece a worker meets.  All other texts go through the
library's own pipeline as they are.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from swapledger.llm.common import utf8
from swapledger.llm.piece_memo import PieceMemo

_LETTER, _DIGIT, _SIGN = 1, 2, 3
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[48:58] = _DIGIT
_CLASS[97:123] = _LETTER
_CLASS[128:] = _LETTER
_ODD = np.zeros(256, bool)
_ODD[:32] = True
_ODD[[9, 10, 13]] = False
_ODD[[39, 127]] = True
_ODD[0xC2] = True
_ODD[0xC4:] = True


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def plain_rows(data: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Which texts have no ``odd`` byte, none of the two signs among Latin-1 letters and no special token."""
    bad = odd[data]
    after = data[:-1] == 0xC3
    bad[1:] |= after & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    bad[1:] |= (data[:-1] == 60) & (data[1:] == 124)
    seen = np.r_[0, np.cumsum(bad)]
    return seen[offsets[1:]] == seen[offsets[:-1]]


class WordTokens:
    """Encoder for one vocabulary file; one per Python worker (see ``encoder``)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer.from_file(path)
        for t in (self.whole, self.words):
            t.no_truncation()
            t.no_padding()
        self.size = self.whole.get_vocab_size()
        # Pieces are lower-case and composed already; only the BPE model is left to do.
        self.words.normalizer = normalizers.Lowercase()
        self.words.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        self.last = np.zeros(self.size, bool)
        for token, i in self.whole.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.memo = PieceMemo(self._learn)

    def _learn(self, pieces: list[bytes]) -> list[np.ndarray]:
        out = []
        for a in range(0, len(pieces), 1000):
            joined = b" ".join(pieces[a : a + 1000]).decode()
            ids = np.array(self.words.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            out += np.split(ids, np.flatnonzero(self.last[ids])[:-1] + 1)
        if len(out) != len(pieces):
            raise ValueError("the vocabulary marks the ends of words in another way")
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts, one after the other, and the number of ids of each; null is empty."""
        data, offsets = utf8(column)
        n = len(offsets) - 1
        plain = plain_rows(data, offsets, _ODD)
        size = np.diff(offsets)
        low = data.copy()
        low[(data >= 65) & (data <= 90)] += 32
        low[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 32
        kind = _CLASS[low]
        kind[~np.repeat(plain, size)] = 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        turn = np.r_[True, kind[1:] != kind[:-1]] | edge[:-1] | (kind == _DIGIT)
        begin = np.flatnonzero(turn)
        close = np.r_[begin[1:], len(data)]
        keep = kind[begin] > 0 if len(begin) else np.zeros(0, bool)
        begin, close = begin[keep], close[keep]
        ids, counts = self.memo.encode(low, begin, close)
        of_text = np.r_[0, np.cumsum(counts)][np.searchsorted(begin, offsets)]
        total = np.diff(of_text)
        if plain.all():
            return ids, total
        parts, at = [], 0
        for i in np.flatnonzero(~plain).tolist():
            parts.append(ids[of_text[at] : of_text[i]])
            own = np.array(self.whole.encode(column[i].as_py(), add_special_tokens=False).ids, np.uint32)
            parts.append(own)
            total[i], at = len(own), i + 1
        parts.append(ids[of_text[at] : of_text[n]])
        return np.concatenate(parts), total


@lru_cache(maxsize=2)
def encoder(path: str) -> WordTokens:
    """The worker's encoder of a vocabulary file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokens(path)
