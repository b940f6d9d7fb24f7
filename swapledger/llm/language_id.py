"""Language identification by words first, with backoff to ever shorter character n-grams.

The model holds, per language, log frequencies of all words and of all character n-grams of
one to five characters (a space stands for the ends of a word) that were counted in a sample
of documents with a language; the sample is bounded by ``SAMPLE``, what is learned from it is not cut.
Only counts that a language has are stored; a language without a token has the log frequency
that all languages together give it.  A text's known words add their log
frequencies; an unknown word adds those of its n-grams: at every place the longest known
one, shortened character by character.  Scores are the posterior of the summed evidence,
each word counting as one observation.

Defined results: null texts and texts without a letter get ``und`` with score 0; with no
learned language every text does; ties go to the language that sorts first; null ids are
learned from or left out like any other id, by ``chosen``; repeated rows count as often as
they come; texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swapledger.llm.common import ODD, U64, mixed, ranges, slices, squeeze, unsqueeze, without
from swapledger.llm.piece_memo import span_hashes

#: Documents of each language that are learned from, about and at most.
SAMPLE = 4_000
LONGEST = 5
#: Tokens of all languages together that are mixed into each language's counts.
PRIOR = 50.0
_LETTERS = np.zeros(0, bool)


def _letters() -> np.ndarray:
    global _LETTERS
    if not len(_LETTERS):
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points (lower case, everything but letters a space), word starts and ends, words before each text."""
    texts = [t.lower() for t in column.fill_null("").to_pylist()]
    points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    edge = np.r_[1, 1 + np.cumsum(size + 1)]
    inside = _letters()[points]
    points = np.where(inside, points, 32)
    step = np.diff(np.r_[False, inside, False].astype(np.int8))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return points, starts, ends, np.searchsorted(starts, edge)


def _hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(points, starts, ends)


def gram_hashes(points: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` code points from each place on."""
    n = max(len(points) - size + 1, 0)
    out = np.full(n, U64(size), U64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = (out + points[i : n + i].astype(U64)) * ODD
            out ^= out >> U64(29)
        return mixed(out)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, list[Counter]] = {}
    for batch in slices(batches, "text", 1_500_000):
        langs = batch.column("lang").to_pylist()
        points, starts, ends, before = words_of(batch.column("text"))
        key = _hashes(points, starts, ends).view(np.int64)
        grams = [gram_hashes(points, g + 1).view(np.int64) for g in range(LONGEST)]
        for i, lang in enumerate(langs):
            mine = total.setdefault(lang, [Counter() for _ in range(LONGEST + 1)])
            a, b = before[i], before[i + 1]
            mine[0].update(key[a:b].tolist())
            for g in range(1, LONGEST + 1):
                # From the space before a word to the one after it.
                at = ranges(starts[a:b] - 1, np.maximum(ends[a:b] - starts[a:b] + 3 - g, 0))
                mine[g].update(grams[g - 1][at].tolist())
    rows = [(lang, kind, k, n) for lang, parts in total.items() for kind, part in enumerate(parts) for k, n in part.items()]
    for a in range(0, len(rows), 50_000):
        lang, kind, key, n = zip(*rows[a : a + 50_000])
        yield pa.RecordBatch.from_pydict({"lang": pa.array(lang), "kind": pa.array(kind, pa.int32()), "key": pa.array(key, pa.int64()), "n": pa.array(n, pa.int64())})


def _packed(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(langs, pa.string())
        for batch in batches:
            kind, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "key"))
            lang = pc.index_in(batch.column("lang"), names).to_numpy(zero_copy_only=False).astype(np.int32)
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.float64)
            for k in np.unique(kind).tolist():
                own = kind == k
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array([k], pa.int32()), "key": [squeeze(key[own])], "lang": [squeeze(lang[own])], "n": [squeeze(n[own])]})

    return run


class Model:
    """Languages, and per kind (0: words, g: n-grams of g) sorted keys with the log frequencies of the languages that have them.

    A language's log frequency of a token is log(n + PRIOR * f) - log(total + PRIOR), where f is the
    token's frequency over all languages.  log(PRIOR * f) is common to all languages and takes no
    part in a comparison, so a key keeps only what each language that counted it adds to that.
    """

    def __init__(self, langs: list[str], parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """``parts``: per kind keys, places of languages, and counts, one entry per key and language."""
        self.langs = langs
        self.keys, self.starts, self.lang, self.gain, self.base = [], [], [], [], []
        for kind in range(LONGEST + 1):
            key, lang, n = parts.pop(kind, (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0)))
            keys, at = np.unique(key, return_inverse=True)
            total = np.bincount(lang, n, len(langs))
            # A language with few rows falls back to the frequencies of all languages: no evidence.
            overall = PRIOR * np.bincount(at, n, len(keys)) / max(n.sum(), 1.0)
            by = np.argsort(at, kind="stable")
            self.keys.append(keys)
            self.starts.append(np.r_[0, np.cumsum(np.bincount(at, minlength=len(keys)))].astype(np.int64))
            self.lang.append(lang[by])
            self.gain.append(np.log1p(n[by] / overall[at[by]]).astype(np.float32))
            self.base.append(-np.log(total + PRIOR))

    def _at(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 for unknown ones."""
        have = self.keys[kind]
        if not len(have):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return np.where(have[at] == keys, at, -1)

    def evidence(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Summed log frequencies per text and language, and the number of words."""
        points, starts, ends, before = words_of(column)
        n, k = len(column), len(self.langs)
        doc = np.repeat(np.arange(n), np.diff(before))
        out = np.zeros((n, k))

        def add(rows: np.ndarray, kind: int, at: np.ndarray, weight: np.ndarray | None = None) -> None:
            out[:] += np.bincount(rows, weight, n)[:, None] * self.base[kind]
            size = np.diff(self.starts[kind])[at]
            some = ranges(self.starts[kind][at], size)
            gain = self.gain[kind][some] if weight is None else self.gain[kind][some] * np.repeat(weight, size)
            out[:] += np.bincount(np.repeat(rows, size) * k + self.lang[kind][some], gain, n * k).reshape(n, k)

        at = self._at(0, _hashes(points, starts, ends).view(np.int64))
        known = at >= 0
        add(doc[known], 0, at[known])
        new = np.flatnonzero(~known)
        if len(new):
            size = ends[new] - starts[new] + 1  # places: the space before the word and its characters
            place = ranges(starts[new] - 1, size)
            word = np.repeat(new, size)
            todo = np.arange(len(place))
            for g in range(LONGEST, 0, -1):
                fits = place[todo] + g <= ends[word[todo]] + 1
                some = todo[fits]
                hit = self._at(g, gram_hashes(points, g)[place[some]].view(np.int64))
                on = hit >= 0
                add(doc[word[some[on]]], g, hit[on], 1.0 / (ends[word[some[on]]] - starts[word[some[on]]] + 1))
                done = np.zeros(len(place), bool)
                done[some[on]] = True
                todo = todo[~done[todo]]
        return out, np.diff(before)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        n = len(column)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        total, words = self.evidence(column)
        best = total.argmax(axis=1)
        with np.errstate(under="ignore"):
            p = np.exp(total - total.max(axis=1, keepdims=True))
        score = p[np.arange(n), best] / p.sum(axis=1)
        return ["und" if not w else self.langs[b] for w, b in zip(words, best)], np.where(words > 0, score, 0.0)


def learn(docs: DataFrame, chosen: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from at most about ``sample`` documents of each language for which ``chosen`` holds."""
    known = docs.where(chosen & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = known.groupBy("lang").count()  # one row per language
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count"))
    some = known.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000)
    counts = some.select("text", "lang").mapInArrow(_count, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    langs = sorted(r["lang"] for r in sizes.collect())
    # What ``sample`` documents of each language hold, as packed columns: few and small rows on the driver.
    packed: dict[int, list] = {}
    for row in counts.mapInArrow(_packed(langs), "kind int, key binary, lang binary, n binary").collect():
        packed.setdefault(row["kind"], []).append(
            (unsqueeze(row["key"], np.int64), unsqueeze(row["lang"], np.int32), unsqueeze(row["n"], np.float64)))
    parts = {kind: tuple(np.concatenate(c) for c in zip(*packed.pop(kind))) for kind in list(packed)}
    return Model(langs, parts)


def with_language(docs: DataFrame, model: Model, text: str = "text", output: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its score; columns of these names are replaced."""
    docs = without(docs, [output, score], text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1_000_000):
            name, p = shared.value.predict(batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name), pa.array(p, pa.float64())], [*batch.schema.names, output, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(output, T.StringType()), T.StructField(score, T.DoubleType())]))
