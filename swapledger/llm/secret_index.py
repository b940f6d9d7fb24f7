"""Secret scan over a trigram inverted index.

``trigram_query`` reads a rule's regular expression and derives a Boolean query of
trigrams that every match must hold.  A block of documents is indexed once: postings of
just the trigrams that some rule asks for.  Queries intersect and unite postings; only
the documents left are verified with the expression itself.  A rule without mandatory
trigrams scans every document.  Blocks are independent, so the scan needs no shuffle, a
hot source or a very long text stays where it is, and a lost executor repeats its blocks.

Defined results: null text is empty; offsets count characters, the end is exclusive;
matches of one rule never overlap, those of different rules may.  A private key runs from
its BEGIN line to the END line of the same label; where the next line of five dashes is not
that END line, to the last base64 line after BEGIN.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from swapledger.llm.common import fresh, slices, utf8, without


@dataclass(frozen=True)
class Rule:
    """A kind of secret: expression, the group that holds the secret, and its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: What follows a BEGIN line: anything without five dashes up to the END line of the same label (group 1), or else
#: the header lines and base64 that are there: long runs after any line break, quote or comment sign, and lines of nothing else.
_TO_END = r"[^-]*+(?:-{1,4}+(?!-)[^-]*+)*+-----END \1PRIVATE KEY-----"
_HEADERS = r"(?:(?:\s|\\[nr])*+(?:Proc-Type|DEK-Info):\s?[^\s\\]++)*+"
_RUN = r"""(?:\s|\\[nrt]|[\\"'+,>#*|/])*+[A-Za-z0-9+/]{16,}+={0,2}"""
_LINE = r"""(?:[^\S\n]|\\r|["'+,])*+(?:\n|\\n)(?:[^\S\n]|[>#*|"'])*+[A-Za-z0-9+/]++={0,2}(?=[^\S\n]*+(?:\Z|\n|\\[nr]|["']))"""

#: The three base rules, then further ones, in the order in which kinds are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("private_key", rf"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(?:{_TO_END}|{_HEADERS}(?:{_RUN}|{_LINE})*+)"),
    Rule("forge_token", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")
#: Most strings that an alternative is spelled out into, and most characters of a class.
SPELLED, CLASS = 96, 8

Query = tuple | None
"""None: every document; ("tri", t); ("and", [...]); ("or", [...])."""


def _both(a: Query, b: Query) -> Query:
    return b if a is None else a if b is None else ("and", [a, b])


def _holds(strings: set[str]) -> Query:
    """Query that any text with one of the strings satisfies."""
    options = []
    for s in sorted(strings):
        raw = s.lower().encode()
        if len(raw) < 3:
            return None
        options.append(("and", [("tri", raw[i : i + 3]) for i in range(len(raw) - 2)]))
    return ("or", options)


def _spell(item) -> tuple[set[str] | None, Query]:
    """All strings that a piece of a pattern can match (None: too many), and its query."""
    op, arg = item
    if op is C.LITERAL:
        return {chr(arg)}, None
    if op is C.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                chars.add(chr(x))
            elif kind is C.RANGE and x[1] - x[0] < CLASS:
                chars |= {chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= CLASS else (None, None)
    if op is C.SUBPATTERN:
        return _walk(arg[3])
    if op is C.BRANCH:
        strings, queries = set(), []
        for branch in arg[1]:
            s, q = _walk(branch)
            queries.append(q if s is None else _both(q, _holds(s)))
            strings = None if s is None or strings is None else strings | s
        whole = None if any(q is None for q in queries) else ("or", queries)
        return (strings, None) if strings is not None and len(strings) <= SPELLED else (None, whole)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, sub = arg
        s, q = _walk(sub)
        if s is not None and low == 0 and high == 1:
            return s | {""}, None
        if s is not None and low == high and len(s) ** low <= SPELLED:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in s}
            return out, q
        return None, (None if low == 0 else _both(q, _holds(s)) if s is not None else q)
    if op is C.AT:
        return {""}, None
    return None, None


def _walk(items) -> tuple[set[str] | None, Query]:
    """Strings and query of a sequence: strings grow until they would be too many, then become a query."""
    strings: set[str] = {""}
    query, whole = None, True
    for item in items:
        s, q = _spell(item)
        query = _both(query, q)
        if s is not None and len(s) * len(strings) <= SPELLED:
            strings = {a + b for a in strings for b in s}
            continue
        query = _both(query, _holds(strings))
        strings, whole = (s if s is not None else {""}), False
    return (strings, query) if whole else (None, _both(query, _holds(strings)))


def trigram_query(pattern: str) -> Query:
    """Boolean trigram query (lower-case bytes) that every text with a match satisfies."""
    strings, query = _walk(parser.parse(pattern))
    return query if strings is None else _both(query, _holds(strings))


def trigrams(query: Query) -> set[bytes]:
    """The trigrams that a query names."""
    if query is None:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams, query[1]))


def _code(t: bytes) -> int:
    return t[0] << 16 | t[1] << 8 | t[2]


class Index:
    """Postings of the wanted trigrams in one block of documents, on lower-cased bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray):
        low = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        self.n = len(offsets) - 1
        self.postings: dict[int, np.ndarray] = {}
        if len(low) < 3:
            return
        code = low[:-2].astype(np.uint32) << 16 | low[1:-1].astype(np.uint32) << 8 | low[2:]
        at = np.flatnonzero(wanted[code])
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[doc + 1]
        pair = np.unique(code[at[inside]].astype(np.int64) << 32 | doc[inside])
        code, doc = pair >> 32, pair & 0xFFFFFFFF
        cut = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else []
        for a, b in zip(cut, np.r_[cut[1:], len(code)] if len(code) else []):
            self.postings[int(code[a])] = doc[a:b]

    def find(self, query: Query) -> np.ndarray:
        """Sorted numbers of the documents that satisfy a query."""
        if query is None:
            return np.arange(self.n)
        kind, arg = query
        if kind == "tri":
            return self.postings.get(_code(arg), np.zeros(0, np.int64))
        if kind == "or":
            return np.unique(np.concatenate([self.find(q) for q in arg]))
        found = sorted((self.find(q) for q in arg), key=len)
        for other in found[1:]:
            if not len(found[0]):
                break
            found[0] = np.intersect1d(found[0], other, assume_unique=True)
        return found[0]


def _scan(text: str, rules: tuple[Rule, ...], output: str):
    queries = [trigram_query(r.pattern) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << 24, bool)
        wanted[[_code(t) for t in set().union(*map(trigrams, queries))]] = True
        compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        for batch in slices(batches, text, 4_000_000):
            column = batch.column(text)
            index = Index(*utf8(column), wanted)
            texts = column.to_pylist()
            found: list[list[tuple]] = [[] for _ in texts]
            for place, (rule, query, pattern) in enumerate(zip(rules, queries, compiled)):
                for d in index.find(query).tolist():
                    for m in pattern.finditer(texts[d] or ""):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found[d].append((m.start(), place, m.end(), m.start(rule.group), m.end(rule.group)))
            out = []
            for spans in found:
                spans.sort()
                out.append([{"kind": rules[p].kind, "start": a, "end": b, "secret_start": x, "secret_end": y} for a, p, b, x, y in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), *((n, pa.int64()) for n in ("start", "end", "secret_start", "secret_end"))]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, output])

    return run


SPANS = "array<struct<kind:string,start:bigint,end:bigint,secret_start:bigint,secret_end:bigint>>"


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, output: str = "secrets") -> DataFrame:
    """``docs`` with the array ``output`` of all spans, by start, then rule order; a column of that name is replaced."""
    docs = without(docs, [output], text)
    schema = T.StructType([*docs.schema.fields, T.StructField(output, T._parse_datatype_string(SPANS))])
    return docs.mapInArrow(_scan(text, rules, output), schema)


def masked(value: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """Text with each secret (start, end, kind) replaced by <kind>; overlapping ones become one."""
    if not spans:
        return value
    parts, at = [], 0
    for a, b, kind in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            parts += [value[at:a], f"<{kind}>"]
        at = b
    return "".join(parts) + value[at:]


def mask_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by its kind in angle brackets."""
    names = docs.columns
    mark = fresh("_secrets", docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _scan(text, rules, mark)(batches):
            texts = batch.column(text).to_pylist()
            for i, spans in enumerate(batch.column(mark).to_pylist()):
                texts[i] = masked(texts[i], [(s["secret_start"], s["secret_end"], s["kind"]) for s in spans])
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if n == text else batch.column(n) for n in names], names
            )

    return docs.mapInArrow(run, docs.schema)
