"""Private keys are found and masked whole: header, body and END line."""

import random

import pytest

import corpus_pipeline as cp
from swapledger.llm import secret_index as si

ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LINES = ["".join(random.Random(i).choices(ABC, k=64)) for i in range(12)] + ["Zm9vYg=="]
BEGIN, END = "-----BEGIN {}PRIVATE KEY-----", "-----END {}PRIVATE KEY-----"
HEADERS = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"


def pem(label="", lines=LINES, sep="\n", headers=""):
    return sep.join([BEGIN.format(label), *([headers.rstrip("\n"), ""] if headers else []), *lines, END.format(label)])


def without_end(label="", lines=LINES, sep="\n", headers=""):
    return pem(label, lines, sep, headers).rsplit(sep + "-----END", 1)[0]


KEY = "<private_key>"
CASES = {
    "plain": (f"before\n{pem()}\nafter it", f"before\n{KEY}\nafter it"),
    "label": (f"{pem('RSA ')}\nafter it", f"{KEY}\nafter it"),
    "headers": (f"{pem('RSA ', headers=HEADERS)}\nafter it", f"{KEY}\nafter it"),
    "crlf": (f"a\r\n{pem(sep=chr(13) + chr(10))}\r\nafter it", f"a\r\n{KEY}\r\nafter it"),
    "one line": (f"{pem(sep=' ')} after it", f"{KEY} after it"),
    "escaped": ('{"k": "' + pem(sep="\\n") + '\\n", "x": 1}', '{"k": "' + KEY + '\\n", "x": 1}'),
    "indented": ("k:\n" + pem(sep="\n    ") + "\nx: 1", f"k:\n{KEY}\nx: 1"),
    "two": (f"{pem('EC ')}\nand here\n{pem('EC ')}\nend", f"{KEY}\nand here\n{KEY}\nend"),
    "no end": (f"{without_end()}\nafter it, more", f"{KEY}\nafter it, more"),
    "no end, headers": (f"{without_end('RSA ', headers=HEADERS)}\nafter it", f"{KEY}\nafter it"),
    "no end, crlf": (f"{without_end(sep=chr(13) + chr(10))}\r\nafter it", f"{KEY}\r\nafter it"),
    "no end, escaped": ('{"k": "' + without_end(sep="\\n") + '", "x": 1}', '{"k": "' + KEY + '", "x": 1}'),
    "no end, quoted": (f"> {without_end(sep=chr(10) + '> ')}\n> after it", f"> {KEY}\n> after it"),
    "no end, then a key": (f"{without_end()}\nand here\n{pem()}\nend", f"{KEY}\nand here\n{KEY}\nend"),
    "other end": (f"{without_end('EC ')}\n{END.format('RSA ')}\nend", f"{KEY}\n{END.format('RSA ')}\nend"),
    "cut": (without_end(lines=LINES[:3] + [LINES[3][:7]]), KEY),
    "header only": (f"The line {BEGIN.format('')} opens it.", f"The line {KEY} opens it."),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text, "en", "a", len(text)) for i, (text, _) in enumerate(CASES.values())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


def test_no_byte_of_a_key_stays(spark, docs):
    got = {r.doc_id: r for r in cp.secrets(spark, docs, "").collect()}
    for i, (name, (_, want)) in enumerate(CASES.items()):
        assert got[i].text == want, name
        assert got[i].n_chars == len(want)


def test_spans_cover_the_key(docs):
    for r in si.find_secrets(docs).collect():
        keys = [s for s in r.secrets if s.kind == "private_key"]
        assert keys and all(r.text[s.start : s.end].startswith("-----BEGIN ") for s in keys)
        assert all((s.start, s.end) == (s.secret_start, s.secret_end) for s in keys)


def test_query_asks_for_the_header_only():
    rule = next(r for r in si.RULES if r.kind == "private_key")
    header = si.trigram_query(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
    assert si.trigrams(si.trigram_query(rule.pattern)) == si.trigrams(header) != set()
