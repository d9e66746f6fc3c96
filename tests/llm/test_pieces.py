"""The piece table against the sentencepiece library."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.llm import pieces
from murmuration.llm.queries import PIECE_MODEL, QUERIES


@pytest.fixture(scope="module")
def table():
    return pieces.PieceTable(PIECE_MODEL)


def ids(x):
    return np.frombuffer(x, "<i4").tolist()


SIGNS = [" ", "  ", "\n", "\t", "\0", "a", "e", "th", "The", "é", "'s", "'", ".", "!!", "12", "²",
         "².", "日本", "🙂", "\r", "\x1c", "▁", "ing", "�", "﷽", "Ā", "क्", "int main(",
         "    ", "​", "zzzz", "aaaaaaa"]


def test_ids_equal_the_library(table):
    rng = random.Random(4)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(32, 0x2FF),
                                      rng.randint(0x300, 0xD7FF), rng.randint(0x1F300, 0x1F6FF)]))
                      for _ in range(rng.randint(1, 20))) for _ in range(4000)]
    texts += ["x" * 30_000, "th" * 20_000 + " " + "日" * 9_000]
    for x, got in zip(texts, table.encode(texts), strict=True):
        assert ids(got) == table.library.encode(x), repr(x[:60])


def test_small_memos_change_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_UNITS", 3)
    monkeypatch.setattr(pieces, "MEMO_PAIRS", 3)
    tab = pieces.PieceTable(PIECE_MODEL)
    for x in ["a new word", "a new sword of words", "words, again a new word"] * 3:
        assert ids(tab.encode([x])[0]) == tab.library.encode(x)


def test_pairs_and_last_tokens_by_definition(table):
    """A pair is compatible if the library keeps the two; a prefix ends in its own last token."""
    rng = random.Random(6)
    lib, test = table.library, table.compatible
    plain = [p for p in table.compatible.scores if p.isalpha()]
    for _ in range(4000):
        a, b = rng.choice(plain), rng.choice(plain)
        # a line break is a sign of no piece: it keeps the model's added space away from the pair
        got = [lib.id_to_piece(k) for k in lib.encode(f"\n{a}{b}")][2:]
        if test.history(a) is not None and test.history(b) is not None:
            assert test(a, b) == (got == [a, b]), (a, b, got)
    for word in ["internationalisation", "thingamajigs", "zzzzqqqéü", "aaaaaaaaaaaaaaaa"]:
        last = table.last_tokens(["▁" + word])
        for k in range(len(word)):
            token = last[k + 2]
            want = lib.id_to_piece(lib.encode(word[:k + 1])[-1])
            assert token < 0 or table.tokens[token] == want


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_awkward_rows(docs, clashing, empty, rows, table):
    lib = table.library
    want = Counter()
    for r in rows:
        k = lib.encode(r[1] or "")
        want[r[0], tuple(k), lib.decode(k)] += 1
    for df in (docs, clashing):
        out = pieces.encode(df, PIECE_MODEL, decoded=True)
        assert Counter((r[0], tuple(r[1]), r[2]) for r in out.collect()) == want
    assert pieces.encode(empty, PIECE_MODEL).collect() == []
    back = pieces.decode(pieces.encode(docs, PIECE_MODEL), PIECE_MODEL)
    assert Counter(map(tuple, back.collect())) == Counter((r[0], (r[1] or "")) for r in rows)
    none = docs.select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert {r["decoded"] for r in pieces.decode(none, PIECE_MODEL).collect()} == {""}


def test_query(spark, sf001, table):
    lib = table.library
    got = {r["doc_id"]: r for r in QUERIES["op12_pieces"](spark, sf001).collect()}
    docs = spark.read.parquet(f"{sf001}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        k = lib.encode(d["text"] or "")
        assert tuple(got[d["doc_id"]])[1:] == (len(k), digest(",".join(map(str, k))),
                                               digest(lib.decode(k)))
