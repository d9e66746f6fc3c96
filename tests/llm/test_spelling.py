"""Spelling variants against deletion neighbourhoods in Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from murmuration.llm import spelling
from murmuration.llm.queries import QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(rows, least=5):
    total = Counter()
    for r in rows:
        for run in RUN.findall(r[1] or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 6:
                total[w] += 1
    return {w: n for w, n in total.items() if n >= least}


def plain_near(words):
    """Each word's near words: equal after one deletion on one side or at one place on both."""
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[w[:k], w[k + 1:]].add(w)
            if (shorter := w[:k] + w[k + 1:]) in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    return near


def plain_variants(words):
    near, form = plain_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], words.get(form[w]), root)
    return out


def got(df):
    rows = df.collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def typos():
    """Texts of few stems with many spellings, plus accents, hot words and odd rows."""
    rng = random.Random(2)
    stems = ["".join(rng.choice("abcdeéÿÀ") for _ in range(rng.randint(6, 9))) for _ in range(12)]
    words = []
    for s in stems:
        words += [s] * 130
        for _ in range(40):
            k = rng.randrange(len(s))
            words += [rng.choice([s[:k] + rng.choice("abcdeé") + s[k + 1:], s[:k] + s[k + 1:],
                                  s[:k] + "b" + s[k:]])] * rng.choice([3, 5, 9, 30])
    words += ["hothot"] * 3000 + ["chainaa"] * 600 + ["chainab"] * 70 + ["chainbb"] * 11
    rng.shuffle(words)
    rows = [(k, rng.choice(" ,\n1;.7ß×").join(words[k::60]), "en", "s", 1) for k in range(60)]
    return rows + [(None, "nullid nullid " * 40, None, None, None), (90, None, "en", "s", 1),
                   (91, "", "en", "s", 1), (92, "日本 ABCdef-abcDEF " * 300, "en", "s", 1)] * 2


@pytest.mark.parametrize("block,groups", [(512, None), (3, 2), (4, 6)])
def test_matches_brute_force(spark, typos, block, groups, monkeypatch):
    df = spark.createDataFrame(typos, "doc_id long, text string, lang string, source string, "
                                      "n_chars long").repartition(4)
    want = plain_variants(plain_words(typos))
    pairs = spelling.near_pairs
    monkeypatch.setattr(spelling, "near_pairs", lambda w: pairs(w, block, groups))
    assert got(spelling.variants(df)) == want
    assert any(v[4] != k and v[4] != v[2] for k, v in want.items())     # chains occur


def test_awkward_rows(spark, docs, clashing, empty, rows):
    want = plain_variants(plain_words(rows))
    assert got(spelling.variants(docs)) == want
    assert got(spelling.variants(clashing)) == want
    assert spelling.variants(empty).collect() == []


def test_one_edit():
    rng = random.Random(1)
    for n in (6, 7):
        a = ["".join(rng.choice("ab") for _ in range(n)) for _ in range(400)]
        b = ["".join(rng.choice("ab") for _ in range(6)) for _ in range(400)]
        ca, cb = (np.array(x).view("<u4").reshape(len(x), -1) for x in (a, b))
        want = [sum(x != y for x, y in zip(s, t, strict=True)) == 1 if n == 6 else
                any(s[:k] + s[k + 1:] == t for k in range(n)) for s, t in zip(a, b, strict=True)]
        assert spelling.one_edit(ca, cb).tolist() == want


def test_query(spark, sf001):
    rows = [(r["doc_id"], r["text"]) for r in
            spark.read.parquet(f"{sf001}/documents.parquet").collect()]
    assert got(QUERIES["op11_spelling"](spark, sf001)) == plain_variants(plain_words(rows))
