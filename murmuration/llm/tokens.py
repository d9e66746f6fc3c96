"""Token ids of documents, cut into pieces for packing.

The vocabulary file splits a text into words before it merges bytes, so a word's ids do not
depend on its neighbours. Documents repeat words far more often than they bring new ones, so
each Python worker keeps the ids of words it has met (two generations of at most about
``MEMO_WORDS`` words) and asks the tokenizer only for new ones. A text with longer white-space
runs, where the vocabulary's split looks further than one character, is given to the tokenizer
whole.

Null texts count as empty (the end id alone); texts of any length are encoded whole, in slices of a
bounded size. Repeated rows give repeated pieces, an empty table none. Only the id and text
columns take part, whatever the other columns are called; pieces of equal texts are equal.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

MEMO_WORDS = 400_000
END_ID = 2
if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("token ids are kept as native 32-bit little-endian arrays")
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"   # no apostrophe: it may begin a word part


def _visible_bytes() -> dict[int, int]:
    """Byte-level vocabularies write a byte without a printable sign as a sign from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: 256 + k for k, b in enumerate(hidden)}


class WideSpace(Exception):
    """A white-space run that the split into words may cut."""


class WordMemo(dict):
    """Ids of words met, as bytes; a word not yet met is encoded on its first use."""

    def __init__(self, whole: Tokenizer, size: int):
        super().__init__()
        self.whole, self.model, self.size = whole, whole.model, size
        self.model._resize_cache(0)       # this memo is the cache
        self.visible = _visible_bytes()
        self.space = chr(self.visible[32])
        self.old: dict[str, bytes] = {}

    def renew(self) -> None:
        """Between texts: when full, start a new generation; words in use come back from the old."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()

    def _letters(self, word: str) -> bytes:
        """A run of letters, with or without a space in front: one unit of the vocabulary."""
        if word.isascii():
            sign = self.space + word[1:] if word[0] == " " else word
        else:
            sign = word.encode().decode("latin-1").translate(self.visible)
        return array("I", [t.id for t in self.model.tokenize(sign)]).tobytes()

    def ask(self, text: str) -> bytes:
        (got,) = self.whole.encode_batch_fast([text], add_special_tokens=False)
        return array("I", got.ids).tobytes()

    def __missing__(self, x: str) -> bytes:
        ids = self.old.get(x)
        if ids is None:
            stem = x.rstrip(TAIL)
            if (stem[1:] if stem[:1] == " " else stem).isalpha():
                if len(stem) < len(x):
                    ids = self[stem] + self[x[len(stem):]]
                else:
                    ids = self._letters(x)
            else:
                body = x[1:] if x[:1] == " " else x
                if x != "\n" and (not body or body[0].isspace() or body[-1].isspace()):
                    raise WideSpace
                ids = self.ask(x)
        self[x] = ids
        return ids


class WordTokenizer:
    """``encode`` gives the ids of texts, little-endian unsigned 32-bit, as bytes."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        self.memo = WordMemo(whole, memo_words)

    def _word(self, word: str) -> bytes | None:
        try:
            return self.memo[word]
        except WideSpace:
            return None

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """Arrow splits the texts and numbers their distinct words, each of which is looked up once;
        their ids are then copied to every place in one NumPy gather."""
        self.memo.renew()
        lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(
            texts, "\n", "\0\n\0"), " ", "\0 "), "\0")
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.memo.get, distinct))
        for k, ids in enumerate(known):
            if ids is None:
                known[k] = self._word(distinct[k])
        at = words.indices.to_numpy(zero_copy_only=False)
        sizes = np.fromiter((len(x) // 4 if x is not None else 0 for x in known), np.int64,
                            len(known))
        store = np.frombuffer(b"".join(x for x in known if x is not None), "<u4")
        first = np.cumsum(sizes) - sizes
        long = sizes[at]
        ends = np.concatenate([[0], np.cumsum(long)])
        ids = store[np.repeat(first[at] - ends[:-1], long) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(
            zero_copy_only=False))])
        places = ends[bounds].tolist()
        out = [ids[lo:hi].tobytes() for lo, hi in zip(places, places[1:], strict=False)]
        # texts whose white space the split may cut, or that hold the sign it uses
        odd = pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
        wide = np.array([x is None for x in known], dtype=bool)
        if wide.any():
            hit = np.concatenate([[0], np.cumsum(wide[at])])[bounds]
            odd = odd | (hit[1:] > hit[:-1])
        for k in np.flatnonzero(odd).tolist():
            out[k] = self.memo.ask(texts[k].as_py())
        return out


def slices(texts: pa.StringArray, rows: int = 2000, size: int = 2 << 20) -> list[tuple[int, int]]:
    """(start, rows) of runs of at most ``rows`` texts and about ``size`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    out, lo = [], 0
    while lo < len(texts):
        before = int(ends[lo - 1]) if lo else 0
        hi = int(np.searchsorted(ends, before + size, side="right"))
        hi = min(max(hi, lo + 1), lo + rows, len(texts))
        out.append((lo, hi - lo))
        lo = hi
    return out


_LOADED: dict[str, WordTokenizer] = {}     # one per Python worker and file


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole if it fits, else full pieces of which the
    first takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, id_col: str = "doc_id",
             text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, piece, start, length, ids (binary, little-endian unsigned 32-bit).

    Null text counts as empty (its only id is ``end_id``).
    """
    end = end_id.to_bytes(4, "little")
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer_path)
        for batch in batches:
            for lo, n in slices(batch.column(1)):
                part = batch.slice(lo, n)
                encoded = tok.encode(part.column(1))
                row, piece, start, length, ids = [], [], [], [], []
                for r, body in enumerate(encoded):
                    body += end
                    for k, (s, n) in enumerate(piece_bounds(len(body) // 4, capacity)):
                        row.append(r)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        ids.append(body[4 * s:4 * (s + n)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(ids, pa.binary())],
                    names=[id_col, "piece", "start", "length", "ids"])

    schema = (f"`{id_col}` {id_type.simpleString()}, piece int, start long, length long, "
              "ids binary")
    return (docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
            .mapInArrow(run, schema))
