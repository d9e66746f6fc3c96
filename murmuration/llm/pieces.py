"""SentencePiece encoding and decoding of documents with a merge-type (BPE) model.

Merging joins the neighbouring symbols of best score until none are left to join. The result has
a property that makes a table possible: the encoding of a prefix is what the encoding of the whole
would be if it were cut there, so every prefix has one last token, and a token t may follow the
last token p of the prefix before it exactly if p and t, merged alone, stay two tokens. The table
stores the unique last token of each prefix: an Aho-Corasick automaton over the vocabulary lists
the pieces that end at a position, and the one that is compatible with the last token of the
prefix before it is kept (if none is, the last token is the single character, written as bytes).
The ids are then recovered backwards from the end. Each character costs its few matches, whatever
the length of the text.

Two tokens are compatible if no merge ever crosses their border. Each token has one merge history
(score, left end, right end after the merge); walking the two histories in the order of their
scores shows every pair of symbols that meets at the border and whether it would have merged
before one of its sides grew. Results of pair tests are kept in a bounded memo.

The text is first normalised by the model's own rules and cut where no piece of the vocabulary
can reach across (found from the vocabulary when it is loaded: before a word, between letters and
other signs, at a sign that no piece holds). Such units repeat, so a worker keeps the ids of
units it met in a bounded memo and runs the table over the new ones of a slice together.

``encode`` gives the library's ids (no begin or end ids, no sampling); ``decode`` hands ids back to
the library's decoder. Null texts count as empty, which has no ids and decodes to the empty text.
Texts of any length are encoded whole. Repeated rows give repeated results, an empty table none.
Only the id and text columns take part, whatever the other columns are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO_UNITS = 200_000       # units a worker keeps, twice at most
MEMO_PAIRS = 500_000
SLICE_ROWS = 256
SPACE = "▁"           # how pieces write a space
NEVER = float("-inf")
START, OPEN = -2, -1       # table entries: the start of a unit, a prefix without its token yet
Merge = tuple[float, str, str]      # score, and the left and right end after the merge


class PairTest:
    """Whether two tokens stay two when merged alone."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.histories: dict[str, list[Merge] | None] = {}

    def history(self, token: str) -> list[Merge] | None:
        """The merges that make ``token`` of its characters, in order; None if they do not."""
        if token not in self.histories:
            parts, merges = list(token), []
            while len(parts) > 1:
                best, at = NEVER, -1
                for k in range(len(parts) - 1):
                    s = self.scores.get(parts[k] + parts[k + 1])
                    if s is not None and s > best:
                        best, at = s, k
                if at < 0:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
                merges.append((best, parts[0], parts[-1]))
            self.histories[token] = merges if len(parts) == 1 else None
        return self.histories[token]

    def __call__(self, left: str, right: str) -> bool:
        mine, other = self.history(left), self.history(right)
        if mine is None or other is None:
            return False
        x, y, i, j = left[-1], right[0], 0, 0
        while True:
            cross = self.scores.get(x + y)
            a = mine[i][0] if i < len(mine) else NEVER
            b = other[j][0] if j < len(other) else NEVER
            if cross is not None and cross > a and cross >= b:   # ties: the leftmost merges first
                return False
            if a == b == NEVER:
                return True
            if a >= b:
                x = mine[i][2]
                i += 1
            else:
                y = other[j][1]
                j += 1


class PieceTable:
    """``encode`` gives the ids of a text as little-endian 32-bit integers."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        byte_ids = [k for k in range(lib.get_piece_size()) if lib.is_byte(k)]
        if len(byte_ids) != 256:
            raise ValueError("the model must write unknown characters as bytes")
        self.bytes = {int(lib.id_to_piece(k)[3:5], 16): k for k in byte_ids}
        ids = {lib.id_to_piece(k): k for k in range(lib.get_piece_size())
               if not (lib.is_control(k) or lib.is_unknown(k) or lib.is_byte(k)
                       or lib.is_unused(k))}
        # tokens by number: the pieces, then characters outside the vocabulary as they are met
        self.tokens = list(ids)
        self.lengths = [len(p) for p in ids]
        self.parts = [np.array([k], "<i4").tobytes() for k in ids.values()]
        self.strange: dict[str, int] = {}
        self.compatible = PairTest({p: lib.get_score(k) for p, k in ids.items()})
        self.follow: list[dict[int, bool]] = [{} for _ in ids]   # per token, pair tests made
        self.tested = 0
        self.automaton = ahocorasick.Automaton()
        for number, piece in enumerate(ids):
            self.automaton.add_word(piece, number)
        self.automaton.make_automaton()
        self.units, self.border = self._cuts(list(ids))
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _cuts(pieces: list[str]) -> tuple[re.Pattern, str]:
        """The finest split that leaves every piece whole, and a sign that no piece holds."""
        held = set("".join(pieces))
        border = next(c for c in ["\n", "\0", *map(chr, range(0xE000, 0xF8FF))] if c not in held)
        odd = re.escape("".join(c for c in held if re.match(r"[^\W\d_]", c) and not c.isalpha()))
        letter, other = rf"[^\W\d_{odd}]", rf"(?:[\W\d_{odd}](?<![{SPACE}{border}]))"
        for pattern in (rf"{SPACE}*(?:{letter}+|{other}+)|{SPACE}+|{border}",
                        rf"{SPACE}*[^{SPACE}{border}]+|{SPACE}+|{border}"):
            units = re.compile(pattern)
            if all(units.fullmatch(p) and len(units.findall(p)) == 1 for p in pieces):
                return units, border
        return re.compile(rf"[^{border}]+|{border}"), border

    def _stranger(self, char: str) -> int:
        """The number of a character outside the vocabulary."""
        if char not in self.strange:
            self.strange[char] = len(self.tokens)
            self.tokens.append(char)
            self.lengths.append(1)
            self.follow.append({})
            self.parts.append(np.array([self.bytes[b] for b in char.encode()], "<i4").tobytes())
        return self.strange[char]

    def last_tokens(self, units: list[str]) -> list[int]:
        """The table of the units, one after the other: per unit ``START``, then per character the
        last token of the prefix that it ends."""
        last = []
        for unit in units:
            last.append(START)
            last += [OPEN] * len(unit)
        text, lengths, follow = self.border.join(units), self.lengths, self.follow
        for end, number in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            at = end - lengths[number]
            before = last[at]
            if before < 0:
                if before == START:
                    if self.compatible.history(self.tokens[number]) is not None:
                        last[end] = number
                    continue
                # no piece that ends there fits: the character stands alone
                before = last[at] = self._stranger(text[at - 1])
            good = follow[before].get(number)
            if good is None:
                good = self._test(before, number)
            if good:
                last[end] = number
        return last

    def _test(self, before: int, number: int) -> bool:
        good = self.compatible(self.tokens[before], self.tokens[number])
        self.follow[before][number] = good
        self.tested += 1
        return good

    def _learn(self, units: list[str]) -> None:
        """Ids of units not met before, by one table over all of them."""
        last, parts, lengths = self.last_tokens(units), self.parts, self.lengths
        end = -1
        for unit in units:
            start, end = end + 1, end + 1 + len(unit)
            at, found = end, []
            while at > start:
                token = last[at]
                if token == OPEN:
                    token = self._stranger(unit[at - start - 1])
                found.append(parts[token])
                at -= lengths[token]
            found.reverse()
            self.memo[unit] = b"".join(found)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO_UNITS:       # units in use come back from the old generation
            self.old, self.memo = self.memo, {}
        if self.tested > MEMO_PAIRS:
            self.follow = [{} for _ in self.tokens]
            self.tested = 0
        memo, old = self.memo, self.old
        cut = [self.units.findall(self.library.normalize(x)) if x else [] for x in texts]
        wanted = {u for units in cut for u in units if u not in memo}
        new = []
        for u in wanted:
            if u in old:
                memo[u] = old[u]
            elif u == self.border:
                memo[u] = self.parts[self._stranger(u)]
            else:
                new.append(u)
        if new:
            self._learn(new)
        return [b"".join(map(memo.__getitem__, units)) for units in cut]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return [self.library.decode(x.tolist()) if len(x) else "" for x in ids]


_LOADED: dict[str, PieceTable] = {}     # one per Python worker and file


def _table(path: str) -> PieceTable:
    if path not in _LOADED:
        _LOADED[path] = PieceTable(path)
    return _LOADED[path]


def _id_lists(encoded: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *[len(x) // 4 for x in encoded]])
    values = np.frombuffer(b"".join(encoded), "<i4")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
           decoded: bool = False) -> DataFrame:
    """One row per document: id and ``ids`` (array<int>); with ``decoded`` also the text that the
    ids decode to, in the same pass."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = _table(model_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                encoded = tab.encode(part.column(1).to_pylist())
                out = [part.column(0), _id_lists(encoded)]
                if decoded:
                    ids = [np.frombuffer(x, "<i4") for x in encoded]
                    out.append(pa.array(tab.decode(ids), pa.string()))
                yield pa.RecordBatch.from_arrays(
                    out, names=[id_col, "ids", "decoded"][:len(out)])

    schema = f"`{id_col}` {kind}, ids array<int>" + (", decoded string" if decoded else "")
    return (docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
            .mapInArrow(run, schema))


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """One row per row: id and the ``decoded`` text of its ids (null ids: empty)."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = _table(model_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                lists = part.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ids = np.split(flat, np.cumsum(sizes)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(tab.decode(ids), pa.string())],
                    names=[id_col, "decoded"])

    return (rows.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("_ids"))
            .mapInArrow(run, f"`{id_col}` {kind}, decoded string"))
