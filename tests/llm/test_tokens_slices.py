"""The tokenizer's slices bound what a worker holds at once."""

import pyarrow as pa

from murmuration.llm.tokens import slices


def test_slices_are_small_and_whole():
    texts = pa.array(["x" * 1000] * 5000)
    found = slices(texts, rows=10_000)
    assert sum(n for _, n in found) == 5000
    assert max(n for _, n in found) * 1000 <= 2 << 20
