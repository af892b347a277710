"""Texts of an Arrow batch as one array of code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MAX_CHARS = 1_000_000  # of one block, unless a single text is longer
CODE_POINTS = 0x110000


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive texts (null as empty) as (number of texts, code points, ends): text i of a
    block is codes[ends[i - 1] : ends[i]]."""
    held: list[str] = []
    size = 0
    for t in texts:
        s = t.as_py() or ""
        if held and size + len(s) > MAX_CHARS:
            yield _block(held)
            held, size = [], 0
        held.append(s)
        size += len(s)
    if held:
        yield _block(held)


def _block(held: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
    return len(held), codes, np.cumsum([len(s) for s in held])
