"""A table of distinct text chunks and their token ids.

Both tokenizers here cut a text at spaces into chunks that no token crosses, so
a chunk's ids do not depend on its neighbours: each distinct chunk is encoded
once per table and every occurrence is a lookup. A table lives in its Python
worker, from one task to the next, and starts anew after ``MOST`` chunks (which
bounds its memory and changes no result).
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Sequence
from itertools import chain, repeat

import numpy as np

MOST = 1_200_000
LONG = 64           # longer chunks are encoded each time, not kept


class ChunkTable(dict):
    """chunk -> row; ``ids`` of row r are flat[at[r]:at[r + 1]]. ``encode`` takes a list of chunks."""

    def __init__(self, encode: Callable[[list], Sequence[Sequence[int]]]):
        super().__init__()
        self.encode = encode
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat, self.at = array("i"), array("q", [0])

    def add(self, chunks: list) -> None:
        for chunk, ids in zip(chunks, self.encode(chunks), strict=True):
            self.flat.extend(ids)
            self[chunk] = len(self.at) - 1
            self.at.append(len(self.flat))

    def join(self, docs: Sequence[Sequence]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each document's chunks in order: (all ids, where each document starts)."""
        if len(self) > MOST or len(self.flat) > 16 * MOST:
            self.reset()
        count = np.fromiter(map(len, docs), np.int64, len(docs))
        words = list(chain.from_iterable(docs))
        rows = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(rows < 0).tolist()
        new = list({words[k] for k in unknown})
        self.add(new)
        rows[unknown] = [self[words[k]] for k in unknown]
        flat, at = np.frombuffer(self.flat, np.int32), np.frombuffer(self.at, np.int64)
        size = at[rows + 1] - at[rows]
        end = np.concatenate(([0], np.cumsum(size)))
        take = np.arange(end[-1]) - np.repeat(end[:-1] - at[rows], size)
        ids = flat[take] if len(take) else np.zeros(0, np.int32)
        for chunk in new:                   # its ids stay until the next reset, without a key
            if len(chunk) > LONG or not isinstance(chunk, str) and len(chunk[0]) > LONG:
                del self[chunk]
        return ids, end[np.concatenate(([0], np.cumsum(count)))]
