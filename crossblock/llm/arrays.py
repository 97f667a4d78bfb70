"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

Texts of a batch are taken in chunks of bounded size (a longer text is a chunk of its own), so
a task's memory follows its longest text and not its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(MULTIPLIER, -1, 1 << 64)
#: ASCII white space: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Chunk:
    """Texts first..first+n of a batch; text i is data[edges[i]:edges[i + 1]]."""

    first: int
    edges: np.ndarray
    data: np.ndarray

    @property
    def n(self) -> int:
        return len(self.edges) - 1


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of whole texts; missing texts are empty."""
    if not len(column):
        return
    filled = pc.fill_null(pc.cast(column, pa.large_string()), "")
    filled = pa.concat_arrays([filled])
    _, where, held = filled.buffers()
    edges = np.frombuffer(where, dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(filled):
        high = int(np.searchsorted(edges, edges[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), len(filled))
        yield Chunk(low, edges[low : high + 1] - edges[low], data[edges[low] : edges[high]])
        low = high


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, MULTIPLIER, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@lru_cache(maxsize=2)
def _byte_values(fold_case: bool) -> np.ndarray:
    values = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
    if fold_case:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


@dataclass(frozen=True)
class Words:
    """starts and ends in the chunk's bytes; words of text i are edges[i]:edges[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    edges: np.ndarray


def words(chunk: Chunk) -> Words:
    solid = np.empty(len(chunk.data) + 2, dtype=bool)
    solid[0] = solid[-1] = False
    np.logical_not(SPACE[chunk.data], out=solid[1:-1])
    begin = solid[1:-1] & ~solid[:-2]
    finish = solid[1:-1] & ~solid[2:]
    # A word ends with its text even where the next text goes on without a space.
    inner = chunk.edges[(chunk.edges > 0) & (chunk.edges < len(chunk.data))]
    begin[inner] = solid[1:-1][inner]
    finish[inner - 1] = solid[1:-1][inner - 1]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, chunk.edges))


def word_hashes(chunk: Chunk, found: Words, fold_case: bool = True) -> np.ndarray:
    """64-bit hashes of the words' bytes, ASCII letters in either case alike if asked."""
    n = len(chunk.data) + 1
    up, down = _powers(1 << max(20, (n - 1).bit_length()))
    sums = np.zeros(n, np.uint64)
    np.cumsum(_byte_values(fold_case)[chunk.data] * up[: n - 1], out=sums[1:])
    return mix((sums[found.ends] - sums[found.starts]) * down[found.starts])
