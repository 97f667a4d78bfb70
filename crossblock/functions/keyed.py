"""Random draws as functions of (seed, key): the same under any partitioning.

Two kinds. `digest` and `uniform` go through md5 and serve orderings and single
draws. `mix32` is a 32-bit integer finaliser for the many draws of a bootstrap: one
md5 per block, then a few integer operations per replicate, all inside generated code.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the integer mixing step.
MULTIPLIER = 0x45D9F3B
GOLDEN = 0x9E3779B1
MASK = 0xFFFFFFFF

#: Cumulative Poisson(1) probabilities scaled to 32 bits; weight = how many are <= the draw.
POISSON = [
    math.floor(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) * 2**32)
    for k in range(11)
]


def _text(part: str | Column) -> Column:
    return (F.col(part) if isinstance(part, str) else part).cast("string")


def digest(seed: int | str, *parts: str | Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *map(_text, parts)))


def word(hex_digest: Column, index: int = 0) -> Column:
    """The index-th 32-bit word of a digest, as a long."""
    return F.conv(F.substring(hex_digest, 1 + 8 * index, 8), 16, 10).cast("long")


def uniform(seed: int | str, *parts: str | Column) -> Column:
    return word(digest(seed, *parts)) / F.lit(float(2**32))


def index_draw(size: Column, seed: int | str, *parts: str | Column) -> Column:
    """An index below `size` from 52 bits, so that every index up to 2^52 can be drawn."""
    share = F.conv(F.substring(digest(seed, *parts), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
    return F.floor(share * size)


def stable_seed(base: int, *parts: str | Column) -> Column:
    """A non-negative 31-bit seed from strings, equal in every process."""
    joined = F.concat_ws("\x1f", *map(_text, parts))
    head = F.conv(F.substring(F.sha2(joined, 256), 1, 8), 16, 10).cast("long")
    return F.pmod(head + F.lit(base), F.lit(2**31)).cast("long")


def mix32(x: Column) -> Column:
    for _ in range(2):
        x = (F.shiftrightunsigned(x, 16).bitwiseXOR(x) * F.lit(MULTIPLIER)).bitwiseAND(F.lit(MASK))
    return F.shiftrightunsigned(x, 16).bitwiseXOR(x)


def first_mix(word0: Column, replicate: Column) -> Column:
    spread = replicate.cast("long") * F.lit(GOLDEN)
    return mix32((word0 + spread).bitwiseAND(F.lit(MASK)))


def poisson_weight(draw: Column) -> Column:
    weight = F.when(draw < F.lit(POISSON[0]), F.lit(0.0))
    for k, edge in enumerate(POISSON[1:], start=1):
        weight = weight.when(draw < F.lit(edge), F.lit(float(k)))
    return weight.otherwise(F.lit(float(len(POISSON))))


# The same arithmetic on numpy arrays, for the matrix form of the bootstrap.


def np_mix32(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = ((x >> np.uint32(16)) ^ x) * np.uint32(MULTIPLIER)
    return (x >> np.uint32(16)) ^ x


def np_first_mix(word0: np.ndarray, n_boot: int) -> np.ndarray:
    spread = np.arange(n_boot, dtype=np.uint32) * np.uint32(GOLDEN)
    return np_mix32(word0.astype(np.uint32)[:, None] + spread[None, :])


def np_poisson(draw: np.ndarray) -> np.ndarray:
    weight = np.zeros(draw.shape, dtype=np.uint8)
    for edge in POISSON:
        weight += draw >= np.uint32(min(edge, MASK))
    return weight.astype(np.float64)
