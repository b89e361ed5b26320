"""Keyed uniform numbers: a pure function of (seed, stream, unit key, replicate).

``rand(seed)`` depends on partitioning and on retries, so it can neither be replayed nor checked
from another engine. Here a unit gets bits of an md5 over (seed, stream, key), which any engine with md5
reproduces. For a single number 32 bits will do; a stream of numbers, one per replicate, belongs to 64 bits of the unit, so that no two units
share a stream at any size. The replicate number is a counter that is mixed in with plain 32-bit integer arithmetic, one half of the unit
after the other.

The unit number refers to the key once and is never NULL: a filter or an inferred IS NOT NULL that
Catalyst pushes below it therefore stays one small expression.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
# Fixed value: multiplier of a widely used public-domain 32-bit integer mixer.
MULTIPLIER = 0x45D9F3B

# Draws below this weight are compared with every cut, the few others are looked up.
COMMON = 4

# Independent streams, so that one seed never reuses a number for two purposes.
STREAM_SPLIT = 1
STREAM_RANDOM_PICK = 2
STREAM_BOOTSTRAP = 3
STREAM_FOLD = 4
STREAM_HONEST = 5
STREAM_DRAW = 6
STREAM_RESAMPLE = 7


def mix_column(h: Column) -> Column:
    for _ in range(2):
        h = (h.bitwiseXOR(F.shiftrightunsigned(h, 16)) * F.lit(MULTIPLIER)).bitwiseAND(F.lit(MASK))
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16))


def mix_array(h: np.ndarray, inplace: bool = False) -> np.ndarray:
    """The same round on uint32 arrays (products wrap at 32 bits by themselves)."""
    h = h if inplace else h.copy()
    shifted = np.empty_like(h)
    for _ in range(2):
        np.right_shift(h, np.uint32(16), out=shifted)
        np.bitwise_xor(h, shifted, out=h)
        np.multiply(h, np.uint32(MULTIPLIER), out=h)
    np.right_shift(h, np.uint32(16), out=shifted)
    return np.bitwise_xor(h, shifted, out=h)


def unit_prefix(seed: int, stream: int) -> str:
    return f"{seed}:{stream}"


def unit_hash(key: str | Column, seed: int, stream: int) -> Column:
    """A uniform bigint in [0, 2^32) that depends on the unit key only."""
    column = F.col(key) if isinstance(key, str) else key
    text = F.concat_ws(":", F.lit(unit_prefix(seed, stream)), column.cast("string"))
    leading = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.coalesce(leading, F.lit(0).cast("bigint"))


def wide_hash(key: str | Column, seed: int, stream: int) -> Column:
    """A uniform bigint in [0, 2^60), for numbers that 32 bits are too coarse for."""
    column = F.col(key) if isinstance(key, str) else key
    text = F.concat_ws(":", F.lit(unit_prefix(seed, stream)), column.cast("string"))
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


def stream_id(key: str | Column, seed: int, stream: int) -> Column:
    """64 uniform bits of the unit key as a bigint: the identity of its stream of numbers."""
    column = F.col(key) if isinstance(key, str) else key
    text = F.md5(F.concat_ws(":", F.lit(unit_prefix(seed, stream)), column.cast("string")))
    high, low = (F.conv(F.substring(text, at, 8), 16, 10).cast("bigint") for at in (1, 9))
    return F.coalesce(F.shiftleft(high, 32).bitwiseOR(low), F.lit(0).cast("bigint"))


def draw_column(unit: Column, word: Column) -> Column:
    """The number in [0, 2^32) at the place ``word`` of the unit's stream; pass plain columns, the expression repeats them."""
    first = mix_column(unit.bitwiseAND(F.lit(MASK)).bitwiseXOR(word))
    return mix_column(first.bitwiseXOR(F.shiftrightunsigned(unit, 32)))


def draw_matrix(units: np.ndarray, words: np.ndarray, by_replicate: bool = False) -> np.ndarray:
    """The same for all pairs: units (int64) as rows and replicates as columns, or the other way round."""
    units = units.view(np.uint64)
    low, high = (units & np.uint64(MASK)).astype(np.uint32), (units >> np.uint64(32)).astype(np.uint32)
    if by_replicate:
        low, high, words = low[None, :], high[None, :], words[:, None]
    else:
        low, high, words = low[:, None], high[:, None], words[None, :]
    h = mix_array(low ^ words, inplace=True)
    np.bitwise_xor(h, high, out=h)
    return mix_array(h, inplace=True)


def poisson_cuts(rate: float = 1.0) -> tuple[int, ...]:
    """Cumulative Poisson probabilities, ``rate`` at most 1, on the 32-bit scale; above the last one the tail is < 2^-32."""
    cuts, total = [], 0.0
    for i in range(12):
        total += math.exp(-rate) * rate**i / math.factorial(i)
        cuts.append(int(total * 2**32))
    return tuple(cuts)


def poisson_weight(h: Column, rate: float = 1.0) -> Column:
    """Inverse-CDF Poisson draw; pass a plain column, the expression repeats it."""
    cuts = poisson_cuts(rate)
    weight = F.lit(len(cuts))
    for value, cut in reversed(list(enumerate(cuts))):
        weight = F.when(h < F.lit(cut), F.lit(value)).otherwise(weight)
    return weight


def poisson_matrix(units: np.ndarray, words: np.ndarray, rate: float = 1.0, by_replicate: bool = False) -> np.ndarray:
    """Weights of every pair of unit and replicate."""
    h = draw_matrix(units, words, by_replicate)
    weight = np.zeros(h.shape, dtype=np.int8)
    cuts = [np.uint32(cut) for cut in poisson_cuts(rate) if cut <= MASK]  # no number lies above a larger one
    above = np.empty(h.shape, dtype=bool)
    for cut in cuts[:COMMON]:
        np.greater_equal(h, cut, out=above)
        np.add(weight, above.view(np.int8), out=weight)
    if len(cuts) > COMMON:  # few draws reach the later cuts
        places = np.flatnonzero(weight.ravel() == COMMON)
        weight.ravel()[places] = np.searchsorted(np.array(cuts), h.ravel()[places], side="right")
    return weight


def replicate_words(n_replicates: int) -> np.ndarray:
    """One 32-bit word per replicate; a unit's draw mixes it with the unit's 64 bits."""
    return mix_array(np.arange(n_replicates, dtype=np.uint32))
