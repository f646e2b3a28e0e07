"""Words of text as numbers, and a filter of bounded size that says which keys are worth counting.

Texts come as UTF-8 bytes: every separator of the operators that use this is one ASCII byte, so
bytes can be cut where code points would be. A task numbers the words it meets (``Numbering``), works
on arrays of numbers, and writes words back only for what it emits.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a filter in bits: 8 MB, whatever the corpus holds.
FILTER_BITS = 1 << 26
#: Multipliers that put the hashes of a key's parts in order (exact in 64 bits).
FACTORS = (1, 31337, 7919, 104729)


class Numbering:
    """Numbers for byte strings, in the order they are first met."""

    def __init__(self):
        self._numbers: dict[bytes, int] = {}

    def __len__(self) -> int:
        return len(self._numbers)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        coded = pa.array(words, pa.binary()).dictionary_encode()
        numbers = self._numbers
        own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in coded.dictionary.to_pylist()), np.int64,
                          len(coded.dictionary))
        return own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.empty(0, np.int64)

    def words(self) -> list[bytes]:
        return list(self._numbers)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def combined(parts: list) -> np.ndarray:
    """Place in a filter of a key from the hashes of its parts (numbers or arrays)."""
    return sum(p * f for p, f in zip(parts, FACTORS)) % FILTER_BITS


def filter_place(*parts: Column) -> Column:
    """``combined`` of the parts' bytes, in Spark."""
    total = sum((F.crc32(p.cast("binary")) * F.lit(f) for p, f in zip(parts, FACTORS)), F.lit(0).cast("long"))
    return F.pmod(total, F.lit(FILTER_BITS))


def key_filter(df: DataFrame, *parts: Column) -> Broadcast:
    """A broadcast bit array of ``FILTER_BITS`` bits in which the place of every key of ``df`` is set.

    No key of ``df`` is ever missed; another key may share a place with one, which costs work, not
    results, since whatever passes is counted exactly afterwards. Spark sets the bits; the driver gets
    at most ``FILTER_BITS`` of them, never the keys.
    """
    place = filter_place(*parts) + F.lit(1)
    rows = (df.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect())
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["bucket"] - 1) * len(part)
        out[at:at + len(part)] = part[:len(out) - at]
    return df.sparkSession.sparkContext.broadcast(out)


def passes(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
