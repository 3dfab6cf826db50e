"""A 64-bit mixer for arrays, and filters that tell which keys of a large table can have a partner.

A filter is a Bloom filter of one 64-bit word per key: every key sets three bits of the word that its hash names.
Tasks set the bits of their own keys, words are merged with ``bit_or`` before and after the shuffle, and
only the words reach the driver: at most ``most_words``, however many keys there are. Keys beyond that make the
filter less selective, never wrong: whatever passes is still joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_WORDS = 1 << 20  # 8 MB
_KEYS_PER_WORD = 5
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _places(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each key and its bits in there."""
    h = mix(keys.view(_U) + _U(0x9E3779B97F4A7C15))
    bits = np.zeros(len(h), _U)
    for shift in (0, 6, 12):
        bits |= _U(1) << ((h >> _U(shift)) & _U(63))
    return ((h >> _U(20)) % _U(words)).astype(np.int64), bits


def key_filter(keys: DataFrame, expected: int, most_words: int = MOST_WORDS) -> np.ndarray:
    """The words of a filter for the column ``key`` (long, without nulls) of ``keys``; expected: about how many distinct keys it has."""
    words = 1
    while words < min(most_words, expected / _KEYS_PER_WORD):
        words *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(words, _U)
        for batch in batches:
            at, bits = _places(batch["key"].to_numpy(zero_copy_only=False), words)
            np.bitwise_or.at(own, at, bits)
        used = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(own[used].view(np.int64))], names=["word", "bits"])

    rows = keys.select("key").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False for keys that are surely not in the filter."""
    at, bits = _places(keys, len(words))
    return (words.view(_U)[at] & bits) == bits
