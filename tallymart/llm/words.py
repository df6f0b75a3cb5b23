"""Words and their hashes, for the operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: bytes.split() parts at exactly 0x20 and 0x09-0x0D; bytes.lower() changes A-Z only.
SPACES = b" \t\n\x0b\x0c\r"
_MEMO = 1 << 18
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def prefer_small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts can be long: never hand more than ``rows`` of them to Python at once, nor many more than 4 MB."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


class WordHashes(dict):
    """64-bit hash of a word; forgets all when it has met so many, so its size is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        made = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return made

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive words (at most 8), in order."""
    last = len(hashes) - width + 1
    total = np.zeros(max(last, 0), np.uint64)
    for i in range(width):
        total += hashes[i : i + max(last, 0)] * _SPREAD[i]
    return mixed(total)


def texts_as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def per_batch(make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function; ``make`` runs once a task and returns what each batch goes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield step(batch)

    return run


class TextHashes:
    """Word hashes of many texts at once, from running polynomial sums over their bytes.

    A word's hash is the sum of a random number for each byte times a power of
    its place, modulo 2^64, mixed with the word's length.
    """

    _BASE = 0x5851F42D4C957F2D

    def __init__(self) -> None:
        numbers = np.frombuffer(b"".join(blake2b(bytes((i,)), digest_size=8).digest() for i in range(256)), "<u8")
        self.numbers = numbers.astype(np.uint64)
        self.space = np.zeros(256, bool)
        self.space[list(SPACES)] = True
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            size = max(size, 1 << 19)
            self.powers, self.inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b % (1 << 64), np.uint64)])) for b in (self._BASE, pow(self._BASE, -1, 1 << 64)))

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and where each text's words begin, with the end."""
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        self._grow(len(data))
        gap = self.space[data]
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        first, last = edges[0::2], edges[1::2]
        sums = np.cumsum(self.numbers[data] * self.powers[: len(data)])
        hashes = mixed((sums[last - 1] - sums[first - 1]) * self.inverses[first] + (last - first).astype(np.uint64) * _SPREAD[0])
        begins = np.concatenate([[1], 1 + np.cumsum(np.array([len(t) + 1 for t in texts]))])
        return hashes, np.searchsorted(first, begins)


def chunks(texts: list[bytes], size: int = 1 << 18) -> Iterator[list[bytes]]:
    """The texts in order, in lists of about ``size`` bytes; a longer text is a list of its own."""
    some, held = [], 0
    for text in texts:
        if some and held + len(text) > size:
            yield some
            some, held = [], 0
        some.append(text)
        held += len(text) + 1
    if some:
        yield some
