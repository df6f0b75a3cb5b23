"""Terms of texts for search and decontamination: digits, letters (A-Z lower-cased) and all that is not ASCII."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Characters that terms are made of, as a pattern over texts whose A-Z are lower-cased.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def term_lists(text: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, a list for about every ``size`` bytes."""
    plain = text.translate(_TABLE)
    start = 0
    while len(plain) - start > size and (end := plain.find(b" ", start + size)) >= 0:
        yield plain[start:end].split()
        start = end
    yield plain[start:].split() if start else plain.split()


def terms(text: Column) -> Column:
    """The same terms as an array column; null for null."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(PATTERN), F.lit(0))


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


class Numbers(dict):
    """Numbers words from ``first`` on in the order in which it meets them."""

    def __init__(self, first: int = 0) -> None:
        super().__init__()
        self.first = first

    def __missing__(self, word: bytes) -> int:
        made = self[word] = len(self) + self.first
        return made

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def query_blocks(queries: DataFrame, size: Callable[[Row], int], most: int) -> Iterator[list[Row]]:
    """The rows of a query set in lists whose sizes add up to at most ``most`` each (a larger row is a list of its own).

    The driver holds one list and one partition of the set at a time.
    """
    block, held = [], 0
    for row in queries.toLocalIterator():
        if block and held + size(row) > most:
            yield block
            block, held = [], 0
        block.append(row)
        held += size(row)
    if block:
        yield block


def ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All whole numbers of the half-open ranges, one range after the other."""
    sizes = ends - begins
    shift = np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(sizes) else np.zeros(0, np.int64)
    return shift + np.arange(len(shift))
