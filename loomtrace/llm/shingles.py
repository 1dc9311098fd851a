"""Word shingles as 64-bit hashes and a fixed-size table of how common they are."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from loomtrace.llm.arrow import utf8
from loomtrace.llm.totals import total

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of each word met so far; emptied when it has grown to ``most`` words."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of products and sums."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes | None, hashes: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's word windows; a shorter text is one shingle, a text without words has none.

    Words are separated by ASCII white space and A-Z are lower-cased.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    w, span = hashes.of(words), min(size, len(words))
    rolled = np.full(len(words) - span + 1, span, dtype=np.uint64)
    for k in range(span):
        rolled = rolled * _FACTOR + w[k:len(words) - span + 1 + k]
    return np.unique(mixed(rolled))


def commonness(docs: DataFrame, size: int = 5, bits: int = 22) -> np.ndarray:
    """For each of 2**bits hash buckets the rounded logarithm of how many (document, shingle) pairs fell into it.

    Counted over all documents. The table has a fixed size (4 MB by default) and only decides an order, so two shingles in one
    bucket cost time, never results. ``bits`` can be raised with the corpus.
    """
    def fill():
        hashes = WordHashes()

        def step(batch, counts):
            for text in utf8(batch):
                s = shingle_set(text, hashes, size)
                if len(s):
                    np.add.at(counts, s >> np.uint64(64 - bits), 1)
        return step

    return np.log2(total(docs.select("text"), 1 << bits, np.uint32, fill) + 1.0).round().astype(np.uint8)
