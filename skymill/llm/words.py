"""Words as 64-bit numbers, many documents at a time, for operators that compare word sequences."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

MEMO_LIMIT = 100_000
BATCH_CHARS = 500_000  # characters handled together; one longer text is a batch of its own


class WordIds(dict):
    """word (bytes) -> XXH64, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


WORD_IDS = WordIds()


def ids_of(words: Iterable[bytes], count: int) -> np.ndarray:
    return np.fromiter(map(WORD_IDS.__getitem__, words), dtype=np.uint64, count=count)


def batches(texts: list[str], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


class Rolling:
    """Hashes of all runs of a given number of consecutive words, for any number, from one prefix sum."""

    def __init__(self, ids: np.ndarray):
        self.up, down = _powers(len(ids) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * down[: len(ids)])])

    def of(self, n: int) -> np.ndarray:
        count = len(self.sums) - n
        return mixed((self.sums[n:] - self.sums[:-n]) * self.up[:count]) if count > 0 else np.zeros(0, np.uint64)
