"""What several of the operators share."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np

#: A-Z to a-z and every other ASCII byte that is no letter or digit to a blank; bytes above stay as they are.
FOLD_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: About how many bytes a task's memory of words may take; a task starts with an empty one.
MEMORY = 16_000_000


def folded_words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of letters, digits and characters beyond ASCII. Null has none."""
    return (text or "").encode().translate(FOLD_WORDS).split()


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of rows whose sizes sum to about ``most``; a larger row stands alone."""
    start, total, i = 0, 0, -1
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if i >= start:
        yield start, i + 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit integers (the finaliser of SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(words: Iterable[bytes]) -> np.ndarray:
    """64-bit hashes of different words."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64)


class Memory(dict):
    """What a task has found out about words; it empties itself when its entries take about ``most`` bytes."""

    def __init__(self, most: int = MEMORY) -> None:
        super().__init__()
        self.most, self.taken = most, 0

    def unknown(self, words: Iterable) -> list:
        """The different words that are not in here, for which there is room now."""
        words = set(words)
        new = [w for w in words if w not in self]
        if self.taken > self.most:
            self.clear()
            self.taken, new = 0, list(words)
        self.taken += sum(map(len, new)) + 160 * len(new)
        return new


class WordHashes:
    """64-bit hashes of words, computed once for each different word of a task."""

    def __init__(self) -> None:
        self.known = Memory()

    def of(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        for w in known.unknown(words):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def bucket(key: object, n: int) -> int:
    """crc32 of a key written as text, modulo ``n``; a null key is the empty text."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % n
