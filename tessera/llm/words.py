"""Words of many texts as 64-bit hashes, made with whole-array operations on their bytes.

A word is a maximal run of 0-9, A-Z (lower-cased), a-z and bytes from 0x80 on, that is of every non-ASCII character.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd: its powers have inverses modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once, unless a single word is longer.
BLOCK = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True

_powers: dict[str, np.ndarray] = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["base"]) < n:
        size = max(n, BLOCK + 1)
        for name, factor in (("base", _BASE), ("inverse", _INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["base"], _powers["inverse"]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after another, and the bounds between texts (one more than texts)."""
    blobs = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    inside = WORD[data]
    edges = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, blobs), np.int64, len(blobs)) + 1)])
    bounds = np.searchsorted(starts, begins)
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        low, high = starts[at], ends[upto - 1]
        base, inverse = _power_tables(int(high - low) + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((LOWER[data[low:high]].astype(np.uint64) + np.uint64(1)) * base[: high - low], out=sums[1:])
        s, e = starts[at:upto] - low, ends[at:upto] - low
        hashes[at:upto] = mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = upto
    return hashes, bounds


def rolling(hashes: np.ndarray, bounds: np.ndarray, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words within a text, and the bounds between texts."""
    n = np.maximum(np.diff(bounds) - k + 1, 0)
    if len(hashes) < k:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    grams = np.zeros(len(hashes) - k + 1, np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + len(grams)]
    keep = np.repeat(np.arange(len(n)), np.diff(bounds))
    keep = keep[: len(grams)] == keep[k - 1 :]
    return mixed(grams[keep], salt), np.concatenate([[0], np.cumsum(n)])


def text_words(text: str) -> list[bytes]:
    """The words themselves, for small texts and tests."""
    data = LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    return np.where(WORD[data], data, np.uint8(32)).tobytes().split()
