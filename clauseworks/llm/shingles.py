"""Words and word runs of whole batches as 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

CHARACTERS_AT_ONCE = 1_000_000
STEP = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _is_word() -> np.ndarray:
    """By code point: whether it is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def _of_character() -> np.ndarray:
    return mixed(np.arange(0x110000, dtype=np.uint64), 77)


_GROWN: list[tuple[np.ndarray, np.ndarray]] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _GROWN or len(_GROWN[0][0]) < n:
        size = max(n, 2 * CHARACTERS_AT_ONCE)
        inverse = pow(STEP, -1, 1 << 64)
        up, down = np.full(size, np.uint64(STEP)), np.full(size, np.uint64(inverse))
        up[0] = down[0] = 1
        _GROWN[:] = [(np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))]
    return _GROWN[0]


def _hash_words(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """(first place, hash) of each word of a text: the sum of its characters' hashes, each by a power of its place."""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = _is_word()[codes]
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    up, down = _powers_to(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_of_character()[codes] * up[: len(codes)], out=total[1:])
    return start, mixed((total[end] - total[start]) * down[start], 5)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all texts, number of words of each text): of the lower-cased texts, the maximal runs
    of letters and digits."""
    hashes, counts, group, size = [], [], [], 0
    for k, t in enumerate(texts):
        group.append(t.lower())
        size += len(group[-1]) + 1
        if size >= CHARACTERS_AT_ONCE or k == len(texts) - 1:
            start, value = _hash_words("\n".join(group))
            begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in group])])
            hashes.append(value)
            counts.append(np.diff(np.searchsorted(start, begin)))
            group, size = [], 0
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def runs(flat: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``size`` successive words within a text, repeated runs included."""
    text = np.repeat(np.arange(len(counts)), counts)
    if len(flat) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(flat) - size + 1
    value = np.zeros(n, np.uint64)
    for k in range(size):
        value = value * np.uint64(STEP) + flat[k : k + n]
        value ^= value >> np.uint64(29)
    inside = text[:n] == text[size - 1 :]
    return text[:n][inside], mixed(value[inside])


def pair_value(first: int, second: int) -> int:
    """The hash that ``runs`` gives to two successive words, by their hashes."""
    full = (1 << 64) - 1
    value = first ^ (first >> 29)
    value = (value * STEP + second) & full
    value ^= value >> 29
    value = ((value ^ (value >> 30)) * 0xBF58476D1CE4E5B9) & full
    value = ((value ^ (value >> 27)) * 0x94D049BB133111EB) & full
    return value ^ (value >> 31)


def by_text(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The order by text and the upper 44 bits of the value, for up to 2**20 texts: one sort of one key."""
    return np.argsort((text.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
