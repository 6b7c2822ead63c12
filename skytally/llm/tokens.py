"""Words of Arrow text columns as numpy arrays, without a Python object a word."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the word hash and of its mixing.
STEP, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def byte_classes(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], bool)


#: Lower case of A-Z, all other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Words of letters, digits and all that is not ASCII; and words between ASCII white space.
ALNUM = byte_classes(lambda b: b >= 128 or chr(b).isalnum())
SPACED = byte_classes(lambda b: not (b == 32 or 9 <= b <= 13))


BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes and ends of the words of all texts, and for each text (and the end) the number of its first word."""
    inside = classes[data]
    edge = np.zeros(len(data), bool)  # where a text begins, a word that goes on is another word
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    edge[begins] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
    first = np.flatnonzero(inside & (~before | edge))
    after = np.zeros(len(data) + 1, bool)
    after[1:] = inside
    starts_or_out = np.ones(len(data) + 1, bool)
    starts_or_out[:-1] = ~inside | edge
    end = np.flatnonzero(after & starts_or_out)
    return first, end, np.searchsorted(first, offsets)


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of the words: a polynomial in the bytes, then scrambled together with the length."""
    if not len(first):
        return np.zeros(0, np.uint64)
    length = end - first
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(length.max()), STEP * np.uint64(2 * seed + 1), np.uint64))
        starts = np.concatenate([[0], np.cumsum(length)[:-1]])
        at = np.repeat(first - starts, length) + np.arange(starts[-1] + length[-1])  # the bytes of all words
        value = BYTE[data[at]] * powers[at - np.repeat(first, length)]
        return mixed(np.add.reduceat(value, starts) + length.astype(np.uint64))
