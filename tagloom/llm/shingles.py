"""Hashed word shingles of a text."""

from __future__ import annotations

import numpy as np
import xxhash


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    y = x ^ (x >> np.uint64(31))
    y *= np.uint64(0x7FB5D329728EA185)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x81DADEF4BC2DD44D)
    y ^= y >> np.uint64(33)
    return y


def word_codes(text: str | bytes | None) -> np.ndarray:
    """64-bit codes of the words; A to Z are lowered, other letters are not.

    On bytes, lowering and white space are those of ASCII: exactly the rule.  Bytes are UTF-8.
    """
    if not text:
        return np.zeros(0, np.uint64)
    data = text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
    words = data.lower().split()
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def shingle_codes(words: np.ndarray, width: int) -> np.ndarray:
    """Codes of all runs of ``width`` words in order; fewer words make one shingle of them all."""
    if not len(words):
        return words.astype(np.uint64)
    width = min(width, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        # Odd factors, no two alike: the order of words counts.
        factor = pow(0x9E3779B97F4A7C15, i + 1, 1 << 64)
        total += words[i : len(words) - width + 1 + i] * np.uint64(factor)
    return mixed(total)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingle_codes(word_codes(text), width))
