"""Hashed character n-grams of texts."""

from __future__ import annotations

import sys

import numpy as np

MIX = np.uint32(0x9E3779B1)
STEP = np.uint32(0x01000193)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def codes(text: str) -> np.ndarray:
    """Lower-case letters of a text as code points; runs of anything else are one blank, as are both ends."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    c = np.where(letters()[c], c, np.uint32(32))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    return c[keep]


def ids(c: np.ndarray, low: int, high: int, bits: int, within: bool = False) -> np.ndarray:
    """Hashed ids (below 2 ** bits) of the n-grams of `low` to `high` code points; within: those that have no blank inside."""
    out = []
    k = c * MIX
    h = k
    blanks = np.zeros(len(c) + 1, np.int32)
    if within:
        np.cumsum(c == 32, out=blanks[1:])
    for n in range(1, high + 1):
        if n > 1:
            if len(h) < 2:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(13))) * STEP + k[n - 1 :]
        if n >= low:
            x = h
            if within and n > 2:
                x = h[blanks[n - 1 : len(c)] == blanks[1 : len(h) + 1]]
            x = (x ^ (x >> np.uint32(15))) * (MIX + np.uint32(2 * n))
            out.append(x >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
