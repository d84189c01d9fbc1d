"""Distinct word-shingle hashes of texts, vectorised over blocks of texts."""

from __future__ import annotations

import hashlib

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
#: Keys of the word hash, and of long words' digests.
_FIRST, _SECOND, _KEY = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), b"word"
#: For 0 to 8 bytes, the bits that they take.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, A-Z folded; bounds: words of text i are at bounds[i]:bounds[i + 1]).

    Words of up to 16 bytes are scrambled as two numbers, so that those of one
    length of up to 8 never collide; longer ones are digested whole. No word is
    hashed by a polynomial of its letters, which regular words can defeat.
    """
    data = _LOWER[np.frombuffer(b" ".join([b"", *texts, b""]) + bytes(16), np.uint8)]
    space = _SPACE[data[:-16]]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    length = ends - starts
    # The eight bytes from every place on, as a number.
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    words = mix((eight[starts] & _MASK[np.minimum(length, 8)]) ^ _FIRST)
    words += mix((eight[np.minimum(starts + 8, len(eight) - 1)] & _MASK[np.clip(length - 8, 0, 8)]) ^ _SECOND)
    words = mix(words + length.astype(np.uint64) * _P)
    long = np.flatnonzero(length > 16)
    if len(long):
        flat = data.tobytes()
        digests = [hashlib.blake2b(flat[a:b], digest_size=8, key=_KEY).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        words[long] = np.frombuffer(b"".join(digests), np.uint64)
    first = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return words, np.searchsorted(starts, first)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its width-word shingles.

    A text of fewer words has its whole sequence as one shingle, a text
    without words none.
    """
    words, bounds = word_hashes(texts)
    n = max(0, len(words) - width + 1)
    rolled = np.full(n, np.uint64(width))
    for k in range(width):
        rolled = mix(rolled * _P + words[k : k + n])
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for w in words[a:b]:
                one = mix(one * _P + w)
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out
