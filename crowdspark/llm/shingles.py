"""Word shingle sets and MinHash signatures of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import mix, text_bytes, word_bounds, word_hashes

_U = np.uint64
_KEEP = _U((1 << 52) - 1)
_ODD = np.random.default_rng(911).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
MAX_TEXTS = 4000


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints (52 bits, ascending) of each text end to end, and n+1 offsets.

    Words are runs without ASCII white space, A-Z as a-z. A text of fewer words than ``width`` is one shingle of
    them all; one without words has none. At most MAX_TEXTS texts at a time.
    """
    raw, offsets = text_bytes(texts)
    starts, ends, words = word_bounds(raw, offsets)
    h = word_hashes(raw, starts, ends)
    n = np.diff(words)
    owner_of_word = np.repeat(np.arange(len(n)), n)
    codes, owners = [], []
    if len(h) >= width:
        last = len(h) - width + 1
        inside = owner_of_word[:last] == owner_of_word[width - 1 :]
        rolled = sum((h[j : j + last] * _ODD[j] for j in range(width)), np.zeros(last, np.uint64))
        codes.append(rolled[inside])
        owners.append(owner_of_word[:last][inside])
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        place = np.arange(len(h)) - words[:-1][owner_of_word]
        total = np.zeros(len(n), np.uint64)
        few = np.isin(owner_of_word, short)
        np.add.at(total, owner_of_word[few], h[few] * _ODD[32 + place[few]])
        codes.append(total[short] + n[short].astype(np.uint64))
        owners.append(short)
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    key = (np.concatenate(owners).astype(np.uint64) << _U(52)) | (mix(np.concatenate(codes)) >> _U(12))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & _KEEP, np.searchsorted(key >> _U(52), np.arange(len(n) + 1, dtype=np.uint64))


def signatures(values: np.ndarray, offsets: np.ndarray, size: int, seed: int = 77) -> np.ndarray:
    """MinHash signatures (texts x size, 64 bits); rows of empty sets are all ones.

    The whole value is kept: a minimum over a long text is small, so its upper half alone would be shared by
    unlike texts once there are millions of them, and their postings would run together.
    """
    make = np.random.default_rng(seed)
    flips = make.integers(0, 1 << 63, size, dtype=np.uint64)
    factors = make.integers(0, 1 << 63, size, dtype=np.uint64) * _U(2) + _U(1)
    out = np.full((len(offsets) - 1, size), 0xFFFFFFFFFFFFFFFF, np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for i in range(size):
            out[full, i] = np.minimum.reduceat((values ^ flips[i]) * factors[i], offsets[:-1][full])
    return out


def digests(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set, independent of order; 0 for an empty one."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = mix(np.add.reduceat(mix(values + _U(0x51ED2701)), offsets[:-1][full]) + np.diff(offsets)[full].astype(np.uint64))
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two ascending distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)) if len(b) else 0
    return 100 * both >= percent * (len(a) + len(b) - both)
