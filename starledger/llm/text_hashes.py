"""Hashes of the words of UTF-8 text, computed on whole buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20  # text that is hashed in one go

# --- fixed values: odd constants of public mixing functions ---------------------

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BASE = np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)

_CODES = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = _CODES[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), BASE)]))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 bytes, A-Z lower-cased, in order."""
    found = []
    at = 0
    while at < len(data):
        end = at + BLOCK_BYTES
        if end < len(data):  # cut at white space; a longer word makes a longer block
            while end < len(data):
                spaces = np.flatnonzero(_SPACE[data[end : end + BLOCK_BYTES]])
                if len(spaces):
                    end += int(spaces[0])
                    break
                end += BLOCK_BYTES
        found.append(_block_hashes(data[at:end]))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _block_hashes(data: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    letters = data[inside[1:-1].astype(bool)]
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(letters)) - np.repeat(firsts, lengths)
    summed = np.add.reduceat(_CODES[letters] * _powers(int(lengths.max()))[place], firsts)
    return mix64(summed + lengths.astype(np.uint64))


def text_bytes(text: pa.StringScalar) -> np.ndarray:
    buffer = text.as_buffer() if text.is_valid else None
    return np.frombuffer(buffer, np.uint8) if buffer else np.empty(0, np.uint8)
