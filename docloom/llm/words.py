"""Hashes of white-space words of whole batches, shared by the operators that compare words."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

ODD = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one.
_LONG = 256
#: _MASK[n] keeps the n lowest bytes of eight.
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD
    h = (h ^ (h >> np.uint64(29))) * ODD
    return h ^ (h >> np.uint64(32))


def is_space(flat: np.ndarray) -> np.ndarray:
    """Which bytes are one of the six ASCII white-space characters."""
    return (flat == 32) | ((flat - np.uint8(9)) < 5)


def word_bounds(space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of bytes that are not white space."""
    wide = np.concatenate(([True], space, [True]))
    edge = np.flatnonzero(wide[1:] != wide[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[begin:end], eight bytes of all words at a time."""
    eights = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    size = end - begin
    h = mix((eights[begin] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * ODD)
    more, done = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(more):
        h[more] = mix(h[more] + (eights[begin[more] + done] & _MASK[np.minimum(size[more] - done, 8)]))
        done += 8
        more = more[size[more] > done]
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = xxh3_64_intdigest(data[begin[i] : end[i]])
    return h


def first_of_each(code: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """For each row the index of the first row, by the order keys, of those with the same code; rows alone are their own."""
    by = np.argsort(code)
    same = code[by[1:]] == code[by[:-1]]
    first = np.arange(len(code))
    if same.any():
        some = by[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        some = some[np.lexsort((*reversed([k[some] for k in order]), code[some]))]
        new = np.concatenate(([True], code[some[1:]] != code[some[:-1]]))
        first[some] = some[np.flatnonzero(new)][np.cumsum(new) - 1]
    return first
