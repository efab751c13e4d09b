"""Vectorised word and substring hashing over the byte buffer of many texts.

All kernels work on one ``uint8`` array that holds several texts end to end and
on the offsets of those texts.  Bytes are read eight at a time as numbers, and
numbers are combined by steps that mix every bit into every other.  Equal strings
hash alike in every process.

A hash only proposes: whoever knows its constants can make two strings that have
it in common, so what decides on a result compares bytes or a cryptographic
digest, or hashes under a key that ``draw_key`` gives anew for each run.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

import numpy as np

_MASK = (1 << 64) - 1
#: Odd multipliers of the two halves of a string and of their mixture.
_LEFT, _RIGHT, _BOTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
#: Spans of more bytes are hashed one by one.
_LONG_SPAN = 256


def draw_key() -> int:
    """A random key of 128 bits, drawn by the driver for one run and sent with its tasks; 0 stands for the fixed constants."""
    return int.from_bytes(os.urandom(16), "little") | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & _MASK))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What an item of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` is made of, after lower-casing.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: What an item of `[^\x20\x09-\x0D]+` is made of.
NONSPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])



def eights(buf: np.ndarray) -> np.ndarray:
    """At every position, and at the end, the eight bytes from there as one number; zeros follow the buffer."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def combine(left: np.ndarray, right: np.ndarray, key: int = 0) -> np.ndarray:
    """Hash of two strings' hashes in this order."""
    a, b = (np.uint64(key & _MASK | 1), np.uint64(key >> 64 | 1)) if key else (_LEFT, _RIGHT)
    x = left * a
    x += right * b
    x ^= x >> np.uint64(29)
    x *= _BOTH
    x ^= x >> np.uint64(32)
    return x


def every_hash(buf: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from every position that has so many."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, size = eights(buf)[: len(buf) - min(width, 8) + 1].copy(), 8
    if width < 8:
        h &= np.uint64((1 << 8 * width) - 1)
    h = mix(h)
    while 2 * size <= width:
        h = combine(h[:-size], h[size:])
        size *= 2
    if width > size:  # the two parts overlap
        h = combine(h[: size - width], h[width - size :])
    return h


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """Hash of each span of the buffer, eight bytes at a step."""
    size = end - start
    h = mix(size.astype(np.uint64) + np.uint64((_MASK // 3 + key) & _MASK))
    if not len(size):
        return h
    at_once = eights(buf)
    long = np.flatnonzero(size > _LONG_SPAN)
    rows = np.flatnonzero((size > 0) & (size <= _LONG_SPAN))
    done = 0
    while len(rows):
        x = at_once[start[rows] + done]
        left = size[rows] - done
        x = np.where(left < 8, x & ((np.uint64(1) << (8 * np.minimum(left, 7)).astype(np.uint64)) - np.uint64(1)), x)
        h[rows] = mix(combine(h[rows], x, key))
        done += 8
        rows = rows[left > 8]
    for k in long.tolist():
        digest = hashlib.blake2b(buf[start[k] : end[k]].tobytes(), digest_size=8, key=key.to_bytes(16, "little") if key else b"").digest()
        h[k] = np.frombuffer(digest, "<u8")[0]
    return h


def same_bytes(x: np.ndarray, x_start: np.ndarray, y: np.ndarray, y_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes from each start are equal in both buffers; every size is positive."""
    if not len(size):
        return np.zeros(0, bool)
    first = np.cumsum(size) - size
    step = np.arange(int(size.sum())) - np.repeat(first, size)
    return np.logical_and.reduceat(x[np.repeat(x_start, size) + step] == y[np.repeat(y_start, size) + step], first)


@dataclass
class Words:
    """Words of several texts: their hash, byte span, and ``first[d]:first[d + 1]`` as those of text d."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def word_spans(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and per-text first index of the maximal runs of bytes in ``inside`` (a table of 256)."""
    n = len(buf)
    flag = inside[buf]
    new = np.zeros(n + 1, bool)
    new[off[:-1]] = True
    new[n] = True
    before = np.empty(n, bool)
    if n:
        before[0] = True
        np.logical_or(~flag[:-1], new[1:n], out=before[1:])
    start = np.flatnonzero(flag & before)
    after = np.empty(n, bool)
    if n:
        after[-1] = True
        np.logical_or(~flag[1:], new[1:n], out=after[:-1])
    end = np.flatnonzero(flag & after) + 1
    return start, end, np.searchsorted(start, off)


def words(buf: np.ndarray, off: np.ndarray, inside: np.ndarray, key: int = 0) -> Words:
    """Lower-cased words (A-Z only) made of the bytes in ``inside``."""
    low = LOWER[buf]
    start, end, first = word_spans(low, off, inside)
    return Words(span_hash(low, start, end, key) if key else span_hash(low, start, end), start, end, first)


def shingles(w: Words, size: int, key: int = 0) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its runs of ``size`` words; a shorter text is one run, no words none."""
    weights = stream(23 + key, size) | np.uint64(1)
    n = len(w.hash)
    runs = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        runs[: n - k] += w.hash[k:] * weights[k]
    runs = mix(runs + np.uint64(size))
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            x = np.sort(runs[a : b - size + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            out.append(mix((w.hash[a:b] * weights[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(1_000_003 * (b - a))))
        else:
            out.append(runs[:0])
    return out
