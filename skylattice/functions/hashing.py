"""Reproducible pseudo-random numbers from md5, equal on every engine, partitioning and retry."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(*parts) -> Column:
    cols = [F.col(p) if isinstance(p, str) else (p if isinstance(p, Column) else F.lit(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def digest(*parts) -> Column:
    """md5 of the parts joined by ':'. Strings name columns; other values are literals."""
    return F.md5(_text(*parts))


def uniform(*parts) -> Column:
    """Uniform in (0, 1) from 32 bits of the digest."""
    bits = F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(4294967296.0)


def standard_normal(*parts) -> Column:
    """Box-Muller from two independent digests."""
    u1, u2 = uniform(*parts, 1), uniform(*parts, 2)
    return F.sqrt(-2 * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def lognormal(rel_sigma, *parts) -> Column:
    """Factor with median 1 and log standard deviation ln(1 + rel_sigma)."""
    s = rel_sigma if isinstance(rel_sigma, Column) else F.lit(float(rel_sigma))
    return F.exp(standard_normal(*parts) * F.log1p(s))


#: Messages hashed at once; and bytes that one md5 block can hold.
_AT_ONCE, _BLOCK = 32768, 55
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF) for i in range(64)]
_TURNS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]


def _rounds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the md5 of messages of one block; words has the 16 words of each message in its columns."""
    start = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(words.shape[1], v) for v in start)
    f, t = np.empty_like(a), np.empty_like(a)
    for i, (sine, turn) in enumerate(zip(_SINES, _TURNS, strict=True)):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        f += sine
        f += words[g]
        np.right_shift(f, np.uint32(32 - turn), out=t)
        f <<= np.uint32(turn)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return a + start[0], b + start[1]


def side_by_side(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts (no NULL) as the rows of a matrix, filled up with zeros, and their numbers."""
    raw = texts.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    sizes = np.diff(ends)
    wide = np.zeros((len(raw), max(1, sizes.max(initial=0))), np.uint8)
    if sizes.any():
        wide[np.arange(wide.shape[1]) < sizes[:, None]] = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return wide, sizes


def digest_heads(prefix: str, wide: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first 64 bits of md5(prefix + text) of texts `side_by_side`, as whole numbers in the order of the hex digests."""
    lead, out = prefix.encode(), np.empty(len(wide), np.uint64)
    if len(lead) + wide.shape[1] > _BLOCK:
        heads = (hashlib.md5(lead + row[:n].tobytes(), usedforsecurity=False).digest()[:8] for row, n in zip(wide, sizes, strict=True))
        return np.frombuffer(b"".join(heads), ">u8").astype(np.uint64)
    for lo in range(0, len(wide), _AT_ONCE):
        some, ends = wide[lo : lo + _AT_ONCE], sizes[lo : lo + _AT_ONCE] + len(lead)
        block = np.zeros((len(some), 64), np.uint8)
        block[:, : len(lead)] = np.frombuffer(lead, np.uint8)
        block[:, len(lead) : len(lead) + some.shape[1]] = some
        block[np.arange(len(some)), ends] = 0x80
        words = np.ascontiguousarray(block.view("<u4").T)
        words[14] = ends * 8
        a, b = _rounds(words)
        out[lo : lo + len(some)] = a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()
    return out
