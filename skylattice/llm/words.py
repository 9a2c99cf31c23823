"""Arrow and numpy helpers that the text operators run inside Spark tasks.

Texts come in as Arrow batches. They are cut into pieces of bounded size, split on ASCII white space and coded against
the piece's own vocabulary, so that per-word work is done once for every distinct word of a piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20
#: For work on all words at once, whose arrays are many times as large as the texts.
SMALL_BYTES = 1 << 19
_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text; a longer text makes a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


@dataclass
class Words:
    """Words of some texts: `codes` into `vocabulary`; text i has the words starts[i] to starts[i + 1]."""

    codes: np.ndarray
    starts: np.ndarray
    vocabulary: list[str]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def keep(self, wanted: np.ndarray) -> Words:
        """Only those words whose vocabulary entry is wanted."""
        mask = wanted[self.codes]
        total = np.concatenate(([0], np.cumsum(mask)))
        return Words(self.codes[mask], total[self.starts], self.vocabulary)


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of every text; a null text has none. `lower` folds A-Z only."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = Words(coded.indices.to_numpy().astype(np.int64), offsets - offsets[0], vocabulary)
    if "" in vocabulary:
        blank = vocabulary.index("")
        words = words.keep(np.arange(len(vocabulary)) != blank)
        words = Words(words.codes - (words.codes > blank), words.starts, vocabulary[:blank] + vocabulary[blank + 1 :])
    return words


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def gram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each n consecutive hashed values, whatever text they belong to."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, np.uint64(n))
    for i in range(n):
        h *= _STEP
        h += values[i : i + m]
    return mixed(h)


_RANDOM = np.random.Generator(np.random.PCG64(20))
_BYTE = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def hashed_words(texts: pa.Array, bare: bool = False, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and where each text's words start, without making the words.

    A-Z are folded, unless `fold` is false. With `bare` all letters are folded, ASCII marks are dropped from the words, and words of marks alone
    vanish. A word's hash is a polynomial of scrambled bytes.
    """
    texts = pc.fill_null(texts, "")
    texts = pc.utf8_lower(texts) if bare else pc.ascii_lower(texts) if fold else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    first[at] |= inside[at]
    used = np.flatnonzero(inside & ~_MARK[data] if bare else inside)
    if not len(used):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = np.cumsum(first, dtype=np.int32)[used]
    begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    place = np.arange(len(used)) - np.repeat(begin, np.diff(np.append(begin, len(used))))
    power = np.cumprod(np.full(int(place.max()) + 1, _BASE))
    hashes = mixed(np.add.reduceat(_BYTE[data[used]] * power[place], begin))
    return hashes, np.searchsorted(used[begin], offsets)


def set_shingles(texts: pa.Array, n: int, bare: bool = False) -> list[np.ndarray]:
    """The sorted distinct hashes of the n-word shingles of each text, as in `shingles`."""
    return [np.unique(s) for s in shingles(texts, n, bare)]


def shingles(texts: pa.Array, n: int, bare: bool = False) -> Iterator[np.ndarray]:
    """For each text the hashes of its n-word shingles in order, repeats included.

    A text of fewer than n words has its whole sequence as one shingle; one without words has none.
    """
    values, starts = hashed_words(texts, bare)
    grams = gram_hashes(values, n)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= n:
            yield grams[a : b - n + 1]
        elif b > a:
            yield gram_hashes(values[a:b], b - a)
        else:
            yield grams[:0]


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of integer values from starts[i] to starts[i + 1]."""
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
    return total[starts[1:]] - total[starts[:-1]]
