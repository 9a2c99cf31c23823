"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Test items are short and documents may be long, so a MinHash of whole documents would never agree with that of an item.
Items are partitioned by their number of shingles; for each size class a document is cut into overlapping windows of that
size, each with a one-permutation MinHash of more bins than an item has shingles. An item of the class that lies in a text
fills a large part of one window, and the two agree in some bin. An agreeing bin makes a candidate, and the share of the
item's shingles that the whole text holds decides. Texts stay where they are read: there is no shuffle.

Items of at most SHORT shingles have too few bins for that. They are found by their shingles themselves: a text that holds
enough of n shingles holds one of any n - enough + 1 of them, so the rarest ones of each item make all candidates.

Items are fetched in blocks of at most BLOCK, and each block goes to all tasks, so that what is sent has a fixed bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.words import SMALL_BYTES, pieces, set_shingles, shingles

SHINGLE = 5
CONTAINMENT = 0.8
BLOCK = 20_000
SHORT = 8
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_BITS = 20


@dataclass
class SizeClass:
    """Sketch values of the items with more than size / 2 and at most `size` shingles."""

    size: int
    values: np.ndarray
    items: np.ndarray
    present: np.ndarray

    @property
    def bins(self) -> int:
        return 4 * self.size


def _spot(values: np.ndarray) -> np.ndarray:
    return ((values >> np.uint64(16)) & np.uint64((1 << _BITS) - 1)).astype(np.int64)


class ItemIndex:
    """The MinHash index of one block of test items."""

    def __init__(self, ids: list, texts: list[str | None], threshold: float = CONTAINMENT):
        self.ids, self.threshold = ids, threshold
        self.sets = set_shingles(pa.array(texts, pa.string()), SHINGLE, bare=True)
        by_size: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s) > SHORT:
                by_size.setdefault(1 << int(len(s) - 1).bit_length(), []).append(i)
        self.short = self._short([i for i, s in enumerate(self.sets) if 0 < len(s) <= SHORT])
        self.classes = [self._class(size, members) for size, members in sorted(by_size.items())]

    def enough(self, i: int) -> int:
        """The least number of an item's shingles that makes a match."""
        return max(1, math.ceil(self.threshold * len(self.sets[i]) - 1e-9))

    def _short(self, members: list[int]) -> SizeClass:
        """For each of the items the shingles of which a matching text holds at least one: those that the fewest items have."""
        shown, counts = np.unique(np.concatenate([self.sets[i] for i in members] or [np.zeros(0, np.uint64)]), return_counts=True)
        keys = []
        for i in members:
            own = self.sets[i]
            keys.append(own[np.argsort(counts[np.searchsorted(shown, own)], kind="stable")][: max(0, len(own) - self.enough(i) + 1)])
        values = np.concatenate(keys or [np.zeros(0, np.uint64)])
        return self._sorted(SHORT, values, np.repeat(np.array(members, np.int64), [len(k) for k in keys]))

    def _sorted(self, size: int, values: np.ndarray, items: np.ndarray) -> SizeClass:
        order = np.argsort(values, kind="stable")
        present = np.zeros(1 << _BITS, bool)
        present[_spot(values)] = True
        return SizeClass(size, values[order], items[order], present)

    def _class(self, size: int, members: list[int]) -> SizeClass:
        found = []
        for i in members:
            low = np.full(4 * size, _NONE)
            np.minimum.at(low, (self.sets[i] % np.uint64(4 * size)).astype(np.int64), self.sets[i])
            low = low[low != _NONE]
            found.append((low, np.full(len(low), i)))
        return self._sorted(size, np.concatenate([v for v, _ in found]), np.concatenate([i for _, i in found]))

    def candidates(self, grams: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) that share a short item's key or whose sketches agree in a bin of some window.

        `grams` of text i are starts[i] to starts[i + 1].
        """
        pairs: set[tuple[int, int]] = set()
        counts = np.diff(starts)
        text = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(grams)) - np.repeat(starts[:-1], counts)
        seen = np.flatnonzero(self.short.present[_spot(grams)])
        first, last = np.searchsorted(self.short.values, grams[seen], "left"), np.searchsorted(self.short.values, grams[seen], "right")
        for t, a, b in {(int(text[seen[k]]), int(first[k]), int(last[k])) for k in np.flatnonzero(last > first)}:
            pairs.update((t, i) for i in self.short.items[a:b].tolist())
        for c in self.classes:
            blocks = np.concatenate(([0], np.cumsum(-(-counts // c.size))))
            low = np.full(int(blocks[-1]) * c.bins, _NONE)
            np.minimum.at(low, (blocks[text] + place // c.size) * c.bins + (grams % np.uint64(c.bins)).astype(np.int64), grams)
            low = low.reshape(-1, c.bins)
            # a window is a block and the one after it in the same text
            follows = np.ones(len(low), bool)
            follows[blocks[1:][blocks[1:] > blocks[:-1]] - 1] = False
            window = low.copy()
            window[:-1] = np.where(follows[:-1, None], np.minimum(low[:-1], low[1:]), low[:-1])
            owner = np.repeat(np.arange(len(counts)), np.diff(blocks))
            row, col = np.nonzero(c.present[_spot(window)] & (window != _NONE))
            value = window[row, col]
            first, last = np.searchsorted(c.values, value, "left"), np.searchsorted(c.values, value, "right")
            for k in np.flatnonzero(last > first):
                pairs.update((int(owner[row[k]]), int(i)) for i in c.items[first[k] : last[k]])
        return pairs

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """(text, item, shingles found) with found >= threshold * shingles of the item, and at least one."""
        sets = list(shingles(texts, SHINGLE, bare=True))
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
        grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        out = []
        for t, i in sorted(self.candidates(grams, starts)):
            found = int(np.isin(self.sets[i], sets[t]).sum())
            if found >= self.enough(i):
                out.append((t, i, found))
        return out


def item_blocks(items: DataFrame, block: int = BLOCK, threshold: float = CONTAINMENT) -> Iterator[ItemIndex]:
    """Indexes of the items in blocks, in the order of item_id; the driver holds one block at a time."""
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator()
    while some := list(islice(rows, block)):
        yield ItemIndex([r[0] for r in some], [r[1] for r in some], threshold)


def contaminated_pairs(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, block: int = BLOCK) -> DataFrame:
    """One row for each row of `docs` and each test item that it contains: doc_id, item_id, n_shingles, n_found, containment.

    Containment is the share of the item's distinct five-word shingles that occur in the text; words are lower-cased and
    lose ASCII marks, so that marks around a copied passage do not hide it. An item of fewer than five words is one shingle, found only in a text of the same words. Null texts
    and texts or items without words match nothing. Repeated rows are searched one by one; other columns are ignored.
    """
    schema = "doc_id long, item_id long, n_shingles long, n_found long, containment double"
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    out = None
    for index in item_blocks(items, block, threshold):

        def search(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, "text", SMALL_BYTES):
                ids, rows = piece.column(0).to_pylist(), index.matches(piece.column(1))
                data = [(ids[t], index.ids[i], len(index.sets[i]), n, n / len(index.sets[i])) for t, i, n in rows]
                cols = list(zip(*data, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.float64()], strict=True)],
                                                 ["doc_id", "item_id", "n_shingles", "n_found", "containment"])

        found = source.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, block: int = BLOCK) -> DataFrame:
    """The rows of `docs`, all columns unchanged, that contain no test item in the sense of `contaminated_pairs`."""
    for index in item_blocks(items, block, threshold):

        def clean(batches: Iterator[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, "text", SMALL_BYTES):
                keep = np.ones(piece.num_rows, bool)
                keep[[t for t, _, _ in index.matches(piece.column("text"))]] = False
                yield piece.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
