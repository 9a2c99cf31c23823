"""Removal of repeated passages through anchors at the positions of a difference cover.

A difference cover of a period holds, for any two positions, one step below the period that brings both to positions of
the cover. So of two equal windows of `length` words, one step leads to the same place of both where an anchor (the hash
of the next `length - period + 1` words) is kept, although only some positions keep one and they are counted from each
text's start.

An anchor that occurs once has no partner. Around every other one lies its block: the words of all windows that hold the
anchor within their first `period` words. A match is extended from the anchor in both directions: equal blocks settle all their
windows at once; where blocks of one anchor differ, one place of each block is read again and extended window by window.
Windows that another anchor has settled only answer. Places with equal blocks are combined before the shuffle, tasks stream the
sorted places of any anchor in constant memory, and windows settle by counts; no pairs of places are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.repeats import _Stretches
from skylattice.llm.words import SMALL_BYTES, hashed_words, mixed, pieces, split_words
from skylattice.operators.materialise import materialise

LENGTH = 35
#: Perfect difference sets, the smallest covers of their periods.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
#: A key with more than this share of a table's rows counts as hot; there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 1 / 500


#: Bytes of text in which places with equal blocks are combined.
PIECE = 1 << 20


def period_for(length: int) -> int:
    """The longest period whose anchors have three fifths of a window's words at least."""
    return max(p for p in COVERS if p == 1 or 5 * (length - p + 1) >= 3 * length)


class _Places:
    """The anchors of some texts: owner text, position, hash of the anchor and of its block, first and last window of the block."""

    def __init__(self, texts: pa.Array, length: int, period: int):
        values, self.starts = hashed_words(texts, fold=False)
        self.stretch, self.length, self.period = _Stretches(values), length, period
        size = length - period + 1
        counts = np.diff(self.starts)
        owner = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(values)) - self.starts[:-1][owner]
        # texts shorter than a window have none
        here = np.isin(np.arange(period), COVERS[period])[at % period] & (at + size <= counts[owner]) & (counts[owner] >= length)
        self.owner, self.at = owner[here], at[here]
        begin = np.flatnonzero(here)
        self.anchor = self.stretch(begin, begin + size)
        self.first, self.last = block_windows(self.at, counts[self.owner], length, period)
        base = begin - self.at
        self.block = self.stretch(base + self.first, base + self.last + length) + (self.at - self.first).astype(np.uint64)


def block_windows(at: np.ndarray, n_words: np.ndarray, length: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of the blocks of anchors at some positions of texts."""
    return np.maximum(at - period + 1, 0), np.minimum(at, n_words - length)


def _covered(first: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` places lie in one of the ranges, ends included."""
    return np.cumsum(np.bincount(first, minlength=size + 1) - np.bincount(last + 1, minlength=size + 1))[:size] > 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _with_counts(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Rows whose keys stand in a table of one row per key, whose `count` says how many of the rows have the key.

    Hot keys, of which there can be few, go to all tasks; the rows with other keys are shuffled.
    """
    total = table.agg(F.sum(count)).collect()[0][0] or 0
    hot = F.col(count) > total * HOT_SHARE
    few = F.broadcast(table.where(hot).select(*keys))
    return rows.join(few, keys).unionByName(rows.join(few, keys, "left_anti").join(table.where(~hot).select(*keys), keys))


def _texts(docs: DataFrame, key: str, column: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text")).withColumn("rid", F.xxhash64("key", "text"))


def _sent(piece: pa.RecordBatch, length: int, period: int) -> pa.RecordBatch:
    """The places of a piece. Of equal blocks one place stands for two; the others need no partner and go where chance sends them."""
    p = _Places(piece.column(1), length, period)
    order = np.lexsort((p.block, p.anchor))
    anchor, block = p.anchor[order], p.block[order]
    first = np.ones(len(order), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])
    single = first & np.append(first[1:], True)
    weight = np.where(single, 1, np.where(first, 2, 0))
    rid = piece.column(2).to_numpy()[p.owner[order]]
    at = p.at[order]
    anchor = np.where(weight == 0, mixed(rid.view(np.uint64) + at.astype(np.uint64) + np.uint64(1)), anchor)
    return pa.RecordBatch.from_arrays([_signed(anchor), _signed(block), pa.array(rid), pa.array(4 * at + weight)], ["anchor", "block", "rid", "place"])


class _Judge:
    """Decides about places that come sorted by anchor and block; what is open is one place, whatever the group's size."""

    def __init__(self) -> None:
        self.open = [np.zeros(0, np.int64) for _ in range(4)]
        #: whether the open place's settling is written already, and whether its anchor had another block before
        self.written = self.varied = False

    def __call__(self, columns: list[np.ndarray], final: bool = False) -> pa.RecordBatch | None:
        anchor, block, rid, place = (np.concatenate(x) for x in zip(self.open, columns, strict=True))
        if not len(anchor):
            return None
        at, weight = place // 4, place % 4
        # places of weight 0 have anchors by chance; they are settled, and stand for no block
        new_anchor, new_block = np.ones(len(anchor), bool), np.ones(len(anchor), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_block[1:] = new_anchor[1:] | (block[1:] != block[:-1])
        start = np.flatnonzero(new_block)
        total = np.add.reduceat(weight, start)
        blocks = np.add.reduceat(new_block.astype(np.int64), np.flatnonzero(new_anchor))
        varied = (blocks > 1)[np.cumsum(new_anchor)[start] - 1]
        if self.varied:
            varied[: blocks[0]] = True
        size = np.diff(np.append(start, len(anchor)))
        settled = np.repeat(total > 1, size) | (weight == 0)
        if self.written:
            settled[0] = False
        closed = np.ones(len(start), bool)
        closed[-1] = final
        rep = start[closed & varied & (total > 0)]
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate((rid[settled], rid[rep]))), pa.array(np.concatenate((at[settled], at[rep])).astype(np.int32)),
                                          pa.array(np.concatenate((np.zeros(int(settled.sum()), np.int32), np.minimum(total[closed & varied & (total > 0)], 2).astype(np.int32))))], ["rid", "at", "weight"])
        if not final:
            top = start[-1]
            self.varied = bool(varied[-1])
            self.written = bool(total[-1] > 1) or weight[top] == 0
            self.open = [anchor[top:][:1], block[top:][:1], rid[top:][:1], 4 * at[top:][:1] + min(int(total[-1]), 2)]
        return out


def judged_places(rows: DataFrame, length: int, period: int) -> DataFrame:
    """rid, at, weight: anchors whose block occurs again (weight 0), and for each block of an anchor with several blocks one place.

    The latter have weight 2 if the block occurs again, else 1.
    """

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            yield _sent(piece, length, period)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = _Judge()
        for batch in batches:
            if (out := decide([c.to_numpy() for c in batch.columns])) is not None:
                yield out
        if (out := decide([np.zeros(0, np.int64)] * 4, final=True)) is not None:
            yield out

    return (rows.mapInArrow(retain, "anchor long, block long, rid long, place long").repartition("anchor").sortWithinPartitions("anchor", "block")
            .mapInArrow(judge, "rid long, at int, weight int"))


def extended_windows(rows: DataFrame, places: DataFrame, length: int, period: int) -> DataFrame:
    """rid, start of windows that no block settles and that occur again at the same step of the same anchor.

    `places` has one row per text: rid, settled (positions), border (position and weight).
    """

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", SMALL_BYTES):
            p = _Places(piece.column(1), length, period)
            n_words = np.diff(p.starts)
            text = np.arange(piece.num_rows)
            owner = [np.repeat(text, np.diff(piece.column(i).offsets.to_numpy())) for i in (3, 4)]
            known = piece.column(3).flatten().to_numpy().astype(np.int64)
            first, last = block_windows(known, n_words[owner[0]], length, period)
            base = p.starts[:-1]
            done = _covered(first + base[owner[0]], last + base[owner[0]], int(p.starts[-1]))
            at, weight = (piece.column(4).flatten().field(i).to_numpy().astype(np.int64) for i in range(2))
            found = np.searchsorted(p.owner * (1 << 40) + p.at, owner[1] * (1 << 40) + at)
            many = p.last[found] - p.first[found] + 1
            which = np.repeat(np.arange(len(found)), many)
            start = p.first[found][which] + np.arange(len(which)) - (np.cumsum(many) - many)[which]
            begin = start + base[owner[1]][which]
            group = mixed(p.anchor[found][which] + (at[which] - start + 1).astype(np.uint64))
            # settled windows ask nothing, but answer
            ask = (weight[which] == 1) & ~done[begin]
            yield pa.RecordBatch.from_arrays([_signed(group), _signed(p.stretch(begin, begin + length)), pa.array(np.where(ask, piece.column(2).to_numpy()[owner[1]][which], 0)),
                                              pa.array(np.where(ask, start, 0).astype(np.int32)), pa.array(np.where(ask, 1, 2).astype(np.int32))], ["group", "window", "rid", "start", "weight"])

    asked = places.where("size(border) > 0").withColumnRenamed("rid", "prid")
    read = rows.join(asked, F.expr("rid = prid")).select("key", "text", "rid", "settled", "border")
    windows = materialise(read.mapInArrow(extend, "group long, window long, rid long, start int, weight int"))
    again = windows.groupBy("group", "window").agg(F.sum("weight").alias("n"), F.min("weight").alias("least")).where("n > 1 AND least = 1")
    return _with_counts(windows.where("weight = 1").select("group", "window", "rid", "start"), materialise(again.select("group", "window", "n")), ["group", "window"], "n").select("rid", "start")


def without_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", column: str = "text") -> DataFrame:
    """`key`, n_words, n_removed, kept_text: each word goes that a window of `length` words covers which starts anywhere else too.

    Words are split on ASCII white space and compared unchanged; kept ones are joined by one space. Windows are judged on the
    input, so all copies of a passage go. One row per row of `docs`: null and empty texts have no words and an empty result;
    texts shorter than a window lose nothing; repeated rows repeat each other; null and equal keys are rows of their own.
    Words, stretches of words and rows are known by 64-bit hashes; a match rests on two, of different stretches.
    Other columns are ignored.
    """
    period = period_for(length)
    rows, kind = _texts(docs, key, column), dict(docs.dtypes)[key]
    # a text's lists are bounded by its own length; a row that is there several times is one entry
    places = materialise(judged_places(rows, length, period).groupBy("rid").agg(
        F.collect_set(F.when(F.col("weight") == 0, F.col("at"))).alias("settled"), F.collect_set(F.when(F.col("weight") > 0, F.struct("at", "weight"))).alias("border")))
    windows = extended_windows(rows, places, length, period).groupBy("rid").agg(F.collect_set("start").alias("windows"))
    found = places.select("rid", "settled").join(windows, "rid", "left").withColumnRenamed("rid", "prid")
    joined = rows.join(found, F.expr("rid = prid"), "left").select("key", "text", "settled", "windows")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = split_words(piece.column(1))
            text = np.arange(piece.num_rows)
            (own, at), (other, start) = ((np.repeat(text, pc.fill_null(pc.list_value_length(piece.column(i)), 0).to_numpy()), piece.column(i).flatten().to_numpy().astype(np.int64)) for i in (2, 3))
            first, last = block_windows(at, words.counts[own], length, period)
            first, last = np.concatenate((first + words.starts[own], start + words.starts[other])), np.concatenate((last + words.starts[own], start + words.starts[other]))
            gone = _covered(first, last + length - 1, len(words.codes))
            total = np.concatenate(([0], np.cumsum(gone)))[words.starts]
            left = pa.array(words.vocabulary, pa.string()).take(pa.array(words.codes[~gone]))
            kept = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(words.starts - total), left), " ")
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(words.counts), pa.array(np.diff(total)), kept.cast(pa.string())], [key, "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(remove, f"{key} {kind}, n_words long, n_removed long, kept_text string")


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`without_repeats` with the SHA-256 of the kept text in place of the text."""
    return without_repeats(docs, length).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
