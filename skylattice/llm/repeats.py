"""Repeated passages through sparse suffixes.

Of each text's suffixes only those at minimisers are retained: a window of LENGTH words has LENGTH - GRAM + 1 grams of GRAM
words, and the gram of the least hash is its minimiser, so that equal windows retain equal suffixes wherever they stand.
Neighbouring windows with one minimiser form a run. Suffixes that begin with the same gram are neighbours in suffix order;
they are brought together by the gram's hash, and those without a neighbour in another text go.

A match is extended to the left and right at once: equal hashes of the words of whole runs settle all windows of both. What is
left are runs at the borders of passages. Their texts are read again, and each alignment, window by window, is compared within
the neighbours. A group of copies of any size settles by counts, which Spark combines before the shuffle; no pairs are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.words import SMALL_BYTES, gram_hashes, hashed_words, mixed, pieces
from skylattice.operators.materialise import materialise

LENGTH = 50
GRAM = 16
_BASE = 0x9FB21C651E98DF25
_BACK = pow(_BASE, -1, 1 << 64)


class _Stretches:
    """Hashes of any stretches of some word hashes, by sums of powers."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(values) * np.cumprod(np.full(n, np.uint64(_BASE))), dtype=np.uint64)))
        self.back = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, np.uint64(_BACK)))))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _first(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """1 for the first of equal values of a text, else 0, so that sums count texts."""
    order = np.lexsort((value, text))
    same = np.zeros(len(order), bool)
    same[1:] = (text[order][1:] == text[order][:-1]) & (value[order][1:] == value[order][:-1])
    out = np.ones(len(order), np.int32)
    out[order[same]] = 0
    return out


def _runs(texts: pa.Array, length: int, gram: int) -> list[np.ndarray]:
    """Text, minimiser, hash of the run's words, first and last window of each run, and whether the two hashes are the text's first."""
    values, starts = hashed_words(texts)
    minima = _sliding_min(gram_hashes(values, gram), length - gram + 1) if len(values) >= length else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(texts)), np.diff(starts))
    window = np.flatnonzero(np.arange(len(minima)) + length <= starts[1:][text[: len(minima)]])
    least = minima[window]
    new = np.ones(len(window), bool)
    new[1:] = (window[1:] != window[:-1] + 1) | (least[1:] != least[:-1])
    begin = window[new]
    last = window[np.append(np.flatnonzero(new)[1:], len(window)) - 1] if len(window) else window
    owner = text[begin] if len(begin) else begin
    whole = _Stretches(values)(begin, last + length)
    return [owner, least[new], whole, begin - starts[owner], last - starts[owner], _first(owner, least[new]), _first(owner, whole)]


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, start_word, end_word of the longest stretches of each text whose every `length`-word window occurs in another row.

    Words are split on ASCII white space after folding A-Z; positions count words from 0, the end is exclusive. Null texts and
    texts of fewer words have no spans. Equal rows repeat each other and give one set of spans; rows with equal ids and
    different texts are separate. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tkey", F.xxhash64("text"))

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", SMALL_BYTES):
            text, least, whole, first, last, one, two = _runs(piece.column(1), length, gram)
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([piece.column(0).take(take), piece.column(2).take(take), pa.array(least.view(np.int64)), pa.array(whole.view(np.int64)),
                                              pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(one), pa.array(two)], _NAMES)

    suffixes = materialise(rows.mapInArrow(retain, "doc_id long, tkey long, gram long, run long, first int, last int, one int, two int"))
    neighbours = suffixes.groupBy("gram").agg(F.sum("one").alias("texts")).where("texts > 1").select("gram")
    near = materialise(suffixes.join(neighbours, "gram"))
    settled = near.groupBy("run").agg(F.sum("two").alias("texts"), F.expr("min(struct(doc_id, tkey, first, last, gram))").alias("rep")).where("texts > 1")
    settled = materialise(settled)
    judged = materialise(near.join(settled.select("run", F.lit(True).alias("whole")), "run", "left").withColumn("whole", F.coalesce("whole", F.lit(False))))
    border = judged.where("NOT whole")
    # a settled run stands for two texts at least, among the border runs of its gram
    stands = settled.join(border.select("gram").distinct(), F.expr("rep.gram = gram"), "left_semi").select("rep.doc_id", "rep.tkey", "rep.first", "rep.last", F.lit(2).alias("weight"))
    asked = border.select("doc_id", "tkey", "first", "last", F.lit(1).alias("weight")).unionByName(stands).groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("first", "last", "weight")).alias("runs"))
    texts = rows.join(asked.select(F.col("doc_id").alias("aid"), F.col("tkey").alias("akey"), "runs"), F.expr("tkey = akey AND doc_id <=> aid")).select("doc_id", "tkey", "text", "runs")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", SMALL_BYTES):
            values, starts = hashed_words(piece.column(2))
            runs, counts = piece.column(3).flatten(), np.diff(piece.column(3).offsets.to_numpy())
            owner = np.repeat(np.arange(piece.num_rows), counts)
            first, last, weight = (runs.field(i).to_numpy().astype(np.int64) for i in range(3))
            number = last - first + 1
            run = np.repeat(np.arange(len(number)), number)
            at = first[run] + np.arange(len(run)) - (np.cumsum(number) - number)[run]
            text = owner[run]
            begin = at + starts[:-1][text]
            value = _Stretches(values)(begin, begin + length)
            # of equal windows of one text the heaviest counts
            order = np.lexsort((-weight[run], value, text))
            again = np.zeros(len(order), bool)
            again[1:] = (text[order][1:] == text[order][:-1]) & (value[order][1:] == value[order][:-1])
            counted = weight[run]
            counted[order[again]] = 0
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([piece.column(0).take(take), piece.column(1).take(take), pa.array(value.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(counted.astype(np.int32)), pa.array((weight[run] == 1))],
                                             ["doc_id", "tkey", "window", "at", "weight", "border"])

    windows = materialise(texts.mapInArrow(align, "doc_id long, tkey long, window long, at int, weight int, border boolean"))
    again = windows.groupBy("window").agg(F.sum("weight").alias("texts")).where("texts > 1").select("window")
    found = windows.where("border").join(again, "window").select("doc_id", "tkey", F.col("at").alias("first"), F.col("at").alias("last"))
    spans = judged.where("whole").select("doc_id", "tkey", "first", "last").unionByName(found)
    # a text's spans are bounded by its own length; equal rows merge here
    merged = spans.groupBy("doc_id", "tkey").agg(F.expr(f"sort_array(collect_set(struct(first AS s, last + {length} AS e)))").alias("x"))
    joined = F.expr("""aggregate(x, cast(array() AS array<struct<s: int, e: int>>), (acc, y) ->
        CASE WHEN size(acc) > 0 AND element_at(acc, -1).e >= y.s
             THEN concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).s AS s, greatest(element_at(acc, -1).e, y.e) AS e)))
             ELSE concat(acc, array(y)) END)""")
    return merged.select("doc_id", F.explode(joined).alias("y")).select("doc_id", F.col("y.s").cast("long").alias("start_word"), F.col("y.e").cast("long").alias("end_word"))


_NAMES = ["doc_id", "tkey", "gram", "run", "first", "last", "one", "two"]
