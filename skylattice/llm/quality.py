"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between trusted texts and the whole corpus.

Every text is read twice. The first pass counts hashed unigrams and bigrams of word and punctuation runs in all texts (raw
corpus) and in the texts of trusted documents (target). The second gives each text the sum of log(target / raw) over its
grams in whole millionths, divided by their number. Integer sums make the score independent of batches and retries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.llm.words import Words, gram_hashes, mixed, pieces, segment_sums, split_words

BUCKETS = 1 << 16
#: Trusted ids that every task holds; all of them count in any case.
TRUSTED_LIMIT = 100_000
#: Nats per gram below which a text is rejected.
MIN_SCORE = -0.2
SYMBOLS = "[#*$%&|<>]"
WHITE = " \t\n\x0b\x0c\r"
#: Words are joined by line ends, which are runs of their own.
_RUNS = re.compile(r"\w+|\n|[^\w\s]+")
_END = np.uint64(xxhash.xxh64_intdigest("\n", 1))
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _runs(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of word characters and of marks of each word, in lower case, and where each word's runs start.

    Nothing outlives the call: worker processes are used again, and what they remembered would add up over a session.
    """
    found = pa.array(_RUNS.findall("".join(f"{w}\n" for w in vocabulary).lower()), pa.string()).dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(r, 1) for r in found.dictionary.to_pylist()), np.uint64, len(found.dictionary))
    codes = found.indices.to_numpy()
    end = hashes[codes] == _END
    return hashes[codes[~end]], np.concatenate(([0], np.cumsum(~end)[end]))


def _grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the unigrams and bigrams of each text, and where each text's grams start."""
    flat, offset = _runs(words.vocabulary)
    length = np.diff(offset)[words.codes]
    total = np.concatenate(([0], np.cumsum(length)))
    tokens = flat[np.repeat(offset[words.codes] - total[:-1], length) + np.arange(total[-1])]
    starts = total[words.starts]
    pair = gram_hashes(tokens, 2)
    last = np.zeros(len(tokens), bool)
    last[starts[1:][starts[1:] > starts[:-1]] - 1] = True
    joined = np.empty(2 * len(tokens), np.int64)
    joined[0::2] = tokens % np.uint64(BUCKETS)
    joined[1::2][: len(pair)] = pair % np.uint64(BUCKETS)
    valid = np.ones(2 * len(tokens), bool)
    valid[1::2] = ~last
    kept = np.concatenate(([0], np.cumsum(valid)))
    return joined[valid], kept[2 * starts]


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids (doc_id) that are labelled good and never bad or toxic."""
    return (labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
            .where("q = 1 AND coalesce(t, 0) = 0").select("doc_id"))


def gram_counts(docs: DataFrame, trusted: DataFrame, few: int = TRUSTED_LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket in the trusted texts and in all texts; the result has BUCKETS rows whatever the corpus.

    Up to `few` trusted ids are held by every task; more meet the texts by sort and merge.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for piece in pieces(batches, "text"):
            grams, starts = _grams(split_words(piece.column(1)))
            raw += np.bincount(grams, minlength=BUCKETS)
            known = pc.is_valid(piece.column(0)).to_numpy(zero_copy_only=False)
            target += np.bincount(grams[np.repeat(known, np.diff(starts))], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(target[used]), pa.array(raw[used])], ["bucket", "target", "raw"])

    texts, good = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), trusted.withColumn("good", F.lit(True))
    held = trusted.limit(few + 1).count() <= few
    marked = (texts.join(F.broadcast(good), "doc_id", "left") if held else texts.hint("merge").join(good, "doc_id", "left")).select("good", "text")
    parts = marked.mapInArrow(count, "bucket int, target long, raw long")
    target, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("target"), F.sum("raw")).collect():
        target[r[0]], raw[r[0]] = r[1], r[2]
    return target, raw


def ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(target / raw) of each bucket in millionths. The target is smoothed towards the raw corpus by one gram a bucket."""
    q = (raw + 1) / (raw.sum() + BUCKETS)
    p = (target + BUCKETS * q) / (target.sum() + BUCKETS)
    return np.rint(1e6 * np.log(p / q)).astype(np.int64)


def repeated_words(codes: np.ndarray, n: int = 5) -> int:
    """Words that lie in an n-word window found at least twice; exact, by ranks of ever longer windows."""
    m = len(codes) - n + 1
    if m < 2:
        return 0
    rank, size = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
    key = rank
    while size < n:
        step = min(size, n - size)
        # two overlapping or adjacent windows of the known size make the longer one
        key = key[: len(codes) - size - step + 1] * (int(key.max()) + 1) + key[step : step + len(codes) - size - step + 1]
        size += step
        key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    again = np.bincount(key)[key] > 1
    edge = np.zeros(len(codes) + 1, np.int64)
    edge[:m] += again
    edge[n : n + m] -= again
    return int((np.cumsum(edge)[:-1] > 0).sum())


def repeated_lines(text: str | None) -> int:
    lines = [x for x in (text or "").split("\n") if x.strip(WHITE)]
    return len(lines) - len(set(lines))


def _measures(texts: pa.Array, table: np.ndarray, min_score: float) -> tuple[list[pa.Array], np.ndarray]:
    words = split_words(texts)
    vocabulary = pa.array(words.vocabulary, pa.string())
    sums = [segment_sums(pc.cast(x, pa.int64()).to_numpy(zero_copy_only=False)[words.codes], words.starts)
            for x in (pc.utf8_length(vocabulary), pc.count_substring_regex(vocabulary, SYMBOLS))]
    bounds = words.starts.tolist()
    # without equal hashes there are no equal windows; only the other texts are counted exactly
    windows = gram_hashes(mixed(words.codes.astype(np.uint64) + np.uint64(1)), 5)
    repeats = np.zeros(len(texts), np.int64)
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        seen = np.sort(windows[a : max(a, b - 4)])
        if (seen[1:] == seen[:-1]).any():
            repeats[i] = repeated_words(words.codes[a:b])
    lines = np.array([repeated_lines(t) for t in texts.to_pylist()], np.int64)
    grams, starts = _grams(words)
    number, total = np.diff(starts), segment_sums(table[grams], starts)
    failed = (words.counts < 10) | (100 * repeats > 20 * words.counts)
    kept = ~failed & (total >= round(min_score * 1e6) * number)
    score = np.where(number > 0, total / np.maximum(number, 1) / 1e6, 0.0)
    return [pa.array(x) for x in (words.counts, *sums, lines, repeats, failed, kept, score)], kept


def _table(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    return ratios(*gram_counts(docs, trusted_ids(labels)))


def quality_scores(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per row of `docs` (doc_id, text): the base counts, base_failed, kept and score (nats per gram).

    Null or empty texts have zero counts, fail the base rule and are not kept. Rows with equal or null ids are judged
    one by one. Other columns are ignored. Without trusted labels every ratio is zero and the base rule alone decides.
    """
    table = _table(docs, labels)
    schema = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.LongType()) for c in MEASURES]
                          + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece.column(0), *_measures(piece.column(1), table, min_score)[0]], schema.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(judge, schema)


def keep_good(docs: DataFrame, labels: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of `docs`, all columns unchanged, that `quality_scores` keeps."""
    table = _table(docs, labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            yield piece.filter(pa.array(_measures(piece.column("text"), table, min_score)[1]))

    return docs.mapInArrow(judge, docs.schema)
