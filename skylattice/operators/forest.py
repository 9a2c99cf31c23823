"""Out-of-fold random forests on binned features, grown in the tasks that hold the rows.

Features are cut into at most BINS bins at percentiles of the training rows. While a node of a tree holds more training rows than one
task may, its split is chosen from histograms that all tasks sum (a level of all trees at a time); only these few top splits reach the
driver. The rows below them are brought together by (held-out fold, tree, node), where the rest of the tree is grown and
predicts its rows at once, so that no tree is ever held whole. A training set that one task may hold is sent once for many trees.

Bootstrap weights are Poisson numbers from a hash of the row and the tree, so that recomputed partitions agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators.materialise import materialise, task_slots

#: Bins of a feature, and training rows (counted with their weights) that a child must have.
BINS, LEAST = 32, 5
#: Training rows, and bytes of their bins, of a node that one task grows; larger ones are split by all tasks. A task needs some nine
#: times these bytes. Where the whole training set is more, every tree gets its own copy of the rows, so the limit is what a task can hold.
ROWS, BYTES = 1 << 20, 5 << 23
#: Cells of the histograms that a task sums at once, and entries that it counts at once.
CELLS, COUNTED = 1 << 20, 1 << 16

#: Shares of Poisson(1) numbers up to 0, 1, 2, ...
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.array([1, *range(1, 16)], float)))


def _weights(h: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap sample, from the row's hash."""
    z = h.view(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_POISSON, (z ^ (z >> np.uint64(31))) / 2.0**64, side="right").astype(float)


def _histograms(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and weighted labels by (picked feature, node, bin); `at` is each row's node. Some features at a time, so that
    what is counted stays in the processor's cache."""
    k, m = picks.shape
    n, s = np.empty((m, k, BINS)), np.empty((m, k, BINS))
    entries, row, wy = x.ravel(), np.arange(len(at)) * x.shape[1], w * y
    step = max(1, COUNTED // max(len(at), 1))
    for a in range(0, m, step):
        some = picks.T[a : a + step]
        cell = some.take(at, 1)
        cell += row
        cell = entries.take(cell) + (np.arange(len(some))[:, None] * (k * BINS) + at * BINS)
        cell = cell.ravel()
        for into, v in ((n, w), (s, wy)):
            into[a : a + step] = np.bincount(cell, np.tile(v, len(some)), len(some) * k * BINS).reshape(-1, k, BINS)
    return n, s


def _best(n: np.ndarray, s: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """For each node the place of the picked feature that lowers the variance most (-1: none does), and its last bin to the left.

    The labels' sums `s` are of labels less their node's mean.
    """
    left, gain = np.cumsum(n, 2), np.cumsum(s, 2)
    count = left[0, :, -1].copy()
    right = left[:, :, -1:] - left
    gain *= gain
    few = np.minimum(left, right) < LEAST
    left *= right
    left[few] = np.inf
    gain /= left
    last = gain.argmax(2)
    most = np.take_along_axis(gain, last[:, :, None], 2)[:, :, 0] * count
    best, every = most.argmax(0), np.arange(n.shape[1])
    return np.where(most[best, every] > noise, best, -1), last[best, every]


def _grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, m: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """feature (-1: leaf), cut, left (child; the right one follows) and value of every node; nodes see m features each."""
    rows = np.flatnonzero(w > 0)
    if not len(rows):
        return ()
    centre = np.average(y, weights=w)
    y = y - centre
    noise = 1e-12 * float(w @ (y * y))
    feature, cut, left, value = np.full(1, -1), np.zeros(1, int), np.zeros(1, int), np.full(1, centre)
    at = np.zeros(len(rows), int)
    for _ in range(depth):
        if not len(rows):
            break
        ids, local = np.unique(at, return_inverse=True)
        order = np.argsort(local, kind="stable")
        rows, local = rows[order], local[order]
        picks = np.argsort(rng.random((len(ids), x.shape[1])), 1)[:, :m]
        split, last = np.zeros(len(ids), int), np.zeros(len(ids), int)
        step = max(1, CELLS // (m * BINS))
        for a in range(0, len(ids), step):
            b = min(a + step, len(ids))
            lo, hi = np.searchsorted(local, (a, b))
            some, own = rows[lo:hi], local[lo:hi]
            split[a:b], last[a:b] = _best(*_histograms(x[some], y[some] - (value[ids] - centre)[own], w[some], own - a, picks[a:b]), noise)
        cutting = split >= 0
        feature[ids] = chosen = np.where(cutting, picks[np.arange(len(ids)), split], -1)
        cut[ids] = last
        born, new = len(feature), 2 * int(cutting.sum())
        left[ids[cutting]] = born + 2 * np.arange(new // 2)
        going = cutting[local]
        rows, local = rows[going], local[going]
        child = left[ids[local]] + (x[rows, chosen[local]] > last[local]) - born
        n, s = (np.bincount(child, v, new) for v in (w[rows], w[rows] * y[rows]))
        feature, cut, left = (np.concatenate((old, np.full(new, fill))) for old, fill in ((feature, -1), (cut, 0), (left, 0)))
        value = np.concatenate((value, centre + s / np.maximum(n, 1)))
        large = n[child] >= 2 * LEAST
        rows, at = rows[large], child[large] + born
    return feature, cut, left, value


def _walked(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The value of each row's leaf."""
    feature, cut, left, value = tree
    at, every = np.zeros(len(x), int), np.arange(len(x))
    while (inner := feature[at] >= 0).any():
        at = np.where(inner, left[at] + (x[every, feature[at]] > cut[at]), at)
    return value[at]


def _edges(train: DataFrame, p: int, n_folds: int) -> list[list[np.ndarray]]:
    """For each held-out fold and feature the upper ends of the bins, from the rows outside that fold."""
    shares = [i / BINS for i in range(1, BINS)]
    found = train.agg(*[F.percentile_approx(F.when(F.col("f") != f, F.col("x")[j]), shares, 10_000).alias(f"q{f}_{j}") for f in range(n_folds) for j in range(p)]).first()
    return [[np.unique(np.array(found[f"q{f}_{j}"] or [], float)) for j in range(p)] for f in range(n_folds)]


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.uint8)


def _picks(seed: int, f: int, tree: int, node: int, p: int, m: int) -> np.ndarray:
    """The features that a node of the top may split on."""
    return np.random.default_rng([seed, f, tree, node]).permutation(p)[:m]


def _placed(x: np.ndarray, splits: dict[int, tuple[int, int]]) -> np.ndarray:
    """The node below the top splits in which each row lies; the children of node i are 2 i and 2 i + 1."""
    at = np.ones(len(x), np.int64)
    for node in sorted(splits):
        feature, last = splits[node]
        here = at == node
        at[here] = 2 * node + (x[here, feature] > last)
    return at


def _matrix(batch: pa.RecordBatch, p: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)


def _top(train: DataFrame, edges: list, sizes: list[int], limit: int, trees: int, m: int, seed: int, max_depth: int) -> tuple[dict, dict]:
    """The splits of all nodes with more than `limit` training rows, by (fold, tree), and the means of those that no split improves."""
    p = len(edges[0])
    splits: dict[tuple[int, int], dict[int, tuple[int, int]]] = {(f, t): {} for f in range(len(edges)) for t in range(trees)}
    final: dict[tuple[int, int, int], float] = {}
    active = [(f, t, 1) for f, t in splits if sizes[f] > limit]
    step = max(1, CELLS // (m * BINS))
    while active:
        found = []
        for a in range(0, len(active), step):
            some = active[a : a + step]
            spread = train.sparkSession.sparkContext.broadcast((some, {k: splits[k] for k in {x[:2] for x in some}}))

            def partial(batches: Iterator[pa.RecordBatch], spread=spread, first=a) -> Iterator[pa.RecordBatch]:
                nodes, tops = spread.value
                picks = np.array([_picks(seed, *node, p, m) for node in nodes])
                index = {node: i for i, node in enumerate(nodes)}
                n, s, rows, squares = np.zeros((len(nodes), m, BINS)), np.zeros((len(nodes), m, BINS)), np.zeros((len(nodes), m, BINS)), np.zeros(len(nodes))
                for batch in batches:
                    raw, own, h, y = _matrix(batch, p), *(batch.column(c).to_numpy() for c in ("f", "h", "y"))
                    for f in sorted({k[0] for k in tops}):
                        use = own != f
                        x, hs, ys = _binned(raw[use], edges[f]), h[use], y[use]
                        for f2, t in (k for k in tops if k[0] == f):
                            w, at = _weights(hs, seed, t), _placed(x, tops[f2, t])
                            for node in np.unique(at[w > 0]):
                                if (i := index.get((f, t, int(node)))) is None:
                                    continue
                                here = (at == node) & (w > 0)
                                zero, pick = np.zeros(int(here.sum()), int), picks[i : i + 1]
                                one, two = _histograms(x[here], ys[here], w[here], zero, pick)
                                n[i], s[i] = n[i] + one[:, 0], s[i] + two[:, 0]
                                rows[i] += _histograms(x[here], ys[here], np.ones(len(zero)), zero, pick)[0][:, 0]
                                squares[i] += w[here] @ ys[here] ** 2
                i, j, b = np.nonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (i + first, j, b, n[i, j, b], s[i, j, b], rows[i, j, b], np.where((j == 0) & (b == n[i, 0].argmax(1)), squares[i], 0.0))], ["i", "j", "b", "n", "s", "r", "q"])

            def choose(pdf: pd.DataFrame) -> pd.DataFrame:
                n, s, r = (np.zeros((m, 1, BINS)) for _ in range(3))
                for into, c in ((n, "n"), (s, "s"), (r, "r")):
                    into[pdf.j, 0, pdf.b] = pdf[c]
                count, mean = n[0, 0].sum(), s[0, 0].sum() / n[0, 0].sum()
                split, last = _best(n, s - mean * n, 1e-12 * max(pdf.q.sum() - count * mean**2, 0.0))
                rows = r[max(split[0], 0), 0]
                return pd.DataFrame({"i": [pdf.i.iloc[0]], "j": split, "b": last, "mean": [mean], "lo": [rows[: last[0] + 1].sum()], "hi": [rows[last[0] + 1 :].sum()]})

            sums = train.mapInArrow(partial, "i long, j long, b long, n double, s double, r double, q double").groupBy("i", "j", "b").agg(*[F.sum(c).alias(c) for c in "nsrq"])
            found += sums.groupBy("i").applyInPandas(choose, "i long, j long, b long, mean double, lo double, hi double").collect()
            spread.unpersist()
        after = []
        for i, j, b, mean, lo, hi in found:
            f, t, node = active[i]
            if j < 0 or node.bit_length() > max_depth:
                final[f, t, node] = mean
                continue
            splits[f, t][node] = (int(_picks(seed, f, t, node, p, m)[j]), int(b))
            after += [(f, t, 2 * node + side) for side, rows in enumerate((lo, hi)) if rows > limit]
        active = after
    return splits, final


def one_task(p: int) -> int:
    """Training rows of p features that one task grows."""
    return max(4 * LEAST, min(ROWS, BYTES // p))


def together(spark: SparkSession, trees: int) -> int:
    """Trees that get their rows together: as many as leave work for all cores. Each further batch sends all rows once more, so that
    their number must not follow that of the shuffle's partitions."""
    return max(1, trees // (4 * spark.sparkContext.defaultParallelism))


def forest_oof(df: DataFrame, features: Sequence[str], label: str, fold: str, folds: Sequence, trees: int, keep: Sequence[str] = (),
               predict: DataFrame | None = None, seed: int = 42, max_depth: int = 30) -> DataFrame:
    """Out-of-fold predictions `pred` of a regression forest: columns `keep`, fold, label and pred.

    Each tree has a bootstrap sample of the rows outside the fold, each node half of the features (rounded up). The rows of `predict`,
    or else of `df`, are predicted; rows without a label train nothing, missing features fail the job. NULL where nothing trains.
    """
    p, m, spark = len(features), -(-len(features) // 2), df.sparkSession
    slots = task_slots(spark)  # files of a few MB would be read by few tasks, whose work is many times their size
    place = F.coalesce(*[F.when(F.col(fold) == g, F.lit(i)) for i, g in enumerate(folds)], F.when(F.col(fold).isNotNull(), F.lit(-1)))
    known = [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.raise_error(F.lit(f"{c} is missing"))).otherwise(F.col(c).cast("double")) for c in features]
    used = [c for c in dict.fromkeys([*keep, fold, label, *features]) if c in df.columns]
    train = materialise(df.where(F.col(label).isNotNull() & F.col(fold).isNotNull())
                        .select(place.alias("f"), F.xxhash64(*used).alias("h"), F.col(label).cast("double").alias("y"), F.array(*known).alias("x"))
                        .repartition(slots, "h"))
    asked = (df if predict is None else predict).withColumn("__f", place).where("__f >= 0")
    asked = materialise(asked.repartition(slots, F.xxhash64(*[c for c in used if c in asked.columns]))
                        .select("__f", F.monotonically_increasing_id().alias("__id"), *dict.fromkeys([*keep, fold, label]), F.array(*known).alias("__x")))
    counts = {r["f"]: r["count"] for r in train.groupBy("f").count().collect()}
    sizes = [sum(counts.values()) - counts.get(f, 0) for f in range(len(folds))]
    edges = _edges(train, p, len(folds))
    limit = one_task(p)
    splits, final = _top(train, edges, sizes, limit, trees, m, seed, max_depth) if max(sizes, default=0) > limit else ({}, {})
    batch_of = 1 if splits else together(spark, len(folds) * trees)  # one where the top parts the rows
    top = spark.sparkContext.broadcast((splits, final))

    def dealt(x: np.ndarray, f: int, g: int) -> np.ndarray:
        tops = top.value[0].get((f, g)) if batch_of == 1 else None
        return _placed(x, tops) if tops else np.ones(len(x), np.int64)

    def spread(kind: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, own, h, y = _matrix(batch, p), *(batch.column(c).to_numpy() for c in ("f", "h", "y"))
                for f in range(len(folds)):
                    use = (own != f) if kind == 0 else (own == f)
                    if not use.any():
                        continue
                    x, hs, ys = _binned(raw[use], edges[f]), h[use], y[use]
                    for g in range(-(-trees // batch_of)):
                        node = dealt(x, f, g)
                        stay = np.ones(len(x), bool)
                        if kind == 0 and batch_of == 1:
                            stay = (_weights(hs, seed, g) > 0) & ~np.isin(node, [n for f2, t, n in top.value[1] if (f2, t) == (f, g)])
                        n = int(stay.sum())
                        bins = pa.Array.from_buffers(pa.binary(p), n, [None, pa.py_buffer(np.ascontiguousarray(x[stay]).tobytes())]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, f, np.int32)), pa.array(np.full(n, g, np.int32)), pa.array(node[stay]), pa.array(np.full(n, kind, np.int32)), pa.array(hs[stay]), pa.array(ys[stay]), bins],
                                                         ["f", "g", "node", "kind", "h", "y", "x"])

        return run

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, grown = None, [], None
        for batch in batches:
            f, g, node, kind, h, y = (batch.column(c).to_numpy() for c in ("f", "g", "node", "kind", "h", "y"))
            bins = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(-1, p)
            ends = np.flatnonzero((np.diff(f) != 0) | (np.diff(g) != 0) | (np.diff(node) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *ends], [*ends, len(f)], strict=True):
                if hi == lo:
                    continue
                if (now := (int(f[lo]), int(g[lo]), int(node[lo]))) != key:
                    key, held, grown = now, [], None
                if kind[lo] == 0:
                    held.append((bins[lo:hi], y[lo:hi], h[lo:hi]))
                    continue
                if grown is None:
                    grown = list(ours(now, held))
                    held = []
                total = sum((_walked(tree, bins[lo:hi]) for tree in grown), np.zeros(hi - lo))
                yield pa.RecordBatch.from_arrays([pa.array(h[lo:hi]), pa.array(total), pa.array(np.full(hi - lo, len(grown)))], ["__id", "s", "k"])

    def ours(key: tuple[int, int, int], held: list) -> Iterator[tuple[np.ndarray, ...]]:
        f, g, node = key
        if key in top.value[1]:
            yield np.full(1, -1), np.zeros(1, int), np.zeros(1, int), np.full(1, top.value[1][key])
        elif held:
            x, y, h = (np.concatenate(part) for part in zip(*held, strict=True))
            for t in range(g * batch_of, min((g + 1) * batch_of, trees)):
                tree = _grown(x, y, _weights(h, seed, t), max_depth + 1 - node.bit_length(), m, np.random.default_rng([seed, f, t, node, 1]))
                if tree:
                    yield tree

    shape = "f int, g int, node long, kind int, h long, y double, x binary"
    both = train.select("f", "h", "y", "x").mapInArrow(spread(0), shape).unionByName(
        asked.select(F.col("__f").alias("f"), F.col("__id").alias("h"), F.lit(0.0).alias("y"), F.col("__x").alias("x")).mapInArrow(spread(1), shape))
    groups = len(folds) * -(-trees // batch_of) + sum(map(len, splits.values()))
    parts = min(2000, max(slots, 2 * groups))
    # batches of trees are few and long, so that two of them in one partition by their hash would make the last tasks wait
    dealt_out = both.repartition(parts, "f", "g", "node") if splits else both.repartitionById(parts, F.col("f") * -(-trees // batch_of) + F.col("g"))
    told = (dealt_out.sortWithinPartitions("f", "g", "node", "kind", "h")
            .mapInArrow(fit, "__id long, s double, k long").groupBy("__id").agg((F.sum("s") / F.nullif(F.sum("k"), F.lit(0))).alias("pred")))
    return asked.join(told.hint("merge"), "__id", "left").select(*keep, fold, label, "pred")
