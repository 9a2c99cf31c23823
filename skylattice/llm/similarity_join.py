"""N-gram Jaccard join with adaptive multi-match prefixes, and the classes that its links form.

A text's set holds its distinct word shingles. Sets are ordered by one global order: shingles that are frequent in many
places come last, by their counted frequency, all others by their hash. Two sets that link share at least l of the tokens of
their l-prefixes, of length n - ceil(t * n) + l. Each set chooses its own l: a longer prefix costs more postings, but asks
for l shared tokens before a pair is verified; for l and m the smaller of the two is asked for, which loses no pair.
A posting carries the token's position. Two sets that must share o tokens share l of them at positions up to n - o + l in
both, so that tokens further back join no pair; and sketches of the parities of hashed cells bound the difference of two
sets from below, inside the same join.

Equal sets are one node, whatever their number. Groups of near copies are not paired off: first, in a few rounds, each
node is verified against a few centres of other classes, the nodes that stand for most of its token lists. Then only pairs of nodes of different
classes are generated; a token whose nodes are all of one class generates none. What these verified links join are the final
classes, and they are exactly those of all links: a pair left out lies within a class.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.llm.words import SMALL_BYTES, mixed, pieces, set_shingles
from skylattice.operators.materialise import materialise

#: Frequent shingles kept for the global order. The order changes the cost only, never the result.
FREQUENT = 200_000
#: Texts of one piece that must share a shingle for it to count as frequent there.
LOCAL = 4
#: Longest multi-match asked for, and the weight of a verification against reading one posting.
LONGEST, VERIFY = 6, 16.0
#: Most rounds with centres; a round without a new link is the last. Centres of a token after the first round, and most
#: centres that a node tries in a round.
ROUNDS, CENTRES, TRIED = 3, 8, 6
#: Cells of the hash space whose counts bound the overlap of two sets from above.
CELLS = 256
#: Columns of the parities of the cells.
ODD = tuple(f"odd{k}" for k in range(4))
#: Tables of at most this many rows go to all tasks when texts are fetched; larger ones are joined by shuffle.
SMALL_ROWS = 2_000_000


def frequent_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in many texts of some place, with their counts; at most FREQUENT, all texts are counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", SMALL_BYTES):
            sets = set_shingles(piece.column(0), n)
            values, times = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
            often = times >= LOCAL
            yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(times[often])], ["token", "n"])

    top = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    tokens, counts = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any set that it links with."""
    return -(-percent * n // 100)


def adaptive_prefix(values: np.ndarray, percent: int, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix of one set in the global order, and the number of matches l that it asks for.

    The cost of l is the number of postings read, and the candidates among them weighted by VERIFY / l: a candidate
    takes up l of the postings at least.
    """
    df = np.zeros(len(values), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        df = np.where(frequent[at] == values, counts[at], 0)
    order = np.lexsort((values, df))
    shortest = len(values) - least_overlap(len(values), percent) + 1
    read = np.cumsum(np.maximum(df[order] - 1, 0))
    choices = range(1, min(LONGEST, len(values) - shortest + 1) + 1)
    best = min(choices, key=lambda m: (shortest + m - 1) + read[shortest + m - 2] * (1 + VERIFY / m))
    return values[order[: shortest + best - 1]], best


def _set_hash(values: np.ndarray) -> int:
    """64 bits from two sums of scrambled values and the size; the order does not matter."""
    one, two = int(mixed(values + np.uint64(11)).sum()), int(mixed(mixed(values) + np.uint64(7)).sum())
    return int(mixed(np.array([(one ^ two * 0x9E3779B97F4A7C15 ^ len(values)) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


def _cells(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """How many values lie in each cell, up to 255; and a bit for each cell, set where the number is odd, in four longs."""
    counts = np.bincount((values >> np.uint64(56)).astype(np.int64), minlength=CELLS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), np.packbits(counts % 2 == 1).view(np.int64)


def _needed(a: str, b: str, percent: int) -> str:
    """Shingles that sets of these sizes share at least if they link."""
    return f"(({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent})"


def _places_fit(a: str, b: str, percent: int) -> str:
    """Whether a shared token counts for a pair: it is among the first size - needed + matches of both sides.

    a and b are patterns of column names, such as "{}_a".
    """
    (pa_, na, ma), (pb, nb, mb) = ([k.format(c) for c in ("pos", "size", "m")] for k in (a, b))
    need, match = _needed(na, nb, percent), f"least({ma}, {mb})"
    return f"{pa_} + {need} <= {na} + {match} AND {pb} + {need} <= {nb} + {match}"


def _apart(a: str, b: str) -> str:
    """A lower bound of the number of shingles in just one of two sets: cells whose counts differ in parity."""
    return " + ".join(f"bit_count({a.format(f'odd{k}')} ^ {b.format(f'odd{k}')})" for k in range(4))


def _possible(pairs: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose overlap can be large enough: it is at most the sum of the lesser counts of each cell.

    A full cell bounds nothing, so that a pair with one stays. No pair that links is lost.
    """
    x, y = (about.select(F.col("node").alias(k), F.col("size").alias(f"n{k}"), F.col("cells").alias(f"c{k}")) for k in "ab")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ca, cb = (np.frombuffer(b"".join(batch.column(f"c{k}").to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int64) for k in "ab")
            most = np.minimum(ca, cb).sum(1)
            sizes = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            open_end = ((ca == 255) | (cb == 255)).any(1)
            yield batch.filter(pa.array(open_end | (100 * most >= percent * (sizes - most)))).select(["a", "b"])

    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "na", "nb", "ca", "cb").mapInArrow(bound, "a long, b long")


def _keyed(docs: DataFrame) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.withColumn("tkey", F.xxhash64("text"))


def _prefix_table(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, tkey (hash of the text), node (hash of the set), n_shingles, m (matches asked for), cells, odd0 to odd3 (their parities), prefix."""
    frequent, counts = frequent_shingles(docs, n)
    spread = docs.sparkSession.sparkContext.broadcast((frequent, counts))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, times = spread.value
        for piece in pieces(batches, "text", SMALL_BYTES):
            nodes, sizes, asked, cells, odd, prefixes = [], [], [], [], [], []
            for values in set_shingles(piece.column(1), n):
                sizes.append(len(values))
                counts, parities = _cells(values)
                cells.append(counts)
                odd.append(parities)
                if len(values):
                    prefix, m = adaptive_prefix(values, percent, tokens, times)
                    nodes.append(_set_hash(values))
                else:
                    prefix, m = values, 0
                    nodes.append(0)
                asked.append(m)
                prefixes.append(prefix.view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(prefixes)))
            bits = [pa.array(np.ascontiguousarray(column)) for column in np.array(odd).T]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(asked, pa.int32()), pa.array(cells, pa.binary()), *bits, lists],
                                             ["doc_id", "tkey", "node", "n_shingles", "m", "cells", *ODD, "prefix"])

    return materialise(docs.mapInArrow(read, f"doc_id long, tkey long, node long, n_shingles long, m int, cells binary, {', '.join(f'{c} long' for c in ODD)}, prefix array<long>"))


def _sizes_fit(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _verified(pairs: DataFrame, bodies: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link, as a written table."""
    x = bodies.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    y = bodies.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half in pieces([batch], "ta", SMALL_BYTES):
                for piece in pieces([half], "tb", SMALL_BYTES):
                    fits = []
                    for p, q in zip(set_shingles(piece.column("ta"), n), set_shingles(piece.column("tb"), n), strict=True):
                        both = np.concatenate((p, q))
                        both.sort()
                        shared = int((both[1:] == both[:-1]).sum())
                        fits.append(shared > 0 and 100 * shared >= percent * (len(both) - shared))
                    yield piece.filter(pa.array(fits)).select(["a", "b"])

    texts = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "ta", "tb")
    return materialise(texts.mapInArrow(check, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node reachable over the edges (a, b). Each round hooks every node to its least neighbour and
    contracts, so that the rounds are logarithmic in the number of nodes; the tables of a round are written."""
    left = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")))
        # hooks always lead downwards; one jump halves their chains
        jump = hook.alias("h").join(hook.alias("u"), F.expr("h.up = u.a"), "left").select(F.col("h.a").alias("node"), F.coalesce("u.up", "h.up").alias("up"))
        jump = materialise(jump)
        if labels is None:
            labels = jump.select("node", F.col("up").alias("label"))
        else:
            labels = labels.join(jump.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
        labels = materialise(labels)
        ends = left.join(jump.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(jump.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        left = materialise(ends.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0) if labels is None else labels


def similarity_classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (the least doc_id of the row's class, itself included).

    Words are split on ASCII white space after folding A-Z. Two rows link when 100 * |intersection| >= percent * |union| of
    their sets of n-word shingles; fewer words than n make one shingle. Null texts and texts without words have empty sets
    and are linked with nothing. Rows with equal ids are separate rows. A null id never is the least one; it gets a
    component_id only if its class holds another id. Other columns are ignored.
    """
    rows = _keyed(docs)
    table = _prefix_table(rows, n, percent)
    labels, folded = _labels(rows, table, n, percent)
    # the least id of each class: of nodes first, so that no group of copies is brought to one task
    nodes = table.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = materialise(nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "least"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "label").select("node", "component_id")
    out = table.select("doc_id", "n_shingles", "node").join(classes, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _labels(rows: DataFrame, table: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The label of every node that links with another, and all verified links."""
    postings = table.select(F.posexplode("prefix").alias("pos", "token"), "node", F.col("n_shingles").alias("size"), "m").withColumn("pos", F.col("pos") + 1)
    lists = postings.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("token")
    shared = materialise(postings.join(lists, "token").groupBy("token", "node").agg(F.max("size").alias("size"), F.max("m").alias("m"), F.min("pos").alias("pos")))
    about = materialise(table.where("n_shingles > 0").groupBy("node").agg(F.max("n_shingles").alias("size"), F.max("m").alias("m"), F.expr("min(struct(doc_id, tkey))").alias("rep"), F.max("cells").alias("cells"), *[F.max(c).alias(c) for c in ODD]))
    links, labels = None, None
    for r in range(ROUNDS):
        star = _star(shared, about, labels, r, percent)
        if star.isEmpty():
            break
        found = _verified(star, _bodies(rows, about, star), n, percent)
        if found.isEmpty():
            break
        links = found if links is None else materialise(links.unionByName(found))
        labels = components(links)
    # exact round: tokens with nodes of more than one class, pairs across classes only
    open_lists = materialise(_open(shared, labels).join(about.select("node", *ODD), "node"))
    a, b = (open_lists.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "pos", "size", "m", "label", *ODD)]) for s in "ab")
    near = f"{_apart('{}_a', '{}_b')} <= size_a + size_b - 2 * {_needed('size_a', 'size_b', percent)}"
    pairs = a.join(b, "token").where(f"node_a < node_b AND label_a <> label_b AND {_sizes_fit('size_a', 'size_b', percent)} AND {_places_fit('{}_a', '{}_b', percent)} AND {near}")
    pairs = pairs.groupBy("node_a", "node_b").agg(F.count("*").alias("shared"), F.min(F.least("m_a", "m_b")).alias("m")).where("shared >= m")
    pairs = materialise(_possible(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), about, percent))
    if pairs.isEmpty():
        return (components(pairs) if labels is None else labels), links
    more = _verified(pairs, _bodies(rows, about, pairs), n, percent)
    links = more if links is None else links.unionByName(more)
    return components(links), links


def _open(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The postings of tokens whose nodes are of more than one class, with the class label."""
    if labels is None:
        return shared.withColumn("label", F.col("node"))
    classed = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lists = classed.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    return classed.join(lists, "token")


def _star(shared: DataFrame, about: DataFrame, labels: DataFrame | None, r: int, percent: int) -> DataFrame:
    """At most TRIED pairs (a, b) for each node a: the b are nodes of other classes that are centres of a's tokens and by
    their parities closest to a, if sizes and matches allow a link. A token's centres are its nodes of the
    least hashes in this round; every other one is taken among those with the fewest rarer tokens, which differ least from the rest."""
    lists = _open(shared, labels)
    number = 1 if r == 0 else CENTRES
    least = [F.min(F.struct(F.col("pos") if k % 2 == 0 else F.lit(0), F.xxhash64("node", F.lit(r * CENTRES + k)), *[F.col(c).alias(f"{c}_c") for c in ("node", "label", "pos", "size", "m")])).alias(f"c{k}") for k in range(number)]
    parts = [F.struct(*[f"c{k}.{c}_c" for c in ("node", "label", "pos", "size", "m")]) for k in range(number)]
    centres = lists.groupBy("token").agg(*least).select("token", F.explode(F.array_distinct(F.array(*parts))).alias("c")).select("token", "c.*")
    star = lists.join(centres, "token").where(f"label <> label_c AND {_sizes_fit('size', 'size_c', percent)} AND {_places_fit('{}', '{}_c', percent)}")
    star = star.groupBy("node", "node_c").agg(F.count("*").alias("shared"), F.max("size").alias("size"), F.max("size_c").alias("size_c"), F.min(F.least("m", "m_c")).alias("m")).where("shared >= m")
    star = star.join(about.select("node", *ODD), "node").join(about.select(*[F.col(c).alias(f"{c}_c") for c in ("node", *ODD)]), "node_c")
    star = star.withColumn("apart", F.expr(_apart("{}", "{}_c"))).where(f"apart <= size + size_c - 2 * {_needed('size', 'size_c', percent)}")
    star = star.groupBy("node").agg(F.expr(f"slice(sort_array(collect_list(struct(apart, node_c))), 1, {TRIED})").alias("best"))
    return materialise(_possible(star.select(F.col("node").alias("a"), F.explode("best.node_c").alias("b")), about, percent))


def _bodies(rows: DataFrame, about: DataFrame, pairs: DataFrame) -> DataFrame:
    """node, text of every node of the pairs: the text of its representative row."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialise(nodes.join(about.select("node", F.col("rep.doc_id").alias("rid"), F.col("rep.tkey").alias("rkey")), "node"))
    if wanted.count() <= SMALL_ROWS:
        wanted = F.broadcast(wanted)
    found = rows.join(wanted, F.expr("tkey = rkey AND doc_id <=> rid"))
    return materialise(found.select("node", "text").dropDuplicates(["node"]))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns unchanged, with the least doc_id of their class; of several such rows one stays.

    Rows without a set (null texts, texts without words) all stay, as do rows of a class that has no id.
    """
    own, kind = _unused(docs.columns, "__class"), _unused(docs.columns, "__keep")
    spark_rows = docs.withColumn(own, F.struct(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tkey"), F.col("doc_id").cast("long").alias("doc_id")))
    rows = _keyed(docs)
    table = _prefix_table(rows, n, percent)
    labels, _ = _labels(rows, table, n, percent)
    nodes = table.where("n_shingles > 0").groupBy("node").agg(F.expr("min(CASE WHEN doc_id IS NOT NULL THEN struct(doc_id, tkey) END)").alias("rep"), F.expr("min(struct(doc_id, tkey))").alias("any_rep"))
    named = nodes.join(labels, "node", "left").select(F.coalesce("label", "node").alias("label"), F.expr("struct(isnull(rep) AS unnamed, coalesce(rep, any_rep) AS rep)").alias("rep"))
    winners = named.groupBy("label").agg(F.min("rep").alias("rep")).select(F.col("rep.rep.tkey").alias("wkey"), F.col("rep.rep.doc_id").alias("wid"))
    empty = table.where("n_shingles = 0").select(F.col("tkey").alias("wkey"), F.col("doc_id").alias("wid")).distinct()
    keep = materialise(winners.withColumn("single", F.lit(True)).unionByName(empty.withColumn("single", F.lit(False))))
    kept = spark_rows.join(keep.select(F.struct(*keep.columns).alias(kind)), F.expr(f"`{own}`.tkey = `{kind}`.wkey AND `{own}`.doc_id <=> `{kind}`.wid"))
    # equal rows of one winner: a number within (id, text), which are few; rows without a set keep all
    single = kept.where(f"`{kind}`.single").drop(kind).dropDuplicates([own])
    return single.unionByName(kept.where(f"NOT `{kind}`.single").drop(kind)).drop(own)


def _unused(columns: Sequence[str], name: str) -> str:
    """The name, lengthened until no column has it in any case."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name
