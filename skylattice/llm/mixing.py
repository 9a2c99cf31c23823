"""Soft-membership mixing of sources to target weights.

A multinomial classifier, fitted on labelled documents, gives each document posterior weights over the domains of the label
table: good, poor and toxic. Each document gets a rate r >= 0, the expected number of times it is used. With token shares w
and posteriors p, projected-gradient steps minimise

    1/2 sum_k ((sum_d w_d r_d p_dk - target_k) / target_k)^2    subject to r >= 0,

from rate 1 on. There is no upper bound and no penalty, so that a rare domain reaches its target too. A step moves every rate by p . g and cuts
it at zero. Its vector g is the gradient in the metric of the domain totals of the rates that are free to move, which would end at the
targets if no rate were cut; a step that does not lower the sum is halved, and one that stays so is replaced by
the plain gradient, which always lowers it. Steps end when every total is within TOLERANCE of its target, when the projected gradient is
small, or after MAX_STEPS; the residual of every domain is returned, so a target that no rates can reach shows.

A step needs only the domain totals and a small matrix. A document's rate is a function of its posteriors and of the vectors so
far, so that no rates are stored between steps: each step is one pass over the written posterior table.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators.materialise import shared_folder

DOMAINS = ("good", "poor", "toxic")
#: Shares of the tokens of the mix, relative to all tokens of the corpus; they need not sum to one.
TARGETS = {"good": 0.90, "poor": 0.08, "toxic": 0.02}
FEATURES = 1 << 14
#: Labelled documents that the classifier is fitted on; of more, those with the smallest hashes of their ids.
LABELLED_LIMIT = 20_000
#: Share of its target within which a domain's total counts as met.
TOLERANCE = 1e-6
#: Passes over the posteriors; the residual is returned in any case.
MAX_STEPS = 60
#: Copies of a row that are listed at once when rows are repeated.
COPIES = 10_000
_WORDS = "filter(split(lower(text), '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+'), w -> w <> '')"


def labelled_domains(labels: DataFrame, limit: int = LABELLED_LIMIT) -> DataFrame:
    """At most `limit` rows doc_id, domain (index into DOMAINS). Any toxic label makes toxic, else any bad one poor."""
    return (labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id")
            .agg(F.expr("CASE WHEN max(toxic) = 1 THEN 2 WHEN min(quality) = 0 THEN 1 ELSE 0 END").cast("double").alias("domain"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))


def _features(df: DataFrame) -> DataFrame:
    """Unit vectors of the hashed words that occur, from a column `words`."""
    return Normalizer(inputCol="tf", outputCol="features").transform(HashingTF(numFeatures=FEATURES, binary=True, inputCol="words", outputCol="tf").transform(df)).drop("tf")


def with_posteriors(docs: DataFrame, labels: DataFrame, column: str = "mix") -> DataFrame:
    """`docs` with a struct column of n (words) and p (posterior of each domain).

    With labels of one domain only, that domain is certain; without labels the domains are equally likely.
    """
    # the labelled ids are bounded by their limit
    train = (docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(labelled_domains(labels)), "doc_id")
             .select("domain", F.expr(_WORDS).alias("words")))
    fitted = _features(train)
    seen = sorted(int(r[0]) for r in train.select("domain").distinct().collect())
    words = f"{column}_words"
    out = docs.withColumn(words, F.expr(_WORDS.replace("text", "coalesce(cast(text AS string), '')")))
    n = F.size(words).cast("long").alias("n")
    if len(seen) < 2:
        sure = [1.0 if seen == [k] else 0.0 if seen else 1.0 / len(DOMAINS) for k in range(len(DOMAINS))]
        return out.withColumn(column, F.struct(n, F.array(*map(F.lit, sure)).alias("p"))).drop(words)
    model = LogisticRegression(featuresCol="features", labelCol="domain", family="multinomial", regParam=1e-4, maxIter=40).fit(fitted)
    inputs = f"{column}_tf", f"{column}_features", f"{column}_probability", f"{column}_raw", f"{column}_class"
    out = HashingTF(numFeatures=FEATURES, binary=True, inputCol=words, outputCol=inputs[0]).transform(out)
    out = Normalizer(inputCol=inputs[0], outputCol=inputs[1]).transform(out)
    model = model.setFeaturesCol(inputs[1]).setProbabilityCol(inputs[2]).setRawPredictionCol(inputs[3]).setPredictionCol(inputs[4])
    p = vector_to_array(inputs[2])
    full = F.array(*[F.coalesce(F.get(p, k), F.lit(0.0)) for k in range(len(DOMAINS))])
    return model.transform(out).withColumn(column, F.struct(n, full.alias("p"))).drop(words, *inputs)


def rates_of(p: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The rates after the steps in `moves` (steps x domains), from rate 1 on."""
    r = np.ones(len(p))
    for g in moves:
        r = np.maximum(r - p @ g, 0.0)
    return r


def _totals(posteriors: DataFrame, moves: np.ndarray, target: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Domain totals as shares of all tokens, and the sums of w p p' over the rates that are free to move, from one pass.

    Free are the rates above zero, and those at zero whose likeliest domain lacks tokens. The matrix only scales the next step.
    """
    k = len(DOMAINS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k + (k + 1) * k * k)
        for b in batches:
            n, p = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, k)
            r = rates_of(p, moves)
            first = np.where(r > 0, -1, p.argmax(1))  # which domain's lack frees a rate of zero
            squares = [((p[first == d] * n[first == d, None]).T @ p[first == d]).ravel() for d in range(-1, k)]
            out += np.concatenate([(n * r) @ p, *squares])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out)], ["k", "e"])

    found = posteriors.select("n", "p").mapInArrow(sums, "k int, e double").groupBy("k").agg(F.sum("e").alias("e")).orderBy("k").collect()
    got = np.array([r["e"] for r in found]) / total
    matrices = got[k:].reshape(-1, k, k)
    return got[:k], matrices[0] + matrices[1:][got[:k] < target].sum(0)


def fit(posteriors: DataFrame, targets: Mapping[str, float] = TARGETS, steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The moves of all kept steps (steps x domains) and the totals less the targets, from a table with the columns n and p."""
    total = posteriors.agg(F.sum("n")).first()[0] or 0
    target = np.array([float(targets[d]) for d in DOMAINS])
    scale = np.maximum(target, TOLERANCE)
    moves = np.zeros((0, len(DOMAINS)))
    if not total:
        return moves, -target
    loss = lambda e: float(np.sum((e / scale) ** 2))
    at, matrix = _totals(posteriors, moves, target, total)
    error, trial, plain = at - target, None, False
    for _ in range(steps):
        gradient = error / scale**2
        if np.max(np.abs(error) / scale) <= tolerance or gradient @ matrix @ gradient <= 1e-18 * loss(error):
            break
        if trial is None:
            if plain:
                trial = gradient / max(np.linalg.eigvalsh(matrix / np.outer(scale, scale)).max(), 1e-300)
            else:
                trial = np.linalg.pinv(matrix, rcond=1e-10, hermitian=True) @ error
            tries = 0
        new_at, new_matrix = _totals(posteriors, np.vstack((moves, trial)), target, total)
        if loss(new_at - target) < loss(error):
            moves, error, matrix, trial, plain = np.vstack((moves, trial)), new_at - target, new_matrix, None, False
        elif tries < 3:
            trial, tries = trial / 2, tries + 1
        elif not plain:
            trial, plain = None, True
        else:
            break
    return moves, error


def _with_rates(scored: DataFrame, moves: np.ndarray, column: str) -> DataFrame:
    """Adds to the struct the rate and the number of copies: the rate rounded up or down by a hash of the row's id and text."""
    columns = scored.columns
    name = columns.index(column)
    schema = scored.withColumn(column, F.expr(f"struct({column}.n, {column}.p, 0D AS rate, 0L AS copies)")).schema

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mix = b.column(name)
            p = mix.field("p").flatten().to_numpy().reshape(-1, len(DOMAINS))
            r = rates_of(p, moves)
            copies = np.floor(r + mix.field("u").to_numpy()).astype(np.int64)
            new = pa.StructArray.from_arrays([mix.field("n"), mix.field("p"), pa.array(r), pa.array(copies)], ["n", "p", "rate", "copies"])
            yield pa.RecordBatch.from_arrays([new if i == name else b.column(i) for i in range(b.num_columns)], columns)

    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) if "text" in scored.columns else F.shiftrightunsigned(F.xxhash64("doc_id", F.col(f"{column}.t")), 11)) / F.lit(float(1 << 53))
    return scored.withColumn(column, F.struct(F.col(f"{column}.n"), F.col(f"{column}.p"), u.alias("u"))).mapInArrow(rate, schema)


def document_rates(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, steps: int = MAX_STEPS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens (words), p_good, p_poor, p_toxic, rate, copies, and residual_good,
    residual_poor, residual_toxic: the domain's expected tokens less its target, as shares of all tokens, the same on every row.

    Null and empty texts have no tokens, so that they do not count for the totals; they get the rate of their posteriors.
    Equal rows get equal rates and copies. Other columns are ignored.
    """
    spark, path = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/posteriors"
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    scored = with_posteriors(slim, labels)
    scored.select("doc_id", F.struct("mix.n", "mix.p", F.xxhash64("text").alias("t")).alias("mix")).write.parquet(path)
    table = spark.read.parquet(path)
    moves, left = fit(table.select("mix.n", "mix.p"), targets, steps)
    out = _with_rates(table, moves, "mix")
    return out.select("doc_id", F.col("mix.n").alias("n_tokens"), *[F.col("mix.p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "mix.rate", "mix.copies",
                      *[F.lit(float(e)).alias(f"residual_{d}") for d, e in zip(DOMAINS, left)])


def mixed(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, steps: int = MAX_STEPS) -> DataFrame:
    """The rows of `docs`, all columns unchanged, each as often as its rate says: rate rounded by a hash of doc_id and text."""
    spark, path = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/mixing"
    column = "mix"
    while any(c.startswith(column) for c in docs.columns):
        column = "_" + column
    with_posteriors(docs, labels, column).write.parquet(path)
    table = spark.read.parquet(path)
    moves, _ = fit(table.select(f"{column}.n", f"{column}.p"), targets, steps)
    # rates have no upper bound: copies are listed in two stages, so no long array is made
    parts = F.expr(f"explode(if({column}.copies > 0, transform(sequence(0L, ({column}.copies - 1) div {COPIES}), i -> least({COPIES}, {column}.copies - i * {COPIES})), array()))")
    rows = _with_rates(table, moves, column).withColumn(column, parts)
    return rows.withColumn(column, F.expr(f"explode(array_repeat(1, int({column})))")).select(*docs.columns)
