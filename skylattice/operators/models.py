"""Cross-validated prediction, ablation and group permutation tests.

Ridge models work from per-fold product sums: one pass over the data serves every fold, every penalty and every
replicate, and only the p x p systems reach Python. Boosted trees use pyspark.ml, one distributed fit per fold; forests are
grown by `forest_oof`.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.functions.hashing import digest, digest_heads, side_by_side
from skylattice.operators.forest import forest_oof
from skylattice.operators.isotonic import decreasing_fit
from skylattice.operators.materialise import materialise, task_slots
from skylattice.operators.quantiles import position_within, shuffle_within
from skylattice.operators.regression import _full, product_sums
from skylattice.operators.sizing import join_on, join_rows
from skylattice.operators.statistics import skill_split
from skylattice.settings import CONSTRUCTION_LINKS

PENALTIES = tuple(np.logspace(-3, 4, 30))
#: Bytes of a fold that one task may hold, places of the orders that it keeps, and errors that it sums at once.
HELD, ORDERS, ERRORS = 1 << 28, 1 << 25, 1 << 20


# ---------------------------------------------------------------- feature choice
class LeakageError(ValueError):
    """A feature shares inputs with the label, or is a reference column."""


def allowed_features(features: Sequence[str], label: str, links=CONSTRUCTION_LINKS, waive: Sequence[str] = ()) -> list[str]:
    """The features, or an error if one is a reference column or is construction-linked to the label and not waived."""
    bad = [f for f in features if f.startswith("ref_") or (f in links.get(label, ()) and f not in waive)]
    if bad:
        raise LeakageError(f"not allowed for {label}: {', '.join(bad)}")
    return list(features)


def unlinked(features: DataFrame, links: DataFrame) -> DataFrame:
    """Table form: (label, feature) candidates without the linked pairs and without reference columns."""
    return features.join(links, ["label", "feature"], "left_anti").where(~F.col("feature").startswith("ref_"))


# ---------------------------------------------------------------- ridge
def _ridge_schema(df: DataFrame, keys: list[str], fold: str, with_alpha: bool) -> T.StructType:
    fields = [df.schema[k] for k in [*keys, fold]]
    extra = [T.StructField("__b", T.ArrayType(T.DoubleType()))]
    if with_alpha:
        extra.append(T.StructField("alpha", T.DoubleType()))
    return T.StructType(fields + extra)


def _fit_from_sums(m: np.ndarray, n: float, alpha: float) -> np.ndarray:
    """Intercept and slopes of a ridge on standardised regressors; m holds sums over [1, x.., y]."""
    mean = m[0] / n
    cov = m - n * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[1:-1] / n, 0.0))
    scale = np.where(sd > 0, sd, 1.0)
    a = cov[1:-1, 1:-1] / np.outer(scale, scale) + alpha * np.eye(len(scale))
    slope = np.linalg.lstsq(a, cov[1:-1, -1] / scale, rcond=None)[0] / scale
    return np.concatenate([[mean[-1] - slope @ mean[1:-1]], slope])


def ridge_oof(df: DataFrame, features: Sequence[str], label: str, fold: str, keys: Sequence[str] = (),
              alphas: Sequence[float] = PENALTIES, predict: DataFrame | None = None) -> DataFrame:
    """Out-of-fold predictions `pred`: each fold is predicted from all others; blocks must lie in one fold.

    With several penalties, each training set picks its own by leaving out its folds one after another.
    `predict` holds other rows to predict with the same models, of the keys that it has; for keys that it lacks, each of its
    rows is predicted once for every value.
    Shuffles: (keys, fold) product sums; one row per (keys, fold) afterwards.
    """
    keys, features = list(keys), list(features)
    coef = ridge_coefficients(fold_sums(df, features, label, fold, keys), len(features) + 2, fold, keys, alphas)
    return ridge_predictions(df if predict is None else predict, coef, features, fold, keys)


def fold_sums(df: DataFrame, features: Sequence[str], label: str, fold: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, fold, xx): packed product sums over [1, features.., label] of the rows with a label."""
    x = [F.lit(1.0), *[F.col(c) for c in features], F.col(label)]
    return product_sums(df.where(F.col(label).isNotNull()), x, F.lit(0.0), [*keys, fold]).select(*keys, fold, "xx")


def ridge_coefficients(sums: DataFrame, p: int, fold: str, keys: Sequence[str] = (), alphas: Sequence[float] = PENALTIES) -> DataFrame:
    """(keys, fold, __b, alpha): the model of all other folds, from the `fold_sums` of p columns."""
    keys = list(keys)
    packed = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(fold).alias("f"), F.col("xx").alias("xx")))).alias("parts"))
    if keys:  # a few kB, but each row may be many solved systems
        packed = packed.repartition(task_slots(sums.sparkSession), F.xxhash64(*keys))
    schema = _ridge_schema(sums, keys, fold, True)
    grid = [float(a) for a in alphas]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                parts = [(q["f"], _full(np.asarray(q["xx"], dtype=float), p)) for q in rec["parts"]]
                total = sum(m for _, m in parts)
                for f, own in parts:
                    train = total - own
                    best = grid[0]
                    if len(grid) > 1:
                        best = min(grid, key=lambda a: sum(_val_error(train, m, a) for g, m in parts if g != f))
                    b = _fit_from_sums(train, train[0, 0], best)
                    rows.append({**{k: rec[k] for k in keys}, fold: f, "__b": b.tolist(), "alpha": best})
            yield pd.DataFrame(rows, columns=[f.name for f in schema])

    def _val_error(train, held, alpha):
        rest = train - held
        if rest[0, 0] < 2:
            return 0.0
        b = np.append(_fit_from_sums(rest, rest[0, 0], alpha), -1.0)
        return float(b @ held @ b)

    return packed.mapInPandas(solve, schema)


def ridge_predictions(rows: DataFrame, coef: DataFrame, features: Sequence[str], fold: str, keys: Sequence[str] = ()) -> DataFrame:
    """The rows with `pred`; for keys that they lack, each row is predicted once for every value."""
    pred = F.col("__b")[0]
    for i, c in enumerate(features, start=1):
        pred = pred + F.col("__b")[i] * F.col(c)
    return join_on(rows, coef, [*[k for k in keys if k in rows.columns], fold], "left").withColumn("pred", pred).drop("__b")


# ---------------------------------------------------------------- experiments
def experiment_rows(df: DataFrame, features: Sequence[str], schemes: Mapping[str, Column], targets: Mapping[str, Column], domains: Mapping[str, Column],
                    cell: str, group: Column) -> DataFrame:
    """Every row once for each scheme and target: `scheme`, `fold`, `target`, `y`, the validation group `part`, its `cell`,
    the names of its domains `inside`, and the features as `x0`, `x1`, ...; the table's own columns may have any names.

    A scheme gives the fold that predicts the row, -1 for rows that only train, and NULL for rows that it leaves out (the gap
    of a hold-out). Rows without a target or without one of the features are left out too.
    """
    x = [f"x{i}" for i in range(len(features))]
    known = reduce(lambda a, c: a & F.col(c).isNotNull(), features, F.lit(True))
    inside = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in domains.items()]))
    dealt = F.array(*[F.struct(F.lit(n).alias("scheme"), c.cast("int").alias("fold")) for n, c in schemes.items()])
    asked = F.array(*[F.struct(F.lit(n).alias("target"), c.cast("double").alias("y")) for n, c in targets.items()])
    fixed = ["cell", "part", "inside", *x]
    rows = (df.where(known).select(F.col(cell).alias("cell"), group.alias("part"), inside.alias("inside"), *[F.col(c).cast("double").alias(n) for c, n in zip(features, x)],
                                   asked.alias("t"), F.explode(dealt).alias("s"))
            .select(*fixed, "s.*", F.explode("t").alias("t")).select(*fixed, "scheme", "fold", "t.*"))
    return rows.where("fold IS NOT NULL AND y IS NOT NULL")


def sliced_models(rows: DataFrame, sets: Mapping[str, Sequence[str]], alphas: Sequence[float] = PENALTIES) -> DataFrame:
    """(scheme, target, features, fold, __b, alpha): ridge models of all feature sets from one pass of product sums.

    The sums are taken once over every feature of any set; each set, fold and penalty solves its part of them. The penalty
    is the best over the validation groups within the training rows, which hold whole blocks. Folds and groups are few, so
    one scheme and target is one short list. A fold without other rows gets no model.
    """
    every = list(dict.fromkeys(c for cols in sets.values() for c in cols))
    p, keys = len(every) + 2, ["scheme", "target"]
    places = {name: [0, *[1 + every.index(c) for c in cols], p - 1] for name, cols in sets.items()}
    grid = [float(a) for a in alphas]
    packed = (fold_sums(rows, every, "y", "fold", [*keys, "part"]).groupBy(*keys)
              .agg(F.sort_array(F.collect_list(F.struct("fold", "part", "xx"))).alias("sums")))
    schema = "scheme string, target string, features string, fold int, __b array<double>, alpha double"

    def penalty(train: np.ndarray, groups: Sequence[np.ndarray]) -> float:
        def error(alpha: float) -> float:
            total = 0.0
            for held in groups:
                rest = train - held
                if rest[0, 0] >= 2:
                    b = np.append(_fit_from_sums(rest, rest[0, 0], alpha), -1.0)
                    total += float(b @ held @ b)
            return total

        return min(grid, key=error) if len(grid) > 1 else grid[0]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rec in pdf.to_dict("records"):
                sums = [(q["fold"], q["part"], _full(np.asarray(q["xx"], dtype=float), p)) for q in rec["sums"]]
                for fold in sorted({f for f, _, _ in sums if f >= 0}):
                    others = [(g, m) for f, g, m in sums if f != fold]
                    if not others:
                        continue
                    train = sum(m for _, m in others)
                    held = [sum(m for h, m in others if h == g) for g in sorted({g for g, _ in others})]
                    for name, at in places.items():
                        cut = np.ix_(at, at)
                        alpha = penalty(train[cut], [h[cut] for h in held])
                        b = np.zeros(p - 1)
                        b[at[:-1]] = _fit_from_sums(train[cut], train[0, 0], alpha)
                        out.append({"scheme": rec["scheme"], "target": rec["target"], "features": name, "fold": fold, "__b": b.tolist(), "alpha": alpha})
            yield pd.DataFrame(out, columns=["scheme", "target", "features", "fold", "__b", "alpha"])

    return packed.mapInPandas(solve, schema)


def score_table(df: DataFrame, sets: Mapping[str, Sequence[str]], schemes: Mapping[str, Column], targets: Mapping[str, Column], domains: Mapping[str, Column],
                cell: str, group: Column, ceilings: DataFrame | None = None, alphas: Sequence[float] = PENALTIES) -> DataFrame:
    """Out-of-fold skill of every feature set for each (scheme, target, domain), all from two passes over the rows.

    `domains` are row conditions under which the predictions are scored; models are fitted on all rows. With `ceilings`
    (target, domain, ceiling) the table has `ceiling_normalised_r2`, NULL where a ceiling is missing or zero.
    """
    every = list(dict.fromkeys(c for cols in sets.values() for c in cols))
    slots = {c: f"x{i}" for i, c in enumerate(every)}
    rows = experiment_rows(df, every, schemes, targets, domains, cell, group)
    fitted = sliced_models(rows, {name: [slots[c] for c in cols] for name, cols in sets.items()}, alphas)
    pred = ridge_predictions(rows.where("fold >= 0"), fitted, list(slots.values()), "fold", ["scheme", "target"]).where("pred IS NOT NULL")
    scores = skill_split(pred.withColumn("domain", F.explode("inside")), "cell", "y", "pred", ["scheme", "target", "features", "domain"])
    if ceilings is None:
        return scores
    return (join_on(scores, ceilings.select("target", "domain", "ceiling"), ["target", "domain"], "left")
            .withColumn("ceiling_normalised_r2", F.try_divide("r2", "ceiling")))


# ---------------------------------------------------------------- pyspark.ml estimators
def estimator(kind: str, trees: int | None = None, seed: int = 42):
    """Boosted trees or ridge regression by name."""
    if kind == "gbt":
        return GBTRegressor(maxIter=trees or 400, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, seed=seed,
                            featuresCol="scaled", labelCol="__y", predictionCol="pred")
    if kind == "ridge":
        return LinearRegression(elasticNetParam=0.0, regParam=1.0, featuresCol="scaled", labelCol="__y", predictionCol="pred")
    raise ValueError(kind)


def ml_oof(df: DataFrame, features: Sequence[str], label: str, fold: str, folds: Sequence, kind: str = "rf", trees: int | None = None,
           keep: Sequence[str] = (), predict: DataFrame | None = None) -> DataFrame:
    """Out-of-fold predictions from a forest, or from a pyspark.ml pipeline with one distributed fit per fold.

    The models are fitted on the rows of `df`; those of `predict`, or else of `df`, are predicted.
    """
    if kind == "rf":
        return forest_oof(df, features, label, fold, folds, trees or 500, keep, predict)
    base = df.withColumn("__y", F.col(label).cast("double"))
    rows = base if predict is None else predict

    def one(f) -> DataFrame:
        pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__x"),
                                StandardScaler(inputCol="__x", outputCol="scaled", withMean=True, withStd=True), estimator(kind, trees)])
        return pipe.fit(base.where(F.col(fold) != f)).transform(rows.where(F.col(fold) == f)).select(*keep, fold, label, "pred")

    with ThreadPoolExecutor(max_workers=4) as pool:  # the fits are independent jobs
        return reduce(DataFrame.unionByName, pool.map(one, folds))


def ablation(df: DataFrame, groups: dict[str, Sequence[str]], label: str, fold: str, folds: Sequence, cell: str, kind: str = "rf",
             trees: int | None = None) -> DataFrame:
    """Skill of the full feature set, of every set with one group dropped, and of models fitted on shuffled features.

    The control's training rows are shuffled within their folds; the rows it predicts keep their real features.
    """
    every = [c for g in groups.values() for c in g]
    sets = {"all": every, **{f"without {n}": [c for c in every if c not in g] for n, g in groups.items()}}
    out = None
    shuffled = shuffle_within(df, [fold], cell, every, "control")
    for name, feats in [*sets.items(), ("shuffled", every)]:
        src = shuffled if name == "shuffled" else df
        s = skill_split(ml_oof(src, feats, label, fold, folds, kind, trees, keep=[cell], predict=df), cell, label, "pred").withColumn("feature_set", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


def isotonic_detrend(df: DataFrame, y: str, dist: str, train: Column, out: str = "residual") -> DataFrame:
    """Subtract a decreasing isotonic fit of y on distance, fitted on the training rows; clipped outside their range."""
    return decreasing_fit(df, y, dist, train, "__fit").withColumn(out, F.col(y) - F.col("__fit")).drop("__fit")


# ---------------------------------------------------------------- permutation tests
def remap_group(df: DataFrame, mapping: DataFrame, group: Sequence[str], row_keys: Sequence[str], src_keys: Sequence[str]) -> DataFrame:
    """Every row takes the group's values from its source row; all other columns stay.

    `mapping` holds the row keys of each target row, the source keys (same order as `row_keys`) and any replicate keys.
    """
    extra = [c for c in mapping.columns if c not in row_keys and c not in src_keys]
    donors = df.select(*[F.col(r).alias(s) for r, s in zip(row_keys, src_keys)], *group)
    rest = df.select(*[c for c in df.columns if c not in group])
    return (rest.hint("merge").join(mapping, [r for r in row_keys if r in mapping.columns]).hint("merge").join(donors, list(src_keys))
            .select(*extra, *df.columns))


def season_orders(seasons: Sequence[str]) -> list[tuple[str, ...]]:
    """All orders of the seasons except the real one."""
    from itertools import permutations

    return [o for o in permutations(seasons) if list(o) != list(seasons)]


def season_mapping(df: DataFrame, season: str, orders: Sequence[Sequence[str]], seasons: Sequence[str]) -> DataFrame:
    """(rep, season, src_season) for each order."""
    rows = [(r, s, o[i]) for r, o in enumerate(orders, start=1) for i, s in enumerate(seasons)]
    return df.sparkSession.createDataFrame(rows, f"rep int, {season} string, src_{season} string")


def row_shuffles(df: DataFrame, group: Sequence[str], row_id: str, within: Sequence[str], reps: int, seed: int) -> DataFrame:
    """`reps` copies of the table with the group's rows shuffled inside `within`, in each copy in another order."""
    copies = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    return shuffle_within(copies, ["rep", *within], row_id, group, F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string")))


def permutation_scores(observed: DataFrame, nulls: DataFrame, features: Sequence[str], label: str, fold: str, cell: str,
                       score: str = "spatial_r2", alphas: Sequence[float] = (1.0,), keys: Sequence[str] = (), train_only: bool = False) -> DataFrame:
    """(keys, rep, score): observed table as rep 0 and all null tables in one job.

    With `train_only` the null tables give training rows only, and the observed rows are predicted (row shuffles); else each
    null table is predicted itself (maps that stay realistic: season orders, rotations).
    """
    both = observed.withColumn("rep", F.lit(0)).unionByName(nulls)
    oof = ridge_oof(both, features, label, fold, [*keys, "rep"], alphas, observed if train_only else None)
    return skill_split(oof, cell, label, "pred", [*keys, "rep"]).select(*keys, "rep", F.col(score).alias("score"))


def shuffled_sums(df: DataFrame, base: Sequence[str], group: Sequence[str], label: str, fold: str, row_id: str, reps: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rep, fold, xx) over [1, base.., group.., label], with the group's rows shuffled together inside each fold, in `reps` ways.

    A shuffle changes neither the sums of the other columns nor those of the group with itself: these come from one pass over
    the rows. Only the products of the group with the other columns are summed for every replicate: in tasks that hold a
    fold, or, for larger folds, from copies that hold the group alone. The orders are those of `row_shuffles` within (keys, fold).
    """
    keys, base, group = list(keys), list(base), list(group)
    known = df.where(F.col(label).isNotNull())
    fixed = fold_sums(known, [*base, *group], label, fold, keys)
    others = [*base, label]
    sizes = known.groupBy(*keys, fold).count().collect()  # one row per fold and key
    largest = max((r["count"] for r in sizes), default=0)
    if largest * 8 * (len(others) + len(group) + 6) <= HELD:
        cross = _crossed_in_tasks(known, others, group, [*keys, fold], row_id, reps, seed, sizes, largest)
    else:
        cross = _crossed_by_position(known, others, group, [*keys, fold], row_id, reps, seed)
    return join_on(cross, fixed, [*keys, fold]).select(*keys, "rep", fold, F.array(*_blocks(len(base), len(group))).alias("xx"))


def _crossed_by_position(known: DataFrame, others: list[str], group: list[str], within: list[str], row_id: str, reps: int, seed: int) -> DataFrame:
    """(within, rep, __c): a copy of every row for each replicate finds the receiver of its position; for folds of any size."""
    receivers = position_within(known.select(*within, row_id, *others), within, digest(row_id), row_id, "__p").drop(row_id)
    copies = known.select(*within, row_id, *group).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    order = digest(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string")), F.lit("donor"), F.col(row_id))
    donors = position_within(copies, ["rep", *within], order, row_id, "__p").drop(row_id)
    mixed = join_rows(donors, receivers.withColumnsRenamed({c: f"__o{i}" for i, c in enumerate(others)}), [*within, "__p"])
    cross = [F.sum(F.col(g).cast("double") * F.col(f"__o{i}").cast("double")) for g in group for i in range(len(others))]
    return mixed.groupBy("rep", *within).agg(F.array(*cross).alias("__c"))


def _crossed_in_tasks(known: DataFrame, others: list[str], group: list[str], within: list[str], row_id: str, reps: int, seed: int,
                      sizes: Sequence[Row], largest: int) -> DataFrame:
    """(within, rep, __c) of folds that one task can hold: each task holds a fold once for many replicates and finds their orders itself.

    Rows are sent once for each batch of replicates, whose number follows the cores. An order depends on the row ids alone, so keys
    with the same rows in a fold share it.
    """
    spark = known.sparkSession
    units = list(dict.fromkeys(r[within[-1]] for r in sizes))
    at_once = max(1, min(-(-reps * len(units) // (4 * spark.sparkContext.defaultParallelism)), ORDERS // max(largest, 1)))
    batches = -(-reps // at_once)
    index = _numbered(known, within, [(*(r[k] for k in within), units.index(r[within[-1]]), i) for i, r in enumerate(sizes)], "__u int, __m int")
    o, g = [f"__o{i}" for i in range(len(others))], [f"__g{i}" for i in range(len(group))]
    text = F.concat_ws(":", F.col(row_id).cast("string"))  # as in `digest`: a NULL is no part, so nothing
    rows = join_on(known, F.broadcast(index), within).select(
        "__u", "__m", text.alias("__id"), F.col(row_id).isNull().alias("__void"), *[F.col(c).cast("double").alias(n) for c, n in zip([*group, *others], [*g, *o])])
    rows = rows.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    rows = rows.repartitionById(max(1, len(units) * batches), F.col("__u") * batches + F.col("__b")).sortWithinPartitions("__u", "__b", "__m", "__void", "__id", *g, *o)

    def crossed(held: pa.Table, orders: dict) -> np.ndarray:
        """(replicates, group, others): sums of products; NaN with a mask of those without any product."""
        number = lambda c: (held.column(c).to_numpy(), held.column(c).is_valid().to_numpy())
        giving, taking = [number(c) for c in g], [number(c) for c in o]
        whole = all(ok.all() for _, ok in (*giving, *taking))
        own = orders["own"]
        out, missing = np.zeros((len(orders["donors"]), len(g), len(o))), np.zeros((len(orders["donors"]), len(g), len(o)), bool)
        taken = [(v[own], ok[own]) for v, ok in taking]
        for r, order in enumerate(orders["donors"]):
            for i, (v, ok) in enumerate(giving):
                v, ok = v[order], ok[order]
                for j, (w, fine) in enumerate(taken):
                    if whole:
                        out[r, i, j] = v @ w
                    else:
                        both = ok & fine
                        out[r, i, j], missing[r, i, j] = v[both] @ w[both], not both.any()
        return np.ma.array(out, mask=missing)

    def ordered(texts: pa.Array, void: np.ndarray, batch: int) -> dict:
        wide, length = side_by_side(texts)

        def order(lead: str) -> np.ndarray:
            heads = digest_heads(f"{lead}:" if lead else "", wide, length)
            if lead and void.any():  # no text, no colon
                heads[void] = digest_heads(lead, wide[:1, :0], length[:1] * 0)
            return heads.argsort(kind="stable").astype(np.uint32)

        these = range(1 + batch * at_once, 1 + min(reps, (batch + 1) * at_once))
        return {"own": order(""), "donors": [order(f"{seed}:{rep}:donor") for rep in these], "reps": list(these)}

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, known_ids, orders = None, [], None, None

        def done() -> pa.RecordBatch:
            nonlocal known_ids, orders
            held = pa.Table.from_batches(parts).combine_chunks()
            ids = held.select(["__u", "__b", "__void", "__id"])
            if known_ids is None or not ids.equals(known_ids):
                known_ids, orders = ids, ordered(held.column("__id").combine_chunks(), held.column("__void").to_numpy(), now[1])
            sums = crossed(held.select([*g, *o]), orders)
            flat = pa.array([[None if v is np.ma.masked else float(v) for v in one.ravel()] for one in sums], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), now[2], np.int32)), pa.array(orders["reps"], pa.int32()), flat], ["__m", "rep", "__c"])

        for batch in batches_in:
            u, b, m = (batch.column(c).to_numpy() for c in ("__u", "__b", "__m"))
            ends = np.flatnonzero((np.diff(u) != 0) | (np.diff(b) != 0) | (np.diff(m) != 0)) + 1
            for lo, hi in zip([0, *ends], [*ends, len(m)], strict=True):
                if hi == lo:
                    continue
                if (key := (int(u[lo]), int(b[lo]), int(m[lo]))) != now:
                    if parts:
                        yield done()
                    now, parts = key, []
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield done()

    found = rows.mapInArrow(run, "__m int, rep int, __c array<double>")
    return found.join(F.broadcast(index.drop("__u")), "__m").drop("__m")


def _numbered(df: DataFrame, keys: Sequence[str], rows: Sequence[tuple], numbers: str) -> DataFrame:
    """A table of few rows: keys of the types of df, and numbers."""
    schema = T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in keys], *T._parse_datatype_string(numbers).fields])
    return df.sparkSession.createDataFrame(list(rows), schema)


def _blocks(nb: int, ng: int) -> list[Column]:
    """The packed triangle over [1, base.., group.., label], with the group's products with base and label from `__c`."""
    p, out = nb + ng + 2, []
    for i in range(p):
        for j in range(i, p):
            inside = [nb < k <= nb + ng for k in (i, j)]
            if i == 0 or inside[0] == inside[1]:
                out.append(F.col("xx")[len(out)])
            else:
                g, o = (i, j) if inside[0] else (j, i)
                out.append(F.col("__c")[(g - nb - 1) * (nb + 1) + (o - 1 if o <= nb else nb)])
    return out


def row_permutation_scores(df: DataFrame, base: Sequence[str], group: Sequence[str], label: str, fold: str, cell: str, reps: int, seed: int,
                           score: str = "spatial_r2", alphas: Sequence[float] = PENALTIES, keys: Sequence[str] = (), dist: str | None = None, folds: Sequence = ()) -> DataFrame:
    """(keys, rep, score) of a ridge: rep 0 is the observed table, the others have the group's training rows shuffled.

    The rows that are predicted keep their values, and every replicate tunes its own penalty. With `dist` the target of each
    of the `folds` is the residual of a decreasing isotonic fit on the distance over the rows outside that fold.
    """
    keys, features = list(keys), [*base, *group]
    own = F.lit(True)
    df = df.select(*dict.fromkeys([*keys, fold, cell, *features, label, *([dist] if dist else [])]))
    if dist is not None:
        df = materialise(residual_targets(df, label, dist, fold, folds))
        label, keys, own = "__residual", [*keys, "held"], F.col(fold) == F.col("held")
    sums = fold_sums(df, features, label, fold, keys).withColumn("rep", F.lit(0)).unionByName(shuffled_sums(df, base, group, label, fold, cell, reps, seed, keys))
    coef = ridge_coefficients(sums, len(features) + 2, fold, [*keys, "rep"], alphas)
    return replicate_skill(df.where(own), coef, features, label, fold, cell, keys, [k for k in keys if k != "held"]).select(*[k for k in keys if k != "held"], "rep", F.col(score).alias("score"))


def replicate_skill(rows: DataFrame, coef: DataFrame, features: Sequence[str], label: str, fold: str, cell: str, models: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """`skill_split` by (keys, rep) of every row's predictions by all replicates' models of its (models, fold).

    The coefficients, one row per model, fold and replicate, go to every task. The rows of a cell meet once, and the task that has
    them predicts and sums for all replicates: no prediction is shuffled.
    """
    spark, models, keys = rows.sparkSession, list(models), list(keys)
    found = coef.select(*models, fold, "rep", "__b").collect()
    reps = sorted({r["rep"] for r in found})
    place = {m: i for i, m in enumerate(dict.fromkeys(tuple(r[k] for k in [*models, fold]) for r in found))}
    groups = {g: i for i, g in enumerate(dict.fromkeys(tuple(r[k] for k in keys) for r in found))}
    beta = np.full((len(place), len(reps), len(features) + 1), np.nan)
    for r in found:
        beta[place[tuple(r[k] for k in [*models, fold])], reps.index(r["rep"])] = r["__b"]
    own = {m: groups[tuple(dict(zip([*models, fold], m))[k] for k in keys)] for m in place}
    index = _numbered(coef, [*models, fold], [(*m, i, own[m]) for m, i in place.items()], "__m int, __g int")
    spread = spark.sparkContext.broadcast(beta)

    full = reduce(lambda a, c: a & F.col(c).isNotNull(), features, F.col(label).isNotNull())
    x = [f"__x{i}" for i in range(len(features))]
    met = (join_on(rows.where(full), F.broadcast(index), [*models, fold])
           .select("__g", F.col(cell).alias("__cell"), "__m", F.col(label).cast("double").alias("__y"), *[F.col(c).cast("double").alias(n) for c, n in zip(features, x)]))
    met = met.repartition(task_slots(spark), "__g", "__cell")
    cells = met.groupBy("__g", "__cell").agg(F.count("*").cast("double").alias("n"), F.avg("__y").alias("my"), F.var_pop("__y").alias("vy"))
    n = F.sum("n")
    grand = F.sum(F.col("n") * F.col("my")) / n
    totals = cells.groupBy("__g").agg(
        n.alias("n"), F.count("*").alias("cells"), (F.var_pop("my") * F.count("*")).alias("between"), F.sum(F.col("n") * F.col("vy")).alias("within"),
        (F.sum(F.col("n") * F.col("vy")) + F.sum(F.col("n") * F.col("my") * F.col("my")) - n * grand * grand).alias("total"))

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta, sums, last = spread.value, {}, None
        step = max(1, ERRORS // max(beta.shape[1], 1))

        def add(g: int, n: np.ndarray, mean: np.ndarray, square: np.ndarray, size: np.ndarray) -> None:
            one = np.stack([(mean * mean).sum(0), (n[:, None] * mean * mean).sum(0), square.sum(0), size.sum(0)])
            sums[g] = sums.get(g, 0.0) + one

        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                g, m, y = (batch.column(c).to_numpy() for c in ("__g", "__m", "__y"))
                values = [batch.column(c).to_numpy() for c in x]
                names = batch.column("__cell")
                code = names.dictionary_encode(null_encoding="encode").indices.to_numpy()
                starts = np.flatnonzero(np.append(True, (np.diff(g) != 0) | (np.diff(code) != 0)))
                n = np.diff(np.append(starts, len(g))).astype(float)
                e = np.empty((len(g), beta.shape[1]))
                for k in np.unique(m):
                    at = m == k
                    pred = beta[k, :, 0] + np.zeros((int(at.sum()), 1))
                    for i, v in enumerate(values, start=1):
                        pred += beta[k, :, i] * v[at][:, None]
                    e[at] = y[at][:, None] - pred
                mean = np.add.reduceat(e, starts) / n[:, None]
                dev = e - np.repeat(mean, n.astype(int), 0)
                square, size = np.add.reduceat(dev * dev, starts), np.add.reduceat(np.abs(e), starts)
                first = (int(g[0]), names[0].as_py())
                if last is not None:
                    key, n0, mean0, square0, size0 = last
                    if key == first:  # the cell goes on from the rows before
                        gap, n1 = mean[0] - mean0, n0 + n[0]
                        mean[0], square[0], size[0], n[0] = mean0 + gap * (n[0] / n1), square0 + square[0] + gap * gap * (n0 * n[0] / n1), size0 + size[0], n1
                    else:
                        add(key[0], np.array([n0]), mean0[None], square0[None], size0[None])
                last = ((int(g[-1]), names[len(g) - 1].as_py()), n[-1], mean[-1].copy(), square[-1].copy(), size[-1].copy())
                of = g[starts][:-1]
                for k in np.unique(of):
                    at = np.flatnonzero(of == k)
                    add(int(k), n[at], mean[at], square[at], size[at])
        if last is not None:
            add(last[0][0], np.array([last[1]]), *(v[None] for v in last[2:]))
        for k, one in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(reps), k, np.int32)), pa.array(reps, pa.int32()), *[pa.array(v) for v in one]], ["__g", "rep", "gap", "weighted", "spread", "size"])

    parts = met.sortWithinPartitions("__g", "__cell").mapInArrow(errors, "__g int, rep int, gap double, weighted double, spread double, size double")
    parts = parts.groupBy("__g", "rep").agg(*[F.sum(c).alias(c) for c in ("gap", "weighted", "spread", "size")])
    named = _numbered(coef, keys, [(*g, i) for g, i in groups.items()], "__g int")
    sse, many = F.col("spread") + F.col("weighted"), F.col("n") > 2
    return (parts.join(totals, "__g").join(F.broadcast(named), "__g")
            .select(*keys, "rep", F.when(many, 1 - F.try_divide(sse, "total")).alias("r2"), F.sqrt(sse / F.col("n")).alias("rmse"), (F.col("size") / F.col("n")).alias("mae"),
                    F.when(F.col("cells") > 2, 1 - F.try_divide("gap", "between")).alias("spatial_r2"), F.when(many, 1 - F.try_divide("spread", "within")).alias("temporal_r2"),
                    F.col("n").cast("bigint").alias("n_rows")))


def residual_targets(df: DataFrame, y: str, dist: str, fold: str, folds: Sequence) -> DataFrame:
    """Every row once for each held-out fold `held`, with `__residual`: y less the isotonic fit over the rows outside that fold."""
    return reduce(DataFrame.unionByName, [isotonic_detrend(df, y, dist, F.col(fold) != f, "__residual").withColumn("held", F.lit(f)) for f in folds])


def forest_permutation_scores(df: DataFrame, base: Sequence[str], group: Sequence[str], label: str, fold: str, folds: Sequence, cell: str, reps: int, seed: int,
                              kind: str = "rf", trees: int | None = None, score: str = "spatial_r2") -> DataFrame:
    """(rep, score) as in `row_permutation_scores`, with tree models; each replicate's folds are fitted as parallel jobs."""
    features = [*base, *group]
    null = materialise(row_shuffles(df, group, cell, [fold], reps, seed).select("rep", cell, fold, label, *features))
    out = []
    for rep in range(reps + 1):
        train = df if rep == 0 else null.where(F.col("rep") == rep).drop("rep")
        pred = ml_oof(train, features, label, fold, folds, kind, trees, keep=[cell], predict=df)
        out.append(skill_split(pred, cell, label, "pred").select(F.lit(rep).alias("rep"), F.col(score).alias("score")))
    return reduce(DataFrame.unionByName, out)


def permutation_test(scores: DataFrame, keys: Sequence[str] = (), level: float = 0.05) -> DataFrame:
    """Observed score, null mean / sd / max, effect, one-sided p = (1 + #{null >= observed}) / (R + 1)."""
    keys = list(keys)
    obs = scores.where(F.col("rep") == 0).select(*keys, F.col("score").alias("observed"))
    null = scores.where(F.col("rep") > 0)
    if keys:
        j = join_on(null, obs, keys)
    else:
        j = null.withColumn("__k", F.lit(0)).join(F.broadcast(obs.withColumn("__k", F.lit(0))), "__k")
    p = (1 + F.count_if(F.col("score") >= F.col("observed"))) / (F.count("*") + 1)
    return j.groupBy(*keys, "observed").agg(F.avg("score").alias("null_mean"), F.stddev_pop("score").alias("null_sd"), F.max("score").alias("null_max"),
                                            (F.first("observed") - F.avg("score")).alias("effect"), p.alias("p_value"),
                                            (p <= level).alias("significant"), F.count("*").alias("n_perm"))


def random_orders(n_orders: int, take: int, seed: int, spark) -> DataFrame:
    """Positions of a random subset of orders without replacement, by seeded hash."""
    return spark.range(n_orders).orderBy(digest(seed, F.col("id"))).limit(take)


def sign_agreement(effects: DataFrame, test: str, variant: str, primary: str, effect: str = "effect") -> DataFrame:
    """Does each variant's effect have the sign of the primary run's effect?"""
    ref = effects.where(F.col(variant) == primary).select(test, F.signum(effect).alias("__s"))
    return effects.join(ref, test, "left").withColumn("same_sign", F.signum(effect) == F.col("__s")).drop("__s")


def unfinished(tests: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tests without a stored result for the same input fingerprint."""
    return tests.join(results.select(*keys).distinct(), list(keys), "left_anti")


