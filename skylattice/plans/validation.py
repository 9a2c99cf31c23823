"""Statistics, spatial cross-validation, models, permutation tests, frozen tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.operators import features, folds, models, nulls, resample, statistics, variogram
from skylattice.operators.materialise import materialise
from skylattice.operators.quantiles import shuffle_within
from skylattice.operators.spatial import kernel_sum
from skylattice.plans import views as v
from skylattice.plans.registry import query
from skylattice.sources import freeze


def rnd(df, digits, *cols):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- summaries
@query(f"""WITH {v.CELLS}, u AS (UNPIVOT (SELECT label, size, brand FROM cells) ON label, size, brand INTO NAME "column" VALUE val)
  SELECT "column", count(*) AS n, min(val) AS min, round(quantile_cont(val, 0.01), 6) AS p1, round(quantile_cont(val, 0.5), 6) AS p50, round(quantile_cont(val, 0.99), 6) AS p99, max(val) AS max FROM u GROUP BY 1""")
def summary_stats(spark, sf):
    """Minimum, exact percentiles and maximum of several columns."""
    return rnd(statistics.summary(v.cells(spark, sf), ["label", "size", "brand"]), 6, "p1", "p50", "p99")


@query("""WITH u AS (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice FROM lineitem) ON l_quantity, l_extendedprice INTO NAME "column" VALUE val)
  SELECT l_returnflag, "column", count(*) AS n, min(val) AS min, max(val) AS max, round(quantile_cont(val, 0.1), 4) AS p10, round(quantile_cont(val, 0.9), 4) AS p90 FROM u GROUP BY ALL""")
def summary_by_group(spark, sf):
    """Percentiles by group where each group holds a third of all rows."""
    l = v.table(spark, sf, "lineitem")
    return rnd(statistics.summary(l, ["l_quantity", "l_extendedprice"], ["l_returnflag"], {"p10": 0.1, "p90": 0.9}), 4, "p10", "p90")


@query(f"""WITH {v.CELLS}, g AS (SELECT CASE WHEN size >= 5 THEN label END AS label, size, CASE WHEN brand <> 7 THEN brand END AS brand FROM cells),
  c AS (SELECT count(*) AS n, count(*) - count(label) AS a, count(*) - count(size) AS b, count(*) - count(brand) AS d FROM g)
  SELECT 'label' AS "column", a AS n_missing, round(100e0 * a / n, 6) AS pct_missing FROM c UNION ALL SELECT 'size', b, round(100e0 * b / n, 6) FROM c UNION ALL SELECT 'brand', d, round(100e0 * d / n, 6) FROM c""")
def missing_audit(spark, sf):
    """NULLs per column in one pass."""
    g = v.cells(spark, sf).select(F.when(F.col("size") >= 5, F.col("label")).alias("label"), "size", F.when(F.col("brand") != 7, F.col("brand")).alias("brand"))
    return rnd(statistics.missing_audit(g, ["label", "size", "brand"]), 6, "pct_missing")


@query("""WITH m AS (SELECT *, avg(l_quantity) OVER k AS a, avg(l_extendedprice) OVER k AS b FROM lineitem WINDOW k AS (PARTITION BY l_partkey))
  SELECT 'l_quantity' AS "column", round(var_pop(a) / var_pop(l_quantity), 6) AS spatial_share FROM m UNION ALL SELECT 'l_extendedprice', round(var_pop(b) / var_pop(l_extendedprice), 6) FROM m UNION ALL SELECT 'constant', NULL""")
def variance_share(spark, sf):
    """Share of the variance that lies between cells; NULL for a constant column."""
    l = v.table(spark, sf, "lineitem").withColumn("constant", F.lit(1.0))
    return rnd(statistics.variance_share(l, "l_partkey", ["l_quantity", "l_extendedprice", "constant"]), 6, "spatial_share")


@query("""WITH m AS (SELECT l_partkey, avg(l_quantity) AS a, avg(l_extendedprice) AS b FROM lineitem GROUP BY 1)
  SELECT 'l_quantity' AS "column", round(var_pop(a) / (SELECT var_pop(l_quantity) FROM lineitem), 6) AS spatial_share FROM m UNION ALL SELECT 'l_extendedprice', round(var_pop(b) / (SELECT var_pop(l_extendedprice) FROM lineitem), 6) FROM m""")
def variance_share_cells(spark, sf):
    """Share of the variance that lies between cells, where every cell counts once."""
    return rnd(statistics.variance_share(v.table(spark, sf, "lineitem"), "l_partkey", ["l_quantity", "l_extendedprice"], by_rows=False), 6, "spatial_share")


@query("""WITH l AS (SELECT 'quantity' AS name, l_quantity AS x, CASE WHEN l_tax > 0.01 THEN l_extendedprice / 1000 END AS y FROM lineitem UNION ALL SELECT 'days', date_diff('day', o_orderdate, l_shipdate), date_diff('day', o_orderdate, l_shipdate) + l_discount * 100 FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  r AS (SELECT name, rank() OVER (PARTITION BY name ORDER BY x) + (count(*) OVER (PARTITION BY name, x) - 1) / 2e0 AS rx, rank() OVER (PARTITION BY name ORDER BY y) + (count(*) OVER (PARTITION BY name, y) - 1) / 2e0 AS ry FROM l WHERE x IS NOT NULL AND y IS NOT NULL),
  c AS (SELECT name, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1)
  SELECT name, round(quantile_cont(x, 0.5), 6) AS median_first, round(quantile_cont(y, 0.5), 6) AS median_second, any_value(spearman) AS spearman FROM l JOIN c USING (name) GROUP BY 1""")
def source_agreement(spark, sf):
    """Two sources of each quantity: medians and rank correlation."""
    l, o = v.table(spark, sf, "lineitem"), v.table(spark, sf, "orders")
    d = l.join(o, l.l_orderkey == o.o_orderkey).withColumn("lag", F.date_diff("l_shipdate", "o_orderdate"))
    d = d.withColumns({"price": F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice") / 1000), "lag2": F.col("lag") + F.col("l_discount") * 100})
    return rnd(statistics.source_agreement(d, {"quantity": ("l_quantity", "price"), "days": ("lag", "lag2")}), 6, "median_first", "median_second", "spearman")


@query("""WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
  SELECT CAST(least(floor((l_extendedprice - lo) * 40 / (hi - lo)), 39) AS INTEGER) AS bin, round(any_value(lo + (hi - lo) * least(floor((l_extendedprice - lo) * 40 / (hi - lo)), 39) / 40), 6) AS left_edge, count(*) AS n FROM lineitem, b GROUP BY 1""")
def histogram_40(spark, sf):
    """Forty equal bins between minimum and maximum."""
    return rnd(statistics.histogram(v.table(spark, sf, "lineitem"), "l_extendedprice", 40), 6, "left_edge")


@query(f"""WITH {v.CELLS}, r AS (SELECT rank() OVER (ORDER BY label) + (count(*) OVER (PARTITION BY label) - 1) / 2e0 AS a, rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2e0 AS b,
    rank() OVER (ORDER BY brand) + (count(*) OVER (PARTITION BY brand) - 1) / 2e0 AS c, rank() OVER (ORDER BY x - label) + (count(*) OVER (PARTITION BY x - label) - 1) / 2e0 AS d FROM cells),
  q AS (SELECT 'label' AS a, 'size' AS b, corr(a, b) AS rho FROM r UNION ALL SELECT 'label', 'brand', corr(a, c) FROM r UNION ALL SELECT 'label', 'drop', corr(a, d) FROM r UNION ALL SELECT 'size', 'brand', corr(b, c) FROM r
    UNION ALL SELECT 'size', 'drop', corr(b, d) FROM r UNION ALL SELECT 'brand', 'drop', corr(c, d) FROM r)
  SELECT a, b, round(rho, 6) AS rho, abs(rho) >= 0.8 AS strong FROM q""")
def spearman_matrix(spark, sf):
    """Rank correlations with tied ranks averaged; strong pairs flagged."""
    c = v.cells(spark, sf).withColumn("drop", F.col("x") - F.col("label")).select("label", "size", "brand", "drop")
    s = statistics.spearman_pairs(c, ["label", "size", "brand", "drop"])
    return rnd(s.withColumn("strong", F.abs("rho") >= 0.8), 6, "rho")


@query(f"""WITH {v.CELLS}, q AS (SELECT klass, 'label' AS a, 'size' AS b, corr(label, size) AS r FROM cells GROUP BY 1 UNION ALL SELECT klass, 'label', 'brand', corr(label, brand) FROM cells GROUP BY 1 UNION ALL SELECT klass, 'size', 'brand', corr(size, brand) FROM cells GROUP BY 1)
  SELECT klass, a, b, round(r, 6) AS r, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY klass ORDER BY abs(r) DESC, a, b) AS INTEGER) AS rank FROM q) WHERE rank <= 2""")
def top_correlations(spark, sf):
    """The two strongest pairs per group."""
    p = statistics.pair_correlations(v.cells(spark, sf), ["label", "size", "brand"], ["klass"])
    return rnd(features.top_per_group(p, "klass", F.abs("r"), 2), 6, "r")


@query("""SELECT p_type, count(*) AS n, count(DISTINCT p_brand) AS n_brands FROM part GROUP BY 1""")
def value_counts(spark, sf):
    """Value counts and distinct counts."""
    p = v.table(spark, sf, "part")
    return statistics.value_shares(p, "p_type").join(p.groupBy("p_type").agg(F.count_distinct("p_brand").alias("n_brands")), "p_type")


@query("""SELECT l_returnflag, round(1 - avg(sd * sd) / var_pop(y), 6) AS noise_ceiling_r2, round(avg(CASE WHEN y < 0 THEN 1e0 ELSE 0e0 END), 6) AS negative_fraction, count(*) AS n, round(quantile_cont(sd / nullif(abs(y), 0), 0.5), 6) AS median_relative_sd
  FROM (SELECT l_returnflag, l_extendedprice / 1000 - 20 AS y, l_quantity / 10 AS sd FROM lineitem) GROUP BY 1""")
def label_quality(spark, sf):
    """Noise ceiling, share of negative labels, median relative error."""
    l = v.table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000 - 20).alias("y"), (F.col("l_quantity") / 10).alias("sd"))
    return rnd(statistics.label_quality(l, "y", "sd", ["l_returnflag"]), 6, "noise_ceiling_r2", "negative_fraction", "median_relative_sd")


# ---------------------------------------------------------------- skill
_PRED = "pr AS (SELECT l_returnflag AS f, l_partkey AS cell, l_extendedprice / 1000 AS y, l_quantity * 15e-1 + l_discount * 3 AS p FROM lineitem)"


@query(f"""WITH {_PRED}, a AS (SELECT *, avg(y) OVER k AS cy, avg(p) OVER k AS cp FROM pr WINDOW k AS (PARTITION BY f, cell)),
  o AS (SELECT f, 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) AS r2, sqrt(avg(pow(y - p, 2))) AS rmse, avg(abs(y - p)) AS mae, count(*) AS n_rows, 1 - sum(pow((y - cy) - (p - cp), 2)) / (var_pop(y - cy) * count(*)) AS t FROM a GROUP BY 1),
  s AS (SELECT f, 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) AS s FROM (SELECT f, cell, avg(y) AS y, avg(p) AS p FROM pr GROUP BY ALL) GROUP BY 1)
  SELECT f, round(r2, 6) AS r2, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(s, 6) AS spatial_r2, round(t, 6) AS temporal_r2, n_rows FROM o JOIN s USING (f)""")
def skill_scores(spark, sf):
    """Overall, spatial and temporal skill per group from one grouped pass."""
    l = v.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_partkey").alias("cell"), (F.col("l_extendedprice") / 1000).alias("y"),
                                              (F.col("l_quantity") * 1.5 + F.col("l_discount") * 3).alias("p"))
    return rnd(statistics.skill_split(l, "cell", "y", "p", ["f"]), 6, "r2", "rmse", "mae", "spatial_r2", "temporal_r2")


@query(f"""WITH {_PRED}, x AS (SELECT CAST(cell % 20 AS INTEGER) AS block, y, p AS p1, p * 9e-1 + 2 AS p2 FROM pr), b AS (SELECT block, count(*) AS n, sum(y) AS sy, sum(y * y) AS syy, sum(pow(y - p1, 2)) AS e1, sum(pow(y - p2, 2)) AS e2 FROM x GROUP BY 1),
  u AS (SELECT block, row_number() OVER (ORDER BY md5(CAST(block AS VARCHAR)), block) - 1 AS slot, count(*) OVER () AS n FROM b),
  dr AS (SELECT rep, CAST(floor((CAST('0x' || substr(md5('5:' || rep || ':' || slot), 1, 8) AS BIGINT) + 5e-1) / 4294967296e0 * n) AS BIGINT) AS slot FROM u, (SELECT unnest(range(1, 41)) AS rep)),
  w AS (SELECT rep, block, count(*) AS w FROM dr JOIN u USING (slot) GROUP BY ALL UNION ALL SELECT 0, block, 1 FROM b),
  r AS (SELECT rep, (sum(w * e1) - sum(w * e2)) / (sum(w * syy) - pow(sum(w * sy), 2) / sum(w * n)) AS g FROM w JOIN b USING (block) GROUP BY 1)
  SELECT round(max(CASE WHEN rep = 0 THEN g END), 6) AS estimate, round(quantile_cont(CASE WHEN rep > 0 THEN g END, 0.025), 6) AS lo, round(quantile_cont(CASE WHEN rep > 0 THEN g END, 0.975), 6) AS hi FROM r""")
def paired_block_bootstrap(spark, sf):
    """Interval of the R2 gain of one prediction over another, resampling whole blocks."""
    p = F.col("l_quantity") * 1.5 + F.col("l_discount") * 3
    l = v.table(spark, sf, "lineitem").select((F.col("l_partkey") % 20).cast("int").alias("block"), (F.col("l_extendedprice") / 1000).alias("y"), p.alias("p1"), (p * 0.9 + 2).alias("p2"))
    g = resample.paired_block_bootstrap(l, "block", "y", "p1", "p2", 40, 5)
    return rnd(resample.interval(g, [], "r2_gain", {"lo": 0.025, "hi": 0.975}), 6, "estimate", "lo", "hi")


# ---------------------------------------------------------------- variogram, blocks, folds
_VAR = f"""{v.CELLS}, pr AS (SELECT CAST(floor(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS INTEGER) AS lag, 5e-1 * pow(a.size - b.size, 2) AS g FROM cells a JOIN cells b ON a.cell_id < b.cell_id AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 15),
  vg AS (SELECT lag, lag + 5e-1 AS h, avg(g) AS gamma, count(*) AS n_pairs FROM pr GROUP BY ALL)"""


@query(f"WITH {_VAR} SELECT lag, h, round(gamma, 6) AS gamma, n_pairs FROM vg")
def semivariogram(spark, sf):
    """Half squared differences over all pairs closer than 15 km, by 1-km lag."""
    return rnd(variogram.semivariogram(v.cells(spark, sf), "size", 15.0), 6, "gamma")


@query(f"""WITH {_VAR}, s0 AS (SELECT avg(gamma) AS sill0 FROM vg WHERE h >= 7.5), g AS (SELECT h, gamma / sill0 AS g, gamma, sill0 FROM vg, s0), rr AS (SELECT 5e-1 + 5e-1 * k AS r FROM (SELECT unnest(range(200)) AS k)),
  e AS (SELECT r, 1 - exp(-3 * h / r) AS e, g FROM g, rr), s AS (SELECT r, count(*) AS n, sum(e) AS se, sum(e * e) AS see, sum(g) AS sg, sum(e * g) AS seg, sum(g * g) AS sgg FROM e GROUP BY 1),
  f AS (SELECT *, (n * seg - se * sg) / nullif(n * see - se * se, 0) AS b FROM s), f2 AS (SELECT *, (sg - b * se) / n AS a, greatest(0, seg / see) AS b1, greatest(0, sg / n) AS a1 FROM f),
  f3 AS (SELECT *, sgg - 2 * b1 * seg + b1 * b1 * see <= sgg - 2 * a1 * sg + n * a1 * a1 AS cs FROM f2), f4 AS (SELECT r, CASE WHEN b >= 0 AND a >= 0 THEN a WHEN cs THEN 0 ELSE a1 END AS nu, CASE WHEN b >= 0 AND a >= 0 THEN b WHEN cs THEN b1 ELSE 0 END AS si, n, se, see, sg, seg, sgg FROM f3),
  f5 AS (SELECT *, sgg - 2 * nu * sg - 2 * si * seg + n * nu * nu + 2 * nu * si * se + si * si * see AS sse FROM f4), best AS (SELECT r, nu, si FROM f5 ORDER BY sse, r LIMIT 1), fr AS (SELECT coalesce(min(CASE WHEN gamma >= 95e-2 * sill0 THEN h END), max(h)) AS first_ FROM g)
  SELECT round(nu * sill0, 4) AS nugget, round(si * sill0, 4) AS sill, r AS range_km, first_ AS first_reach_km, greatest(5, CAST(ceil(greatest(r, first_)) AS BIGINT)) AS block_km FROM best, fr, s0""")
def block_size(spark, sf):
    """Exponential variogram model by grid search, first lag at 95 % of the sill, block size."""
    vg = variogram.semivariogram(v.cells(spark, sf), "size", 15.0)
    b = variogram.block_size(vg, variogram.tail_mean(vg, 7.5))
    return rnd(b.drop("sse"), 4, "nugget", "sill")


_BLK = f"{v.CELLS}, bk AS (SELECT CAST(floor(x / 7) AS BIGINT) || '_' || CAST(floor(y / 7) AS BIGINT) AS block_id, count(*) AS n FROM cells GROUP BY 1)"


@query(f"WITH {_BLK} SELECT block_id, n AS n_cells FROM bk")
def spatial_blocks(spark, sf):
    """Square blocks and their cell counts."""
    return folds.spatial_blocks(v.cells(spark, sf), 7).groupBy("block_id").agg(F.count("*").alias("n_cells"))


_DEALT = f"""{_BLK}, o AS (SELECT block_id, n, row_number() OVER (ORDER BY n DESC, md5('42:' || block_id), block_id) AS rn FROM bk),
  r AS (SELECT CAST(0 AS BIGINT) AS rn, CAST('' AS VARCHAR) AS block_id, CAST(0 AS BIGINT) AS n, CAST(-1 AS INTEGER) AS fold, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS l
    UNION ALL SELECT o.rn, o.block_id, o.n, CAST(list_position(r.l, list_min(r.l)) - 1 AS INTEGER),
      list_transform(range(1, 6), lambda i: r.l[i] + CASE WHEN i = list_position(r.l, list_min(r.l)) THEN o.n ELSE 0 END) FROM r JOIN o ON o.rn = r.rn + 1)"""


@query(f"WITH RECURSIVE {_DEALT} SELECT block_id, n AS n_cells, fold FROM r WHERE rn > 0")
def balanced_folds(spark, sf):
    """Blocks dealt largest first to the least-loaded fold."""
    b = folds.spatial_blocks(v.cells(spark, sf), 7)
    return folds.balanced_folds(b, "cell_id", "block_id", 5, 42)


@query("""WITH s AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS y FROM lineitem) SELECT 'loso' AS scheme, s.y AS left_out, CASE WHEN year(l_shipdate) = s.y THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM lineitem, s GROUP BY ALL""")
def leave_one_season_out(spark, sf):
    """Every season held out once."""
    l = v.table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("season"))
    years = [r[0] for r in l.distinct().orderBy("season").collect()]  # one value per season
    return folds.scheme_roles(l, "season", years, "loso").groupBy("scheme", "left_out", "role").agg(F.count("*").alias("n"))


def model_table(spark, sf):
    """Cells with features, distance, block and fold, written once: it is the hand-over table of all experiments."""
    c = folds.with_folds(v.cells(spark, sf), "cell_id", 7)
    c = c.withColumn("dist", F.sqrt((F.col("x") - 25) * (F.col("x") - 25) + (F.col("y") - 20) * (F.col("y") - 20)))
    return materialise(c.withColumn("target", F.col("label") / 10 + F.col("size") / 5 - F.col("dist") / 3))


# ---------------------------------------------------------------- prediction
_MT = f"""{_BLK}, mt AS (SELECT cell_id, x, y, size, brand, CAST(cell_id % 5 AS INTEGER) AS fold, label / 1e1 + size / 5 - sqrt((x - 25) * (x - 25) + (y - 20) * (y - 20)) / 3 AS target FROM cells)"""


@query(f"""WITH {_MT}, f AS (SELECT DISTINCT fold AS g FROM mt), t AS (SELECT g, count(*) AS n, avg(size) AS m1, avg(brand) AS m2, avg(target) AS my, stddev_pop(size) AS s1, stddev_pop(brand) AS s2, covar_pop(size, brand) AS c12, covar_pop(size, target) AS c1, covar_pop(brand, target) AS c2
    FROM f JOIN mt ON mt.fold <> f.g GROUP BY 1), a AS (SELECT *, 1 + 5e0 / n AS d, c12 / (s1 * s2) AS r FROM t), b AS (SELECT *, (d * c1 / s1 - r * c2 / s2) / (d * d - r * r) / s1 AS b1, (d * c2 / s2 - r * c1 / s1) / (d * d - r * r) / s2 AS b2 FROM a)
  SELECT cell_id, round(my + b1 * (size - m1) + b2 * (brand - m2), 6) AS pred FROM mt JOIN b ON fold = g""")
def oof_ridge(spark, sf):
    """Out-of-fold ridge on standardised features; every fold from one pass of product sums."""
    c = v.cells(spark, sf)
    dist = F.sqrt((F.col("x") - 25) * (F.col("x") - 25) + (F.col("y") - 20) * (F.col("y") - 20))
    m = c.withColumn("fold", (F.col("cell_id") % 5).cast("int")).withColumn("target", F.col("label") / 10 + F.col("size") / 5 - dist / 3)
    return rnd(models.ridge_oof(m, ["size", "brand"], "target", "fold", alphas=[5.0]).select("cell_id", "pred"), 6, "pred")


@query()
def oof_ridge_tuned(spark, sf):
    """Ridge with the penalty chosen inside each training set, scored by fold."""
    p = models.ridge_oof(model_table(spark, sf), ["size", "brand", "dist", "x", "y"], "target", "fold")
    return statistics.skill(p, "target", "pred", ["fold", "alpha"])


def _vectors(spark, sf):
    """Rows with every entry of their vectors as a column, and the names of these columns."""
    e = v.table(spark, sf, "embeddings")
    cols = [f"e{i}" for i in range(e.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    return cols, e.select("vec_id", F.col("label").cast("double").alias("target"), (F.col("vec_id") % 3).cast("int").alias("fold"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])


# ---------------------------------------------------------------- experiments
_EXP = """e AS (SELECT cell, season, cell % 25 AS cx, cell // 25 AS cy, q, d, price, CASE WHEN q > 23 THEN tax END AS tax FROM (SELECT l_partkey % 500 AS cell, year(l_shipdate) % 3 AS season, avg(l_quantity) AS q,
    avg(l_discount) AS d, avg(l_extendedprice) / 1000 AS price, avg(l_tax) * 100 AS tax FROM lineitem GROUP BY ALL)),
  sc AS (SELECT *, 'blocks' AS scheme, (cx // 5 + 3 * (cy // 4)) % 5 AS fold FROM e UNION ALL SELECT *, 'loso', season FROM e UNION ALL SELECT *, 'zone', CASE WHEN cx < 8 THEN 0 WHEN cx > 10 THEN -1 END FROM e),
  r AS (SELECT scheme, fold, 'price' AS target, price AS yy, cell, cx, q, d FROM sc WHERE fold IS NOT NULL AND price IS NOT NULL UNION ALL SELECT scheme, fold, 'tax', tax, cell, cx, q, d FROM sc WHERE fold IS NOT NULL AND tax IS NOT NULL),
  f AS (SELECT DISTINCT scheme, target, fold AS g FROM r WHERE fold >= 0),
  t AS (SELECT scheme, target, g, count(*) AS n, avg(q) AS m1, avg(d) AS m2, avg(yy) AS my, stddev_pop(q) AS s1, stddev_pop(d) AS s2, covar_pop(q, d) / (stddev_pop(q) * stddev_pop(d)) AS c, covar_pop(q, yy) / stddev_pop(q) AS c1, covar_pop(d, yy) / stddev_pop(d) AS c2
    FROM f JOIN r USING (scheme, target) WHERE fold <> g GROUP BY ALL),
  u AS (SELECT *, 1 + 5e0 / n AS w FROM t),
  k AS (SELECT scheme, target, g, 'AB' AS features, m1, m2, my, (w * c1 - c * c2) / (w * w - c * c) / s1 AS b1, (w * c2 - c * c1) / (w * w - c * c) / s2 AS b2 FROM u UNION ALL SELECT scheme, target, g, 'A', m1, m2, my, c1 / w / s1, 0e0 FROM u),
  p AS (SELECT scheme, target, features, cell, cx, yy, my + b1 * (q - m1) + b2 * (d - m2) AS pp FROM r JOIN k USING (scheme, target) WHERE fold = g),
  dm AS (SELECT *, 'all' AS domain FROM p UNION ALL SELECT *, 'core' FROM p WHERE cx BETWEEN 5 AND 15),
  a AS (SELECT *, avg(yy) OVER z AS my, avg(pp) OVER z AS mp FROM dm WINDOW z AS (PARTITION BY scheme, target, features, domain, cell)),
  o AS (SELECT scheme, target, features, domain, 1 - sum(pow(yy - pp, 2)) / (var_pop(yy) * count(*)) AS r2, sqrt(avg(pow(yy - pp, 2))) AS rmse, avg(abs(yy - pp)) AS mae, count(*) AS n_rows, 1 - sum(pow((yy - my) - (pp - mp), 2)) / nullif(sum(pow(yy - my, 2)), 0) AS temporal_r2 FROM a GROUP BY ALL),
  s AS (SELECT scheme, target, features, domain, 1 - sum(pow(my - mp, 2)) / (var_pop(my) * count(*)) AS spatial_r2 FROM (SELECT DISTINCT scheme, target, features, domain, cell, my, mp FROM a) GROUP BY ALL)"""


def _experiment(spark, sf):
    """The scores of two feature sets, three schemes, two targets and two domains, and the rows' noise ceilings."""
    l = v.table(spark, sf, "lineitem")
    e = l.groupBy((F.col("l_partkey") % 500).alias("cell"), (F.year("l_shipdate") % 3).alias("season")).agg(
        F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), (F.avg("l_extendedprice") / 1000).alias("price"), (F.avg("l_tax") * 100).alias("tax"))
    e = materialise(e.select("*", (F.col("cell") % 25).alias("cx"), F.expr("cell div 25").alias("cy")).withColumn("tax", F.expr("CASE WHEN q > 23 THEN tax END")))
    block = F.expr("cx div 5 + 3 * (cy div 4)")
    schemes = {"blocks": block % 5, "loso": F.col("season"), "zone": F.expr("CASE WHEN cx < 8 THEN 0 WHEN cx > 10 THEN -1 END")}
    targets = {"price": F.col("price"), "tax": F.col("tax")}
    domains = {"all": F.lit(True), "core": F.col("cx").between(5, 15)}
    named = e.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("target"), c.alias("y")) for n, c in targets.items()])).alias("t")).select("cx", "t.*")
    inside = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in domains.items()]))
    noise = statistics.label_quality(named.where("y IS NOT NULL").withColumn("domain", F.explode(inside)).withColumn("sd", F.col("y") / 20), "y", "sd", ["target", "domain"])
    ceilings = noise.select("target", "domain", F.col("noise_ceiling_r2").alias("ceiling"))
    return models.score_table(e, {"A": ["q"], "AB": ["q", "d"]}, schemes, targets, domains, "cell", block, ceilings, alphas=[5.0])


@query(f"""WITH {_EXP}, y AS (SELECT 'price' AS target, cx, price AS v FROM e UNION ALL SELECT 'tax', cx, tax FROM e WHERE tax IS NOT NULL),
  c AS (SELECT target, domain, 1 - avg(pow(v / 20, 2)) / var_pop(v) AS ceiling FROM (SELECT *, 'all' AS domain FROM y UNION ALL SELECT *, 'core' FROM y WHERE cx BETWEEN 5 AND 15) GROUP BY ALL)
  SELECT scheme, target, features, domain, round(r2, 6) AS r2, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(spatial_r2, 6) AS spatial_r2, round(temporal_r2, 6) AS temporal_r2, n_rows,
    round(ceiling, 6) AS ceiling, round(r2 / ceiling, 6) AS ceiling_normalised_r2 FROM o JOIN s USING (scheme, target, features, domain) JOIN c USING (target, domain)""")
def score_table(spark, sf):
    """Skill of each feature set under blocks, left-out seasons and a zone hold-out, by target and domain, against the noise ceiling."""
    return rnd(_experiment(spark, sf), 6, "r2", "rmse", "mae", "spatial_r2", "temporal_r2", "ceiling", "ceiling_normalised_r2")


@query(f"""WITH {_EXP}, x AS (SELECT target, domain, scheme, sum(CASE WHEN features = 'AB' THEN r2 ELSE -r2 END) AS effect FROM o GROUP BY ALL)
  SELECT x.target, x.domain, x.scheme, round(x.effect, 6) AS effect, sign(x.effect) = sign(b.effect) AS same_sign FROM x LEFT JOIN x b ON b.target = x.target AND b.domain = x.domain AND b.scheme = 'blocks'""")
def robustness_signs(spark, sf):
    """The gain of the larger feature set, rerun under every scheme: has it the sign of the primary scheme's gain?"""
    gain = F.sum(F.when(F.col("features") == "AB", F.col("r2")).otherwise(-F.col("r2")))
    effects = materialise(_experiment(spark, sf).groupBy("target", "domain", "scheme").agg(gain.alias("effect")).withColumn("test", F.concat_ws(":", "target", "domain")))
    return rnd(models.sign_agreement(effects, "test", "scheme", "blocks").drop("test"), 6, "effect")


@query()
def oof_forest(spark, sf):
    """Out-of-fold random forest on all entries of the vectors, pooled skill."""
    cols, d = _vectors(spark, sf)
    o = models.ml_oof(d, cols, "target", "fold", [0, 1, 2], "rf", trees=500, keep=["vec_id"])
    return statistics.skill(o, "target", "pred")


@query()
def oof_wide(spark, sf):
    """Prediction columns of two estimators side by side."""
    cols, d = _vectors(spark, sf)
    long = None
    for kind, trees in (("ridge", None), ("gbt", 5)):
        o = models.ml_oof(d, cols, "target", "fold", [0, 1, 2], kind, trees=trees, keep=["vec_id"]).withColumn("model", F.lit(kind))
        long = o if long is None else long.unionByName(o)
    return freeze.predictions_wide(long, ["vec_id", "fold"], "model", "pred", ["ridge", "gbt"])


@query()
def ablation_forest(spark, sf):
    """Skill with each feature group dropped and with all features shuffled."""
    d = model_table(spark, sf)
    return models.ablation(d, {"position": ["x", "y", "dist"], "size": ["size"], "brand": ["brand"]}, "target", "fold", list(range(5)), "cell_id", "rf", trees=500)


_MODEL = f"""{_DEALT}, mt AS (SELECT cell_id, x, y, size, brand, dist, fold, label / 1e1 + size / 5 - dist / 3 AS target
    FROM (SELECT *, sqrt((x - 25) * (x - 25) + (y - 20) * (y - 20)) AS dist, CAST(floor(x / 7) AS BIGINT) || '_' || CAST(floor(y / 7) AS BIGINT) AS block_id FROM cells) JOIN (SELECT block_id, fold FROM r WHERE rn > 0) USING (block_id))"""


@query(f"""WITH RECURSIVE {_MODEL}, t AS (SELECT dist AS x, avg(target) AS y, count(*) AS w FROM mt WHERE fold <> 0 GROUP BY 1), p AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS sw, sum(w * y) OVER (ORDER BY x) AS sy, w, w * y AS wy FROM t),
  m AS (SELECT a.i AS a, b.i AS b, (b.sy - a.sy + a.wy) / (b.sw - a.sw + a.w) AS av FROM p a JOIN p b ON a.i <= b.i), g AS (SELECT a, b AS i, max(av) OVER (PARTITION BY a ORDER BY b DESC) AS top FROM m),
  f AS (SELECT x, i, min(top) AS f FROM g JOIN p USING (i) GROUP BY ALL), q AS (SELECT mt.*, lo.f AS f0, lo.x AS x0, hi.f AS f1, hi.x AS x1 FROM mt ASOF LEFT JOIN f lo ON mt.dist >= lo.x ASOF LEFT JOIN f hi ON mt.dist <= hi.x)
  SELECT cell_id, fold, round(target - coalesce(f0 + (f1 - f0) * coalesce((dist - x0) / nullif(x1 - x0, 0), 0), f0, f1), 6) AS residual FROM q""")
def isotonic_detrend(spark, sf):
    """Label minus a decreasing isotonic fit on distance, fitted outside one fold."""
    d = models.isotonic_detrend(model_table(spark, sf), "target", "dist", F.col("fold") != 0)
    return d.select("cell_id", "fold", F.round("residual", 6).alias("residual"))


# ---------------------------------------------------------------- permutations
@query(f"""WITH {v.CELLS}, a AS (SELECT cell_id, klass, row_number() OVER (PARTITION BY klass ORDER BY md5(CAST(cell_id AS VARCHAR)), cell_id) AS p FROM cells), b AS (SELECT cell_id AS src, klass, size, brand, row_number() OVER (PARTITION BY klass ORDER BY md5('9:donor:' || cell_id), cell_id) AS p FROM cells)
  SELECT a.cell_id, a.klass, b.size, b.brand FROM a JOIN b USING (klass, p)""")
def permutation_rows(spark, sf):
    """Two columns shuffled together within each group."""
    return shuffle_within(v.cells(spark, sf).select("cell_id", "klass", "size", "brand"), ["klass"], "cell_id", ["size", "brand"], 9)


def _season_table(spark, sf):
    l = v.table(spark, sf, "lineitem")
    return l.groupBy((F.col("l_partkey") % 500).alias("cell"), F.concat(F.lit("s"), (F.year("l_shipdate") % 3).cast("string")).alias("season")).agg(
        F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("target"), F.avg("l_discount").alias("disc"))


_ST = "st AS (SELECT l_partkey % 500 AS cell, 's' || CAST(year(l_shipdate) % 3 AS VARCHAR) AS season, avg(l_quantity) AS q, avg(l_extendedprice) AS target FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_ST}, o AS (SELECT * FROM (VALUES (1,'s0','s0'),(1,'s1','s2'),(1,'s2','s1'),(2,'s0','s1'),(2,'s1','s0'),(2,'s2','s2'),(3,'s0','s1'),(3,'s1','s2'),(3,'s2','s0'),(4,'s0','s2'),(4,'s1','s0'),(4,'s2','s1'),(5,'s0','s2'),(5,'s1','s1'),(5,'s2','s0')) t(rep, season, src))
  SELECT CAST(rep AS INTEGER) AS rep, a.cell, a.season, round(b.q, 6) AS q, round(a.target, 6) AS target FROM st a JOIN o ON o.season = a.season JOIN st b ON b.cell = a.cell AND b.season = o.src""")
def permutation_seasons(spark, sf):
    """All season orders: each row takes the group's values from the mapped season of its cell."""
    t = _season_table(spark, sf).drop("disc")
    seasons = ["s0", "s1", "s2"]
    m = models.season_mapping(t, "season", models.season_orders(seasons), seasons)
    full = t.select("cell", "season").join(m, "season").withColumn("src_cell", F.col("cell"))
    out = models.remap_group(t, full, ["q"], ["cell", "season"], ["src_cell", "src_season"])
    return rnd(out, 6, "q", "target").select("rep", "cell", "season", "q", "target")


@query()
def permutation_test_seasons(spark, sf):
    """Group permutation test over all season orders with temporal skill."""
    t = _season_table(spark, sf).withColumn("fold", (F.col("cell") % 5).cast("int"))
    seasons = ["s0", "s1", "s2"]
    m = models.season_mapping(t, "season", models.season_orders(seasons), seasons)
    full = t.select("cell", "season").join(m, "season").withColumn("src_cell", F.col("cell"))
    null = models.remap_group(t, full, ["q"], ["cell", "season"], ["src_cell", "src_season"])
    s = models.permutation_scores(t, null, ["disc", "q"], "target", "fold", "cell", "temporal_r2")
    return models.permutation_test(s)


@query()
def permutation_test_rows(spark, sf):
    """Row-shuffle permutation test of one feature group."""
    t = model_table(spark, sf)
    return models.permutation_test(models.row_permutation_scores(t, ["dist", "x", "y"], ["size"], "target", "fold", "cell_id", 99, 42, alphas=[1.0]))


@query()
def permutation_test_residual(spark, sf):
    """Row-shuffle test on the residual of an isotonic fit on distance, refitted and tuned outside every fold."""
    t = model_table(spark, sf)
    return models.permutation_test(models.row_permutation_scores(t, ["x", "y"], ["size"], "target", "fold", "cell_id", 99, 42, dist="dist", folds=range(5)))


_SPIN = f"""{v.CELLS}, ang AS (SELECT rep, radians(20 + 320e0 / 3 * (rep - 1) + 10 * (CAST('0x' || substr(md5('42:' || rep), 1, 8) AS BIGINT) + 5e-1) / 4294967296e0 - 5) AS a FROM (SELECT unnest(range(1, 5)) AS rep)),
  rp AS (SELECT rep, cell_id, (x - 25) * CASE WHEN rep % 2 = 0 THEN -1 ELSE 1 END AS e, y - 20 AS n, a FROM cells, ang),
  rt AS (SELECT rep, cell_id, 25 + e * cos(a) - n * sin(a) AS rx, 20 + e * sin(a) + n * cos(a) AS ry FROM rp)"""


def spins(spark, sf, n: int):
    c = v.cells(spark, sf)
    c = c.withColumn("dist", F.sqrt((F.col("x") - 25) * (F.col("x") - 25) + (F.col("y") - 20) * (F.col("y") - 20)))
    return nulls.spin_maps(c, "cell_id", nulls.source_from_distances(c, "dist"), n, 42, 1.0)


@query(f"""WITH {_SPIN} SELECT CAST(rt.rep AS INTEGER) AS rep, rt.cell_id, min_by(c.cell_id, ((rx - x) * (rx - x) + (ry - y) * (ry - y), c.cell_id)) AS src_cell FROM rt, cells c GROUP BY ALL""")
def spin_maps(spark, sf):
    """Rotated and mirrored cell maps about the fitted source; points off the grid take the nearest cell."""
    return spins(spark, sf, 4).select("rep", "cell_id", "src_cell")


@query()
def permutation_test_spin(spark, sf):
    """Rotation permutation test of one feature group."""
    t = model_table(spark, sf)
    null = models.remap_group(t, spins(spark, sf, 19), ["size"], ["cell_id"], ["src_cell"]).select("rep", *t.columns)
    s = models.permutation_scores(t, null, ["dist", "x", "y", "size"], "target", "fold", "cell_id", "spatial_r2")
    return models.permutation_test(s)


@query(f"""WITH {v.CELLS}, k AS (SELECT a.cell_id, a.x, a.y, sum(b.label * exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 8)) AS field FROM cells a, cells b GROUP BY ALL)
  SELECT x, y, round(field, 4) AS field FROM k""")
def kernel_smooth(spark, sf):
    """Gaussian neighbour sums of a cell column."""
    return rnd(kernel_sum(v.cells(spark, sf), "label", 2.0), 4, "field")


@query(f"""WITH {v.CELLS}, w AS (SELECT cell_id, x, y, sqrt(-2 * ln((CAST('0x' || substr(md5('3:' || cell_id || ':1'), 1, 8) AS BIGINT) + 5e-1) / 4294967296e0)) * cos(2 * pi() * ((CAST('0x' || substr(md5('3:' || cell_id || ':2'), 1, 8) AS BIGINT) + 5e-1) / 4294967296e0)) AS w FROM cells),
  k AS (SELECT a.cell_id, sum(b.w * exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 8)) AS f FROM w a, w b GROUP BY ALL), z AS (SELECT cell_id, (f - avg(f) OVER ()) / stddev_pop(f) OVER () AS f FROM k)
  SELECT cell_id, round(f + 1e-1 * sqrt(-2 * ln((CAST('0x' || substr(md5('3:row:' || cell_id || ':1'), 1, 8) AS BIGINT) + 5e-1) / 4294967296e0)) * cos(2 * pi() * ((CAST('0x' || substr(md5('3:row:' || cell_id || ':2'), 1, 8) AS BIGINT) + 5e-1) / 4294967296e0)), 6) AS null_label FROM z""")
def smooth_null_labels(spark, sf):
    """Smooth random labels with ten per cent noise."""
    c = v.cells(spark, sf)
    return rnd(nulls.noise_labels(c, c, "cell_id", "cell_id", 3, 2.0).select("cell_id", "null_label"), 6, "null_label")


@query()
def false_positive_rate(spark, sf):
    """Share of significant permutation tests on null labels over seeds."""
    t = model_table(spark, sf)
    c = v.cells(spark, sf)
    out = None
    for seed in range(1, 6):
        n = nulls.noise_labels(t, c, "cell_id", "cell_id", seed, 2.0).withColumn("seed", F.lit(seed))
        out = n if out is None else out.unionByName(n)
    out = materialise(out)
    s = models.row_permutation_scores(out, ["dist", "x", "y"], ["size"], "null_label", "fold", "cell_id", 19, 7, alphas=[1.0], keys=["seed"])
    p = models.permutation_test(s, ["seed"])
    return p.agg(F.count("*").alias("n_tests"), F.count_if("significant").alias("false_alarms"), F.avg(F.col("significant").cast("double")).alias("rate"))


@query("""WITH e AS (SELECT c_mktsegment AS test, CASE WHEN c_nationkey < 8 THEN 'primary' WHEN c_nationkey < 16 THEN 'without fold' ELSE 'blocks10' END AS variant, avg(c_acctbal) - 4500 AS effect FROM customer GROUP BY ALL)
  SELECT e.test, e.variant, round(e.effect, 6) AS effect, sign(e.effect) = sign(p.effect) AS same_sign FROM e LEFT JOIN e p ON p.test = e.test AND p.variant = 'primary'""")
def sign_agreement(spark, sf):
    """Robustness variants compared in sign with the primary effect."""
    n = F.col("c_nationkey")
    e = (v.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("test"), F.when(n < 8, "primary").when(n < 16, "without fold").otherwise("blocks10").alias("variant"))
         .agg((F.avg("c_acctbal") - 4500).alias("effect")))
    return rnd(models.sign_agreement(e, "test", "variant", "primary"), 6, "effect")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def unfinished_tests(spark, sf):
    """Work items without a stored result under the same key and fingerprint."""
    t = v.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.lit("1-URGENT").alias("mark"))
    done = v.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("mark"))
    return models.unfinished(t, done, ["c_custkey", "mark"]).drop("mark")


@query("""WITH f AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'ref_' ELSE '' END || n_name AS feature, r_name AS label, n_nationkey FROM nation, region)
  SELECT label, feature FROM f WHERE NOT starts_with(feature, 'ref_') AND NOT EXISTS (SELECT 1 FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = f.label AND n.n_name = f.feature)""")
def leakage_guard(spark, sf):
    """Feature candidates per label without construction-linked and reference columns."""
    n, r = v.table(spark, sf, "nation"), v.table(spark, sf, "region")
    name = F.concat(F.when(F.col("n_nationkey") % 5 == 0, "ref_").otherwise(""), F.col("n_name"))
    # the candidates are by definition every feature for every label
    cand = n.select(name.alias("feature")).crossJoin(r.select(F.col("r_name").alias("label")))
    links = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("label"), F.col("n_name").alias("feature"))
    return models.unlinked(cand, links).select("label", "feature")


# ---------------------------------------------------------------- frozen tables
@query("""WITH d AS (SELECT CAST('0x' || substr(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), l_returnflag, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR))), 1, 12) AS BIGINT) AS b FROM lineitem)
  SELECT count(*) AS n_rows, CAST(sum(b) AS VARCHAR) AS digest_sum, CAST(bit_xor(b) AS VARCHAR) AS digest_xor FROM d""")
def table_fingerprint(spark, sf):
    """Order-insensitive fingerprint of a table."""
    l = v.table(spark, sf, "lineitem")
    return freeze.fingerprint(l, [F.col("l_orderkey"), F.col("l_partkey"), F.col("l_returnflag"), F.round(F.col("l_extendedprice") * 100).cast("bigint")])


@query("""SELECT * FROM (PIVOT (SELECT l_partkey, l_returnflag, CAST(l_quantity AS DOUBLE) AS q FROM lineitem) ON l_returnflag IN ('A', 'N', 'R') USING max(q) GROUP BY l_partkey)""")
def predictions_wide(spark, sf):
    """Long predictions to one column per model."""
    l = v.table(spark, sf, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.max("l_quantity").alias("q"))
    return freeze.predictions_wide(l, ["l_partkey"], "l_returnflag", "q", ["A", "N", "R"])


