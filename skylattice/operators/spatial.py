"""Spatial joins on tables of points, lines, polygons and square cells.

Every join is an equi-join on integer cell or bin keys produced by expressions. Rows at the same location are
combined before any pair is formed, and pairs exist only between neighbouring bins.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.geodesy import clipped_length, in_corridor, in_ring, meets_box
from skylattice.operators.materialise import materialise
from skylattice.operators.sizing import join_on, join_rows


# ---------------------------------------------------------------- lines
def line_segments(lines: DataFrame, points: str, keep: Sequence[str]) -> DataFrame:
    """One row per segment of an ARRAY<STRUCT<x, y>> polyline."""
    p = F.col(points)
    pairs = F.arrays_zip(F.slice(p, F.lit(1), F.size(p) - 1).alias("a"), F.slice(p, F.lit(2), F.size(p) - 1).alias("b"))
    s = lines.where(F.size(p) >= 2).select(*keep, F.explode(pairs).alias("s"))
    return s.select(*keep, F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"),
                    F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def any_vertex_in_box(points: str, x0: float, x1: float, y0: float, y1: float) -> Column:
    return F.exists(points, lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1))


def segment_cells(segments: DataFrame, size: float) -> DataFrame:
    """Segments exploded to the closed square cells they touch, with the clipped length in each (`len_in`); a
    segment along a shared edge counts in both cells.

    Columns first, then only the rows the segment spans inside each column: the number of candidates grows
    with the segment's length, not with the area of its bounding box.
    """
    lo, hi = F.least("x1", "x2"), F.greatest("x1", "x2")
    s = segments.withColumn("cx", F.explode(F.sequence(F.ceil(lo / size) - 1, F.floor(hi / size))))
    dx = F.col("x2") - F.col("x1")

    def y_at(x):
        t = F.coalesce(F.try_divide(x - F.col("x1"), dx), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.col("y1") + t * (F.col("y2") - F.col("y1"))

    ya = F.when(dx == 0, F.col("y1")).otherwise(y_at(F.col("cx") * size))
    yb = F.when(dx == 0, F.col("y2")).otherwise(y_at((F.col("cx") + 1) * size))
    pad = 1e-9 * size  # interpolation rounding must not lose a cell the segment only just reaches
    s = s.withColumn("cy", F.explode(F.sequence(F.floor((F.least(ya, yb) - pad) / size),
                                                F.floor((F.greatest(ya, yb) + pad) / size))))
    x0, y0 = F.col("cx") * size, F.col("cy") * size
    return s.withColumn("len_in", clipped_length("x1", "y1", "x2", "y2", x0, y0, x0 + size, y0 + size))


def line_km_per_cell(segments: DataFrame, cells: DataFrame, size: float, classes: Sequence[str], klass: str = "klass",
                     cell_id: str = "cell_id") -> DataFrame:
    """Length of every line class inside each cell (one column per class and the total); cells without lines get 0.

    Lengths are summed per lattice key and class before the cell table is joined.
    """
    sums = (segment_cells(segments, size).groupBy("cx", "cy")
            .agg(*[F.sum(F.when(F.col(klass) == c, F.col("len_in")).otherwise(0.0)).alias(f"{c}_km") for c in classes]))
    cols = [f"{c}_km" for c in classes]
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    return (cells.select(cell_id, "cx", "cy").join(sums, ["cx", "cy"], "left").fillna(0.0, cols)
            .select(cell_id, *cols, total.alias("total_km")))


# ---------------------------------------------------------------- polygons
def sub_points(size: float, per_side: int) -> Column:
    """Offsets of a regular per_side x per_side set of sample points inside a cell, as an array."""
    n = per_side * per_side
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(
        k.alias("k"), ((k % per_side + 0.5) * size / per_side).alias("dx"),
        ((F.floor(k / per_side) + 0.5) * size / per_side).alias("dy")))


def polygon_meets_box(ring: str, x0: float, x1: float, y0: float, y1: float) -> Column:
    """True if the ring's area and the closed box share a point: a vertex in the box, a box corner in the ring,
    or an edge that meets the box, be it in one point."""
    r = F.col(ring)
    shifted = F.concat(F.slice(r, F.lit(2), F.size(r) - 1), F.slice(r, F.lit(1), F.lit(1)))
    through = F.exists(F.arrays_zip(r.alias("a"), shifted.alias("b")), lambda e: meets_box(
        e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"], F.lit(x0), F.lit(y0), F.lit(x1), F.lit(y1)))
    return any_vertex_in_box(ring, x0, x1, y0, y1) | in_ring(F.lit(x0), F.lit(y0), r) | through


# ---------------------------------------------------------------- zones
def with_zones(df: DataFrame, zones: dict[str, Column], names: Sequence[Column] = ()) -> DataFrame:
    """One row per (row, zone it lies in); zones may overlap. One pass, no join.

    `names` are columns that hold the name of a further zone of the row, NULL for none.
    """
    named = F.array(*[F.when(cond, F.lit(name)) for name, cond in zones.items()], *[n.cast("string") for n in names])
    return df.withColumn("zone", F.explode(F.filter(named, lambda z: z.isNotNull())))


def zone_totals(df: DataFrame, zones: dict[str, Column], value: Column, keys: Sequence[str] = (), out: str = "total",
                names: Sequence[Column] = ()) -> DataFrame:
    return with_zones(df, zones, names).groupBy(*keys, "zone").agg(F.sum(value).alias(out))


def cell_lattice(spark: SparkSession, x0: int, x1: int, y0: int, y1: int, size: float) -> DataFrame:
    """Square cells with lattice keys x0 <= cx < x1, y0 <= cy < y1 and their centres."""
    nx = x1 - x0
    ids = spark.range(nx * (y1 - y0))
    cx, cy = (F.col("id") % nx + x0).cast("bigint"), (F.expr(f"id div {nx}") + y0).cast("bigint")
    return ids.select(cx.alias("cx"), cy.alias("cy"), ((cx + 0.5) * size).alias("x"), ((cy + 0.5) * size).alias("y"))


def corridor_cells(lattice: DataFrame, size: float, path, buffer: float, discs=(), per_side: int = 10,
                   min_share: float = 0.5) -> DataFrame:
    """Cells with at least `min_share` of their area inside the corridor (share by sub-points)."""
    pts = lattice.withColumn("s", F.explode(sub_points(size, per_side)))
    px, py = F.col("cx") * size + F.col("s.dx"), F.col("cy") * size + F.col("s.dy")
    share = F.avg(in_corridor(px, py, path, buffer, discs).cast("double"))
    return pts.groupBy("cx", "cy", "x", "y").agg(share.alias("frac_in_corridor")).where(F.col("frac_in_corridor") >= min_share)


def region_cells(lattice: DataFrame, corridor: DataFrame, centre: tuple[float, float], radius: float, box, margin: float) -> DataFrame:
    """Cells whose centre is within the radius and the margin-shrunk box, plus all corridor cells (rounded-centre join)."""
    x0, x1, y0, y1 = box
    c = corridor.select(F.round("x").alias("__x"), F.round("y").alias("__y"), F.lit(True).alias("__in"),
                        F.col("frac_in_corridor").alias("__share"))
    near = F.sqrt((F.col("x") - centre[0]) * (F.col("x") - centre[0]) + (F.col("y") - centre[1]) * (F.col("y") - centre[1]))
    kept = (near <= radius) & F.col("x").between(x0 + margin, x1 - margin) & F.col("y").between(y0 + margin, y1 - margin)
    joined = lattice.join(c, (F.round("x") == F.col("__x")) & (F.round("y") == F.col("__y")), "left")
    return (joined.where(F.col("__in").isNotNull() | kept)
            .select("cx", "cy", "x", "y", F.coalesce("__in", F.lit(False)).alias("in_corridor"),
                    F.coalesce("__share", F.lit(0.0)).alias("frac_in_corridor"), near.alias("dist_to_source")))


# ---------------------------------------------------------------- nearest points
#: Places that every task may hold, and places in a leaf of a tree.
FEW, LEAF = 64, 8
#: Bins along each side of a bin of the level above, so that the first level has 16 bins; and levels at most: 4^24 bins along a
#: side are near the resolution of a double.
SIDE, DEEPEST = 4, 24


def _places(points: DataFrame, cols: Sequence[str], px: str, py: str, order: str) -> DataFrame:
    """One row per position (__x, __y) with the row of smallest order as __p; rows without a position go."""
    pts = points.select(F.col(order).alias("__ord"), F.col(px).cast("double").alias("__x"), F.col(py).cast("double").alias("__y"), *cols)
    pts = pts.where("__x IS NOT NULL AND __y IS NOT NULL AND NOT isnan(__x) AND NOT isnan(__y)")
    return pts.groupBy("__x", "__y").agg(F.min_by(F.struct("__ord", *cols), "__ord").alias("__p"))


def _square(a, b) -> Column:
    return (a - b) * (a - b)


def _with_head(df: DataFrame, rows: DataFrame) -> DataFrame:
    """df with `__head`, the array of the few rows."""
    head = rows.agg(F.collect_list(F.struct(*rows.columns)).alias("__head"), F.lit(0).alias("__k"))
    return df.withColumn("__k", F.lit(0)).join(F.broadcast(head), "__k").drop("__k")


def _nearest_of_few(df: DataFrame, places: DataFrame, cols: list[str], x: str, y: str) -> DataFrame:
    """Every row looks through the few places itself: no shuffle of the rows, which are read once."""
    seen = F.transform("__head", lambda p, i: F.struct((_square(p["__x"], F.col(x)) + _square(p["__y"], F.col(y))).alias("d2"), p["__p"]["__ord"].alias("o"), i.alias("i")))
    hit = F.when(F.expr(f"NOT isnan(coalesce(`{x}`, double('nan'))) AND NOT isnan(coalesce(`{y}`, double('nan')))"), F.array_min(seen))
    near = _with_head(df, places).withColumn("__h", hit)
    best = F.get("__head", F.col("__h.i"))["__p"]
    return near.select(*df.columns, F.sqrt("__h.d2").alias("nearest_dist"), *[best[c].alias(c) for c in cols])


def _tree(places: DataFrame, x0: float, y0: float, span: float, n: int) -> tuple[DataFrame, DataFrame, int]:
    """The places with their leaf bins, the bins of all levels in one written table, and the number of levels.

    Levels are added until no leaf holds more than LEAF places, so that points crowded on a spot are parted like any others.
    """
    depth = max(2, math.ceil(math.log(n, SIDE * SIDE)))
    while True:
        leaf = span / float(SIDE) ** depth
        keyed = places.selectExpr("*", *[f"least(cast(floor((__{c} - {o!r}D) / {leaf!r}D) AS bigint), {SIDE ** depth - 1}L) AS b{c}" for c, o in (("x", x0), ("y", y0))])
        at = keyed.selectExpr("__x", "__y", "bx AS lx", "by AS ly", f"explode(sequence(1, {depth})) AS level")
        up = f"cast(2 * ({depth} - level) AS int)"  # SIDE is 2^2
        bins = materialise(at.groupBy("level", F.expr(f"shiftright(lx, {up})").alias("bx"), F.expr(f"shiftright(ly, {up})").alias("by"))
                           .agg(F.min("__x").alias("ax"), F.max("__x").alias("zx"), F.min("__y").alias("ay"), F.max("__y").alias("zy"),
                                F.min(F.struct("__x", "__y")).alias("m"), F.count("*").alias("n")), ["level"])
        full = bins.where(F.col("level") == depth).agg(F.max("n")).first()[0]
        if full <= LEAF or depth >= DEEPEST:
            return keyed, bins.drop("n"), depth
        depth = min(DEEPEST, depth + max(1, math.ceil(math.log(full / LEAF, SIDE * SIDE))))


def _nearest_tree(df: DataFrame, places: DataFrame, cols: list[str], x: str, y: str, x0: float, y0: float, span: float, n: int) -> DataFrame:
    """Nearest place by descending a tree of square bins, SIDE times finer per level.

    Each occupied bin knows its bounding box and one member. A query keeps the bins whose box is not farther than the nearest
    member seen at that level, so a handful of bins per query survives however the places are distributed, and only the places
    of the last bins are compared. Every task holds the first level (at most 16 bins), so queries start below the root and no
    key of a join holds them all; each further level is one equi-join with its part of the written table.
    """
    keyed, bins, depth = _tree(places, x0, y0, span, n)
    spots = df.select(F.col(x).alias("qx"), F.col(y).alias("qy")).where("qx IS NOT NULL AND qy IS NOT NULL AND NOT isnan(qx) AND NOT isnan(qy)").distinct()
    qx, qy = F.col("qx"), F.col("qy")

    def bounds(b) -> tuple[Column, Column]:
        dx, dy = F.greatest(b("ax") - qx, F.lit(0.0), qx - b("zx")), F.greatest(b("ay") - qy, F.lit(0.0), qy - b("zy"))
        return dx * dx + dy * dy, _square(b("m")["__x"], qx) + _square(b("m")["__y"], qy)

    first = _with_head(spots, bins.where("level = 1").drop("level"))
    first = first.withColumn("best", F.array_min(F.transform("__head", lambda b: bounds(lambda c: b[c])[1])))
    near = F.filter("__head", lambda b: bounds(lambda c: b[c])[0] <= F.col("best") * (1 + 1e-9))
    front = first.select("qx", "qy", F.explode(near).alias("b")).selectExpr("qx", "qy", "b.bx AS px", "b.by AS py")
    for level in range(2, depth + 1):
        kids = bins.where(F.col("level") == level).selectExpr("*", "shiftright(bx, 2) AS px", "shiftright(by, 2) AS py")
        lo, hi = bounds(F.col)
        front = (front.join(kids, ["px", "py"]).select("qx", "qy", "bx", "by", lo.alias("lo"), hi.alias("hi"))
                 .selectExpr("*", "min(hi) OVER (PARTITION BY qx, qy) AS best").where("lo <= best * (1 + 1e-9D)")
                 .selectExpr("qx", "qy", "bx AS px", "by AS py"))
    d2 = _square(F.col("__x"), qx) + _square(F.col("__y"), qy)
    hit = (front.join(keyed.withColumnsRenamed({"bx": "px", "by": "py"}), ["px", "py"]).withColumn("d2", d2)
           .groupBy("qx", "qy").agg(F.min_by(F.struct("d2", "__p"), F.struct("d2", "__p.__ord")).alias("h")))
    got = hit.select(F.col("qx").alias(x), F.col("qy").alias(y), F.sqrt("h.d2").alias("nearest_dist"), *[F.col("h.__p")[c].alias(c) for c in cols])
    return join_on(df, got, [x, y], "left")


def nearest_point(df: DataFrame, points: DataFrame, x: str = "x", y: str = "y", px: str = "x", py: str = "y",
                  cols: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Add `nearest_dist` and `cols` of the nearest point; ties go to the smallest `order`.

    Up to FEW distinct places are counted first and then held by every task; more, without limit, are searched through a tree of
    bins whose first level is held in the same way. Points with a NULL or NaN coordinate are nobody's nearest; rows with
    one, and all rows where there is no point, get NULL for the distance and the columns.
    """
    cols = list(cols)
    places = _places(points, cols, px, py, order or px)
    x0, x1, y0, y1, n = places.agg(F.min("__x"), F.max("__x"), F.min("__y"), F.max("__y"), F.count("*")).first()
    if n <= FEW:
        return _nearest_of_few(df, places, cols, x, y)
    return _nearest_tree(df, materialise(places), cols, x, y, x0, y0, max(x1 - x0, y1 - y0) * (1 + 1e-9), n)


def nearest_on_lattice(points: DataFrame, cells: DataFrame, spacing: float, x: str, y: str, cell_id: str,
                       out: str = "src_cell") -> DataFrame:
    """Nearest lattice cell of each point: its rounded lattice node, drawn into the box of all cells, if that cell exists, else a search.

    The node of the box that is nearest to a point outside it is the nearest of all cells if there is a cell. Beyond the corners
    of the box a node may be that of any number of points; these few nodes are held by every task.
    """
    cells = cells.select(F.col(cell_id).alias(out), F.col("x").alias("__cx"), F.col("y").alias("__cy"))
    nodes = {"__ix": "__cx", "__iy": "__cy"}
    keyed = cells.select(out, *[F.rint(F.col(c) / spacing - 0.5).cast("bigint").alias(i) for i, c in nodes.items()])
    box = keyed.agg(*[f(i).alias(f"{n}{i}") for i in nodes for n, f in (("lo", F.min), ("hi", F.max))]).first()
    tagged, beyond, tied = points, [], F.lit(False)
    for i, c in (("__ix", x), ("__iy", y)):
        lo, hi = F.lit(box[f"lo{i}"]), F.lit(box[f"hi{i}"])
        at = F.col(c) / spacing - 0.5
        over = (F.rint(at) < lo) | (F.rint(at) > hi)
        beyond.append(over)
        # half way between two nodes the search settles by the order of the cells
        tied = tied | (~over & (F.abs(F.abs(at - F.rint(at)) - 0.5) < 1e-9))
        tagged = tagged.withColumn(i, F.when(F.col(c).isNotNull() & ~F.isnan(c), F.least(F.greatest(F.rint(at), lo), hi).cast("bigint")))
    tagged = tagged.withColumn("__corner", F.coalesce(beyond[0] & beyond[1], F.lit(False)))
    tagged = tagged.withColumn("__ix", F.when(~((beyond[0] | beyond[1]) & tied), F.col("__ix")))
    ends = keyed.where(F.col("__ix").isin(box["lo__ix"], box["hi__ix"]) & F.col("__iy").isin(box["lo__iy"], box["hi__iy"]))
    direct = tagged.where("NOT __corner").hint("merge").join(keyed, ["__ix", "__iy"], "left").unionByName(tagged.where("__corner").join(F.broadcast(ends), ["__ix", "__iy"], "left"))
    direct = materialise(direct.drop("__ix", "__iy", "__corner"))
    found = direct.where(F.col(out).isNotNull())
    missed = direct.where(F.col(out).isNull()).drop(out)
    searched = nearest_point(missed, cells, x, y, "__cx", "__cy", [out], order=out).drop("nearest_dist")
    return found.unionByName(searched)


# ---------------------------------------------------------------- neighbour sums
def _near_bins(size: float, offsets) -> Column:
    return F.explode(F.array(*[F.struct((F.floor(F.col("x") / size) - i).alias("bx"),
                                        (F.floor(F.col("y") / size) - j).alias("by"), F.lit(i == 0 and j == 0).alias("own"))
                               for i, j in offsets]))


def lag_sums(df: DataFrame, z: str, max_dist: float, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of half squared differences and pair count per distance lag, over all unordered pairs closer than
    `max_dist`. Needs columns x, y.

    Rows are first reduced to (count, mean, variance) per location, from which the sums over all pairs between
    two locations follow exactly; pairs of locations are formed in half of the 3 x 3 bin neighbourhood only.
    """
    keys = list(keys)
    loc = (df.where(F.col(z).isNotNull()).groupBy(*keys, "x", "y")
           .agg(F.count("*").alias("n"), F.avg(z).alias("m"), F.var_pop(z).alias("v")))
    half = [(0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]
    a = loc.select(*keys, *[F.col(c).alias(f"{c}1") for c in ("x", "y", "n", "m", "v")],
                   F.floor(F.col("x") / max_dist).alias("bx"), F.floor(F.col("y") / max_dist).alias("by"))
    b = loc.select("*", _near_bins(max_dist, half).alias("o")).select("*", "o.*").drop("o")
    d = F.sqrt((F.col("x") - F.col("x1")) * (F.col("x") - F.col("x1")) + (F.col("y") - F.col("y1")) * (F.col("y") - F.col("y1")))
    once = ~F.col("own") | (F.col("x1") < F.col("x")) | ((F.col("x1") == F.col("x")) & (F.col("y1") < F.col("y")))
    pairs = (a.hint("merge").join(b, [*keys, "bx", "by"]).where(once).withColumn("d", d).where(F.col("d") < max_dist)
             .select(*keys, F.floor(F.col("d") / width).cast("int").alias("lag"), (F.col("n1") * F.col("n")).alias("n_pairs"),
                     (0.5 * F.col("n1") * F.col("n") * ((F.col("m1") - F.col("m")) * (F.col("m1") - F.col("m"))
                                                        + F.col("v1") + F.col("v"))).alias("half_sq")))
    same = loc.where(F.col("n") > 1).select(*keys, F.lit(0).alias("lag"),
                                            F.expr("n * (n - 1) div 2").alias("n_pairs"),
                                            (0.5 * F.col("n") * F.col("n") * F.col("v")).alias("half_sq"))
    return (pairs.unionByName(same).groupBy(*keys, "lag")
            .agg(F.sum("half_sq").alias("half_sq"), F.sum("n_pairs").alias("n_pairs")))


#: Sigmas beyond which a Gaussian weight is below the rounding of a double.
NEGLIGIBLE = 8.6
#: Lattice points along a row that meet before they are spread.
STRETCH = 1024


def kernel_sum(df: DataFrame, w: str, sigma: float, keys: Sequence[str] = (), out: str = "field", spacing: float = 1.0) -> DataFrame:
    """Per location of a lattice: sum of w over all rows, weighted by exp(-d*d / (2*sigma*sigma)).

    The kernel is the product of one along x and one along y, so each location's sum is spread along its row of the lattice and
    the row sums along the columns; every shuffle is keyed by lattice points, and no pair of locations and no bin is formed.
    Weights below the rounding of a double are left out, no others. Coordinates off the lattice of the given spacing, whose
    origin is the least x and y, fail the job.
    """
    keys = list(keys)
    reach = math.ceil(NEGLIGIBLE * sigma / spacing)
    loc = df.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*keys, "x", "y").agg(F.sum(F.col(w).cast("double")).alias("__w"))
    origin = loc.agg(F.min("x").alias("__x0"), F.min("y").alias("__y0"))
    at = loc.join(F.broadcast(origin))
    for c, i in (("x", "__i"), ("y", "__j")):
        steps = (F.col(c) - F.col(f"__{c}0")) / spacing
        at = at.withColumn(i, F.when(F.abs(steps - F.round(steps)) > 1e-6, F.raise_error(F.concat(F.lit(f"{c} is off the lattice: "), F.col(c).cast("string")))).otherwise(F.round(steps).cast("long")))
    offset = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    weight = F.exp(-(F.col("__d") * spacing) * (F.col("__d") * spacing) / (2 * sigma * sigma))
    spread = at.select(*keys, "__i", "__j", "__w")
    for i, j in (("__i", "__j"), ("__j", "__i")):
        # neighbours along the spread meet first, so that what they add to a point is summed before the next shuffle
        spread = (spread.repartition(*keys, j, F.floor(F.col(i) / STRETCH)).withColumn("__d", offset).withColumn(i, F.col(i) + F.col("__d")).withColumn("__w", F.col("__w") * weight)
                  .groupBy(*keys, "__i", "__j").agg(F.sum("__w").alias("__w")))
        # only rows or columns in which locations stand go on
        spread = join_on(spread, at.select(*keys, i).distinct(), [*keys, i])
    return join_rows(at.select(*keys, "__i", "__j", "x", "y"), spread, [*keys, "__i", "__j"]).select(*keys, "x", "y", F.col("__w").alias(out))
