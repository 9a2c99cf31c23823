"""Polygons as hierarchical coverings of square cells.

A covering has two kinds of pieces. Border cells hold the edges that touch them and the parity of one corner, so a point
in them is settled by these edges alone. Runs of interior cells carry no edge at all; they are cut into aligned blocks of 1, 8
and 64 cells, so their number grows with the outline and not with the area. Rings follow the even-odd rule together, which
makes holes and multi-polygons ordinary: an area is the list of all its rings. Rings of fewer than three vertices and edges with a
missing coordinate are left out; closing edges are implied.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylattice.operators.materialise import materialise, task_slots
from skylattice.operators.spatial import segment_cells, sub_points

#: Block sizes of the covering are 8 ** level.
LEVELS = 3
#: Points, and pieces, of one block that meet in one part of a join; and most tasks that a join is dealt to.
SIDE, MOST_TASKS = 3000, 10_000
#: Pairs of a square beyond which it is tested alone; pairs tested, and rows returned, at once.
CROWDED, PAIRS, ROWS_OUT = 4096, 1 << 17, 1 << 17
#: Sample points per mask column of cover shares.
BITS = 62


def _height_at(x: Column, e) -> Column:
    return F.try_divide((e["y2"] - e["y1"]) * (x - e["x1"]), e["x2"] - e["x1"]) + e["y1"]


def _odd(px: Column, py: Column, left: Column, bottom: Column, e) -> Column:
    """True where an edge changes the parity between the cell's corner (left, bottom) and the point.

    The area is cut at the line x = left. Right of it, vertices cancel around every ring, so only edges that meet the cell count:
    their crossing with the point's ray towards +x, less what they add to the ray of the corner.
    """
    straddles = (e["y1"] > py) != (e["y2"] > py)
    # rounding must not carry the crossing to the left of the edge, or a point beside a left tip lies inside
    at = F.try_divide((e["x2"] - e["x1"]) * (py - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
    crosses = straddles & (px < F.greatest(F.least(e["x1"], e["x2"]), at))
    r1, r2 = e["x1"] >= left, e["x2"] >= left
    end = F.when(r1, e["y1"]).otherwise(e["y2"])
    rest = F.when(r1 & r2, straddles).when(r1 != r2, (end > py) != (_height_at(left, e) > bottom)).otherwise(F.lit(False))
    return F.coalesce(crosses, F.lit(False)) != rest


def _inside(px: Column, py: Column, size: float) -> Column:
    """For a piece and a point of its cells (columns full, corner, edges, and cx, cy of the point's cell)."""
    left, bottom = F.col("cx") * size, F.col("cy") * size
    odd = F.size(F.filter("edges", lambda e: _odd(px, py, left, bottom, e)))
    return F.col("full") | ((F.col("corner") + odd) % 2 == 1)


def _sequence(lo: str, hi: str) -> str:
    return f"if({lo} < {hi}, sequence({lo}, {hi} - 1), array())"


def _blocks(a: str, b: str) -> Column:
    """Structs (level, ky) of the aligned blocks that make up the cells a <= cy < b."""
    parts = []
    for level in range(LEVELS):
        n, up = 8**level, 8 ** (level + 1)
        lo, hi = f"ceil({a} / {n})", f"floor({b} / {n})"
        lo2, hi2 = f"(ceil({a} / {up}) * 8)", f"(floor({b} / {up}) * 8)"
        own = _sequence(lo, hi)
        if level < LEVELS - 1:
            own = f"if({lo2} < {hi2}, concat({_sequence(lo, lo2)}, {_sequence(hi2, hi)}), {own})"
        parts.append(f"transform({own}, k -> struct({level} AS level, cast(k AS bigint) AS ky))")
    return F.expr(f"concat({', '.join(parts)})")


def covering(areas: DataFrame, rings: str, size: float, cols: Sequence[str] = ()) -> DataFrame:
    """(level, cx, ky, full, corner, edges, area): the pieces of every area; `area` is a struct of its columns and `copies`.

    `rings` is an ARRAY<ARRAY<STRUCT<x, y>>>. Equal rows are one area with a number of copies. Shuffles are keyed by (area, cell)
    and (area, column of cells), so one large polygon spreads over many tasks.
    """
    distinct = areas.groupBy(*cols, F.col(rings).alias("__rings")).agg(F.count("*").alias("copies"))
    named = distinct.select(F.md5(F.to_json(F.struct(*cols, "__rings"))).alias("id"), F.struct(*cols, "copies").alias("area"),
                            F.explode("__rings").alias("r")).where(F.size("r") >= 3)
    ends = F.arrays_zip(F.col("r").alias("a"), F.concat(F.slice("r", F.lit(2), F.size("r") - 1), F.slice("r", F.lit(1), F.lit(1))).alias("b"))
    edges = (named.select("id", "area", F.explode(ends).alias("e"))
             .select("id", "area", *[F.col(f"e.{v}.{c}").cast("double").alias(f"{c}{i}") for v, i in (("a", 1), ("b", 2)) for c in "xy"])
             .dropna(subset=["x1", "y1", "x2", "y2"]))
    cells = (segment_cells(edges, size).groupBy("id", "cx", "cy")
             .agg(F.first("area").alias("area"), F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges")))
    # where edges cross the left side lines of the cells' columns
    line = F.col("cx") * size
    span = F.sequence(F.floor(F.least("x1", "x2") / size), F.ceil(F.greatest("x1", "x2") / size))
    crossed = edges.withColumn("cx", F.explode(span)).where((F.col("x1") >= line) != (F.col("x2") >= line))
    e = {c: F.col(c) for c in ("x1", "y1", "x2", "y2")}
    kind, none = "kind", lambda c: F.lit(None).cast(cells.schema[c].dataType).alias(c)
    events = (cells.select("id", "cx", "cy", (F.col("cy") * size).alias("at"), F.lit(0).alias(kind), "area", "edges")
              .unionByName(crossed.select("id", "cx", none("cy"), _height_at(line, e).alias("at"), F.lit(1).alias(kind), none("area"), none("edges"))))
    column = Window.partitionBy("id", "cx")
    above = F.sum(kind).over(column.orderBy(F.desc("at"), kind).rowsBetween(Window.unboundedPreceding, 0))
    border = (events.withColumn("corner", (above % 2).cast("int")).where("kind = 0")
              .withColumn("before", F.lag("cy").over(column.orderBy("cy"))))
    # a gap below a border cell is inside where the cell's corner is
    both = F.when((F.col("corner") == 1) & (F.col("before") + 1 < F.col("cy")),
                  F.transform(_blocks("(before + 1)", "cy"), lambda b: F.struct(b["level"].alias("level"), b["ky"].alias("ky"), F.lit(True).alias("full"))))
    own = F.array(F.struct(F.lit(0).alias("level"), F.col("cy").alias("ky"), F.lit(False).alias("full")))
    pieces = border.select("cx", "corner", "edges", "area", F.explode(F.concat(own, F.coalesce(both, F.slice(own, 1, 0)))).alias("p"))
    return pieces.select("p.level", "cx", "p.ky", "p.full", "corner", F.when(~F.col("p.full"), F.col("edges")).alias("edges"), "area")


def _with_blocks(cells: DataFrame) -> DataFrame:
    """Rows with a cell (cx, cy), once per level of the covering, keyed by (level, cx, ky)."""
    at = F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright("cy", 3 * level).alias("ky")) for level in range(LEVELS)])
    return cells.withColumn("__b", F.explode(at)).select("*", "__b.level", "__b.ky").drop("__b")


def _dealt(points: DataFrame, pieces: DataFrame) -> DataFrame:
    """Points (kind 1) and pieces (kind 0) of the blocks that have both, in squares of a block that are dealt out by the number of pairs."""
    keys = ["level", "cx", "ky"]
    work = points.groupBy(*keys).agg(F.count("*").alias("n")).join(pieces.groupBy(*keys).agg(F.count("*").alias("m")), keys)
    work = materialise(work.select(*keys, F.ceil(F.col("n") / SIDE).alias("__n"), F.ceil(F.col("m") / SIDE).alias("__m"), (F.col("n") * F.col("m")).alias("pairs")))
    pairs = work.agg(F.sum("pairs")).first()[0] or 0
    tasks = min(MOST_TASKS, max(task_slots(points.sparkSession), -(-pairs // SIDE**2)))

    def squares(rows: DataFrame, own: str, n: str, other: str, m: str, what: list[str]) -> DataFrame:
        dealt = rows.join(work.drop("pairs"), keys).withColumn(own, F.pmod(F.xxhash64(*what), F.col(n)))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1))).drop("__n", "__m")

    p = squares(points, "__i", "__n", "__j", "__m", ["point", "px", "py"]).withColumn("kind", F.lit(1))
    q = squares(pieces, "__j", "__m", "__i", "__n", ["area", "full", "corner"]).withColumn("kind", F.lit(0))
    both = q.unionByName(p, allowMissingColumns=True)
    return both.repartition(tasks, *keys, "__i", "__j").sortWithinPartitions(*keys, "__i", "__j", "kind")


def _flips(px, py, left, bottom, x1, y1, x2, y2) -> np.ndarray:
    """`_odd` of arrays that fit together."""
    straddles = (y1 > py) != (y2 > py)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        at, height = (x2 - x1) * (py - y1) / (y2 - y1) + x1, (y2 - y1) * (left - x1) / (x2 - x1) + y1
    r1, r2 = x1 >= left, x2 >= left
    rest = ((r1 & r2) & straddles) | ((r1 != r2) & ((np.where(r1, y1, y2) > py) != (height > bottom)))
    return (straddles & (px < np.maximum(np.minimum(x1, x2), at))) != rest


class _Block:
    """Rows of a batch in the order of their squares, the pieces of each square before its points."""

    def __init__(self, rows: pa.RecordBatch, size: float):
        self.rows = rows
        column = lambda c, none: rows.column(c).fill_null(none).to_numpy(zero_copy_only=False)
        names = ["level", "cx", "ky", "__i", "__j"]
        new = np.append(True, np.any([np.diff(rows.column(c).to_numpy()) != 0 for c in names], 0))
        self.starts = np.flatnonzero(new)
        point = column("kind", 0) == 1
        self.ends = np.append(self.starts[1:], rows.num_rows)
        self.middles = self.starts + np.add.reduceat((~point).astype(int), self.starts)
        self.px, self.py = column("px", 0.0), column("py", 0.0)
        self.left, self.bottom = column("cx", 0) * size, column("ky", 0) * size  # pieces with edges are single cells
        edges = rows.column("edges")
        self.sides = np.where(point, 0, pc.list_value_length(edges).fill_null(0).to_numpy(zero_copy_only=False))
        self.first = np.cumsum(self.sides) - self.sides
        flat = edges.flatten()
        self.edges = dict(zip([f.name for f in flat.type], (c.to_numpy(zero_copy_only=False) for c in flat.flatten()), strict=True))
        self.corner = column("full", False) | (column("corner", 0) == 1)

    def edge(self, at: np.ndarray) -> list[np.ndarray]:
        return [self.edges[c][at] for c in ("x1", "y1", "x2", "y2")]

    def crowded(self, s: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(points, pieces) of the hits of a square: each edge is tested against all points at once."""
        lo, mid, hi = self.starts[s], self.middles[s], self.ends[s]
        order = lo + np.argsort(-self.sides[lo:mid], kind="stable")
        sides, first, corner, left, bottom = self.sides[order], self.first[order], self.corner[order], self.left[lo], self.bottom[lo]
        step = max(1, PAIRS // len(order))
        for a in range(mid, hi, step):
            b = min(a + step, hi)
            px, py, inside = self.px[a:b], self.py[a:b], np.repeat(corner[:, None], b - a, 1)
            for e in range(sides[0]):
                n = int(np.searchsorted(-sides, -e, side="left"))
                inside[:n] ^= _flips(px, py, left, bottom, *[c[:, None] for c in self.edge(first[:n] + e)])
            piece, at = np.nonzero(inside)
            yield at + a, order[piece]

    def sparse(self, squares: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(points, pieces) of the hits of squares of few pairs, all at once."""
        n = (self.ends - self.middles)[squares]
        points = np.repeat(self.middles[squares], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first, count = (np.repeat(v[squares], n) for v in (self.starts, self.middles - self.starts))
        upto = np.cumsum(count)
        a = 0
        while a < len(points):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
            k = count[a:b]
            at = np.repeat(points[a:b], k)
            piece = np.repeat(first[a:b] - np.cumsum(k) + k, k) + np.arange(len(at))
            inside, sides = self.corner[piece], self.sides[piece]
            for e in range(sides.max(initial=0)):
                some = np.flatnonzero(sides > e)
                i, j = at[some], piece[some]
                inside[some] ^= _flips(self.px[i], self.py[i], self.left[j], self.bottom[j], *self.edge(self.first[j] + e))
            yield at[inside], piece[inside]
            a = b

    def hits(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        pairs = (self.middles - self.starts) * (self.ends - self.middles)
        for s in np.flatnonzero(pairs > CROWDED):
            yield from self.crowded(s)
        yield from self.sparse(np.flatnonzero((pairs > 0) & (pairs <= CROWDED)))


def points_in_areas(points: DataFrame, areas: DataFrame, rings: str, size: float, point_cols: Sequence[str], area_cols: Sequence[str]) -> DataFrame:
    """Pairs (point, area) with the point inside, by the even-odd rule; needs columns x, y of the points.

    Points meet pieces of the same (level, column, block). The pairs of every block are counted first: a block with many is
    cut into squares of SIDE points and pieces, and the number of tasks follows the pairs, whose bytes before the join tell
    nothing of them. A task streams its squares and tests each edge of a square against all its points at once.
    Points without coordinates are in no area; equal rows stay apart (rows equal in all columns share a square).
    """
    p = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    p = p.select(F.struct(*point_cols).alias("point"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"),
                 F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    both = _dealt(_with_blocks(p).drop("cy"), materialise(covering(areas, rings, size, area_cols)))
    names = [*[("point", c, f"__p{i}") for i, c in enumerate(point_cols)], *[("area", c, f"__a{i}") for i, c in enumerate(area_cols)]]
    given = both.select("level", "cx", "ky", "__i", "__j", "kind", "full", "corner", "edges", "px", "py", F.col("area.copies").cast("long").alias("__copies"),
                        *[F.col(side)[c].alias(n) for side, c, n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            block = _Block(rows, size)
            copies = rows.column("__copies").fill_null(1).to_numpy(zero_copy_only=False)
            # the pieces of the last square may have further points in the next batch
            last = int(block.starts[-1])
            held = rows.slice(last, int(block.middles[-1]) - last)
            for at, piece in block.hits():
                for a in range(0, len(at), ROWS_OUT):
                    i, j = at[a : a + ROWS_OUT], piece[a : a + ROWS_OUT]
                    if (many := copies[j]).max() > 1:
                        i, j = np.repeat(i, many), np.repeat(j, many)
                    side = {"point": pa.array(i), "area": pa.array(j)}
                    yield pa.RecordBatch.from_arrays([rows.column(n).take(side[s]) for s, _, n in names], [n for _, _, n in names])

    found = given.mapInArrow(run, T.StructType([T.StructField(n, given.schema[n].dataType) for _, _, n in names]))
    return found.select(*[F.col(n).alias(c) for _, c, n in names])


def covered_share(areas: DataFrame, rings: str, cells: DataFrame, size: float, per_side: int = 5, cell_id: str = "cell_id") -> DataFrame:
    """Share of each cell (cell_id, cx, cy) covered by the union of the areas, by per_side x per_side sample points; overlaps count once.

    Every piece gives a bit mask of its sample points; masks are combined before the shuffle, so a cell under any
    number of areas is no hot group.
    """
    n = per_side * per_side
    spots = F.col("spots")
    met = (_with_blocks(cells.select("cx", "cy").distinct()).join(covering(areas, rings, size), ["level", "cx", "ky"])
           .withColumn("spots", sub_points(size, per_side)))
    px, py = lambda s: F.col("cx") * size + s["dx"], lambda s: F.col("cy") * size + s["dy"]
    hit = met.withColumn("hit", F.transform(spots, lambda s: _inside(px(s), py(s), size).cast("bigint")))
    masks = []
    for i in range(0, n, BITS):
        bits = F.slice("hit", i + 1, min(BITS, n - i))
        masks.append(F.bit_or(F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))).alias(f"m{i}"))
    seen = hit.groupBy("cx", "cy").agg(*masks)
    count = sum((F.bit_count(f"m{i}") for i in range(0, n, BITS)), F.lit(0))
    seen = seen.select("cx", "cy", (count / float(n)).alias("cover"))
    return cells.select(cell_id, "cx", "cy").join(seen, ["cx", "cy"], "left").fillna(0.0, ["cover"]).select(cell_id, "cover")
