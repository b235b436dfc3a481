"""Points in boxes on a tree of cells, for crowded places and boxes of any size.

A box sits in the tier that suits its longer side (cell sides are powers of `BASE`, without
end), in at most `SPAN` + 1 cells per axis; a point sits in one cell of each tier that the
boxes of its group occupy. Cells where too many pairs would meet are split into `SPLIT` x
`SPLIT` parts, again and again, each only where it is needed. A box that covers a part
whole isn't taken further down: it holds every point of the part.

* `touched` asks whether a point lies in any box. Parts covered by a box are settled at
  once, and boxes that cross a part alike and leave out a strip along the same side count
  as the widest of them, so that only corners and thin boxes lead further down.
* `inside` gives all pairs. Cells whose pairs are all true ones, or that can't be split
  any further, are dealt out to several tasks by splitting their points.

Places within a cell are compared as numbers 0 to `SPLIT` - 1 along each axis that come
from the coordinate by the same monotone expression for points and for box edges, so
rounding can't part a point from a box that holds it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.functions.geometry import Box
from boxlake.session import cut_lineage

BASE, SPAN = 2, 1
SPLIT = 4
# Pairs of one cell that are compared as they are, and that one task takes of a cell.
PAIR_LIMIT = 1_000_000
# Splits of a cell: its parts are then 2^-40 of its side, at the limit of the numbers.
MAX_DEPTH = 20

# Of a box that another must hold: the points looked at grow with its inverse squared.
LEAST_SHARE = 0.02

EDGES = ("bx1", "by1", "bx2", "by2")
CELL = ["_tier", "_cx", "_cy", "_path"]
WALLS = ["_l", "_r", "_t", "_b"]  # whether a box goes on beyond that side of its cell


def tier(longest: Column) -> Column:
    """The tier of a box by its longer side."""
    return F.greatest(F.ceil(F.log(F.greatest(longest, F.lit(1.0)) / SPAN) / F.log(F.lit(float(BASE)))), F.lit(0)).cast("int")


def _side(t: Column) -> Column:
    return F.pow(F.lit(float(BASE)), t)


def _place(value: Column, side: Column) -> Column:
    return F.floor(value / side)


def _longest() -> Column:
    return F.greatest(F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1"))


def _spread_boxes(boxes: DataFrame) -> DataFrame:
    """A row for each cell of each box, with the walls that the box crosses."""
    known = boxes.filter(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in EDGES) + " AND bx1 <= bx2 AND by1 <= by2")
    placed = known.withColumn("_tier", tier(_longest())).withColumn("_side", _side(F.col("_tier")))
    x1, y1, x2, y2 = (_place(F.col(c), F.col("_side")) for c in EDGES)
    placed = placed.withColumn("_cx", F.explode(F.sequence(x1, x2))).withColumn("_cy", F.explode(F.sequence(y1, y2)))
    walls = {"_l": x1 < F.col("_cx"), "_r": x2 > F.col("_cx"), "_t": y1 < F.col("_cy"), "_b": y2 > F.col("_cy")}
    return placed.withColumns({**walls, "_path": F.lit("")}).drop("_side")


def _spread_points(points: DataFrame, boxes: DataFrame, keys: list[str], tiers: tuple[str, str] | None) -> DataFrame:
    """A row for each tier that boxes of the point's group occupy (between the columns
    `tiers`, if given)."""
    used = boxes.groupBy(*keys).agg(F.collect_set("_tier").alias("_tiers"))
    met = points.filter("px IS NOT NULL AND py IS NOT NULL AND NOT isnan(px) AND NOT isnan(py)").join(used, keys)
    met = met.select(*points.columns, F.explode("_tiers").alias("_tier"))
    if tiers:
        met = met.filter(F.col("_tier").between(F.col(tiers[0]), F.col(tiers[1])))
    side = _side(F.col("_tier"))
    return met.withColumns({"_cx": _place(F.col("px"), side), "_cy": _place(F.col("py"), side), "_path": F.lit("")})


def _part(value: Column, c: str, side: Column) -> Column:
    """Which part of its cell a coordinate lies in, along one axis."""
    low = F.col(c) * _side(F.col("_tier")) + F.col(f"{c}_in")
    return F.greatest(F.lit(0), F.least(F.lit(SPLIT - 1), F.floor((value - low) / (side / SPLIT)))).cast("int")


def _within(df: DataFrame, depth: int) -> tuple[DataFrame, Column]:
    """`df` with the cell's own corner, relative to its first cell (`_cx_in, _cy_in`), and the
    side of cells at this depth."""
    side = _side(F.col("_tier")) / SPLIT**depth
    for axis, c in ((0, "_cx"), (1, "_cy")):
        inner = F.lit(0.0)
        for k in range(depth):
            digit = F.substring("_path", 2 * k + 1 + axis, 1).cast("int")
            inner = inner + digit * (_side(F.col("_tier")) / SPLIT ** (k + 1))
        df = df.withColumn(f"{c}_in", inner)
    return df, side


def _split_points(points: DataFrame, depth: int) -> DataFrame:
    columns = points.columns
    points, side = _within(points, depth)
    ix, iy = _part(F.col("px"), "_cx", side), _part(F.col("py"), "_cy", side)
    return points.withColumn("_path", F.concat("_path", ix.cast("string"), iy.cast("string"))).select(*columns)


def _split_boxes(boxes: DataFrame, depth: int) -> DataFrame:
    columns = boxes.columns
    boxes, side = _within(boxes, depth)
    ranges = {
        "_ix1": F.when(F.col("_l"), -1).otherwise(_part(F.col("bx1"), "_cx", side)),
        "_ix2": F.when(F.col("_r"), SPLIT).otherwise(_part(F.col("bx2"), "_cx", side)),
        "_iy1": F.when(F.col("_t"), -1).otherwise(_part(F.col("by1"), "_cy", side)),
        "_iy2": F.when(F.col("_b"), SPLIT).otherwise(_part(F.col("by2"), "_cy", side)),
    }
    boxes = boxes.withColumns(ranges)
    last = F.lit(SPLIT - 1)
    for axis in ("_ix", "_iy"):
        steps = F.sequence(F.greatest(F.col(f"{axis}1"), F.lit(0)), F.least(F.col(f"{axis}2"), last))
        boxes = boxes.withColumn(axis, F.explode(steps))
    walls = {"_l": F.col("_ix1") < F.col("_ix"), "_r": F.col("_ix2") > F.col("_ix"), "_t": F.col("_iy1") < F.col("_iy"), "_b": F.col("_iy2") > F.col("_iy")}
    path = F.concat("_path", F.col("_ix").cast("string"), F.col("_iy").cast("string"))
    return boxes.withColumns({**walls, "_path": path}).select(*columns)


def _covers() -> Column:
    return reduce(lambda a, b: a & b, [F.col(w) for w in WALLS])


def _census(points: DataFrame, boxes: DataFrame, at: list[str]) -> DataFrame:
    """Points, boxes and covering boxes of each cell that has both."""
    n = points.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    m = boxes.groupBy(*at).agg(F.count(F.lit(1)).alias("_m"), F.count_if(_covers()).alias("_full"))
    return n.join(m, at)


def _holds() -> Column:
    px, py = F.col("px"), F.col("py")
    return (F.col("bx1") <= px) & (px <= F.col("bx2")) & (F.col("by1") <= py) & (py <= F.col("by2"))


def _widest(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Of boxes that cross a cell the same way, leaving out at most a strip along one side,
    the box around them all; of others, the different ones."""
    crossed = reduce(lambda a, b: a + b, [F.col(w).cast("int") for w in WALLS])
    at = [*keys, *CELL, *WALLS]
    wide = boxes.filter(crossed >= len(WALLS) - 1).groupBy(*at).agg(
        *[(F.min if c.endswith("1") else F.max)(c).alias(c) for c in EDGES]
    )
    return boxes.filter(crossed < len(WALLS) - 1).select(*at, *EDGES).distinct().unionByName(wide)


def touched(points: DataFrame, boxes: DataFrame, keys: Sequence[str], pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """The different `keys, px, py` of `points` that lie in any box (`keys, bx1, by1, bx2,
    by2`, edges included) of their group. Boxes with a null, a NaN or turned edges hold
    nothing; a null key belongs to no group."""
    keys = list(keys)
    at, mine = [*keys, *CELL], [*keys, "px", "py"]
    spread = _spread_boxes(boxes.select(*keys, *EDGES).distinct())
    live = cut_lineage(_spread_points(points.select(*mine).distinct(), spread, keys, None))
    area = cut_lineage(spread.select(*at, *WALLS, *EDGES))
    found: list[DataFrame] = []
    for depth in range(MAX_DEPTH + 1):
        cells = cut_lineage(_census(live, area, at).filter((F.col("_full") > 0) | (F.col("_n") * F.col("_m") > pair_limit)))
        last = depth == MAX_DEPTH
        open_ = cells.filter("_full = 0").select(*at)
        if last or not open_.limit(1).count():
            open_ = None
        if not cells.limit(1).count():  # nothing stands out: the ordinary case
            found.append(live.join(area, at).filter(_holds()).select(*mine))
            break
        found.append(live.join(cells.filter("_full > 0").select(*at), at, "left_semi").select(*mine))
        plain = cells.filter("_full > 0").select(*at) if open_ is None else cells.select(*at)
        found.append(live.join(plain, at, "left_anti").join(area, at).filter(_holds()).select(*mine))
        if open_ is None:
            break
        live = cut_lineage(_split_points(live.join(open_, at, "left_semi").select(*live.columns), depth))
        area = cut_lineage(_widest(_split_boxes(area.join(open_, at, "left_semi").select(*area.columns), depth), keys))
    return reduce(DataFrame.unionByName, found).distinct()


def _dealt(live: DataFrame, area: DataFrame, cells: DataFrame, at: list[str], pair_limit: int) -> DataFrame:
    """All pairs of the cells `cells` (`_n, _m`); those of a crowded one go to several tasks."""
    shares = F.greatest(F.lit(1), F.ceil(F.col("_n") * F.col("_m") / pair_limit)).cast("int")
    cells = cells.select(*at, F.least(shares, F.col("_n").cast("int")).alias("_shares"))
    own = live.join(cells, at).withColumn("_share", F.pmod(F.xxhash64(*live.columns), F.col("_shares")).cast("int"))
    held = area.join(cells, at).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    return own.drop("_shares").join(held.drop("_shares"), [*at, "_share"]).drop("_share")


def inside(
    points: DataFrame,
    boxes: DataFrame,
    keys: Sequence[str],
    tiers: tuple[str, str] | None = None,
    pair_limit: int = PAIR_LIMIT,
) -> DataFrame:
    """Each point (`keys, px, py` and more) with each box (`keys, bx1, by1, bx2, by2` and more)
    of its group that holds it, edges included: all columns of both, once for each pair of
    rows. `tiers` names two columns of the points, the least and the greatest tier of boxes
    they look at. Null, NaN and turned edges hold nothing."""
    keys = list(keys)
    at = [*keys, *CELL]
    out = [*points.columns, *[c for c in boxes.columns if c not in keys]]
    spread = _spread_boxes(boxes)
    live = cut_lineage(_spread_points(points, spread, keys, tiers))
    area = cut_lineage(spread)
    found: list[DataFrame] = []
    for depth in range(MAX_DEPTH + 1):
        cells = cut_lineage(_census(live, area, at))
        partial = F.col("_m") - F.col("_full")
        open_ = cells.filter((F.col("_n") * partial > pair_limit) & (F.col("_n") > 1))
        last = depth == MAX_DEPTH or not open_.limit(1).count()
        if last:
            found.append(_dealt(live, area, cells, at, pair_limit))
            break
        # covering boxes of an open cell are settled here, the others go down
        closed = cells.join(open_.select(*at), at, "left_anti")
        covered = open_.filter("_full > 0").select(*at, "_n", F.col("_full").alias("_m"))
        found.append(_dealt(live, area, closed, at, pair_limit))
        found.append(_dealt(live, area.filter(_covers()), covered, at, pair_limit))
        open_ = open_.select(*at)
        live = cut_lineage(_split_points(live.join(open_, at, "left_semi").select(*live.columns), depth))
        area = area.filter(~_covers()).join(open_, at, "left_semi").select(*area.columns)
        area = cut_lineage(_split_boxes(area, depth))
    return reduce(DataFrame.unionByName, [f.filter(_holds()).select(*out) for f in found])


def slightly_larger(b: Box) -> list[Column]:
    """The edges of a box as `bx1, by1, bx2, by2`, moved out by more than rounding can."""
    far = F.greatest(*[F.abs(c) for c in b]) * 1e-12
    return [c.alias(n) for n, c in zip(EDGES, (b.x1 - far, b.y1 - far, b.x2 + far, b.y2 + far))]


def lattice(b: Box, share: float) -> tuple[Column, int]:
    """Points of a box, as an array of `px, py, i, j`, one of which lies in any box that holds
    more than `share` of it; and their number along each axis."""
    if share < LEAST_SHARE:
        raise ValueError(f"shares below {LEAST_SHARE} are not supported")
    n = 1
    while 1.0 / (n + 1) > share:
        n += 1
    points = []
    for i in range(1, n + 1):
        for j in range(1, n + 1):
            x = b.x1 + (b.x2 - b.x1) * (i / (n + 1))
            y = b.y1 + (b.y2 - b.y1) * (j / (n + 1))
            points.append(F.struct(x.alias("px"), y.alias("py"), F.lit(i).alias("i"), F.lit(j).alias("j")))
    return F.array(*points), n
