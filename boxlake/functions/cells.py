"""Grid cells that turn spatial predicates into equi-joins.

Two registrations are used:

* *tiers*: a few fixed cell sides. A box sits in the first tier in which it spans
  at most `SPAN` cells per axis, so its number of cells is bounded for boxes of
  any size up to `SPAN` times the largest side.
* *octaves*: cell sides are powers of two. A box sits in the octave that covers
  its longer side (at most 2x2 cells). Two boxes whose IoU exceeds t differ by at
  most `ceil(log2(1/t))` octaves, so registering that many octaves upward is enough
  for them to meet.

Cells come from plain `explode` steps, which stay inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.functions.geometry import Box, box, height, width

TIER_SIDES = (128.0, 1024.0, 8192.0)
SPAN = 4

# How two boxes of any sizes meet: in the tier of the larger one. The code tells in
# whose own tier the cell lies, so that boxes far below the tier are not compared.
BOTH, LEFT, RIGHT = 0, 1, 2


def cell(value: Column, side) -> Column:
    return F.floor(value / side)


def _explode_grid(df: DataFrame, columns: list[str], b: Box, side: Column) -> DataFrame:
    """`columns, cx, cy` for the cells of a given side a box covers."""
    xs = F.sequence(cell(b.x1, side), cell(b.x2, side))
    ys = F.sequence(cell(b.y1, side), cell(b.y2, side))
    return df.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys)).select(*columns, "cx", "cy")


def tier_of(b: Box) -> Column:
    longest = F.greatest(width(b), height(b))
    expr = F.lit(len(TIER_SIDES) - 1)
    for tier in range(len(TIER_SIDES) - 2, -1, -1):
        expr = F.when(longest <= SPAN * TIER_SIDES[tier], F.lit(tier)).otherwise(expr)
    return expr


def spread_boxes(df: DataFrame, prefix: str = "", meet: int | None = None) -> DataFrame:
    """One row per cell of the box in its own tier, as `tier, cx, cy`. With `meet`
    (`LEFT` or `RIGHT`, the role in a join of two box tables) also in larger tiers, and
    a column `meet` to join on."""
    b = box(prefix)
    boxed = df.filter(b.x1.isNotNull() & b.y1.isNotNull() & b.x2.isNotNull() & b.y2.isNotNull())

    def at(tier: int, code: int) -> Column:
        return F.struct(F.lit(tier).alias("tier"), F.lit(TIER_SIDES[tier]).alias("side"), F.lit(code).alias("meet"))

    def spots(own: int) -> Column:
        if meet is None:
            return F.array(at(own, BOTH))
        other = RIGHT if meet == LEFT else LEFT
        return F.array(at(own, BOTH), at(own, meet), *[at(t, other) for t in range(own + 1, len(TIER_SIDES))])

    own, last = tier_of(b), len(TIER_SIDES) - 1
    chosen = spots(last)
    for tier in range(last - 1, -1, -1):
        chosen = F.when(own == tier, spots(tier)).otherwise(chosen)
    placed = boxed.withColumn("_t", F.explode(chosen)).select(*df.columns, "_t.tier", "_t.side", "_t.meet")
    extra = ["tier"] if meet is None else ["tier", "meet"]
    return _explode_grid(placed, [*df.columns, *extra], b, F.col("side"))


def tiers_used(*tables: tuple[DataFrame, str]) -> list[int]:
    """Tiers the boxes of some tables fall into (`(table, prefix)`): at most one value
    per tier comes back. Most data uses one tier, which saves registering in others."""
    found: set[int] = set()
    for df, prefix in tables:
        b = box(prefix)
        known = df.filter(b.x1.isNotNull() & b.y1.isNotNull() & b.x2.isNotNull() & b.y2.isNotNull())
        rows = known.select(tier_of(b).alias("tier")).distinct().collect()
        found |= {r.tier for r in rows}
    return sorted(found)


def spread_points(df: DataFrame, x: str, y: str, tiers: list[int] | None = None) -> DataFrame:
    """One row with the cell of a point per tier (of those given)."""
    wanted = range(len(TIER_SIDES)) if tiers is None else (tiers or [0])
    spots = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(TIER_SIDES[t]).alias("side")) for t in wanted])
    return df.withColumn("_t", F.explode(spots)).select(
        *df.columns, "_t.tier", cell(F.col(x), F.col("_t.side")).alias("cx"), cell(F.col(y), F.col("_t.side")).alias("cy")
    )


def octave_of(b: Box) -> Column:
    return F.ceil(F.log2(F.greatest(width(b), height(b)))).cast("int")


def octaves_apart(threshold: float) -> int:
    return max(0, math.ceil(math.log2(1.0 / threshold)))


def spread_octaves(df: DataFrame, threshold: float) -> DataFrame:
    """Cells of a box (`octave` given) in its own octave (`own`) and in those of any box
    that could exceed the IoU threshold with it, as `tier, cx, cy, own`."""
    octave = F.col("octave")
    steps = df.withColumn("tier", F.explode(F.sequence(octave, octave + octaves_apart(threshold))))
    placed = _explode_grid(steps, [*df.columns, "tier"], box(), F.pow(F.lit(2.0), F.col("tier")))
    return placed.withColumn("own", F.col("tier") == octave)


def spread_around(df: DataFrame, x: str, y: str, radius: float, side: float) -> DataFrame:
    """Cells that hold anything within the radius of a point, as `cx, cy`."""
    px, py = F.col(x), F.col(y)
    around = Box(px - radius, py - radius, px + radius, py + radius)
    return _explode_grid(df, df.columns, around, F.lit(side))
