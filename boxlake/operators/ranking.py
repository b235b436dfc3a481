"""Ordinals within groups that stay parallel when one group is huge."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows one task may sort for one group before the group is split.
HOT_GROUP = 1_000_000


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys of the groups with more than `limit` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).drop("_n")


class Falling(NamedTuple):
    """A column that an order goes down by, nulls last."""

    column: Column


def same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def _not_after(cut: Column, row: list[Column], falling: list[bool]) -> Column:
    """Whether a sampled row comes before a row, or ties with it, in the order."""
    out = F.lit(True)
    for i in reversed(range(len(row))):
        a, b = cut[f"o{i}"], row[i]
        first = (a > b) | (a.isNotNull() & b.isNull()) if falling[i] else (a < b) | (a.isNull() & b.isNotNull())
        out = F.coalesce(first, F.lit(False)) | (a.eqNullSafe(b) & out)
    return out


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | Falling],
    name: str,
    hot: int = HOT_GROUP,
    draw: Sequence[str] | None = None,
) -> DataFrame:
    """`row_number()` within `keys`. Groups are cut in ranges of about `hot` rows: about one
    row in `hot`, by the hash of its keys and place, is a cut, and a row's range is the
    number of cuts of its group up to it. Ranges are numbered one by one and shifted by the
    sizes of those before. Everything is decided inside the plan, for groups of any size
    alike. Cuts and the sizes of ranges are broadcast: they are a `hot`-th of the rows. An order given as sorted
    columns (`.desc()`) can't be cut; its groups are numbered whole. Where place is costly to
    make, `draw` names cheap columns of `df`, with many values, that are hashed instead."""
    keys = list(keys)
    plain = [o.column if isinstance(o, Falling) else o for o in order]
    falling = [isinstance(o, Falling) for o in order]
    sort = [c.desc() if f else c for c, f in zip(plain, falling)]
    if any(re.search(r"(ASC|DESC) NULLS (FIRST|LAST)'>$", repr(c)) for c in plain):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*sort)).cast("long"))
    drawn = df.filter(F.pmod(F.xxhash64(*(draw or [*keys, *plain])), F.lit(max(1, hot))) == 0)
    spot = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(plain)])
    cuts = drawn.groupBy(*keys).agg(F.collect_set(spot).alias("_cuts"))
    cuts = cuts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_cuts")

    def in_group(left: DataFrame, right: DataFrame) -> Column:
        cond = F.lit(True)
        for i, k in enumerate(keys):
            cond = cond & left[k].eqNullSafe(right[f"_k{i}"])
        return cond

    before = F.size(F.filter("_cuts", lambda cut: _not_after(cut, plain, falling)))
    placed = df.join(F.broadcast(cuts), in_group(df, cuts), "left")
    placed = placed.select(*df.columns, F.coalesce(F.when(F.col("_cuts").isNotNull(), before), F.lit(0)).alias("_range"))
    local = placed.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*sort)))
    # Only groups with cuts have more than one range, so sizes are counted for these alone:
    # a few rows, before and beside the one shuffle of whole rows.
    cut_groups = df.join(F.broadcast(cuts), in_group(df, cuts))
    sizes = cut_groups.groupBy(*[F.col(f"_k{i}") for i in range(len(keys))], before.alias("_r")).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.sum("_size").over(earlier)).drop("_size")
    found = local.join(F.broadcast(offsets), in_group(local, offsets) & (F.col("_range") == F.col("_r")), "left")
    return found.select(*df.columns, (F.col("_local") + F.coalesce("_offset", F.lit(0))).alias(name))


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first `n` rows of each group. Spark prunes to `n` rows per group and task
    before the shuffle, so a hot group does not reach one task whole."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).filter(F.col("_rn") <= n).drop("_rn")
