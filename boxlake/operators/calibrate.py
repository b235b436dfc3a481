"""Alignment of texts with their symbols: offsets, diagnosis, correction.

Input rows are texts with their symbol expanded (`sym_x1, sym_y1`) and, for the
tile-based correction, the tile position of the symbol (`row`, `col`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxlake.functions import geometry as G
from boxlake.session import cut_lineage

# Offsets beyond these, or a spread beyond this share of the mean,
# mean that texts are misplaced.
MAX_MEAN_X = 1000.0
MAX_MEAN_Y = 500.0
MAX_VARIATION = 0.5

# Approximate quantiles are off by at most a row in so many; the band leaves ten times that.
QUANTILE_ACCURACY = 10_000
MARGIN = 10.0


def offsets(texts: DataFrame) -> DataFrame:
    """Texts that have a symbol, with the offset of their corners from it."""
    return texts.withColumns(
        {"off_x": F.col("x1") - F.col("sym_x1"), "off_y": F.col("y1") - F.col("sym_y1")}
    ).filter(F.col("off_x").isNotNull() & F.col("off_y").isNotNull())


def offset_statistics(
    texts: DataFrame, keys: Sequence[str] = ("doc",), hot: int = QUANTILE_ACCURACY
) -> DataFrame:
    """Mean, population deviation, range and exact median of the offsets, and
    whether they call for a correction.

    The offsets are written once and read twice: first for everything but the medians, with
    approximate quantiles just below and above each, whose error is bounded; then the values
    between these two are counted one by one, which gives the exact median. Only that band
    of a group's different values, about 20 in `hot`, is ever ordered."""
    keys = list(keys)
    off = cut_lineage(offsets(texts).select(*keys, "off_x", "off_y"))
    basic = [F.count(F.lit(1)).alias("sample_count")]
    bands = []
    for axis in ("x", "y"):
        c = F.col(f"off_{axis}")
        basic += [
            F.avg(c).alias(f"mean_{axis}"),
            F.stddev_pop(c).alias(f"std_{axis}"),
            F.min(c).alias(f"min_{axis}"),
            F.max(c).alias(f"max_{axis}"),
        ]
        around = [max(0.0, 0.5 - MARGIN / hot), min(1.0, 0.5 + MARGIN / hot)]
        bands.append(F.percentile_approx(c, around, hot).alias(f"_band_{axis}"))
    stats = cut_lineage(off.groupBy(*keys).agg(*basic, *bands))

    # One row for each offset and axis; values below the band count together.
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"o.{k}").eqNullSafe(F.col(f"s.{k}"))
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"off_{a}").alias("v"), F.col(f"_band_{a}").alias("band")) for a in ("x", "y")])
    values = off.alias("o").join(stats.alias("s"), on).select(*[f"o.{k}" for k in keys], "sample_count", F.explode(axes).alias("a"))
    values = values.filter("a.v <= a.band[1]").select(*keys, "sample_count", "a.axis", F.when(F.expr("a.v >= a.band[0]"), F.col("a.v")).alias("v"))
    counts = values.groupBy(*keys, "axis", "v").agg(F.count(F.lit(1)).alias("n"), F.first("sample_count").alias("all"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "axis").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto)
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1

    def at(rank):
        return F.max(F.when((F.col("upto") - F.col("n") < rank) & (rank <= F.col("upto")), F.col("v")))

    middle = placed.groupBy(*keys, "axis").agg(((at(low) + at(high)) / 2).alias("m"))
    medians = middle.groupBy(*keys).agg(*[F.max(F.when(F.col("axis") == a, F.col("m"))).alias(f"median_{a}") for a in ("x", "y")])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"s.{k}").eqNullSafe(F.col(f"m.{k}"))
    stats = stats.alias("s").join(medians.alias("m"), on)
    stats = stats.select(*[f"s.{k}" for k in keys], *[c for c in stats.columns if c not in keys and c[0] != "_"])

    def variation(axis):
        return F.col(f"std_{axis}") / (F.abs(f"mean_{axis}") + 1e-6)

    return stats.withColumn(
        "correction_needed",
        (F.abs("mean_x") > MAX_MEAN_X)
        | (F.abs("mean_y") > MAX_MEAN_Y)
        | (variation("x") > MAX_VARIATION)
        | (variation("y") > MAX_VARIATION),
    )


def tile_offsets(texts: DataFrame, by_page: bool = True) -> DataFrame:
    """Mean offset and number of texts per tile position of the symbol."""
    keys = ["doc", "page", "row", "col"] if by_page else ["doc", "row", "col"]
    placed = offsets(texts).filter(F.col("row").isNotNull() & F.col("col").isNotNull())
    return placed.groupBy(*keys).agg(
        F.avg("off_x").alias("avg_off_x"), F.avg("off_y").alias("avg_off_y"), F.count(F.lit(1)).alias("n")
    )


def corrections(statistics: DataFrame, tiles: DataFrame) -> DataFrame:
    """Per document: `none`, `tile` (some text has a tile position) or `offset`."""
    placed = tiles.select("doc").distinct().withColumn("_tiled", F.lit(True))
    kind = (
        F.when(~F.col("correction_needed"), "none").when(F.col("_tiled"), "tile").otherwise("offset")
    )
    return statistics.join(placed, "doc", "left").select("doc", kind.alias("correction"), "mean_x", "mean_y")


def corrected(texts: DataFrame, chosen: DataFrame, tiles: DataFrame, by_page: bool = True) -> DataFrame:
    """Texts with the mean offset of their document or tile taken off. Rows without
    a tile position keep their box under a tile correction."""
    keys = ["doc", "page", "row", "col"] if by_page else ["doc", "row", "col"]
    joined = texts.join(chosen, "doc", "left").join(
        tiles.select(*keys, F.col("avg_off_x").alias("_tx"), F.col("avg_off_y").alias("_ty")), keys, "left"
    )
    kind = F.col("correction")

    def by(mean, tile):
        moved = F.when(kind == "offset", -F.col(mean)).when(kind == "tile", -F.col(tile))
        return F.coalesce(moved, F.lit(0.0))

    box = G.shift(G.box(), by("mean_x", "_tx"), by("mean_y", "_ty"))
    out = joined.withColumns(G.as_columns(box)).withColumn("correction", F.coalesce(kind, F.lit("none")))
    return out.select(*texts.columns, "correction")


def calibrate(texts: DataFrame, by_page: bool = True, hot: int = QUANTILE_ACCURACY) -> tuple[DataFrame, DataFrame]:
    """Diagnose and correct: `(corrected texts, statistics with the choice)`. Offsets and choices
    are written: they are read again, and texts needn't be shuffled to meet small ones."""
    statistics = offset_statistics(texts, hot=hot)
    tiles = cut_lineage(tile_offsets(texts, by_page))
    chosen = cut_lineage(corrections(statistics, tiles))
    return corrected(texts, chosen, tiles, by_page), statistics.join(chosen.select("doc", "correction"), "doc")
