"""Text boxes relative to their symbol, and symbol layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.functions import geometry as G

RELATIVE = "relative_to_symbol"
ABSOLUTE = "absolute"


def _percent(value: Column, size: Column) -> Column:
    return F.when(size > 0, F.try_divide(value, size) * 100).otherwise(0.0)


def to_relative(texts: DataFrame) -> DataFrame:
    """Move boxes of associated texts (`sym_x1..sym_y2`) into the frame of the symbol.
    The page box stays as `abs_*`; other texts are left as they are."""
    b, s = G.box(), G.box("sym_")
    known = G.has_box(s) & G.has_box(b)
    rel = G.shift(b, -s.x1, -s.y1)
    w, h = G.width(s), G.height(s)

    def only(c):
        return F.when(known, c)

    extra = {f"abs_{n}": only(c) for n, c in G.as_columns(b).items()}
    extra |= {"symbol_width": only(w), "symbol_height": only(h)}
    sizes = {"x1": w, "y1": h, "x2": w, "y2": h}
    extra |= {f"{n}_percent": only(_percent(c, sizes[n])) for n, c in G.as_columns(rel).items()}
    extra |= {n: F.when(known, c).otherwise(F.col(n)) for n, c in G.as_columns(rel).items()}
    extra["coordinate_system"] = F.when(known, RELATIVE).otherwise(ABSOLUTE)
    return texts.withColumns(extra)


def to_absolute(texts: DataFrame) -> DataFrame:
    """Undo `to_relative` for rows marked relative; their relative box becomes
    `rel_*`."""
    b, s = G.box(), G.box("sym_")
    known = (F.col("coordinate_system") == RELATIVE) & G.has_box(s)
    extra = {f"rel_{n}": F.when(known, c) for n, c in G.as_columns(b).items()}
    moved = G.shift(b, s.x1, s.y1)
    extra |= {n: F.when(known, c).otherwise(F.col(n)) for n, c in G.as_columns(moved).items()}
    extra["coordinate_system"] = F.when(known, ABSOLUTE).otherwise(F.col("coordinate_system"))
    return texts.withColumns(extra)


def relative_counts(texts: DataFrame) -> DataFrame:
    return texts.groupBy("doc").agg(
        F.count(F.lit(1)).alias("total_regions"),
        F.count_if(F.col("coordinate_system") == RELATIVE).alias("regions_with_relative_coords"),
    )


def anchor(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Place relative texts on other symbol boxes. `symbols` carries the key of the
    text's symbol (`doc, page, sym_idx`) and the box to place them on (`to_*`)."""
    b = G.box()
    placed = texts.filter(F.col("coordinate_system") == RELATIVE).join(
        symbols.select("doc", "page", "sym_idx", *[f"to_{n}" for n in G.Box._fields]), ["doc", "page", "sym_idx"]
    )
    moved = G.shift(b, F.col("to_x1"), F.col("to_y1"))
    return placed.withColumns(G.as_columns(moved, "abs_"))


def layout_key(class_name: Column, tile: Column) -> Column:
    unknown = F.lit("unknown")
    return F.concat_ws("_", F.coalesce(class_name, unknown), F.coalesce(tile, unknown))


def layout_symbols(texts: DataFrame) -> DataFrame:
    """One row per class and tile: number of texts, and the symbol of the first text
    as representative. Needs `sym_class_name`, `sym_tile` and the symbol box."""
    linked = texts.filter(F.col("sym_idx").isNotNull())
    order = F.struct("page", "text_idx")
    first = F.min_by(F.struct("sym_idx", *[f"sym_{n}" for n in G.Box._fields]), order)
    return (
        linked.groupBy("doc", layout_key(F.col("sym_class_name"), F.col("sym_tile")).alias("symbol_id"))
        .agg(F.count(F.lit(1)).alias("text_count"), first.alias("_s"))
        .select("doc", "symbol_id", "text_count", "_s.*")
    )


def layout_texts(texts: DataFrame) -> DataFrame:
    """The texts of each layout entry, one row each, ordered by `page, text_idx`."""
    return texts.filter(F.col("sym_idx").isNotNull()).withColumn(
        "symbol_id", layout_key(F.col("sym_class_name"), F.col("sym_tile"))
    )
