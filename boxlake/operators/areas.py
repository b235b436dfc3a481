"""Output regions, areas, sequences and tag rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.functions import geometry as G
from boxlake.functions import text as T
from boxlake.operators.ranking import HOT_GROUP, numbered
from boxlake.session import cut_lineage

# Texts of one row of the tag list.
PART_TEXTS = 10_000

# Area type by symbol class; other classes are "symbol".
AREA_TYPES = {
    "resistor": "component",
    "capacitor": "component",
    "inductor": "component",
    "diode": "component",
    "connector": "connection",
    "terminal": "connection",
    "label": "label",
    "text": "label",
}
# Fixed value: confidence written for every tag row.
TAG_CONFIDENCE = 0.95
TAG_AREA = "area_Tag-ID_"
CELL = 100.0


def area_type(class_name: Column, types: Mapping[str, str] = AREA_TYPES) -> Column:
    """`text` without a class, `symbol` for classes not listed."""
    expr = F.when(class_name.isNull(), "text")
    for kind in dict.fromkeys(types.values()):
        expr = expr.when(class_name.isin(*[c for c, k in types.items() if k == kind]), kind)
    return expr.otherwise("symbol")


def area_id(label: Column, x: Column, y: Column, size: float = CELL) -> Column:
    place = [T.padded(F.floor(c / size)) for c in (x, y)]
    return F.concat_ws("_", F.lit("area"), F.coalesce(label, F.lit("null")), *place)


def regions(
    texts: DataFrame, types: Mapping[str, str] = AREA_TYPES, signed: bool = False
) -> DataFrame:
    """Output rows from texts with their symbol expanded (`sym_class_name, sym_x1,
    sym_y1`). Boxes become corner and size; `signed` keeps the corner and signs of
    the source. Blank texts are dropped."""
    b = G.box()
    linked = F.col("sym_idx").isNotNull()
    label = F.when(linked, F.coalesce("sym_class_name", F.lit("unknown")))
    zero = F.lit(0.0)
    corner_x = F.when(linked, F.coalesce("sym_x1", zero)).otherwise(F.coalesce("x1", zero))
    corner_y = F.when(linked, F.coalesce("sym_y1", zero)).otherwise(F.coalesce("y1", zero))
    w, h = G.width(b), G.height(b)
    x, y = (b.x1, b.y1) if signed else (F.least(b.x1, b.x2), F.least(b.y1, b.y2))
    return (
        texts.withColumn("text_content", T.strip(F.col("text")))
        .filter(F.length("text_content") > 0)
        .select(
            F.col("doc").alias("document"),
            "page",
            area_id(F.coalesce(label, F.lit("text")), corner_x, corner_y).alias("area_id"),
            area_type(label, types).alias("area_type"),
            "text_content",
            F.coalesce("confidence", zero).alias("confidence"),
            F.coalesce(x, zero).alias("x"),
            F.coalesce(y, zero).alias("y"),
            F.coalesce(w if signed else F.abs(w), zero).alias("width"),
            F.coalesce(h if signed else F.abs(h), zero).alias("height"),
            F.coalesce("source", F.lit("ocr")).alias("source"),
            "text_idx",
        )
    )


def _keys(by_page: bool) -> list[str]:
    return ["document", "page", "area_id"] if by_page else ["document", "area_id"]


def _order(alphanumeric: bool) -> list[Column]:
    tail = [F.col("page"), F.col("text_idx")]
    if not alphanumeric:
        return tail
    return [*T.alphanumeric_order(F.col("text_content"), F.col("x"), F.col("y")), *tail]


def sequenced(
    rows: DataFrame,
    alphanumeric: bool = True,
    grouping: bool = True,
    by_page: bool = True,
    hot: int = HOT_GROUP,
) -> DataFrame:
    """Numbers rows within their area as `sequence` (three digits at least). Without
    `grouping` all rows of a document form one group. The rows are written first: numbering
    reads them three times, and making them costs more than that."""
    keys = _keys(by_page) if grouping else ["document"]
    out = numbered(cut_lineage(rows), keys, _order(alphanumeric), "_seq", hot, draw=["document", "page", "text_idx"])
    return out.withColumn("sequence", T.padded(F.col("_seq"))).drop("_seq")


def area_groups(rows: DataFrame, by_page: bool = True) -> DataFrame:
    """Areas with their size, in first-seen order of their texts (`first_text`)."""
    return rows.groupBy(*_keys(by_page), "area_type").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "text_idx"))["text_idx"].alias("first_text")
    )


def tag_rows(rows: DataFrame, by_page: bool = True, alphanumeric: bool = True, part_texts: int = PART_TEXTS) -> DataFrame:
    """Tag areas as rows: the texts joined by spaces from top to bottom, and the box around
    them. An area's texts are cut every `part_texts`, whatever its size: one of more texts
    comes as several rows, each with its own box, in the order of their boxes' tops."""
    keys = _keys(by_page)
    tags = rows.filter(F.col("area_id").startswith(TAG_AREA))
    place = [F.col("y"), F.col("x"), *_order(alphanumeric)]
    kept = ["page", "x", "y", "width", "height", "text_content", "text_idx", *[k for k in keys if k != "page"]]
    placed = numbered(cut_lineage(tags.select(*kept)), keys, place, "_n", draw=["document", "page", "text_idx"])
    b = G.Box(F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("_n", "text_content"))), lambda s: s["text_content"])
    first_page = [] if by_page else [F.min_by("page", "_n").alias("page")]
    out = placed.groupBy(*keys, F.expr(f"(_n - 1) div {part_texts}").alias("_part")).agg(
        F.array_join(words, " ").alias("tag_text"),
        F.min(b.x1).alias("bbox_x1"),
        F.min(b.y1).alias("bbox_y1"),
        F.max(b.x2).alias("bbox_x2"),
        F.max(b.y2).alias("bbox_y2"),
        *first_page,
    )
    return out.select(
        "document", "page", "area_id", "tag_text",
        "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2",
        (F.col("bbox_x2") - F.col("bbox_x1")).alias("bbox_width"),
        (F.col("bbox_y2") - F.col("bbox_y1")).alias("bbox_height"),
        F.lit(TAG_CONFIDENCE).alias("confidence"),
    )


def region_summary(rows: DataFrame) -> DataFrame:
    """Counts by document, area, area type and source, and in total, as `dimension,
    value, n`."""
    dims = {"documents": "document", "areas": "area_id", "area_types": "area_type", "sources": "source"}
    cube = rows.select(*[F.col(c).cast("string").alias(c) for c in dims.values()]).groupingSets(
        [*[[F.col(c)] for c in dims.values()], []], *[F.col(c) for c in dims.values()]
    ).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    # bit i of the grouping id is set when that column is rolled up
    flags = {0b1111: "total", 0b0111: "documents", 0b1011: "areas", 0b1101: "area_types", 0b1110: "sources"}
    dimension = F.lit(None).cast("string")
    for bits, name in flags.items():
        dimension = F.when(F.col("_g") == bits, name).otherwise(dimension)
    return cube.select(dimension.alias("dimension"), F.coalesce(*dims.values()).alias("value"), "n")


def grid_areas(texts: DataFrame, size: float = CELL, keys: Sequence[str] = ("doc", "page")) -> DataFrame:
    """Cells of a regular grid that hold texts, with their number."""
    gx, gy = F.floor(F.col("x1") / size), F.floor(F.col("y1") / size)
    grouped = texts.filter(G.has_box(G.box())).groupBy(*keys, gx.alias("grid_x"), gy.alias("grid_y")).agg(
        F.count(F.lit(1)).alias("text_count")
    )
    return grouped.select(
        *keys,
        F.format_string("grid_%03d_%03d", "grid_x", "grid_y").alias("area_id"),
        F.lit("grid").alias("area_type"),
        "grid_x",
        "grid_y",
        (F.col("grid_x") * size).alias("x1"),
        (F.col("grid_y") * size).alias("y1"),
        ((F.col("grid_x") + 1) * size).alias("x2"),
        ((F.col("grid_y") + 1) * size).alias("y2"),
        "text_count",
    )


def grid_members(texts: DataFrame, size: float = CELL) -> DataFrame:
    """Texts with the grid cell they belong to."""
    return texts.filter(G.has_box(G.box())).withColumns(
        {"grid_x": F.floor(F.col("x1") / size), "grid_y": F.floor(F.col("y1") / size)}
    )
