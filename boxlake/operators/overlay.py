"""The rows a renderer would draw: boxes, labels, connectors and legend counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.functions import geometry as G
from boxlake.functions.text import strip

# Page size in pixels and grid the fixed-layout projection assumes.
FIXED_PAGE = (9362, 6623)
FIXED_GRID = (6, 4)
FIRST_COLUMN = 2
# Confidence bands.
HIGH, MEDIUM = 0.95, 0.85

PRIMITIVES = ["doc", "page", "kind", "idx", "x1", "y1", "x2", "y2", "label", "band"]


def band(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").otherwise("normal")


def percent_label(class_name: Column, confidence: Column) -> Column:
    """`class 87%`, ties to even."""
    share = F.bround(confidence * 100, 0).cast("long")
    return F.format_string("%s %d%%", F.coalesce(class_name, F.lit("unknown")), share)


def decimal_label(name: Column, confidence: Column) -> Column:
    """`class (0.87)`, ties to even."""
    return F.format_string("%s (%.2f)", F.coalesce(name, F.lit("unknown")), F.bround(confidence, 2))


def project_boxes(df: DataFrame, method: str = "scale") -> DataFrame:
    """Boxes of an image (`image_w, image_h`) on the page (`out_w, out_h`):

    * `scale`: plain scaling,
    * `rotate`: undo the page rotation (`rotation`; 90, 180, 270) inside the media box
      `out_w x out_h`, no scaling,
    * `rotate_scale`: scale, and for `rotation = 90` turn into portrait first,
    * `counterclockwise`: scale, then a quarter turn counter-clockwise.
    """
    b = G.box()
    iw, ih, ow, oh = (F.col(c) for c in ("image_w", "image_h", "out_w", "out_h"))
    plain = G.scale(b, ow / iw, oh / ih)
    if method == "scale":
        out = plain
    elif method == "rotate":
        out = G.rotate(b, F.col("rotation"), ow, oh)
    elif method == "rotate_scale":
        turned = G.ordered(G.Box(b.y1, iw - b.x2, b.y2, iw - b.x1))
        turned = G.scale(turned, ow / ih, oh / iw)
        quarter = F.coalesce(F.col("rotation") == 90, F.lit(False))
        out = G.Box(*[F.when(quarter, t).otherwise(p) for t, p in zip(turned, plain)])
    elif method == "counterclockwise":
        out = G.turn_counterclockwise(b, iw, ih, ow, oh)
    else:
        raise ValueError(f"unknown method {method!r}")
    return df.withColumns(G.as_columns(out))


def project_grid(
    df: DataFrame,
    page: tuple[int, int] = FIXED_PAGE,
    grid: tuple[int, int] = FIXED_GRID,
    first_column: int = FIRST_COLUMN,
    turn: bool = False,
    inside_only: bool = True,
) -> DataFrame:
    """Tile boxes (`tx1..ty2`, `row`, `col`) on the page (`out_w, out_h`) when tiles
    fill a fixed grid. Rows outside the grid are dropped, with `inside_only` also boxes
    that leave the page. `turn` rotates pages with `rotation = 90` into portrait."""
    (w, h), (rows, cols) = page, grid
    column = F.col("col") - first_column
    valid = (column >= 0) & (column < cols) & (F.col("row") >= 0) & (F.col("row") < rows)
    on_page = G.shift(G.box("t"), column * (w / cols), F.col("row") * (h / rows))
    ow, oh = F.col("out_w"), F.col("out_h")
    out = G.scale(on_page, ow / w, oh / h)
    if turn:
        turned = G.scale(
            G.ordered(G.Box(on_page.y1, w - on_page.x2, on_page.y2, w - on_page.x1)), ow / h, oh / w
        )
        quarter = F.coalesce(F.col("rotation") == 90, F.lit(False))
        out = G.Box(*[F.when(quarter, t).otherwise(p) for t, p in zip(turned, out)])
    placed = df.filter(valid).withColumns(G.as_columns(out))
    if not inside_only:
        return placed
    b = G.box()
    return placed.filter(
        (b.x1 >= 0) & (b.y1 >= 0) & (b.x2 <= ow) & (b.y2 <= oh) & (b.x1 < b.x2) & (b.y1 < b.y2)
    )


def detection_primitives(detections: DataFrame, threshold: float = 0.0, style: str = "percent") -> DataFrame:
    """A box with label and band per visible detection."""
    label = {"percent": percent_label, "decimal": decimal_label}[style]
    shown = detections.filter((F.coalesce("confidence", F.lit(0.0)) >= threshold) & G.has_box(G.box()))
    return shown.select(
        "doc", "page", F.lit("detection").alias("kind"), F.col("det_idx").alias("idx"), "x1", "y1", "x2", "y2",
        label(F.col("class_name"), F.col("confidence")).alias("label"), band(F.col("confidence")).alias("band"),
    )


def label_positions(primitives: DataFrame, label_height: int = 15, gap: int = 5) -> DataFrame:
    """Where the label of a box goes: above it, but not off the page."""
    return primitives.withColumns(
        {"label_x": F.col("x1"), "label_y": F.greatest(F.lit(0.0), F.col("y1") - label_height - gap)}
    )


def marker_primitives(detections: DataFrame, threshold: float = 0.0, margin: float = 5.0) -> DataFrame:
    """Detections enlarged by a margin and clipped to the page (`out_w, out_h`)."""
    grown = G.clip(G.pad(G.box(), margin), F.col("out_w"), F.col("out_h"))
    shown = detections.filter(F.coalesce("confidence", F.lit(0.0)) >= threshold)
    return shown.select(
        "doc", "page", F.lit("marker").alias("kind"), F.col("det_idx").alias("idx"),
        *[c.alias(n) for n, c in G.as_columns(grown).items()],
        F.coalesce("class_name", F.lit("unknown")).alias("label"), band(F.col("confidence")).alias("band"),
    )


def text_primitives(texts: DataFrame, threshold: float = 0.0, max_chars: int | None = None) -> DataFrame:
    """A box per visible text, corners in order; `max_chars` shortens the label."""
    label = strip(F.col("text"))
    if max_chars is not None:
        label = F.substring(label, 1, max_chars)
    shown = texts.filter((F.coalesce("confidence", F.lit(0.0)) >= threshold) & G.has_box(G.box()))
    return shown.select(
        "doc", "page", F.lit("text").alias("kind"), F.col("text_idx").alias("idx"),
        *[c.alias(n) for n, c in G.as_columns(G.ordered(G.box())).items()],
        label.alias("label"), band(F.col("confidence")).alias("band"),
    )


def symbol_text_boxes(texts: DataFrame, threshold: float = 0.0, font_size: float = 8.0) -> DataFrame:
    """Text boxes below their symbol (`sym_x1..sym_y2`); moved left or above the symbol
    where they would leave the page (`out_w, out_h`)."""
    s = G.box("sym_")
    w = F.length("text") * (font_size - 1) * 0.6
    h = F.lit(font_size + 4)
    below = s.y2 + 5
    x1 = F.when(s.x1 + w > F.col("out_w"), F.col("out_w") - w - 10).otherwise(s.x1)
    y1 = F.when(below + h > F.col("out_h"), s.y1 - h - 5).otherwise(below)
    shown = texts.filter((F.coalesce("confidence", F.lit(0.0)) >= threshold) & G.has_box(s))
    return shown.select(
        "doc", "page", F.lit("symbol_text").alias("kind"), F.col("text_idx").alias("idx"),
        x1.alias("x1"), y1.alias("y1"), (x1 + w).alias("x2"), (y1 + h).alias("y2"),
        F.col("text").alias("label"), band(F.col("confidence")).alias("band"),
    )


def layout_primitives(texts: DataFrame) -> DataFrame:
    """Associated texts with their confidence, others marked as fallback."""
    linked = F.col("sym_idx").isNotNull()
    scored = F.when(F.col("confidence") > 0, decimal_label(F.col("text"), F.col("confidence"))).otherwise(F.col("text"))
    shown = texts.filter((F.length("text") > 0) & G.has_box(G.box()))
    return shown.select(
        "doc", "page",
        F.when(linked, "layout_text").otherwise("fallback_text").alias("kind"),
        F.col("text_idx").alias("idx"), "x1", "y1", "x2", "y2",
        F.when(linked, scored).otherwise(F.concat("text", F.lit(" [fallback]"))).alias("label"),
        band(F.col("confidence")).alias("band"),
    )


def scaled_fallback(texts: DataFrame, factor: float = 3.0) -> DataFrame:
    """Texts without a symbol, scaled up; those that leave the page are dropped."""
    b = G.scale(G.box(), F.lit(factor), F.lit(factor))
    return (
        texts.filter(F.col("sym_idx").isNull())
        .withColumns(G.as_columns(b))
        .filter(
            (F.col("x1") >= 0) & (F.col("y1") >= 0) & (F.col("x2") <= F.col("out_w")) & (F.col("y2") <= F.col("out_h"))
        )
    )


def connectors(texts: DataFrame) -> DataFrame:
    """A segment from the center of each associated text to that of its symbol."""
    t, s = G.box(), G.box("sym_")
    return texts.filter(G.has_box(s) & G.has_box(t)).select(
        "doc", "page", F.lit("connector").alias("kind"), F.col("text_idx").alias("idx"),
        G.center_x(t).alias("x1"), G.center_y(t).alias("y1"), G.center_x(s).alias("x2"), G.center_y(s).alias("y2"),
        F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("band"),
    )


def legend(
    detections: DataFrame,
    texts: DataFrame,
    detection_threshold: float = 0.0,
    text_threshold: float = 0.0,
    keys: Sequence[str] = ("doc", "page"),
) -> DataFrame:
    """Shown and total boxes and texts per page, and texts per source. Pages with only
    one of both are present."""
    none = F.lit(None)
    conf = F.coalesce("confidence", F.lit(0.0))
    rows = detections.select(*keys, conf.alias("dc"), none.cast("double").alias("tc"), none.cast("string").alias("source"))
    rows = rows.unionByName(
        texts.select(*keys, none.cast("double").alias("dc"), conf.alias("tc"), "source")
    )
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("dc") >= detection_threshold).alias("detections_shown"),
        F.count("dc").alias("detections_total"),
        F.count_if(F.col("tc") >= text_threshold).alias("texts_shown"),
        F.count("tc").alias("texts_total"),
        F.count_if(F.col("source") == "pdf").alias("pdf_texts"),
        F.count_if(F.col("source") == "ocr").alias("ocr_texts"),
    )
