"""Tile grids, tile-to-page coordinates, regions of interest, completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.functions import geometry as G
from boxlake.operators.ranking import numbered
from boxlake.schemas import PAGE_KEYS

# Tile size and overlap the default pipelines use.
TILE_SIZE = (1500, 1200)
OVERLAP = 500


def _count(length: Column, step: int, overlap: int) -> Column:
    whole = F.greatest(F.lit(1), F.floor((length - overlap) / step))
    return (whole + F.when(length > whole * step, 1).otherwise(0)).cast("int")


def tile_name(doc: Column, page: Column, row: Column, col: Column) -> Column:
    return F.concat(
        doc.cast("string"), F.lit("_p"), page.cast("string"), F.lit("_r"), row.cast("string"),
        F.lit("_c"), col.cast("string"), F.lit(".png"),
    )


def tile_grid(
    pages: DataFrame, size: tuple[int, int] = TILE_SIZE, overlap: int = OVERLAP
) -> DataFrame:
    """Overlapping tiles that cover each page; the last row and column are pulled
    back inside the page."""
    (w, h), pw, ph = size, F.col("page_w"), F.col("page_h")
    step_w, step_h = w - overlap, h - overlap
    counted = pages.select("doc", "page", "page_w", "page_h").withColumns(
        {"rows": _count(ph, step_h, overlap), "cols": _count(pw, step_w, overlap)}
    )
    cells = counted.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col")
    )
    left = F.greatest(F.lit(0), F.least(F.col("col") * step_w, pw - w))
    top = F.greatest(F.lit(0), F.least(F.col("row") * step_h, ph - h))
    placed = cells.withColumns(
        {
            "tile": tile_name(F.col("doc"), F.col("page"), F.col("row"), F.col("col")),
            "x1": left,
            "y1": top,
            "x2": F.least(left + w, pw),
            "y2": F.least(top + h, ph),
        }
    )
    return placed.withColumns({"width": F.col("x2") - F.col("x1"), "height": F.col("y2") - F.col("y1")}).select(
        "doc", "page", "page_w", "page_h", "rows", "cols", "tile", "row", "col",
        "x1", "y1", "x2", "y2", "width", "height",
    )


def to_global(tile_detections: DataFrame, tiles: DataFrame, renumber: bool = True) -> DataFrame:
    """Page coordinates for boxes found on tiles; the tile box is kept as `tx1..ty2`.
    Rows without a full box, or on a tile the manifest does not list, are dropped.

    With `renumber` the ordinal within a tile becomes one within the page, from 0 on, in
    tile order (row, column, ordinal).
    """
    boxed = tile_detections.filter(G.has_box(G.box("b")))
    manifest = tiles.select(
        "doc", "page", "page_w", "page_h", "cols", "tile", "row", "col",
        F.col("x1").alias("ox"), F.col("y1").alias("oy"),
    )
    # a manifest is made from far fewer pages, by whose size Spark would take it for small
    joined = boxed.join(manifest.hint("merge"), "tile")
    b = G.box("b")
    if renumber:
        place = [F.col(c) for c in ("row", "col", "det_idx")]
        joined = numbered(joined, ["doc", "page"], place, "_n").withColumn("det_idx", F.col("_n") - 1)
    page_box = G.shift(b, F.col("ox"), F.col("oy"))
    return joined.select(
        "doc", "page", "page_w", "page_h", "det_idx", "class_id", "class_name", "confidence",
        *[c.cast("double").alias(n) for n, c in G.as_columns(page_box).items()],
        *[F.col(f"b{n}").cast("double").alias(f"t{n}") for n in G.Box._fields],
        "tile", "row", "col",
    )


def with_pages(pages: DataFrame, detections: DataFrame, keys: Sequence[str] = PAGE_KEYS) -> DataFrame:
    """Every page with its detections; pages without any stay as one row of NULLs."""
    extra = [c for c in detections.columns if c not in pages.columns]
    return pages.join(detections.select(*keys, *extra), list(keys), "left")


def out_of_bounds(detections: DataFrame) -> DataFrame:
    """Adds `outside`: the box leaves its page."""
    b = G.box()
    return detections.withColumn(
        "outside", (b.x1 < 0) | (b.y1 < 0) | (b.x2 > F.col("page_w")) | (b.y2 > F.col("page_h"))
    )


def bounds_report(detections: DataFrame, keys: Sequence[str] = ("doc",)) -> DataFrame:
    return out_of_bounds(detections).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("detections"),
        F.count_if("outside").alias("outside"),
        F.coalesce(F.bool_and(~F.col("outside")), F.lit(True)).alias("valid"),
    )


def confident(detections: DataFrame, threshold: float) -> DataFrame:
    return detections.filter(F.coalesce(F.col("confidence"), F.lit(0.0)) >= threshold)


def confidence_report(detections: DataFrame, threshold: float, keys: Sequence[str] = ("doc",)) -> DataFrame:
    return detections.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("before"),
        F.count_if(F.coalesce(F.col("confidence"), F.lit(0.0)) >= threshold).alias("after"),
    )


def roi_boxes(detections: DataFrame, rendered: DataFrame, padding: float, zoom: float = 2.0) -> DataFrame:
    """Pixel regions to read around each detection. `rendered` gives the image size
    per page (`image_w, image_h`, at `zoom`). Regions outside the image are dropped."""
    joined = detections.join(rendered.select("doc", "page", "image_w", "image_h"), ["doc", "page"])
    now_w, now_h = F.floor(F.col("image_w") / zoom), F.floor(F.col("image_h") / zoom)
    # sizes the document does not state are those of the rendering
    orig_w, orig_h = F.coalesce("page_w", now_w), F.coalesce("page_h", now_h)
    b = G.scale(G.box(), now_w / orig_w, now_h / orig_h)
    grown = G.pad(G.scale(b, F.lit(zoom), F.lit(zoom)), padding)
    whole = G.Box(*[c.cast("int") for c in grown])  # truncates towards zero
    clipped = G.Box(
        F.greatest(F.lit(0), whole.x1),
        F.greatest(F.lit(0), whole.y1),
        F.least(F.col("image_w"), whole.x2),
        F.least(F.col("image_h"), whole.y2),
    )
    r = G.box("roi_")
    return (
        joined.withColumns(G.as_columns(clipped, "roi_"))
        .withColumns({"current_w": now_w, "current_h": now_h})
        .filter((r.x1 < r.x2) & (r.y1 < r.y2))
    )


def recognised_texts(results: DataFrame, threshold: float, zoom: float = 2.0) -> DataFrame:
    """Texts from recognition arrays on regions: accepted by score and content, with
    the polygon turned into a page box. `results` are `roi_boxes` rows plus
    `rec_texts, rec_scores, rec_polys`."""
    from boxlake.functions.text import strip

    zipped = F.arrays_zip("rec_texts", "rec_scores", "rec_polys")
    flat = results.select(
        *[c for c in results.columns if not c.startswith("rec_") and c != "error"], F.posexplode(zipped).alias("rec_idx", "_r")
    )
    text, score = F.col("_r.rec_texts"), F.col("_r.rec_scores")
    accepted = flat.filter((score >= threshold) & (strip(text) != ""))
    p = G.polygon_box(F.col("_r.rec_polys"))
    moved = G.shift(p, F.col("roi_x1"), F.col("roi_y1"))
    boxed = G.Box(*[c / zoom for c in moved])
    kept = [c for c in flat.columns if c not in ("_r", "x1", "y1", "x2", "y2", "confidence")]
    return accepted.select(
        *kept,
        strip(text).alias("text"),
        score.cast("double").alias("confidence"),
        *[F.col(c).alias(f"sym_{c}") for c in G.Box._fields],
        *[c.alias(n) for n, c in G.as_columns(boxed).items()],
        F.lit("ocr").alias("source"),
        F.col("det_idx").alias("sym_idx"),
    )


def recognised_to_page(
    texts: DataFrame,
    mode: str = "page",
    size: tuple[int, int] = TILE_SIZE,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Bring recognised boxes from the rendered page to the detector's page.

    `mode='page'` only undoes the scaling. `mode='compat'` also adds the offset of
    the symbol's tile (from `sym_*`/`tx1, ty1`, else from `row`/`col`), as documents
    in the field were written; calibration removes that offset again.
    """
    if mode not in ("page", "compat"):
        raise ValueError(f"unknown mode {mode!r}")
    sx = F.col("page_w") / F.col("current_w")
    sy = F.col("page_h") / F.col("current_h")
    scaled = G.scale(G.box(), sx, sy)
    if mode == "page":
        return texts.withColumns(G.as_columns(scaled))
    (w, h) = size
    step_w, step_h = w - overlap, h - overlap

    def edge(position, page, step, tile):
        n = _count(page, step, overlap)
        plain = position * step
        last = (position == n - 1) & (position > 0)
        return F.when(last, F.greatest(plain, page - tile)).otherwise(plain)

    known = F.col("sym_x1").isNotNull() & F.col("tx1").isNotNull()
    placed = F.col("row").isNotNull() & F.col("col").isNotNull()
    dx = F.when(known, F.col("sym_x1") - F.col("tx1")).when(placed, edge(F.col("col"), F.col("page_w"), step_w, w))
    dy = F.when(known, F.col("sym_y1") - F.col("ty1")).when(placed, edge(F.col("row"), F.col("page_h"), step_h, h))
    moved = G.shift(scaled, dx, dy)
    # without any tile information the box stays as it was
    final = {n: F.when(known | placed, m).otherwise(F.col(n)) for n, m in G.as_columns(moved).items()}
    return texts.withColumns(final)


def tile_problems(tiles: DataFrame, files: DataFrame) -> DataFrame:
    """Compare the manifest with tile images that exist (`tile, file_w, file_h`).

    `status` is `missing`, `height_mismatch`, `width_adjusted` or `ok`; adjusted tiles
    get the columns where the image is centered (`place_x1, place_x2`).
    """
    # a list of files made from pages is larger than the size Spark takes it for
    joined = tiles.join(files.select("tile", "file_w", "file_h").hint("merge"), "tile", "left")
    want_w, want_h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    status = (
        F.when(F.col("file_w").isNull(), "missing")
        .when(F.col("file_h") != want_h, "height_mismatch")
        .when(F.col("file_w") != want_w, "width_adjusted")
        .otherwise("ok")
    )
    centered = F.col("x1") + F.floor((want_w - F.col("file_w")) / 2).cast("int")
    past = centered + F.col("file_w") > F.col("page_w")
    left = F.when(past, F.col("page_w") - F.col("file_w")).otherwise(centered)
    fits = F.col("status").isin("ok", "width_adjusted")
    return joined.withColumn("status", status).withColumns(
        {
            "place_x1": F.when(fits, F.when(F.col("status") == "ok", F.col("x1")).otherwise(left)),
            "place_x2": F.when(
                fits, F.when(F.col("status") == "ok", F.col("x2")).otherwise(left + F.col("file_w"))
            ),
        }
    )
