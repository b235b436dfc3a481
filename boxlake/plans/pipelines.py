"""Compositions a user calls: extraction, globalisation, calibration, tag lists, areas,
overlays. Each takes and returns flat tables; writing is left to `boxlake.sources`."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.functions import geometry as G
from boxlake.functions.text import DEFAULT_PATTERNS, TextPattern, normalised, similar, strip
from boxlake.operators import areas as A
from boxlake.operators import calibrate as K
from boxlake.operators import clusters as L
from boxlake.operators import dedup as D
from boxlake.operators import fusion as U
from boxlake.operators import overlay as O
from boxlake.operators import pagewise
from boxlake.operators import scoring as X
from boxlake.operators import spatial as S
from boxlake.operators import stats as Z
from boxlake.operators import tiles as P
from boxlake.operators.pagewise import PAGE_ROWS
from boxlake.operators.ranking import numbered
from boxlake.schemas import OCR_ORDINAL_SHIFT, PAGE_KEYS
from boxlake.session import cut_lineage, settled

# Share of the smaller box by which a recognised text overlaps the one it repeats.
REPEAT_OVERLAP = 0.5
SYMBOL_COLUMNS = ("class_name", "confidence", "x1", "y1", "x2", "y2")


class Extraction(NamedTuple):
    detections: DataFrame
    texts: DataFrame
    patterns: DataFrame
    statistics: DataFrame


def clean_detections(
    detections: DataFrame, tag_iou: float = 0.7, nms_iou: float | None = 0.5
) -> DataFrame:
    """Tag duplicates, then class-wise suppression (`nms_iou=None` leaves it out).
    The result is read several times later, so it is written once."""
    return settled(detections.sparkSession, lambda: D.cleaned(detections, tag_iou, nms_iou))


def recognise(
    detections: DataFrame,
    rendered: DataFrame,
    recogniser: Callable,
    threshold: float = 0.7,
    padding: float = 20,
    mode: str = "page",
) -> DataFrame:
    """Texts read by the caller's function around each detection, in page coordinates.
    `text_idx` follows detections and then the order of the reader."""
    rois = P.roi_boxes(detections, rendered, padding)
    texts = P.recognised_to_page(P.recognised_texts(X.read_regions(rois, recogniser), threshold), mode)
    # numbering reads its rows more than once; regions are read only once
    texts = cut_lineage(texts.select("doc", "page", "det_idx", "rec_idx", "text", "confidence", "x1", "y1", "x2", "y2", "source", "sym_idx"))
    texts = numbered(texts, ["doc", "page"], [F.col("det_idx"), F.col("rec_idx")], "text_idx")
    return texts.select(
        "doc", "page", (F.col("text_idx") - 1).alias("text_idx"), "text", "confidence", "x1", "y1", "x2", "y2", "source", "sym_idx"
    )


def extract_text(
    detections: DataFrame,
    spans: DataFrame,
    ocr: DataFrame | None = None,
    *,
    tag_iou: float = 0.7,
    nms_iou: float | None = 0.5,
    expand: float = 1.0,
    radius: float = 300.0,
    patterns: Sequence[TextPattern] = DEFAULT_PATTERNS,
    symbol_columns: Sequence[str] = (),
    page_rows: int = PAGE_ROWS,
) -> Extraction:
    """Duplicates out, spans near boxes in, recognised texts merged, nearest symbol
    attached, texts tagged and scored. `symbol_columns` are added as `sym_...` like
    `spatial.with_symbol` does. Pages of up to `page_rows` rows of each kind are settled whole,
    larger ones by cells."""
    kept = clean_detections(detections, tag_iou, nms_iou)

    def make() -> DataFrame:
        tables = [spans, kept] if ocr is None else [spans, kept, ocr]

        def on_pages(*tables: DataFrame) -> DataFrame:
            return _texts_of_pages(*tables, expand=expand, radius=radius, symbol_columns=symbol_columns)

        def by_cells(spans: DataFrame, kept: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
            # each step reads its rows for sizes too
            texts = cut_lineage(_unlinked(S.spans_near_boxes(spans, kept, expand)))
            texts = cut_lineage(U.fuse(texts, ocr)) if ocr is not None else texts
            linked = S.nearest_symbol(texts, kept, radius)
            return S.with_symbol(linked, kept, symbol_columns) if symbol_columns else linked

        large = pagewise.large_groups(tables, PAGE_KEYS, page_rows)
        return U.tag(pagewise.in_two_ways(tables, PAGE_KEYS, large, on_pages, by_cells), patterns)

    tagged = settled(spans.sparkSession, make)
    return Extraction(kept, tagged, U.pattern_counts(tagged), U.extraction_statistics(tagged))


def _unlinked(texts: DataFrame) -> DataFrame:
    return texts if "sym_idx" in texts.columns else texts.withColumn("sym_idx", F.lit(None).cast("long"))


def _texts_of_pages(
    spans: DataFrame, kept: DataFrame, ocr: DataFrame | None = None, *, expand: float, radius: float, symbol_columns: Sequence[str]
) -> DataFrame:
    """Spans near boxes, recognised texts that repeat none of them and the nearest symbol of
    each, from the lists of a page: every row is shuffled once."""
    keys, b = list(PAGE_KEYS), G.box()
    pdf = _unlinked(spans.withColumn("text", strip(F.col("text"))).filter(F.length("text") > 0))
    said = pdf.withColumn("confidence", F.lit(1.0)).withColumn("source", F.lit("pdf"))
    layout = said if ocr is None else said.unionByName(ocr, allowMissingColumns=True)
    fields = [f for f in layout.schema.fields if f.name not in (*keys, "sym_idx")]
    grown = [c.alias(n) for n, c in zip(("bx1", "by1", "bx2", "by2"), G.expand_ratio(b, expand))]
    # boxes without a place are near nothing, but a text may know one
    boxes = kept.select(
        *keys, F.col("det_idx").cast("long").alias("sid"), G.center_x(b).alias("sx"), G.center_y(b).alias("sy"), *grown,
        *[F.col(c).alias(f"sym_{c}") for c in symbol_columns],
    )
    lists = {"_spans": pdf, "_boxes": boxes} | ({} if ocr is None else {"_ocr": ocr})
    pages = pagewise.together(keys, **lists)
    # rows without document or page meet nothing; symbols come by ordinal, which settles ties
    named = F.col("doc").isNotNull() & F.col("page").isNotNull()
    pages = pages.withColumn("_boxes", F.array_sort(F.when(named, F.col("_boxes")).otherwise(F.slice("_boxes", 1, 0))))

    def corners(name: str, prefix: str = "") -> list:
        return [F.col(f"{name}.{prefix}{n}") for n in G.Box._fields]

    closest = pagewise.closest(radius, False)
    added = {"_near": pagewise.centered_in()(*corners("_spans"), *corners("_boxes", "b"))}
    if ocr is not None:
        added["_close"] = pagewise.overlapping(REPEAT_OVERLAP)(*corners("_ocr"), *corners("_spans"))
    for name, texts in (("_spans", pdf), ("_ocr", ocr)):
        if texts is not None:
            added[f"{name}_found"] = closest(*corners(name), F.col("_boxes.sx"), F.col("_boxes.sy"))
            if symbol_columns and "sym_idx" in texts.columns:
                added[f"{name}_known"] = pagewise.places()(F.col(f"{name}.sym_idx").cast("array<bigint>"), F.col("_boxes.sid"))
    pages = pages.withColumns(added)

    def text(name: str, row: Column, i: Column, columns: Sequence[str], **fixed: Column) -> Column:
        """A text of the list `name` with its symbol."""
        own = row["sym_idx"] if "sym_idx" in columns else F.lit(None).cast("long")
        at, away = F.get(F.col(f"{name}_found.at"), i), F.get(F.col(f"{name}_found.dist"), i)
        values = [fixed.get(f.name, row[f.name] if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
        new = F.when(own.isNull() & (at >= 0), F.get("_boxes", at))
        symbol = new
        if f"{name}_known" in added:
            there = F.get(f"{name}_known", i)
            symbol = F.when(own.isNull(), new).when(there >= 0, F.get("_boxes", there))
        return F.struct(
            *values, F.when(new.isNotNull(), away).alias("sym_dist"), F.coalesce(own.cast("long"), new["sid"]).alias("sym_idx"),
            *[symbol[f"sym_{c}"].alias(f"sym_{c}") for c in symbol_columns],
        )

    one, layer = F.lit(1.0), F.lit("pdf")
    out = F.transform("_spans", lambda s, i: F.when(F.get("_near", i), text("_spans", s, i, pdf.columns, confidence=one, source=layer)))
    if ocr is not None:

        def repeats(o: Column, i: Column) -> Column:
            clean = normalised(o["text"])

            def alike(j: Column) -> Column:
                read = normalised(F.get("_spans", j)["text"])
                return F.coalesce(F.get("_near", j) & (read != "") & similar(read, clean), F.lit(False))

            return F.exists(F.get("_close", i), alike)

        shifted = lambda o: o["text_idx"] + F.lit(OCR_ORDINAL_SHIFT)
        out = F.concat(out, F.transform("_ocr", lambda o, i: F.when(~repeats(o, i), text("_ocr", o, i, ocr.columns, text_idx=shifted(o)))))
    return pages.select(*keys, F.inline(F.filter(out, lambda t: t.isNotNull())))


class Globalised(NamedTuple):
    detections: DataFrame
    bounds: DataFrame
    statistics: DataFrame


def globalise(tiles: DataFrame, tile_detections: DataFrame, renumber: bool = True) -> Globalised:
    """Page coordinates with bounds check and statistics; pages without boxes count."""
    boxes = P.to_global(tile_detections, tiles, renumber)
    pages = tiles.select("doc", "page").distinct()
    return Globalised(boxes, P.bounds_report(boxes), Z.detection_statistics(pages, boxes))


class Calibrated(NamedTuple):
    texts: DataFrame
    statistics: DataFrame


def calibrate_texts(
    detections: DataFrame,
    spans: DataFrame,
    ocr: DataFrame,
    min_confidence: float = 0.5,
    by_page: bool = True,
) -> Calibrated:
    """Extraction over confident detections, then alignment of texts and symbols."""
    found = extract_text(P.confident(detections, min_confidence), spans, ocr, symbol_columns=(*SYMBOL_COLUMNS, "row", "col"))
    wide = found.texts.withColumnsRenamed({"sym_row": "row", "sym_col": "col"})
    return Calibrated(*K.calibrate(wide, by_page))


class TagList(NamedTuple):
    regions: DataFrame
    tags: DataFrame
    summary: DataFrame


def tag_list(texts: DataFrame, symbols: DataFrame, by_page: bool = True) -> TagList:
    """Numbered output regions, tag rows, and region counts."""
    rows = A.regions(S.with_symbol(texts, symbols))
    return TagList(A.sequenced(rows, by_page=by_page), A.tag_rows(rows, by_page), A.region_summary(rows))


class Areas(NamedTuple):
    areas: DataFrame
    members: DataFrame
    grid: DataFrame


def area_tables(
    texts: DataFrame,
    symbols: DataFrame,
    by_page: bool = True,
    types: Mapping[str, str] = A.AREA_TYPES,
) -> Areas:
    found, members = L.cluster_areas(texts, symbols, by_page=by_page, types=types)
    keys = ("doc", "page") if by_page else ("doc",)
    return Areas(found, members, A.grid_areas(texts, keys=keys))


class Overlay(NamedTuple):
    primitives: DataFrame
    legend: DataFrame


def overlay_tables(
    detections: DataFrame,
    texts: DataFrame,
    page_sizes: DataFrame,
    detection_threshold: float = 0.25,
    text_threshold: float = 0.5,
    method: str = "scale",
) -> Overlay:
    """Everything a renderer draws: projected detection boxes and markers, text boxes,
    symbol texts, connectors; and legend counts. `page_sizes` has `doc, page, image_w,
    image_h, out_w, out_h, rotation`."""
    sized = detections.join(page_sizes, ["doc", "page"])
    on_page = O.project_boxes(sized, method)
    linked = S.with_symbol(texts.join(page_sizes, ["doc", "page"]), on_page)
    parts = [
        O.detection_primitives(on_page, detection_threshold),
        O.marker_primitives(on_page, detection_threshold),
        O.text_primitives(texts, text_threshold),
        O.symbol_text_boxes(linked, text_threshold),
        O.connectors(linked.filter(F.col("confidence") >= text_threshold)),
    ]
    drawn = parts[0]
    for p in parts[1:]:
        drawn = drawn.unionByName(p)
    return Overlay(drawn, O.legend(detections, texts, detection_threshold, text_threshold))
