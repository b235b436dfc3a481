"""Registered queries: every operator over the whole given tables.

Results are flat (no nested columns) and aliased like their SQL in `boxlake.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake import fixtures as X
from boxlake.functions import geometry as G
from boxlake.functions.text import TextPattern
from boxlake.operators import areas, calibrate, catalog, clusters, dedup, fusion, overlay, ranking, relative, scoring
from boxlake.operators import spatial, stats, tiles
from boxlake.plans import pipelines
from boxlake.session import cut_lineage, scratch_path
from boxlake.sources import documents
from boxlake.sources import tables
from boxlake.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


BOX = ["x1", "y1", "x2", "y2"]


def rounded(*names: str) -> dict:
    """Six decimals, so that the order of a floating sum does not show."""
    return {n: F.floor(F.col(n) * 1e6 + 0.5) / 1e6 for n in names}


# ------------------------------------------------------------ duplicates

@query
def nms_by_class(spark, d):
    kept = dedup.suppress(X.detections(spark, d), 0.5)
    return kept.groupBy("doc", "class_name").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("confidence").alias("confidence"), F.min("det_idx").alias("first_idx")
    )


@query
def nms_survivors(spark, d):
    return dedup.suppress(X.detections(spark, d), 0.5).select("doc", "page", "det_idx", "class_name", "confidence", *BOX)


@query
def nms_any_class(spark, d):
    kept = dedup.suppress(X.detections(spark, d), 0.3, class_specific=False)
    return kept.select("doc", "page", "det_idx", "class_name")


@query
def preprocessed_detections(spark, d):
    return dedup.preprocess(X.detections(spark, d)).select("doc", "page", "det_idx", "class_name", "confidence")


@query
def reduction_by_document(spark, d):
    before = X.detections(spark, d)
    by_page = dedup.reduction_by_page(before, dedup.preprocess(before))
    return dedup.reduction_summary(by_page).withColumns(rounded("reduction_percentage"))


@query
def reduction_by_page(spark, d):
    before = X.detections(spark, d)
    return dedup.reduction_by_page(before, dedup.preprocess(before))


@query
def tag_duplicates(spark, d):
    return dedup.dedup_tags(X.detections(spark, d)).select("doc", "page", "det_idx", "class_name")


@query
def overlap_pairs(spark, d):
    return dedup.overlap_summary(X.detections(spark, d), 0.5)


@query
def overlap_examples(spark, d):
    return dedup.overlap_sample(X.detections(spark, d), 0.5, 10).select(
        "doc", "page", "a_det_idx", "b_det_idx", "a_class_name", "b_class_name", "a_confidence", "b_confidence", "iou"
    )


# ------------------------------------------------------------ tiles and pages

@query
def tile_grid(spark, d):
    return tiles.tile_grid(X.order_pages(spark, d))


@query
def tile_grid_plain(spark, d):
    """The grid without overlap, 800 x 600."""
    grid = tiles.tile_grid(X.order_pages(spark, d), (800, 600), 0)
    return grid.groupBy("doc", "page").agg(
        F.count(F.lit(1)).alias("tiles"), F.sum(F.col("width") * F.col("height")).alias("pixels"),
        F.max("x2").alias("right"), F.max("y2").alias("bottom"),
    )


@query
def tiles_to_page(spark, d):
    grid = tiles.tile_grid(X.pages(spark, d))
    out = tiles.to_global(X.tile_detections(spark, d), grid, renumber=False)
    return out.select("doc", "page", "det_idx", *BOX, "tx1", "ty1", "tile", "row", "col")


@query
def tiles_to_page_numbered(spark, d):
    """Ordinals within the page, by tile and ordinal within it."""
    grid = tiles.tile_grid(X.pages(spark, d))
    out = tiles.to_global(X.tile_detections(spark, d), grid)
    return out.select("doc", "page", "det_idx", *BOX, "tile")


@query
def pages_with_detections(spark, d):
    """Empty pages stay: one row per page with its number of boxes."""
    wide = tiles.with_pages(X.pages(spark, d), X.detections(spark, d))
    return wide.groupBy("doc", "page", "page_w", "page_h").agg(F.count("det_idx").alias("detections"))


@query
def bounds_check(spark, d):
    return tiles.bounds_report(X.detections(spark, d))


@query
def out_of_bounds_boxes(spark, d):
    return tiles.out_of_bounds(X.detections(spark, d)).filter("outside").select("doc", "page", "det_idx", *BOX)


@query
def confidence_filter(spark, d):
    return tiles.confident(X.detections(spark, d), 0.8).select("doc", "page", "det_idx", "confidence")


@query
def confidence_counts(spark, d):
    return tiles.confidence_report(X.detections(spark, d), 0.8)


@query
def tile_completeness(spark, d):
    """Manifest against tile images; one grid position has none, sizes differ by a rule."""
    grid = tiles.tile_grid(X.order_pages(spark, d))
    n = F.col("page") + F.col("row") * 3 + F.col("col")
    files = grid.filter(~((F.col("row") == 1) & (F.col("col") == 2))).select(
        "tile",
        (F.col("width") - F.when(F.pmod(n, F.lit(5)) == 0, 13).when(F.pmod(n, F.lit(5)) == 1, -9).otherwise(0)).alias("file_w"),
        (F.col("height") - F.when(F.pmod(n, F.lit(17)) == 0, 1).otherwise(0)).alias("file_h"),
    )
    return tiles.tile_problems(grid, files).select("tile", "status", "place_x1", "place_x2")


def _rendered(spark, d):
    return X.pages(spark, d).select(
        "doc", "page", (F.col("page_w") * 2 - 200).alias("image_w"), (F.col("page_h") - F.col("page") * 7).alias("image_h")
    )


@query
def regions_of_interest(spark, d):
    out = tiles.roi_boxes(X.detections(spark, d), _rendered(spark, d), 20)
    return out.select("doc", "page", "det_idx", "roi_x1", "roi_y1", "roi_x2", "roi_y2", "current_w", "current_h")


@query
def expanded_boxes(spark, d):
    det = X.detections(spark, d)
    b = G.box()
    near = G.as_columns(G.expand_ratio(b, 1.0), "n_")
    inside = G.as_columns(G.expand_within(b, 0.1, F.col("page_w"), F.col("page_h")), "i_")
    return det.select(
        "doc", "page", "det_idx",
        *[c.alias(n) for n, c in near.items()],
        *[c.cast("double").alias(n) for n, c in inside.items()],
        G.area(b).alias("area"), G.center_x(b).alias("center_x"), G.center_y(b).alias("center_y"),
    )


def _reader():
    """A stand-in for a recogniser: two readings per region, from its coordinates."""

    def read(batch: pd.DataFrame):
        out = []
        for x1, y1, x2, y2, confidence in zip(*[batch[c].tolist() for c in ("roi_x1", "roi_y1", "roi_x2", "roi_y2", "confidence")]):
            w, h = float(x2 - x1), float(y2 - y1)
            square = [[2.0, 2.0], [w - 4.0, 2.0], [w - 4.0, h - 6.0], [2.0, h - 6.0]]
            out.append(([f" T{x1} ", " "], [confidence, 1.0], [square, square]))
        return out

    return read


def _read(spark, d):
    rois = tiles.roi_boxes(X.detections(spark, d), _rendered(spark, d), 20).select(
        "doc", "page", "page_w", "page_h", "det_idx", "confidence", *BOX, "tx1", "ty1", "row", "col",
        "roi_x1", "roi_y1", "roi_x2", "roi_y2", "current_w", "current_h",
    )
    return tiles.recognised_texts(scoring.read_regions(rois, _reader()), 0.5)


@query
def recognised_regions(spark, d):
    return _read(spark, d).select("doc", "page", "det_idx", "rec_idx", "text", "confidence", *BOX)


def _failing(read):
    """A recogniser that fails for a batch with any region it can't read."""

    def run(batch: pd.DataFrame):
        if any(i % 7 == 3 for i in batch["det_idx"].tolist()):
            raise ValueError("unreadable")
        return read(batch)

    return run


@query
def recognised_with_failures(spark, d):
    """Regions read, and regions that failed, with the reason."""
    rois = tiles.roi_boxes(X.detections(spark, d), _rendered(spark, d), 20)
    read = scoring.read_regions(rois.select("doc", "page", "det_idx", "confidence", "roi_x1", "roi_y1", "roi_x2", "roi_y2"), _failing(_reader()))
    return read.select("doc", "page", "det_idx", F.size("rec_texts").alias("texts"), "error")


@query
def recognised_on_page(spark, d):
    out = tiles.recognised_to_page(_read(spark, d), "page")
    return out.select("doc", "page", "det_idx", "text", *BOX).withColumns(rounded(*BOX))


@query
def recognised_with_tile_offset(spark, d):
    out = tiles.recognised_to_page(_read(spark, d), "compat")
    return out.select("doc", "page", "det_idx", "text", *BOX).withColumns(rounded(*BOX))


@query
def recognised_from_grid_position(spark, d):
    """The tile offset when only row and column are known."""
    blind = _read(spark, d).withColumn("tx1", F.lit(None).cast("double"))
    out = tiles.recognised_to_page(blind, "compat")
    return out.select("doc", "page", "det_idx", "text", *BOX).withColumns(rounded(*BOX))


def _detector():
    """A stand-in for a detector: up to four boxes per tile, from its grid position."""

    def detect(batch: pd.DataFrame):
        out = []
        for r in batch.itertuples():
            n = r.row * 3 + r.col
            corner = [(10.0 * k, 5.0 * n) for k in range(n % 4 + 1)]
            out.append(
                [
                    {"class_id": k, "class_name": "PLC", "confidence": (k + 1) / 4, "x1": x, "y1": y, "x2": x + 40, "y2": y + 30}
                    for k, (x, y) in enumerate(corner)
                ]
            )
        return out

    return detect


@query
def scored_tiles(spark, d):
    grid = tiles.tile_grid(X.order_pages(spark, d)).withColumn("image_path", F.concat(F.lit("/img/"), "tile"))
    results = scoring.score_tiles(grid.select("tile", "image_path", "row", "col"), _detector(), 0.5)
    boxes = scoring.tile_detections(results)
    return boxes.groupBy("tile").agg(
        F.count(F.lit(1)).alias("boxes"), F.sum("bx2").alias("right"), F.sum("by1").alias("top"), F.max("confidence").alias("best")
    )


# ------------------------------------------------------------ texts and symbols

@query
def spans_near_boxes(spark, d):
    return spatial.spans_near_boxes(X.spans(spark, d), X.detections(spark, d)).select(
        "doc", "page", "text_idx", "text", "confidence", "source"
    )


@query
def nearest_symbol(spark, d):
    boxes = X.detections(spark, d).select("doc", "page", "det_idx", "class_name", "confidence", *BOX)
    out = spatial.nearest_symbol(X.texts(spark, d), dedup.suppress(boxes, 0.5))
    return out.select("doc", "page", "text_idx", "sym_idx", "sym_dist")


@query
def nearest_symbol_kept(spark, d):
    """Texts that know their symbol keep it, the others look within 60 pixels."""
    out = spatial.nearest_symbol(X.ocr_texts(spark, d), X.detections(spark, d), 60.0)
    return out.select("doc", "page", "text_idx", "sym_idx")


@query
def nearest_symbol_in_document(spark, d):
    out = spatial.nearest_symbol(
        X.texts(spark, d), X.detections(spark, d), 20.0, inclusive=True, by_page=False, keep_existing=False
    )
    return out.select("doc", "page", "text_idx", "sym_page", "sym_idx", "sym_dist")


@query
def fused_texts(spark, d):
    return fusion.fuse(X.texts(spark, d), X.ocr_texts(spark, d)).select("doc", "page", "text_idx", "text", "source", "sym_idx")


@query
def fused_texts_strict(spark, d):
    return fusion.fuse(X.texts(spark, d), X.ocr_texts(spark, d), strict_ratio=0.8).select("doc", "page", "text_idx", "source")


@query
def symbols_of_texts(spark, d):
    out = spatial.with_symbol(X.ocr_texts(spark, d), X.detections(spark, d))
    return out.select("doc", "page", "text_idx", "sym_class_name", "sym_x1", "sym_y1", "sym_x2", "sym_y2")


@query
def tagged_texts(spark, d):
    out = fusion.tag(X.texts(spark, d))
    return out.select(
        "doc", "page", "text_idx", "text", F.array_join("patterns.pattern", ",").alias("patterns"), "relevance"
    )


@query
def tagged_words(spark, d):
    """Distinct words of all documents, tagged."""
    words = X.table(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("text"))
    plain = words.filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return fusion.tag(plain).select("text", "n", F.array_join("patterns.pattern", ",").alias("patterns"), "relevance")


@query
def relevance_order(spark, d):
    return fusion.by_relevance(fusion.tag(X.texts(spark, d))).select("doc", "page", "text_idx", "position")


@query
def pattern_counts(spark, d):
    return fusion.pattern_counts(fusion.tag(X.texts(spark, d)))


@query
def extraction_statistics(spark, d):
    tagged = fusion.tag(fusion.fuse(X.texts(spark, d), X.ocr_texts(spark, d)))
    return fusion.extraction_statistics(tagged).withColumns(
        rounded("average_confidence", "average_relevance_score", "association_rate")
    )


@query
def extraction_summary(spark, d):
    """Customers are the documents asked for, suppliers those read, some without texts."""
    read = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"))
    some = X.ocr_texts(spark, d).filter(F.pmod("doc", F.lit(5)) > 0)  # every fifth has no text
    statistics = fusion.extraction_statistics(fusion.tag(some), documents=read)
    asked = X.table(spark, d, "customer").select(F.col("c_custkey").alias("doc"))
    return fusion.run_summary(statistics, asked).withColumns(
        rounded("average_text_regions_per_file", "success_rate")
    )


@query
def extraction_statistics_of_all(spark, d):
    """Every supplier was read; those that are multiples of five have no text."""
    read = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc"))
    some = X.ocr_texts(spark, d).filter(F.pmod("doc", F.lit(5)) > 0)
    return fusion.extraction_statistics(fusion.tag(some), documents=read).select(
        "doc", "total_texts", "texts_with_associated_symbols"
    )


@query
def extracted_texts(spark, d):
    """Extraction end to end."""
    out = pipelines.extract_text(X.detections(spark, d), X.spans(spark, d), X.ocr_texts(spark, d))
    return out.texts.select(
        "doc", "page", "text_idx", "text", "source", "sym_idx", F.array_join("patterns.pattern", ",").alias("patterns"), "relevance"
    )


# ------------------------------------------------------------ calibration, relative boxes

@query
def offset_statistics(spark, d):
    out = calibrate.offset_statistics(X.linked_texts(spark, d))
    return out.withColumns(rounded("mean_x", "std_x", "mean_y", "std_y", "median_x", "median_y"))


@query
def tile_offsets(spark, d):
    return calibrate.tile_offsets(X.linked_texts(spark, d)).withColumns(rounded("avg_off_x", "avg_off_y"))


@query
def tile_offsets_in_document(spark, d):
    out = calibrate.tile_offsets(X.linked_texts(spark, d), by_page=False)
    return out.withColumns(rounded("avg_off_x", "avg_off_y"))


@query
def calibrated_texts(spark, d):
    out, _ = calibrate.calibrate(X.linked_texts(spark, d))
    return out.select("doc", "page", "text_idx", *BOX, "correction").withColumns(rounded(*BOX))


@query
def calibrated_extraction(spark, d):
    """Confidence filter, extraction and calibration end to end."""
    out = pipelines.calibrate_texts(X.detections(spark, d), X.spans(spark, d), X.ocr_texts(spark, d))
    return out.texts.select("doc", "page", "text_idx", "sym_idx", *BOX, "correction").withColumns(rounded(*BOX))


def _relative(spark, d):
    return relative.to_relative(X.linked_texts(spark, d))


@query
def relative_texts(spark, d):
    percents = [f"{c}_percent" for c in BOX]
    return _relative(spark, d).select(
        "doc", "page", "text_idx", *BOX, "abs_x1", "abs_y1", "symbol_width", "symbol_height", *percents, "coordinate_system"
    ).withColumns(rounded(*percents))


@query
def relative_round_trip(spark, d):
    return relative.to_absolute(_relative(spark, d)).select("doc", "page", "text_idx", *BOX, "rel_x1", "rel_y2", "coordinate_system")


@query
def relative_counts(spark, d):
    return relative.relative_counts(_relative(spark, d))


@query
def anchored_texts(spark, d):
    """Relative texts placed on their symbol moved by (100, 50)."""
    to = X.detections(spark, d).select(
        "doc", "page", F.col("det_idx").alias("sym_idx"),
        *[(F.col(c) + s).alias(f"to_{c}") for c, s in (("x1", 100), ("y1", 50), ("x2", 100), ("y2", 50))],
    )
    return relative.anchor(_relative(spark, d), to).select("doc", "page", "text_idx", *[f"abs_{c}" for c in BOX])


def _layout(spark, d):
    return X.linked_texts(spark, d).withColumn("sym_tile", tiles.tile_name(F.col("doc"), F.col("page"), F.col("row"), F.col("col")))


@query
def layout_symbols(spark, d):
    return relative.layout_symbols(_layout(spark, d))


@query
def layout_texts(spark, d):
    return relative.layout_texts(_layout(spark, d)).select("doc", "page", "text_idx", "symbol_id", "text")


# ------------------------------------------------------------ areas

@query
def output_regions(spark, d):
    return areas.regions(X.linked_texts(spark, d))


@query
def output_regions_signed(spark, d):
    flipped = X.linked_texts(spark, d).withColumns({"x1": F.col("x2"), "x2": F.col("x1")})
    return areas.regions(flipped, signed=True).select("document", "page", "text_idx", "x", "y", "width", "height")


@query
def area_groups(spark, d):
    return areas.area_groups(areas.regions(X.linked_texts(spark, d)))


def _to_sequence(spark, d):
    rows = areas.regions(X.linked_texts(spark, d))
    return rows.select("document", "page", "text_idx", "area_id", "text_content", "x", "y")


@query
def sequenced_regions(spark, d):
    return areas.sequenced(_to_sequence(spark, d)).select("document", "page", "text_idx", "area_id", "sequence")


@query
def sequenced_regions_in_document(spark, d):
    rows = _to_sequence(spark, d)
    return areas.sequenced(rows, by_page=False).select("document", "page", "text_idx", "area_id", "sequence")


@query
def sequenced_without_areas(spark, d):
    rows = _to_sequence(spark, d)
    return areas.sequenced(rows, grouping=False).select("document", "page", "text_idx", "sequence")


@query
def tag_rows(spark, d):
    return areas.tag_rows(areas.regions(X.linked_texts(spark, d)))


@query
def tag_rows_in_document(spark, d):
    return areas.tag_rows(areas.regions(X.linked_texts(spark, d)), by_page=False)


@query
def tag_list_csv(spark, d):
    """The formatted tag list of all documents."""
    out = pipelines.tag_list(X.ocr_texts(spark, d), X.detections(spark, d))
    return documents.tag_csv(out.tags)


@query
def region_summary(spark, d):
    return areas.region_summary(areas.regions(X.linked_texts(spark, d)))


@query
def text_clusters(spark, d):
    return clusters.clusters(X.texts(spark, d), 60.0).select("doc", "page", "text_idx", "cluster_id")


@query
def cluster_areas(spark, d):
    found, _ = clusters.cluster_areas(X.texts(spark, d), X.detections(spark, d), 60.0, 90.0)
    return found


@query
def grid_areas(spark, d):
    return areas.grid_areas(X.texts(spark, d))


@query
def grid_members(spark, d):
    return areas.grid_members(X.texts(spark, d)).select("doc", "page", "text_idx", "grid_x", "grid_y")


# ------------------------------------------------------------ overlays

def _sized(spark, d):
    return X.detections(spark, d).join(X.page_sizes(spark, d), ["doc", "page"])


def _projected(method: str) -> Query:
    def run(spark, d):
        return overlay.project_boxes(_sized(spark, d), method).select("doc", "page", "det_idx", *BOX).withColumns(rounded(*BOX))

    return run


QUERIES["projected_scaled"] = _projected("scale")
QUERIES["projected_rotated"] = _projected("rotate")
QUERIES["projected_rotated_scaled"] = _projected("rotate_scale")
QUERIES["projected_counterclockwise"] = _projected("counterclockwise")


@query
def projected_grid(spark, d):
    out = overlay.project_grid(_sized(spark, d), page=(2800, 2100), grid=(3, 2), first_column=1)
    return out.select("doc", "page", "det_idx", *BOX).withColumns(rounded(*BOX))


@query
def projected_grid_turned(spark, d):
    out = overlay.project_grid(
        _sized(spark, d), page=(2800, 2100), grid=(3, 2), first_column=1, turn=True, inside_only=False
    )
    return out.select("doc", "page", "det_idx", *BOX).withColumns(rounded(*BOX))


@query
def detection_labels(spark, d):
    drawn = overlay.detection_primitives(X.detections(spark, d), 0.3)
    return overlay.label_positions(drawn).select("doc", "page", "idx", "label", "band", "label_x", "label_y")


@query
def detection_labels_decimal(spark, d):
    return overlay.detection_primitives(X.detections(spark, d), 0.3, "decimal").select("doc", "page", "idx", "label", "band")


@query
def markers(spark, d):
    return overlay.marker_primitives(_sized(spark, d), 0.5)


@query
def text_boxes(spark, d):
    return overlay.text_primitives(X.ocr_texts(spark, d), 0.75, 5)


def _linked_sized(spark, d):
    return X.linked_texts(spark, d).join(X.page_sizes(spark, d), ["doc", "page"])


@query
def symbol_texts(spark, d):
    return overlay.symbol_text_boxes(_linked_sized(spark, d), 0.75).withColumns(rounded(*BOX))


@query
def layout_labels(spark, d):
    return overlay.layout_primitives(X.linked_texts(spark, d)).select("doc", "page", "kind", "idx", "label")


@query
def scaled_unlinked_texts(spark, d):
    return overlay.scaled_fallback(_linked_sized(spark, d)).select("doc", "page", "text_idx", *BOX)


@query
def text_connectors(spark, d):
    return overlay.connectors(X.linked_texts(spark, d)).select("doc", "page", "idx", *BOX)


@query
def page_legend(spark, d):
    return overlay.legend(X.detections(spark, d), fusion.fuse(X.texts(spark, d), X.ocr_texts(spark, d)), 0.8, 0.75)


@query
def overlay_counts(spark, d):
    """All primitives of the overlay, counted per page and kind."""
    out = pipelines.overlay_tables(X.detections(spark, d), X.ocr_texts(spark, d), X.page_sizes(spark, d))
    return out.primitives.groupBy("doc", "page", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("x1").alias("x1"), F.sum("y2").alias("y2")).withColumns(
        rounded("x1", "y2")
    )


# ------------------------------------------------------------ statistics, logs, catalogues

@query
def detection_statistics(spark, d):
    out = stats.detection_statistics(X.pages(spark, d), X.detections(spark, d))
    return out.withColumns(rounded("avg_confidence"))


@query
def page_counts(spark, d):
    return stats.page_counts(X.pages(spark, d), X.detections(spark, d))


@query
def class_counts(spark, d):
    return stats.class_counts(X.detections(spark, d))


@query
def globalised_statistics(spark, d):
    """Tiles to pages, then statistics with empty pages counted."""
    out = pipelines.globalise(tiles.tile_grid(X.pages(spark, d)), X.tile_detections(spark, d), renumber=False)
    return out.statistics.join(out.bounds.drop("detections"), "doc", "left").withColumns(rounded("avg_confidence"))


@query
def tile_result_summary(spark, d):
    return stats.tile_summary(X.tile_results(spark, d)).withColumns(rounded("average_detections"))


@query
def latest_tile_results(spark, d):
    return stats.latest_tile_results(X.tile_results(spark, d))


@query
def run_log_summary(spark, d):
    return stats.run_summary(X.run_log(spark, d)).withColumns(rounded("total_duration", "overall_progress"))


@query
def benchmark_comparison(spark, d):
    out = stats.compare_to_baseline(X.benchmark_runs(spark, d), "view")
    return out.drop("success").withColumns(rounded("speed", "baseline_speed", "speedup", "improvement_percent"))


@query
def benchmark_best(spark, d):
    return stats.best_configuration(X.benchmark_runs(spark, d)).drop("success").withColumns(rounded("speed"))


@query
def timing_breakdown(spark, d):
    """Event values as seconds; `purchase` plays the whole batch."""
    timings = X.table(spark, d, "events").select(F.col("event_type").alias("component"), F.col("value").alias("seconds"))
    return stats.timing_breakdown(timings, "purchase").withColumns(rounded("avg_ms", "percent"))


@query
def document_names(spark, d):
    return catalog.with_documents(X.detection_files(spark, d)).select("path", "name", "doc")


def _partners(spark, d):
    found = catalog.with_documents(X.detection_files(spark, d)).select("doc")
    names = X.table(spark, d, "customer")
    sources = names.filter("c_acctbal > 0").select(F.col("c_name").alias("doc"))
    texts = names.filter("c_mktsegment <> 'FURNITURE'").select(F.col("c_name").alias("doc"))
    return found, sources, texts


@query
def paired_documents(spark, d):
    return catalog.pair_documents(*_partners(spark, d))


@query
def documents_with_source(spark, d):
    found, sources, _ = _partners(spark, d)
    return catalog.paired(found, sources)


@query
def documents_without_texts(spark, d):
    found, _, texts = _partners(spark, d)
    return catalog.missing_texts(found, texts)


@query
def pairing_report(spark, d):
    return catalog.pairing_report(catalog.pair_documents(*_partners(spark, d))).withColumns(rounded("success_rate"))


def _archives(spark, d):
    """Orders as archives: date digits from the order date; some dates do not exist."""
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    digits = F.when(F.pmod(key, F.lit(10)) == 0, F.lit("20231399")).otherwise(day)
    ext = F.when(F.pmod(key, F.lit(4)) == 0, ".tar").otherwise(".zip")
    name = F.concat(F.lit("set_"), F.col("o_custkey").cast("string"), F.lit("_"), digits, F.lpad(F.pmod(key, F.lit(100)).cast("string"), 2, "0"), ext)
    return X.table(spark, d, "orders").select(
        name.alias("name"), F.concat(F.lit("/sets/"), key.cast("string"), F.lit("/"), name).alias("path"),
        F.floor("o_totalprice").cast("long").alias("length"), F.col("o_orderdate").alias("modified"),
        F.col("o_custkey").alias("owner"),
    )


@query
def dataset_catalog(spark, d):
    return catalog.dataset_catalog(_archives(spark, d)).withColumns(rounded("size_mb"))


@query
def latest_dataset(spark, d):
    return catalog.latest_dataset(catalog.dataset_catalog(_archives(spark, d)).select("date_version", "name", "date", "version"))


@query
def retained_datasets(spark, d):
    return catalog.retention(_archives(spark, d), 3, "owner").select("owner", "path", "action")


@query
def retained_overall(spark, d):
    return catalog.retention(_archives(spark, d).withColumn("name", F.col("path")), 1000).select("path", "age_rank", "action")


@query
def dataset_splits(spark, d):
    """Line items as files of datasets, one per supplier."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    split = F.when(line <= 4, "train").when(line <= 6, "valid").otherwise("test")
    kind = F.when(F.pmod(key, F.lit(3)) == 0, "labels").otherwise("images")
    files = X.table(spark, d, "lineitem").select(
        F.concat_ws("/", F.lit("/sets"), F.concat(F.lit("set"), F.col("l_suppkey").cast("string")), split, kind, key.cast("string")).alias("path")
    )
    return catalog.split_counts(files)


# ------------------------------------------------------------ documents

def _documents(spark, d, spelling="bbox_global"):
    return documents.detection_documents(X.pages(spark, d), X.detections(spark, d), spelling)


@query
def detection_documents(spark, d):
    """Written as nested documents and read back."""
    return documents.parse_detections(_documents(spark, d)).select(
        "doc", "page", "page_w", "page_h", "det_idx", "class_id", "class_name", "confidence", *BOX, "tx1", "ty1", "tile", "row", "col"
    )


@query
def converted_documents(spark, d):
    """One spelling converted to the other, then read."""
    out = documents.convert_documents(_documents(spark, d))
    return documents.parse_detections(out).select("doc", "page", "det_idx", "class_name", "confidence", *BOX, "tile")


@query
def document_pages(spark, d):
    return documents.parse_pages(_documents(spark, d))


@query
def structure_check(spark, d):
    """Even documents in one spelling, odd ones in the other."""
    even = F.pmod("doc", F.lit(2)) == 0
    mixed = _documents(spark, d).filter(even).unionByName(_documents(spark, d, "global_bbox").filter(~even))
    return documents.structure_report(mixed.select(F.col("doc").cast("string").alias("path"), "value"))


@query
def tile_manifests(spark, d):
    """Manifests, one per page, as JSON and read back."""
    grid = tiles.tile_grid(X.order_pages(spark, d))
    snippet = F.struct(F.col("tile").alias("filename"), "row", "col", "x1", "y1", "x2", "y2", "width", "height")
    nested = grid.groupBy("doc", "page", "page_w", "page_h", "rows", "cols").agg(F.array_sort(F.collect_list(snippet)).alias("snippets"))
    page = F.struct(
        F.col("page").alias("page_num"), F.col("page_w").alias("original_width"), F.col("page_h").alias("original_height"),
        "rows", "cols", "snippets",
    )
    docs = nested.select(
        F.to_json(F.struct(F.concat(F.col("doc").cast("string"), F.lit(".pdf")).alias("original_pdf"), F.array(page).alias("pages"))).alias("value")
    )
    return documents.parse_manifests(docs)


@query
def tile_result_documents(spark, d):
    """Tile results keyed by tile, as JSON and read back; failures keep their error."""
    det = X.tile_detections(spark, d)
    failed = F.col("confidence") < 0.25
    box = F.struct(*[F.col(f"b{c}").alias(c) for c in BOX])
    found = F.array(F.struct("class_id", "class_name", "confidence", box.alias("bbox")))
    entry = F.struct(
        F.concat(F.lit("/img/"), "tile").alias("image_path"),
        F.when(~failed, 1).cast("long").alias("detection_count"),
        F.when(failed, "no image").alias("error"),
        F.when(~failed, found).alias("detections"),
    )
    results = documents.parse_tile_results(det.select(F.to_json(F.create_map("tile", entry)).alias("value")))
    boxes = documents.flat_tile_detections(results).groupBy("tile").agg(F.count(F.lit(1)).alias("boxes"), F.sum("bx1").alias("bx1"))
    counted = results.groupBy("tile").agg(F.count("error").alias("errors"), F.sum("detection_count").alias("detections"))
    return counted.join(boxes, "tile", "left")


@query
def text_documents(spark, d):
    """Tagged texts written as nested documents and read back."""
    det = X.detections(spark, d)
    linked = spatial.with_symbol(X.ocr_texts(spark, d), det, ("class_name", "confidence", *BOX, "tile", "row", "col"))
    tagged = cut_lineage(fusion.tag(linked))  # read for sizes, rows, statistics and counts
    docs = documents.text_documents(tagged, fusion.extraction_statistics(tagged), fusion.pattern_counts(tagged))
    return documents.parse_texts(docs).select(
        "doc", "page", "text_idx", "text", "confidence", *BOX, F.array_join("patterns.pattern", ",").alias("patterns"),
        "relevance", "sym_idx", "sym_class_name", "sym_x1", "sym_tile", "row", "col",
    )


@query
def coordinate_report(spark, d):
    report = documents.coordinate_report(X.pages(spark, d), X.detections(spark, d))
    return report.select("doc", "page", "ord", "line")


@query
def detection_numbers(spark, d):
    return ranking.numbered(X.detections(spark, d), ["doc", "page"], [F.col("det_idx")], "number").select("doc", "page", "det_idx", "number")


@query
def streamed_detections(spark, d):
    """Documents written as files, ingested by a stream, and read from the table."""
    return ingest.replay(spark, _documents(spark, d)).groupBy("doc", "page").agg(
        F.count(F.lit(1)).alias("detections"), F.sum("x1").alias("x1"), F.max("det_idx").alias("last")
    )


@query
def streamed_reload(spark, d):
    """Even documents come a second time with their first two pages only, by force."""
    even = X.detections(spark, d).filter((F.pmod("doc", F.lit(2)) == 0) & (F.col("page") <= 2))
    again = documents.detection_documents(X.pages(spark, d).filter(F.pmod("doc", F.lit(2)) == 0), even)
    return ingest.replay(spark, _documents(spark, d), again=again, force=True).groupBy("doc", "page").agg(
        F.count(F.lit(1)).alias("detections"), F.sum("x1").alias("x1")
    )


@query
def streamed_skip(spark, d):
    """Documents that come again are skipped; their second form has no detections."""
    again = documents.detection_documents(X.pages(spark, d), X.detections(spark, d).filter(F.lit(False)))
    return ingest.replay(spark, _documents(spark, d), again=again).groupBy("doc", "page").agg(
        F.count(F.lit(1)).alias("detections"), F.sum("x1").alias("x1")
    )


@query
def streamed_tile_results(spark, d):
    """Two results for each tile; the one of the larger ordinal is the last."""
    det = X.detections(spark, d).groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    turn = F.explode(F.array(F.lit(2), F.lit(1))).alias("turn")
    results = det.select("tile", turn, "n").withColumn("detection_count", F.col("n") * F.col("turn")).drop("n")
    return ingest.replay_tile_results(spark, results, "turn").select("tile", "detection_count")


# ------------------------------------------------------------ callers' own parts, tables

@query
def own_patterns(spark, d):
    """Texts tagged by patterns of the caller."""
    mine = [TextPattern("motor", r"Motor_\d", 4, "Motors"), TextPattern("even", r"[02468]$", 1, "Even endings")]
    out = fusion.tag(X.texts(spark, d), mine)
    return out.select("doc", "page", "text_idx", F.array_join("patterns.pattern", ",").alias("patterns"))


@query
def own_area_types(spark, d):
    rows = areas.regions(X.linked_texts(spark, d), {"Tag-ID": "tag", "resistor": "part"})
    return rows.select("document", "page", "text_idx", "area_type")


@query
def area_tables(spark, d):
    """Clustered and grid areas in one call, counted by page."""
    out = pipelines.area_tables(X.texts(spark, d), X.detections(spark, d))
    members = out.members.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("members"))
    grid = out.grid.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("cells"), F.sum("text_count").alias("texts"))
    return members.join(grid, ["doc", "page"])


@query
def scored_with_failures(spark, d):
    """A detector that fails gives one error row per tile."""

    def fail(batch: pd.DataFrame):
        raise ValueError("no model")

    grid = tiles.tile_grid(X.order_pages(spark, d)).withColumn("image_path", F.concat(F.lit("/img/"), "tile"))
    return scoring.score_tiles(grid.select("tile", "image_path"), fail).select("tile", "detection_count", "error")


@query
def recognised_in_one_call(spark, d):
    """Regions cut, read, accepted and placed on the page by one composition."""
    out = pipelines.recognise(X.detections(spark, d), _rendered(spark, d), _reader(), 0.5)
    return out.select("doc", "page", "text_idx", "text", "sym_idx", *BOX).withColumns(rounded(*BOX))


@query
def table_round_trip(spark, d):
    """Detections written as a bucketed table and read back."""
    path = scratch_path(spark, "table")
    tables.write_table(X.detections(spark, d), path, buckets=16)
    return tables.read_table(spark, path, buckets=16).select("doc", "page", "det_idx", "class_name", *BOX)
